"""Operator 5: quality rules by robust multivariate outliers.

Each text gives a vector of transformed statistics. For every (language, source), location and scatter are
estimated by minimum covariance determinant: concentration steps that keep the three quarters of the rows
with the smallest Mahalanobis distances and estimate again from them. Rows far from their group's robust
centre are rejected. Everything is DataFrame aggregation and expressions:

* vectors are rounded to 1/1024, so their moments are exact integer sums: reruns agree to the bit;
* medians and quantiles are of such integers, so an aggregation buffer has a bounded number of entries;
* the Cholesky factor of a group's scatter is a chain of column expressions on a table of one row a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framegrain.llm.common import written
from framegrain.llm.textstats import STATS, with_stats

UNIT = 1024
#: Least standard deviation of each coordinate: differences below it are not evidence.
FLOORS = {"length": 0.1, "symbols": 0.25, "upper": 0.08, "repeats": 0.15, "lines": 0.2}
AXES = list(FLOORS)
P = len(AXES)
#: Share of a group that a concentration step keeps, and what makes the scatter of that share consistent at the normal distribution (five coordinates).
HALF = 0.75
CONSISTENCY = 1.41
STEPS = 3
#: Squared distance beyond which a row is an outlier; the chi-square distribution with five degrees of freedom exceeds it once in a million.
CUTOFF = 36.0
#: Groups (about 200 bytes of parameters each) up to which their tables are broadcast.
BROADCAST_GROUPS = 20_000


def _vector() -> dict[str, Column]:
    n, chars = F.col("n_words"), F.col("word_chars")
    share = lambda a, b: F.when(b > 0, F.least(F.lit(1.0), a / b)).otherwise(F.lit(0.0))
    return {
        "length": F.ln(F.when(n > 0, chars / n).otherwise(F.lit(1.0))),
        "symbols": F.ln(1 + 100 * F.when(n > 0, F.col("n_symbols") / n).otherwise(F.lit(0.0))),
        "upper": F.asin(F.sqrt(share(F.col("n_upper"), chars))),
        "repeats": F.asin(F.sqrt(share(F.col("n_repeat_words"), n))),
        "lines": F.asin(F.sqrt(share(F.col("n_dup_lines"), F.col("n_lines")))),
    }


def _x(a: str) -> Column:
    return F.col(f"x_{a}") / float(UNIT)


def _grade(d2: Column) -> Column:
    """Squared distance on a logarithmic scale of whole numbers, so that quantiles have few distinct values."""
    return F.floor(F.lit(64.0) * F.ln(1 + d2)).cast("long")


def _diagonal(params: DataFrame) -> DataFrame:
    """Medians and median deviations as a diagonal factor."""
    cols = [(F.col(f"med_{a}") / UNIT).alias(f"m_{a}") for a in AXES]
    for i, a in enumerate(AXES):
        cols += [(F.greatest(F.lit(FLOORS[a]), 1.4826 * F.col(f"mad_{a}") / UNIT) if i == j else F.lit(0.0)).alias(f"l_{i}_{j}") for j in range(i + 1)]
    return params.select("g", *cols)


def _cholesky(sums: DataFrame) -> DataFrame:
    """(g, mean, lower factor) from a group's integer sums; the floors are added to the diagonal."""
    n = F.col("n").cast("double")
    out = sums.select("*", *[(F.col(f"s_{a}") / n / UNIT).alias(f"m_{a}") for a in AXES])
    for i, a in enumerate(AXES):
        for j, b in enumerate(AXES[: i + 1]):
            v = CONSISTENCY * (F.col(f"s_{b}_{a}") / n / (UNIT * UNIT) - F.col(f"m_{a}") * F.col(f"m_{b}"))
            for k in range(j):
                v = v - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            v = F.sqrt(F.greatest(v + FLOORS[a] ** 2, F.lit(FLOORS[a] ** 2))) if i == j else v / F.col(f"l_{j}_{j}")
            out = out.withColumn(f"l_{i}_{j}", v)
    return out.select("g", *[f"m_{a}" for a in AXES], *[f"l_{i}_{j}" for i in range(P) for j in range(i + 1)])


def _small(table: DataFrame, groups: int) -> DataFrame:
    """A table of one row a group, to be broadcast while there are few: rows then stay where they are and
    aggregate before they are shuffled. Beyond that Spark decides."""
    return F.broadcast(table) if groups <= BROADCAST_GROUPS else table


def _measured(rows: DataFrame, params: DataFrame, groups: int) -> DataFrame:
    """rows with d2, the squared Mahalanobis distance under their group's parameters (forward substitution)."""
    names = [c for c in params.columns if c != "g"]
    out = rows.join(_small(params, groups), "g", "left")
    for i, a in enumerate(AXES):
        z = _x(a) - F.col(f"m_{a}")
        for j in range(i):
            z = z - F.col(f"l_{i}_{j}") * F.col(f"z_{j}")
        out = out.withColumn(f"z_{i}", z / F.col(f"l_{i}_{i}"))
    d2 = sum((F.col(f"z_{i}") * F.col(f"z_{i}") for i in range(P)), F.lit(0.0))
    return out.withColumn("d2", d2).drop(*names, *[f"z_{i}" for i in range(P)])


def robust_parameters(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """Robust centre and scatter of each group g over the integer coordinates x_*: one row a group."""
    med = written(rows.groupBy("g").agg(*[F.percentile(f"x_{a}", 0.5).alias(f"med_{a}") for a in AXES]), "mcd-med")
    groups = med.count()
    mads = rows.join(_small(med, groups), "g").groupBy("g").agg(*[F.first(f"med_{a}").alias(f"med_{a}") for a in AXES], *[F.percentile(F.abs(F.col(f"x_{a}") - F.col(f"med_{a}")), 0.5).alias(f"mad_{a}") for a in AXES])
    params = written(_diagonal(mads), "mcd-0")
    for k in range(1, steps + 1):
        graded = _measured(rows, params, groups).withColumn("grade", _grade(F.col("d2")))
        most = graded.groupBy("g").agg(F.percentile("grade", HALF).alias("most"))
        core = graded.join(_small(most, groups), "g").filter(F.col("grade") <= F.col("most"))
        pairs = [(a, b) for i, b in enumerate(AXES) for a in AXES[: i + 1]]
        sums = core.groupBy("g").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"x_{a}").alias(f"s_{a}") for a in AXES], *[F.sum(F.col(f"x_{a}") * F.col(f"x_{b}")).alias(f"s_{a}_{b}") for a, b in pairs])
        params = written(_cholesky(sums), f"mcd-{k}")
    return params


def quality_rules(df: DataFrame, keep: tuple[str, ...] = (), cutoff: float = CUTOFF, id_col="doc_id", text_col="text", lang_col="lang", source_col="source") -> DataFrame:
    """One row for each input row: doc_id, the statistics, base_failed, distance, kept and the columns in `keep`.

    Null and empty texts have no words and fail the base rules. Null languages and sources are groups of
    their own. Repeated rows are judged alike. A group is estimated from its own rows that pass the base rules,
    however few they are: the floors keep the scatter of one or two rows regular, and those rows lie at their
    group's centre. An empty input gives an empty result.
    """
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    columns = [F.col(id_col).alias("doc_id"), part(lang_col).alias("_lang"), part(source_col).alias("_source"), *[F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)]]
    rows = with_stats(df, text_col, columns)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed).withColumns({f"x_{a}": F.rint(v * UNIT).cast("long") for a, v in _vector().items()})
    rows = written(rows, "quality")
    rows = rows.withColumn("g", F.concat_ws("\x1f", "_lang", "_source"))
    params = robust_parameters(rows.filter(~F.col("base_failed")).select("g", *[f"x_{a}" for a in AXES]))
    out = _measured(rows, params, params.count())
    return out.select(
        "doc_id", *STATS, "base_failed", F.col("d2").alias("distance"), (~F.col("base_failed") & F.coalesce(F.col("d2") <= cutoff, F.lit(True))).alias("kept"),
        *[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)],
    )


def op5_quality_rules(spark, sf_dir):
    out = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    """The whole query as DuckDB SQL: the statistics, then the same concentration steps as common table expressions."""
    real = lambda v: f"{float(v)!r}e0"
    blanks = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    share = lambda a, b: f"CASE WHEN {b} > 0 THEN least(1.0e0, {a} / {b}) ELSE 0.0e0 END"
    vector = {
        "length": "ln(CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 1.0e0 END)",
        "symbols": "ln(1 + 100 * CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0.0e0 END)",
        "upper": f"asin(sqrt({share('n_upper', 'word_chars')}))",
        "repeats": f"asin(sqrt({share('n_repeat_words', 'n_words')}))",
        "lines": f"asin(sqrt({share('n_dup_lines', 'n_lines')}))",
    }
    names = [f"m_{a}" for a in AXES] + [f"l_{i}_{j}" for i in range(P) for j in range(i + 1)]

    def measured(name: str, rows: str, params: str) -> str:
        """rows with d2 under params, one coordinate a level."""
        out = f"SELECT r.*, {', '.join(names)} FROM {rows} r LEFT JOIN {params} USING (g)"
        for i, a in enumerate(AXES):
            z = f"x_{a} / {real(UNIT)} - m_{a}" + "".join(f" - l_{i}_{j} * z_{j}" for j in range(i))
            out = f"SELECT *, ({z}) / l_{i}_{i} AS z_{i} FROM ({out})"
        return f"{name} AS MATERIALIZED (SELECT *, 0.0e0" + "".join(f" + z_{i} * z_{i}" for i in range(P)) + f" AS d2 FROM ({out}))"

    plain = "rid, doc_id, g, " + ", ".join([*(f"x_{a}" for a in AXES)])
    ctes = [
        "d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce('=' || lang, '-') AS lang, coalesce('=' || source, '-') AS source FROM documents)",
        "w AS MATERIALIZED (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d)",
        "p AS (SELECT rid, unnest(range(1, len(ws) - 3)) AS i, unnest([ws[k:k + 4] for k in range(1, len(ws) - 3)]) AS v FROM w)",
        "q AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, v) AS c FROM p) WHERE c > 1)",
        "u AS (SELECT rid, sum(least(5, gap))::BIGINT AS n_repeat_words FROM (SELECT rid, i - coalesce(lag(i) OVER (PARTITION BY rid ORDER BY i), -9) AS gap FROM q) GROUP BY rid)",
        f"""s AS MATERIALIZED (SELECT rid, doc_id, lang, source, len(ws)::BIGINT AS n_words, length(translate(t, {blanks}, ''))::BIGINT AS word_chars, (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
          (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')))::BIGINT AS n_upper, len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN u USING (rid))""",
        "b AS MATERIALIZED (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, " + ", ".join(f"round_even({v} * {UNIT}, 0)::BIGINT AS x_{a}" for a, v in vector.items()) + " FROM s)",
        "h AS MATERIALIZED (SELECT *, lang || chr(31) || source AS g FROM b)",
        f"f AS MATERIALIZED (SELECT {plain} FROM h WHERE NOT base_failed)",
        "e AS MATERIALIZED (SELECT g, " + ", ".join(f"quantile_cont(x_{a}, 0.5) AS med_{a}" for a in AXES) + " FROM f GROUP BY g)",
        "a AS (SELECT g, " + ", ".join(f"any_value(med_{a}) AS med_{a}, quantile_cont(abs(x_{a} - med_{a}), 0.5) AS mad_{a}" for a in AXES) + " FROM f JOIN e USING (g) GROUP BY g)",
        "c0 AS MATERIALIZED (SELECT g, " + ", ".join(f"med_{a} / {real(UNIT)} AS m_{a}" for a in AXES) + ", "
        + ", ".join(f"greatest({real(FLOORS[a])}, 1.4826e0 * mad_{a} / {real(UNIT)}) AS l_{i}_{j}" if i == j else f"0.0e0 AS l_{i}_{j}" for i, a in enumerate(AXES) for j in range(i + 1)) + " FROM a)",
    ]
    for step in range(1, STEPS + 1):
        ctes.append(measured(f"d{step}", "f", f"c{step - 1}"))
        ctes.append(f"g{step} AS MATERIALIZED (SELECT {plain}, floor(64.0e0 * ln(1 + d2)) AS grade FROM d{step})")
        ctes.append(f"h{step} AS (SELECT g, quantile_cont(grade, {HALF}) AS most FROM g{step} GROUP BY g)")
        sums = ", ".join([f"sum(x_{a})::DOUBLE AS s_{a}" for a in AXES] + [f"sum(x_{b} * x_{a})::DOUBLE AS s_{b}_{a}" for i, a in enumerate(AXES) for b in AXES[: i + 1]])
        body = f"SELECT g, count(*)::DOUBLE AS n, {sums} FROM g{step} JOIN h{step} USING (g) WHERE grade <= most GROUP BY g"
        body = "SELECT *, " + ", ".join(f"s_{a} / n / {real(UNIT)} AS m_{a}" for a in AXES) + f" FROM ({body})"
        for i, a in enumerate(AXES):
            for j, b in enumerate(AXES[: i + 1]):
                v = f"{real(CONSISTENCY)} * (s_{b}_{a} / n / {real(UNIT * UNIT)} - m_{a} * m_{b})" + "".join(f" - l_{i}_{k} * l_{j}_{k}" for k in range(j))
                least = real(FLOORS[a] ** 2)
                body = f"SELECT *, {f'sqrt(greatest({v} + {least}, {least}))' if i == j else f'({v}) / l_{j}_{j}'} AS l_{i}_{j} FROM ({body})"
        ctes.append(f"c{step} AS MATERIALIZED (SELECT g, {', '.join(names)} FROM ({body}))")
    ctes.append(measured("z", "h", f"c{STEPS}"))
    return "WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(d2 <= {real(CUTOFF)}, true) AS kept FROM z"


OP5_SQL = _sql()
