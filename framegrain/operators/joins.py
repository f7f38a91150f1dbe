"""Joins of frames, labels, paths and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lookup(df: DataFrame, table: DataFrame, key: str, default: dict | None = None) -> DataFrame:
    """Left equi-join to a dimension; missing values take the defaults. Spark broadcasts it if its size allows."""
    out = df.join(table, key, "left")
    return out.fillna(default) if default else out


def ancestors(path: Column, separator: str = "/") -> Column:
    """All prefixes of a path that end at a separator or at its end, with their depths."""
    parts = F.split(path, separator)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), separator).alias("prefix")))


def longest_prefix_join(df: DataFrame, prefixes: DataFrame, path: str, prefix: str, value: str) -> DataFrame:
    """Adds `value` of the deepest ancestor of `path` in `prefixes`, and its depth; an equi-join on ancestors."""
    rows = df.withColumn("_a", F.explode(ancestors(F.col(path)))).select(*df.columns, F.col("_a.depth").alias("_depth"), F.col("_a.prefix").alias(prefix))
    met = rows.join(prefixes.select(prefix, value), prefix)
    best = met.groupBy(path).agg(F.max_by(value, "_depth").alias(value), F.max("_depth").alias("depth"))
    return df.join(best, path, "left")


#: Rules that a pattern join takes at most: they are broadcast and each distinct text is compared with all.
MOST_PATTERNS = 10_000


def single_pattern_join(df: DataFrame, patterns: DataFrame, text: str, pattern: str, value: str, fallback: str) -> DataFrame:
    """Adds `value` of the one pattern that `text` contains, whatever the case; the fallback if none or several.

    patterns is a short list of rules (more than MOST_PATTERNS fail); texts are matched once for each distinct text.
    """
    if patterns.limit(MOST_PATTERNS + 1).count() > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} patterns")
    names = df.select(text).distinct()
    met = names.join(F.broadcast(patterns), F.contains(F.lower(F.col(text)), F.lower(F.col(pattern))), "left")
    found = met.groupBy(text).agg(F.count(pattern).alias("matches"), F.first(value, ignorenulls=True).alias("_v"))
    found = found.select(text, "matches", F.when(F.col("matches") == 1, F.col("_v")).otherwise(F.lit(fallback)).alias(value))
    return df.join(found, text, "left")


def missing(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return df.join(done, key, "left_anti")


def difference_buckets(left: DataFrame, middle: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, bucket) over three sets of keys: which of them have it, as letters l, m, r."""
    tagged = lambda d, c: d.select(key, F.lit(c).alias("_c")).distinct()
    everything = tagged(left, "l").unionByName(tagged(middle, "m")).unionByName(tagged(right, "r"))
    return everything.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("_c")), "").alias("bucket"))


def interval_labels(frames: DataFrame, labels: DataFrame, episode: str, position: str, bucket: int = 64) -> DataFrame:
    """Labels (episode, start_pos, end_pos, ordinal, label), both ends in, onto frames.

    Adds label and progress of the label with the highest ordinal, and whether any label starts or ends
    here. Ranges are cut into buckets of positions and equi-joined, so a range meets its own frames only.
    """
    cut = labels.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start_pos") / bucket), F.floor(F.col("end_pos") / bucket))))
    rows = frames.withColumn("_b", F.floor(F.col(position) / bucket))
    met = rows.join(cut, [episode, "_b"]).filter((F.col(position) >= F.col("start_pos")) & (F.col(position) <= F.col("end_pos")))
    progress = (F.col(position) - F.col("start_pos")) / F.greatest(F.col("end_pos") - F.col("start_pos"), F.lit(1))
    best = met.groupBy(episode, position).agg(
        F.max_by("label", "ordinal").alias("label"), F.max_by(progress, F.col("ordinal")).alias("progress"),
        F.bool_or(F.col(position) == F.col("start_pos")).alias("is_start"), F.bool_or(F.col(position) == F.col("end_pos")).alias("is_end"),
    )
    return frames.join(best, [episode, position], "left").fillna({"is_start": False, "is_end": False})


def nearest_asof(queries: DataFrame, frames: DataFrame, episode: str, at: str, time: str, value: str, tolerance: float) -> DataFrame:
    """For each query the frame of the episode that is nearest in time; on a tie the earlier.

    Both sides are merged by (episode, time), in either direction: the nearest frame is the last one met from
    the start or from the end. Adds `{value}`, distance and is_pad (distance beyond the tolerance).
    """
    names = [c for c in queries.columns if c not in (episode, at)]
    left = queries.select(episode, F.col(at).alias("_t"), F.struct(*names).alias("_q"), F.lit(None).cast(frames.schema[time].dataType).alias("_ft"), F.lit(None).cast(frames.schema[value].dataType).alias("_fv"), F.lit(1).alias("_side"))
    right = frames.select(episode, F.col(time).alias("_t"), F.lit(None).cast(left.schema["_q"].dataType).alias("_q"), F.col(time).alias("_ft"), F.col(value).alias("_fv"), F.lit(0).alias("_side"))
    both = left.unionByName(right)
    frame = F.when(F.col("_side") == 0, F.struct(F.col("_ft").alias("t"), F.col("_fv").alias("v")))
    w = Window.partitionBy(episode).orderBy("_t", "_side")
    back = Window.partitionBy(episode).orderBy(F.desc("_t"), F.desc("_side"))
    met = lambda way: F.last(frame, ignorenulls=True).over(way.rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumn("_p", met(w)).withColumn("_n", met(back))
    before, after = F.col("_t") - F.col("_p.t"), F.col("_n.t") - F.col("_t")
    earlier = F.col("_n").isNull() | (before <= after)
    out = both.filter("_side = 1").select(
        episode, F.col("_t").alias(at), "_q.*", F.when(earlier, F.col("_p.v")).otherwise(F.col("_n.v")).alias(value), F.when(earlier, before).otherwise(after).alias("distance")
    )
    return out.withColumn("is_pad", F.col("distance") > tolerance)


def partners(episodes: DataFrame, index: str, rows: str) -> DataFrame:
    """Pairs each dense episode index with (index + max(1, n // 2)) mod n, or the next one if that is itself."""
    n = episodes.agg(F.count(F.lit(1)).alias("_n"))
    other = F.col("_n") / 2
    mine = episodes.crossJoin(F.broadcast(n))
    far = (F.col(index) + F.greatest(F.lit(1), F.floor(other))) % F.col("_n")
    mine = mine.withColumn("partner", F.when(far == F.col(index), (F.col(index) + 1) % F.col("_n")).otherwise(far).cast("long")).drop("_n")
    return mine.join(episodes.select(F.col(index).alias("partner"), F.col(rows).alias("partner_rows")), "partner")


def compare_runs(long: DataFrame, metric: str, run: str, value: str, runs: list[str]) -> DataFrame:
    """One row for each metric that all runs have, a column for each run."""
    return long.groupBy(metric).pivot(run, runs).agg(F.first(value)).dropna(subset=runs)


def overlay(df: DataFrame, other: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Fills what is null in `columns` from `other`."""
    theirs = other.select(key, *[F.col(c).alias(f"_o_{c}") for c in columns])
    return df.join(theirs, key, "left").withColumns({c: F.coalesce(c, f"_o_{c}") for c in columns}).drop(*[f"_o_{c}" for c in columns])


def in_request_order(df: DataFrame, wanted: list, key: str) -> DataFrame:
    """Rows for the requested keys with their position; a key that is missing fails the job."""
    spark = df.sparkSession
    asked = spark.createDataFrame([(i, k) for i, k in enumerate(wanted)], f"position int, {key} {df.schema[key].dataType.simpleString()}")
    out = asked.join(df.withColumn("_found", F.lit(True)), key, "left")
    return out.withColumn("_ok", F.when(F.col("_found").isNull(), F.raise_error(F.concat(F.lit("not found: "), F.col(key).cast("string"))).cast("boolean")).otherwise(True)).filter("_ok").drop("_found", "_ok")


def paired(left: DataFrame, right: DataFrame, key: str, rows: str) -> DataFrame:
    """Full outer pairing of two encodings of one source: (key, left_rows, right_rows, issue)."""
    a, b = left.select(key, F.col(rows).alias("left_rows")), right.select(key, F.col(rows).alias("right_rows"))
    issue = F.when(F.col("right_rows").isNull(), "only left").when(F.col("left_rows").isNull(), "only right").when(F.col("left_rows") != F.col("right_rows"), "row counts differ")
    return a.join(b, key, "full_outer").withColumn("issue", issue)


def with_coverage(manifest: DataFrame, moves: DataFrame, catalog: DataFrame, listing: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """(inventory, errors) of a manifest (path, schema_id, file_bytes) after its moves (source, destination), with a
    catalogue (schema_id, family) and the listing (path, length) of what is there below `root`.

    Errors by code, the first that applies: no covering move, destination outside the root, second file for a
    destination (all but the smallest old path), schema missing from the catalogue. Files that are missing, or of
    another size than expected, are errors too but stay in the inventory, as what was expected. The deepest source
    above a path is its move, so a path always lies beneath its move's source.
    """
    names = moves.select("source", F.struct("source", "destination").alias("_move"))
    rows = longest_prefix_join(manifest, names, "path", "source", "_move").drop("depth")
    rest = F.substring("path", F.length("_move.source") + 1, F.length("path"))
    rows = rows.withColumn("new_path", F.concat(F.col("_move.destination"), rest))
    outside = ~(F.col("new_path").startswith(root.rstrip("/") + "/")) | F.col("new_path").contains("/../")
    fits = F.col("new_path").isNotNull() & ~outside
    first = rows.filter(fits).groupBy("new_path").agg(F.min("path").alias("_first"))
    known = catalog.select("schema_id", "family", F.lit(True).alias("_known"))
    there = listing.select(F.col("path").alias("new_path"), F.col("length").alias("actual_bytes"))
    rows = rows.join(first, "new_path", "left").join(known, "schema_id", "left").join(there, "new_path", "left")
    code = (
        F.when(F.col("_move").isNull(), "missing_covering_move").when(outside, "destination_outside_input").when(F.col("path") != F.col("_first"), "duplicate_destination_path")
        .when(F.col("_known").isNull(), "schema_missing_from_catalog").when(F.col("actual_bytes").isNull(), "missing_file").when(F.col("actual_bytes") != F.col("file_bytes"), "file_size_mismatch")
    )
    rows = rows.withColumn("error", code).drop("_move", "_first", "_known")
    stays = F.col("error").isNull() | F.col("error").isin("missing_file", "file_size_mismatch")
    return rows.filter(stays).withColumn("actual_exists", F.col("actual_bytes").isNotNull()).drop("error"), rows.filter("error is not null").select("path", "new_path", "error")


def latest_with_alias(log: DataFrame, aliases: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The latest logged value of each key, else the first alias that names it."""
    latest = log.groupBy(key).agg(F.max_by(value, order).alias(value))
    first = aliases.groupBy(key).agg(F.min_by("alias", "position").alias("_alias"))
    return latest.join(first, key, "full_outer").withColumn(value, F.coalesce(value, "_alias")).drop("_alias")


def by_normal_path(left: DataFrame, right: DataFrame, path: str) -> DataFrame:
    """Inner join on paths without scheme, doubled separators and trailing separator, whatever the case."""
    normal = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(path), "^[a-zA-Z][a-zA-Z0-9+.-]*://", ""), "/+", "/"), "/$", ""))
    return left.withColumn("_k", normal).drop(path).join(right.withColumn("_k", normal), "_k").drop("_k")


def transitions_with_reward(df: DataFrame, episode: str, order: list[str], state: str) -> DataFrame:
    """Demonstration transitions: next state within the episode, reward 1 on its last frame, never truncated."""
    from framegrain.operators.frames import next_states

    return next_states(df, [state], episode, order, sparse_reward=True)


def capped_transitions(df: DataFrame, episode: str, order: list[str], state: str, key: str, capacity: int, seed: int) -> DataFrame:
    """`transitions_with_reward`, of which `capacity` are kept at random where there are more.

    Which ones is settled on the keys alone, by range of their hash, so no task and no driver holds the kept rows.
    """
    from framegrain.operators.ranges import running
    from framegrain.operators.sampling import shuffled

    rows = transitions_with_reward(df, episode, order, state)
    if rows.count() <= capacity:
        return rows
    kept = running(df.select(key, shuffled(seed, key).alias("_h")), ["_h", key]).filter(F.col("number") < capacity).select(key)
    return rows.join(kept, key, "left_semi").select(*rows.columns)
