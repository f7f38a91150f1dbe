"""Finding, identifying, freezing and finishing datasets: listings, boards, manifests, metadata, transactions.

Listings are tables of (path, length); what lists them is passed in, so any store or test can.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framegrain.operators.ranges import running

# --- listings and sources ----------------------------------------------------------------------------------


def listed(spark: SparkSession, roots: Iterable[str], lister: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """(root, path, length) of all roots by the lister that is passed in."""
    parts = [lister(spark, r).select(F.lit(r).alias("root"), "path", "length") for r in roots]
    return reduce(DataFrame.unionByName, parts)


def _once(df: DataFrame, key: str, what: str) -> DataFrame:
    """df; a key that occurs twice fails the job."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    checked = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit(f"{what}: "), F.col(key).cast("string"))).cast("boolean")).otherwise(True)
    return df.join(counts.withColumn("_ok", checked), key).filter("_ok").select(*df.columns)


def episode_of(path: Column) -> Column:
    """The episode's folder above a file: the one above `data` where the file lies in such a folder."""
    parts = F.split(path, "/")
    back = F.when(F.get(parts, F.size(parts) - 2) == "data", 3).otherwise(2)
    return F.get(parts, F.size(parts) - back)


def sources(files: DataFrame, collection: Column, excluded: DataFrame | None = None) -> DataFrame:
    """(collection, episode_id, source_id, path, length) of listed files without those whose episode or source id is excluded.

    excluded: (id). A source id that two files have fails the job.
    """
    rows = files.select(collection.alias("collection"), episode_of(F.col("path")).alias("episode_id"), "path", "length")
    rows = rows.withColumn("source_id", F.concat_ws("/", "collection", "episode_id"))
    for key in ("episode_id", "source_id") if excluded is not None else ():
        rows = rows.join(excluded.select(F.col("id").alias(key)).distinct(), key, "left_anti")
    return _once(rows.select("collection", "episode_id", "source_id", "path", "length"), "source_id", "two files for a source")


def task_groups(files: DataFrame, depth: int, error: str = "error") -> DataFrame:
    """(task, files, bytes, corrupt): files by the folder `depth` levels above them; those with a read error are set aside as a number."""
    parts = F.split("path", "/")
    good = F.col(error).isNull()
    return files.withColumn("task", F.get(parts, F.size(parts) - 1 - depth)).groupBy("task").agg(
        F.sum(good.cast("long")).alias("files"), F.coalesce(F.sum(F.when(good, F.col("length"))), F.lit(0)).alias("bytes"), F.sum((~good).cast("long")).alias("corrupt")
    )


def located_columns(cells: DataFrame, line: str, row: str, wanted: dict[str, str]) -> DataFrame:
    """Records of a board, a table of (line, array of cells): the first line that has all wanted titles is its header.

    wanted: {column: title}, compared trimmed and whatever the case. Lines after the header whose wanted cells are all empty are left out.
    """
    plain = lambda c: F.lower(F.trim(c))
    titles = {k: t.strip().lower() for k, t in wanted.items()}
    names = F.transform(F.col(row), plain)
    has = reduce(lambda a, b: a & b, [F.array_contains(names, t) for t in titles.values()])
    head = cells.filter(has).agg(F.min_by(F.struct(F.col(line).alias("at"), names.alias("names")), line).alias("h")).select("h.*")
    rows = cells.crossJoin(F.broadcast(head)).filter(F.col(line) > F.col("at"))  # one row
    out = rows.select(line, *[F.nullif(F.trim(F.get(row, F.array_position("names", t).cast("int") - 1)), F.lit("")).alias(k) for k, t in titles.items()])
    return out.filter(F.coalesce(*titles).isNotNull())


def robot_layout(fields: Column) -> Column:
    """`dual` where both arms have fields, `left` or `right` where one has, else `single`."""
    has = lambda side: F.exists(fields, lambda f: F.array_contains(F.split(F.lower(f), "[/_.]"), side))
    return F.when(has("left") & has("right"), "dual").when(has("left"), "left").when(has("right"), "right").otherwise("single")


def succeeded(resolved: Column, path: Column, files: Column, marker: Column) -> Column:
    """Whether a download is done: its place is known, and it has files or the marker of completeness."""
    return F.coalesce(resolved, F.lit(False)) & (F.length(F.coalesce(path, F.lit(""))) > 0) & ((F.coalesce(files, F.lit(0)) >= 1) | F.coalesce(marker, F.lit(False)))


def in_splits(path: Column, roots: dict[str, str], fallback: str | None = None) -> Column:
    """The split whose root lies above a path; another path gets the fallback, or fails where that is None."""
    out = None
    for name, root in roots.items():
        out = (F if out is None else out).when(path.startswith(root.rstrip("/") + "/"), F.lit(name))
    return out.otherwise(F.lit(fallback) if fallback is not None else F.raise_error(F.concat(F.lit("in no split: "), path)).cast("string"))


def paired_ids(records: DataFrame, ordinal: str, source_paths: DataFrame, key: str) -> DataFrame:
    """records with source_path (their own, else the one at their ordinal of the dataset's list) and paired_id.

    source_paths: (key, sources: array). paired_id is collection/episode; one that two records have fails the job, and so does a
    record without any.
    """
    listed_ = source_paths.select(key, F.posexplode("sources").alias(ordinal, "_listed"))
    rows = records.join(listed_, [key, ordinal], "left").withColumn("source_path", F.coalesce(F.nullif("source_path", F.lit("")), "_listed")).drop("_listed")
    name = F.when(F.col("source_path").isNull(), F.raise_error(F.lit("a record has no source")).cast("string")).otherwise(F.concat_ws("/", "collection", episode_of(F.col("source_path"))))
    return _once(rows.withColumn("paired_id", name), "paired_id", "two records for a source")


# --- versions ----------------------------------------------------------------------------------------------


def version_of(name: Column) -> Column:
    """array(major, minor, patch) of `v1.2` or `1.2.3`; null for other names."""
    parts = F.transform(F.split(F.regexp_replace(name, "^v", ""), "\\."), lambda x: x.cast("int"))
    return F.when(name.rlike("^v?[0-9]+(\\.[0-9]+){1,2}$"), F.slice(F.concat(parts, F.array(F.lit(0))), 1, 3))


def compatible_version(df: DataFrame, keys: list[str], name: str, wanted: str) -> DataFrame:
    """(keys, version): the newest version of the wanted one's major number that is not newer than it."""
    top = version_of(F.lit(wanted))
    rows = df.withColumn("_v", version_of(F.col(name))).filter(F.col("_v").isNotNull() & (F.get("_v", F.lit(0)) == F.get(top, F.lit(0))) & (F.col("_v") <= top))
    return rows.groupBy(*keys).agg(F.max_by(name, F.struct("_v", F.col(name))).alias("version"))


# --- frozen tables and metadata ----------------------------------------------------------------------------


def save_manifest(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """A frozen manifest; one that is there is replaced only where asked."""
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def digest(df: DataFrame, order: list[str], columns: list[str], fan: int = 1_024) -> DataFrame:
    """One row (rows, sha256): the root of a tree of hashes over a table in order, whatever its size.

    A leaf is the text of a row's columns with `|` between them and a new line after them; null is empty. `fan` leaves, and
    above them `fan` hashes, are joined and hashed, until one hash is left. An empty table has the hash of the empty text.
    """
    leaf = F.concat(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit("\n"))
    level = running(df.select(*order, leaf.alias("_l")), order).select(F.col("number").alias("_n"), "_l")
    rows = level.count()
    left = rows
    while True:
        parts = level.groupBy(F.floor(F.col("_n") / fan).alias("_n")).agg(F.array_sort(F.collect_list(F.struct("_n", "_l"))).alias("_p"))  # at most `fan` entries
        level = parts.select("_n", F.sha2(F.array_join(F.transform("_p", lambda p: p["_l"]), ""), 256).alias("_l"))
        left = -(-left // fan)
        if left <= 1:
            break
    return level.agg(F.lit(rows).cast("long").alias("rows"), F.coalesce(F.first("_l"), F.sha2(F.lit(""), 256)).alias("sha256"))


def dataset_info(frames: DataFrame, episode: str, task: str, fps: float) -> DataFrame:
    """One row: episodes, frames, tasks, seconds at the rate, shortest and longest episode."""
    per = frames.groupBy(episode).agg(F.count(F.lit(1)).alias("_n"))
    lengths = per.agg(F.count(F.lit(1)).alias("episodes"), F.coalesce(F.sum("_n"), F.lit(0)).alias("frames"), F.min("_n").alias("shortest"), F.max("_n").alias("longest"))
    return lengths.crossJoin(frames.agg(F.count_distinct(task).alias("tasks"))).withColumn("seconds", F.col("frames") / float(fps))  # one row each


def episode_lines(frames: DataFrame, episode: str, task: str) -> DataFrame:
    """(episode, length, tasks): what the metadata says of each episode."""
    return frames.groupBy(episode).agg(F.count(F.lit(1)).alias("length"), F.array_sort(F.collect_set(task)).alias("tasks"))


def merged_status(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Status documents after an update: new values where there are any, old ones else, and all keys of both."""
    theirs = new.select(key, *[F.col(c).alias(f"_n_{c}") for c in new.columns if c != key])
    names = [c for c in dict.fromkeys([*old.columns, *new.columns]) if c != key]
    pick = lambda c: F.coalesce(*[F.col(x) for x in ([f"_n_{c}"] if c in new.columns else []) + ([c] if c in old.columns else [])]).alias(c)
    return old.join(theirs, key, "full_outer").select(key, *[pick(c) for c in names])


def structure(df: DataFrame) -> DataFrame:
    """(column, type, rows, nulls): what a table holds, one row a column."""
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.sum(F.col(f"`{f.name}`").isNull().cast("long")).alias(f"_{i}") for i, f in enumerate(df.schema.fields)])
    one = F.array(*[F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.col("_rows").alias("rows"), F.coalesce(f"_{i}", F.lit(0)).alias("nulls")) for i, f in enumerate(df.schema.fields)])
    return counts.select(F.explode(one).alias("_c")).select("_c.*")


# --- resumes ---------------------------------------------------------------------------------------------


def resume_point(done: DataFrame, episode: str, fingerprint: str, now: str) -> DataFrame:
    """One row (next_episode, issue): how far the committed episodes 0, 1, ... go without a gap, and why a run may not go on.

    done: (episode, fingerprint). Episodes that were made under another fingerprint, that come twice, or that lie beyond a gap are issues.
    """
    counts = done.groupBy(episode).agg(F.count(F.lit(1)).alias("_n"), F.bool_or(F.col(fingerprint) != now).alias("_other"))
    nxt = counts.select((F.col(episode) - 1).alias(episode), F.lit(True).alias("_next"))
    ends = counts.join(nxt, episode, "left").filter("_next is null").agg(F.min(episode).alias("_end"))
    total = counts.agg(F.count(F.lit(1)).alias("_all"), F.coalesce(F.min(episode), F.lit(0)).alias("_low"), F.max("_n").alias("_most"), F.coalesce(F.bool_or("_other"), F.lit(False)).alias("_changed"))
    last = F.when(F.col("_low") == 0, F.coalesce(F.col("_end") + 1, F.lit(0))).otherwise(F.lit(0))
    issue = F.when(F.col("_changed"), "fingerprint changed").when(F.col("_most") > 1, "episode twice").when(F.col("_all") > last, "gap")
    return total.crossJoin(ends).select(last.cast("long").alias("next_episode"), issue.alias("issue"))  # one row each


def checked_rows(df: DataFrame, keep: Column, sizes: dict[str, int]) -> DataFrame:
    """Rows that are kept; one whose vectors have not the sizes given, or are not finite, fails the job."""
    from framegrain.operators.governance import issues, vector_contract

    rules = {k: v for c, n in sizes.items() for k, v in vector_contract(c, n).items()}
    found = issues(rules)
    ok = F.when(F.size(found) > 0, F.raise_error(F.array_join(found, "; ")).cast("boolean")).otherwise(True)
    return df.filter(keep).withColumn("_ok", ok).filter("_ok").drop("_ok")
