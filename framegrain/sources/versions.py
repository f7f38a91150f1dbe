"""Datasets of episodes that stay readable while episodes are replaced.

    root/data/tx=<id>/       the frames that one transaction wrote, never changed
    root/episodes/tx=<id>/   (episode, rows) of that transaction
    root/log/<number>.json   one small file a commit, made exclusively: the transaction that version <number> added

A snapshot shows for each episode the frames of its newest transaction up to a version. A run that breaks off before its
log entry leaves files that no snapshot shows; `vacuum` deletes these and what later versions replaced.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ConcurrentCommit(RuntimeError):
    """Another run committed the version first."""


def _files(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def _names(spark: SparkSession, folder: str) -> dict[str, int]:
    """Names in a folder and when they were changed, in seconds."""
    fs, path = _files(spark, folder)
    return {s.getPath().getName(): s.getModificationTime() // 1000 for s in fs.listStatus(path(folder))} if fs.exists(path(folder)) else {}


def log(spark: SparkSession, root: str) -> list[dict]:
    """{version, tx, episode} of every commit, oldest first: one row a commit."""
    names = [n for n in _names(spark, f"{root}/log") if n.endswith(".json")]
    rows = spark.read.text([f"{root}/log/{n}" for n in names], wholetext=True).collect() if names else []
    return sorted((json.loads(r[0]) for r in rows), key=lambda e: e["version"])


def commit(df: DataFrame, root: str, episode: str = "episode_index", expected: int | None = None, fail: Callable[[], None] | None = None) -> int:
    """Adds or replaces the episodes of df as one new version and returns its number, from 1.

    `expected` is the version that df was made from: where another has been committed since, ConcurrentCommit is raised and
    nothing changes. Without it the next free number is taken. `fail` is called before the log entry, for tests.
    """
    spark, tx = df.sparkSession, uuid.uuid4().hex
    df.write.option("compression", "zstd").parquet(f"{root}/data/tx={tx}")
    written = spark.read.schema(df.schema).parquet(f"{root}/data/tx={tx}")
    written.groupBy(episode).agg(F.count(F.lit(1)).alias("rows")).write.parquet(f"{root}/episodes/tx={tx}")
    if fail:
        fail()
    fs, path = _files(spark, root)
    version = (expected if expected is not None else max([0, *(e["version"] for e in log(spark, root))])) + 1
    while True:
        name = f"{root}/log/{version:020d}.json"
        try:
            out = fs.create(path(name), False)  # fails where the file is there
        except Exception as e:
            if not fs.exists(path(name)):
                raise
            if expected is not None:
                raise ConcurrentCommit(f"version {version} is taken") from e
            version += 1
            continue
        out.write(bytearray(json.dumps({"version": version, "tx": tx, "episode": episode}).encode()))
        out.close()
        return version


def _live(spark: SparkSession, root: str, version: int | None) -> tuple[DataFrame, list[dict]] | None:
    """(episode, tx, rows, newest) for each episode of each commit up to the version, and these commits."""
    entries = [e for e in log(spark, root) if version is None or e["version"] <= version]
    if not entries:
        return None
    number = F.create_map(*[F.lit(x) for e in entries for x in (e["tx"], e["version"])])  # one pair a commit
    per = spark.read.option("basePath", f"{root}/episodes").parquet(*[f"{root}/episodes/tx={e['tx']}" for e in entries]).withColumn("tx", F.col("tx").cast("string")).withColumn("_v", number[F.col("tx")])
    name = entries[-1]["episode"]
    newest = per.groupBy(F.col(name).alias("_episode")).agg(F.max("_v").alias("_newest"))
    return per.join(newest, F.col(name).eqNullSafe(F.col("_episode"))).select(name, "tx", "rows", (F.col("_v") == F.col("_newest")).alias("newest")), entries


def snapshot(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The frames of every episode as of a version (the newest, if None). A root without commits fails.

    Transactions of which every episode is live are read as they are; the others are joined with their live episodes.
    """
    live = _live(spark, root, version)
    if live is None:
        raise FileNotFoundError(f"no version of {root}")
    per, entries = live
    name = entries[-1]["episode"]
    counts = {r["tx"]: r for r in per.groupBy("tx").agg(F.count_if("newest").alias("live"), F.count(F.lit(1)).alias("all")).collect()}  # one row a commit
    whole = [e["tx"] for e in entries if e["tx"] in counts and counts[e["tx"]]["live"] == counts[e["tx"]]["all"]]
    partly = [e["tx"] for e in entries if e["tx"] in counts and 0 < counts[e["tx"]]["live"] < counts[e["tx"]]["all"]]
    read = lambda txs: spark.read.option("basePath", f"{root}/data").parquet(*[f"{root}/data/tx={t}" for t in txs]).withColumn("tx", F.col("tx").cast("string"))
    parts = [read(whole).drop("tx")] if whole else []
    if partly:
        rows, kept = read(partly), per.filter("newest").select(F.col(name).alias("_episode"), F.col("tx").alias("_tx"))
        parts.append(rows.join(kept, (F.col("tx") == F.col("_tx")) & F.col(name).eqNullSafe(F.col("_episode")), "left_semi").drop("tx"))
    return parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0] if parts else read([entries[-1]["tx"]]).drop("tx").limit(0)


def history(spark: SparkSession, root: str) -> DataFrame:
    """(version, episode, rows): what each commit wrote."""
    live = _live(spark, root, None)
    if live is None:
        raise FileNotFoundError(f"no version of {root}")
    per, entries = live
    number = F.create_map(*[F.lit(x) for e in entries for x in (e["tx"], e["version"])])
    return per.select(number[F.col("tx")].cast("long").alias("version"), F.col(entries[-1]["episode"]).alias("episode"), "rows")


def vacuum(spark: SparkSession, root: str, keep_versions: int = 1, older_than: float = 24 * 3600) -> list[str]:
    """Deletes the files of transactions that none of the newest `keep_versions` snapshots shows, and of runs that were never
    committed and are older than `older_than` seconds. Returns the transactions deleted; earlier versions can't be read then.
    """
    entries = log(spark, root)
    used: set[str] = set()
    for e in entries[max(0, len(entries) - keep_versions) :]:
        per, _ = _live(spark, root, e["version"])
        used |= {r["tx"] for r in per.filter("newest").select("tx").distinct().collect()}  # one row a commit
    known = {e["tx"] for e in entries}
    fs, path = _files(spark, root)
    gone = []
    for name, changed in _names(spark, f"{root}/data").items():
        tx = name.removeprefix("tx=")
        if tx in used or tx not in known and changed > time.time() - older_than:
            continue
        gone.append(tx)
    for e in entries:
        if e["tx"] in gone:  # the log entry goes first, so no snapshot names files that are gone
            fs.delete(path(f"{root}/log/{e['version']:020d}.json"), False)
    for tx in gone:
        for part in ("data", "episodes"):
            fs.delete(path(f"{root}/{part}/tx={tx}"), True)
    return gone
