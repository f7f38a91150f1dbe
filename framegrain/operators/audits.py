"""Audit of recordings by what their files hold: lengths, cameras, timestamps, arms and language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framegrain.session import stored

#: Where recordings keep what is audited.
CHANNELS, COLORS, DEPTHS, CLOCK = "camera_color_channel", "camera_observations/color_images", "camera_observations/depth_images", "camera_observations/timestamp"
#: Fixed value: steps that a clock may stand still at the end.
STALL_STEPS = 5
#: The kinds of issues. What follows a colon is filled in.
KINDS = (
    "invalid_or_missing_trajectory_length", "empty_dataset:", "length_mismatch:", "declared_camera_missing_color:", "color_camera_not_declared:", "declared_camera_missing_depth:",
    "depth_camera_not_declared:", "rgb_length_mismatch:", "inferred_length_mismatch:", "camera_timestamp_terminal_stall:", "unreadable_camera_timestamp:", "invalid_camera_timestamp",
    "missing_right_peer:", "missing_left_peer:", "missing_language_instruction", "language_instruction_mismatch:",
)


def aligned(path: Column) -> Column:
    """Whether a dataset has one row for each step of the recording."""
    return F.concat(F.lit("/"), path).contains("/camera_observations/") | path.contains("_align/")


def quoted(text: Column) -> Column:
    """Text in quotes: single ones, or double ones where it holds single ones only; what stands for itself is escaped."""
    plain = F.replace(F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t"))
    double = plain.contains("'") & ~plain.contains('"')
    return F.when(double, F.concat(F.lit('"'), plain, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("\\'")), F.lit("'")))


def _lengths(path: Column, kind: str, want: Column, is_: Column) -> Column:
    return F.concat(F.lit(kind), path, F.lit(":expected="), want.cast("string"), F.lit(":actual="), is_.cast("string"))


def stalled_steps(clock: DataFrame, key: str, usable: DataFrame) -> DataFrame:
    """(key, steps): steps at the end of the usable part over which the clock does not advance. clock: (key, step, value)."""
    w = Window.partitionBy(key).orderBy("step")
    before, value = F.lag("value").over(w), F.col("value")
    finite = F.abs(value) < float("inf")
    moved = F.when(finite & (F.isnan(before) | (value > before)) & (F.col("step") > 0), F.col("step"))
    rows = clock.join(usable, key).filter(F.col("step") < F.col("usable")).withColumn("_moved", moved)
    return rows.groupBy(key).agg((F.first("usable") - 1 - F.coalesce(F.max("_moved"), F.lit(0))).alias("steps"), F.first("usable").alias("usable"), F.bool_or(value.isNull()).alias("invalid"))


def recording_issues(recordings: DataFrame, datasets: DataFrame, clock: DataFrame, key: str = "recording", expected_language: str | None = None) -> DataFrame:
    """(key, issue), each issue once: the sixteen KINDS.

    recordings: (key, length, language), length and language null where the file has none. datasets: (key, path, ndim, length,
    error), one row for each dataset with its first dimension's length; error is null unless it can't be read. clock: (key, step,
    value) of the camera timestamps from step 0; a value that is no number is null.

    A recording without datasets has the issues of its length and language only.
    """
    # What is asked several times is written once, so that no task sorts for all of its readers.
    recordings, datasets = stored(recordings, "recordings"), stored(datasets, "datasets")
    ds = stored(datasets.join(recordings.select(key, F.col("length").alias("_t")), key), "audited")
    path, n, t = F.col("path"), F.col("length"), F.col("_t")
    rows = F.col("ndim") > 0
    own = recordings.select(key, F.explode(F.array(
        F.when(F.col("length").isNull() | (F.col("length") <= 0), F.lit(KINDS[0])),
        F.when(F.coalesce(F.col("language"), F.lit("")) == "", F.lit(KINDS[14])).when(F.lit(expected_language is not None) & (F.col("language") != F.lit(expected_language or "")), F.concat(F.lit(KINDS[15] + "actual="), quoted(F.col("language")))),
    )).alias("issue"))
    plain = ds.select(key, F.explode(F.array(
        F.when(rows & (n == 0), F.concat(F.lit(KINDS[1]), path)),
        F.when(rows & t.isNotNull() & aligned(path) & (n != t), _lengths(path, KINDS[2], t, n)),
        F.when((path == CLOCK) & F.col("error").isNotNull(), F.concat(F.lit(KINDS[10]), F.col("error"))),
    )).alias("issue"))

    # Cameras: declared, with colour, with depth.
    below = lambda root: F.regexp_extract(path, f"^{root}/([^/]+)", 1)
    named = ds.withColumn("_in", F.when(below(CHANNELS) != "", F.struct(F.lit("d").alias("k"), below(CHANNELS).alias("n"))).when(below(COLORS) != "", F.struct(F.lit("c").alias("k"), below(COLORS).alias("n"))).when(below(DEPTHS) != "", F.struct(F.lit("z").alias("k"), below(DEPTHS).alias("n"))))
    has = named.filter("_in IS NOT NULL").groupBy(key, F.col("_in.n").alias("_camera")).agg(*[F.bool_or(F.col("_in.k") == k).alias(k) for k in ("d", "c", "z")])
    says = lambda when, kind: F.when(when, F.concat(F.lit(kind), F.col("_camera")))
    cameras = has.select(key, F.explode(F.array(says(F.col("d") & ~F.col("c"), KINDS[3]), says(F.col("c") & ~F.col("d"), KINDS[4]), says(F.col("d") & ~F.col("z"), KINDS[5]), says(F.col("z") & ~F.col("d"), KINDS[6]))).alias("issue"))

    # The length that most colour streams have, of equally frequent ones the first stream's.
    colour = ds.filter(path.rlike(f"^{COLORS}/[^/]+$"))
    counts = colour.groupBy(key, "length").agg(F.count(F.lit(1)).alias("_n"), F.min("path").alias("_first"))
    first = Window.partitionBy(key).orderBy(F.desc("_n"), "_first")  # a row for each length that a recording's cameras have
    inferred = counts.withColumn("_r", F.row_number().over(first)).filter("_r = 1").select(key, F.col("length").alias("_i"))
    lengths = ds.join(inferred, key).select(key, F.explode(F.array(
        F.when(path.rlike(f"^{COLORS}/[^/]+$") & (n != F.col("_i")), _lengths(path, KINDS[7], F.col("_i"), n)),
        F.when(t.isNull() & rows & aligned(path) & (n != F.col("_i")), _lengths(path, KINDS[8], F.col("_i"), n)),
    )).alias("issue"))

    known = ds.filter((path == CLOCK) & F.col("error").isNull()).select(key, F.col("length").alias("_c"))
    usable = inferred.join(known, key).select(key, F.least("_i", "_c").alias("usable")).filter(F.col("usable") > STALL_STEPS)
    stalled = stalled_steps(clock, key, usable).select(key, F.when(F.col("invalid"), F.lit(KINDS[11])).when(F.col("steps") >= STALL_STEPS, F.concat(F.lit(KINDS[9] + "steps="), F.col("steps").cast("string"))).alias("issue"))

    left = path.contains("_left_")
    peer = F.when(left, F.replace(path, F.lit("_left_"), F.lit("_right_"))).when(path.contains("_right_"), F.replace(path, F.lit("_right_"), F.lit("_left_")))
    asked = ds.select(key, left.alias("_left"), peer.alias("_peer")).filter("_peer IS NOT NULL")
    there = datasets.select(key, F.col("path").alias("_peer"))
    peers = asked.join(there, [key, "_peer"], "left_anti").select(key, F.concat(F.when(F.col("_left"), KINDS[12]).otherwise(KINDS[13]), "_peer").alias("issue"))

    out = own
    for part in (plain, cameras, lengths, stalled, peers):
        out = out.unionByName(part)
    return out.filter("issue IS NOT NULL").distinct()
