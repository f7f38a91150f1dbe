"""Splits, samplers and bounded views.

Random choices are hashes of a seed and the row's key: the same rows come out whatever the partitioning, and
on any rerun.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shuffled(seed: int, *keys: str) -> Column:
    """A pseudo-random number of 60 bits for each row, from md5 over the seed and the keys' text, so that other engines can repeat it."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])), 1, 15), 16, 10).cast("long")


def split_sizes(n: Column, ratios: tuple[float, ...]) -> Column:
    """Sizes of splits of n rows: one each while rows last, to splits of positive ratio, then by largest deficit, the first
    of equal ones. Ratios add up to 1.

    All but the last few rows go to splits at once: a split whose deficit is k more than the number of splits
    gets k rows before any split's deficit falls below that number.
    """
    if abs(sum(ratios) - 1) > 1e-9 or min(ratios) < 0:
        raise ValueError(f"not shares of a whole: {ratios}")
    m, first, held = len(ratios), [], F.lit(0)
    for r in ratios:
        one = ((held < n) & F.lit(r > 0)).cast("int")
        first.append(one)
        held = held + one
    lack = [F.lit(float(r)) * n - s for r, s in zip(ratios, first, strict=True)]
    jump = [F.greatest(F.lit(0), F.floor(d) - m).cast("long") for d in lack]
    some = [s + j for s, j in zip(first, jump, strict=True)]
    start = F.struct(F.array(*[d - j for d, j in zip(lack, jump, strict=True)]).alias("lack"), F.array(*some).alias("size"))

    def step(a: Column, _: Column) -> Column:
        best = F.array_position(a["lack"], F.array_max(a["lack"])).cast("int") - 1
        return F.struct(F.transform(a["lack"], lambda x, i: F.when(i == best, x - 1).otherwise(x)).alias("lack"), F.transform(a["size"], lambda x, i: F.when(i == best, x + 1).otherwise(x)).alias("size"))

    left = n - sum(some[1:], some[0])
    turns = F.when(left > 0, F.sequence(F.lit(1).cast("long"), left.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(turns, start, step, lambda a: a["size"])


def coprime_from(least: Column, n: Column) -> Column:
    """The first whole number from `least` on that has no divisor with n but 1.

    Among any 300 numbers in a row there is one, for every n of 64 bits.
    """
    def gcd(a: Column) -> Column:
        pair = F.struct(a.cast("long").alias("a"), n.cast("long").alias("b"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(92)), pair, lambda p, _: F.when(p["b"] == 0, p).otherwise(F.struct(p["b"].alias("a"), F.pmod(p["a"], F.when(p["b"] == 0, F.lit(1)).otherwise(p["b"])).alias("b"))), lambda p: p["a"])

    return F.aggregate(F.sequence(F.lit(0), F.lit(300)), F.lit(None).cast("long"), lambda found, k: F.when(found.isNotNull(), found).when(gcd(least + k) == 1, (least + k).cast("long")))


#: Ranges of hashes that a group's rows are ranked in, as a power of two.
RANK_BITS = 10


def shuffled_rank(df: DataFrame, group: str, key: str, seed: int, into: str) -> DataFrame:
    """Adds a row's place, from 1, among its group's in shuffled order; rows of a null group are left out.

    Ranges of the hash are counted for each group and a row is ranked within its range: a group that holds most
    rows is spread over 2^RANK_BITS windows.
    """
    rows = df.withColumn("_h", shuffled(seed, key)).withColumn("_b", F.shiftright("_h", 60 - RANK_BITS))
    counts = rows.groupBy(group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(group, "_b", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(group, "_b").orderBy("_h", key))
    return rows.join(counts, [group, "_b"]).withColumn(into, F.col("_before") + inside).drop("_h", "_b", "_before")


def stratified_split(df: DataFrame, task: str, key: str, ratios: dict[str, float], seed: int) -> DataFrame:
    """Adds `split`. Each task's rows are shuffled and dealt by split_sizes of its count (one number a task)."""
    names = list(ratios)
    counts = df.groupBy(task).agg(F.count(F.lit(1)).alias("_n"))
    ends = counts.select(task, split_sizes(F.col("_n"), tuple(ratios.values())).alias("_s"))
    rows = shuffled_rank(df, task, key, seed, "_r").join(ends, task)
    split, upto = F.lit(names[-1]), F.lit(0)
    chain = None
    for k, name in enumerate(names):
        upto = upto + F.get("_s", F.lit(k))
        chain = (F if chain is None else chain).when(F.col("_r") <= upto, F.lit(name))
    return rows.withColumn("split", chain.otherwise(split)).drop("_r", "_s")


def round_robin(df: DataFrame, task: str, key: str, n: int, seed: int) -> DataFrame:
    """n rows, one of each task in turn, from the end of each task's shuffled list."""
    w = Window.partitionBy(task).orderBy(shuffled(seed, key).desc(), F.desc(key))
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).orderBy("_r", task).limit(n).drop("_r")


def ratio_split(df: DataFrame, key: str, ratio: float, seed: int, names=("train", "test")) -> DataFrame:
    """Adds `split`: exactly round(n * ratio) rows (halves to even, both sides not empty) in the first part."""
    n = df.count()
    k = min(max(round(n * ratio), 1), max(n - 1, 1))
    chosen = df.select(key).orderBy(shuffled(seed, key), key).limit(k).withColumn("_in", F.lit(True))
    return df.join(chosen, key, "left").withColumn("split", F.when(F.col("_in"), names[0]).otherwise(names[1])).drop("_in")


def label_balanced(df: DataFrame, label: str, key: str, n: int, share: float, seed: int) -> DataFrame:
    """n rows, share of them positive, without replacement while a class lasts and with it beyond."""
    def take(rows: DataFrame, k: int) -> DataFrame:
        have = rows.count()
        if not have or not k:
            return rows.limit(0).withColumn("draw", F.lit(0))
        times = math.ceil(k / have)
        return rows.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).orderBy("draw", shuffled(seed, key, "draw"), key).limit(k)

    k = round(n * share)
    return take(df.filter(F.col(label) == 1), k).unionByName(take(df.filter(F.col(label) == 0), n - k)).orderBy(shuffled(seed + 1, key, "draw"))


def frame_weights(frames: DataFrame, online: str, episode: str, order: list[str], ratio: float, drop_last: int = 0) -> DataFrame:
    """Adds `weight`: ratio spread over eligible online frames, the rest over offline ones; dropped tails get 0.

    Weights sum to 1; where no frame is eligible all are alike.
    """
    left = F.row_number().over(Window.partitionBy(online, episode).orderBy(*[F.desc(c) for c in order])) - 1
    rows = frames.withColumn("_e", (~F.col(online) | (left >= drop_last)).cast("long"))
    totals = rows.groupBy(online).agg(F.sum("_e").alias("_k"))
    raw = F.when((F.col("_e") == 1) & (F.col("_k") > 0), F.when(F.col(online), F.lit(ratio)).otherwise(F.lit(1 - ratio)) / F.col("_k")).otherwise(F.lit(0.0))
    rows = rows.join(totals, online).withColumn("_w", raw)
    mass = rows.agg(F.sum("_w").alias("_m"), F.count(F.lit(1)).alias("_all"))
    return rows.crossJoin(F.broadcast(mass)).withColumn("weight", F.when(F.col("_m") > 0, F.col("_w") / F.col("_m")).otherwise(1 / F.col("_all"))).drop("_e", "_k", "_w", "_m", "_all")


def episode_quota(episodes: DataFrame, index: str, rows: str, n: int, world: int, seed: int) -> DataFrame:
    """n samples dealt round robin to episodes: row (start + k * stride) mod rows with a stride coprime to it.

    (position, episode, row, rank): position is the place in the round robin, rank is position mod world.
    """
    count = episodes.count()
    quota = F.lit(n // max(count, 1)) + (F.col(index) < n % max(count, 1)).cast("int")
    start = F.pmod(shuffled(seed, index), F.col(rows))
    wish = F.pmod(shuffled(seed + 1, index), F.col(rows)) + 1
    out = episodes.withColumn("_q", quota).filter("_q > 0").withColumn("_start", start).withColumn("_stride", coprime_from(wish, F.col(rows)))
    out = out.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("_q") - 1)))
    position = F.col("k") * count + F.col(index)
    return out.select(position.alias("position"), F.col(index).alias("episode"), F.pmod(F.col("_start") + F.col("k") * F.col("_stride"), F.col(rows)).alias("row"), (position % world).alias("rank"))


def shard_of(index: str, world: int) -> Column:
    return F.pmod(F.col(index), F.lit(world))


def alternating(failures: DataFrame, successes: DataFrame, order: str, batch: int) -> DataFrame:
    """Both sides' batches in turn, failures first; the shorter side cycles. Adds `batch` and `slot`.

    Each side is numbered by its own dense `order` column, so batches come from arithmetic.
    """
    a, b = failures.count(), successes.count()
    rounds = max(math.ceil(a / batch), math.ceil(b / batch)) if a and b else 0

    def side(df: DataFrame, n: int, offset: int) -> DataFrame:
        times = F.sequence(F.lit(0), F.floor((F.lit(rounds * batch - 1) - F.col(order)) / n))
        rows = df.withColumn("_c", F.explode(F.when(F.col(order) < rounds * batch, times).otherwise(F.array().cast("array<bigint>"))))
        at = F.col(order) + F.col("_c") * n
        return rows.withColumn("batch", (2 * F.floor(at / batch) + offset).cast("long")).withColumn("slot", (at % batch).cast("long")).drop("_c")

    if not rounds:
        return failures.unionByName(successes).limit(0).withColumn("batch", F.lit(0).cast("long")).withColumn("slot", F.lit(0).cast("long"))
    return side(failures, a, 0).unionByName(side(successes, b, 1))


def half_and_half(online: DataFrame, offline: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    pick = lambda d, k, s: d.orderBy(shuffled(s, key), key).limit(k)
    return pick(online, n // 2, seed).unionByName(pick(offline, n - n // 2, seed + 1))


def capped_subset(df: DataFrame, key: str, capacity: int, seed: int) -> DataFrame:
    """A random subset of at most `capacity` rows, in order of the key."""
    return df.orderBy(shuffled(seed, key), key).limit(capacity).orderBy(key)


def objectives(key: str, shares: dict[str, float], seed: int) -> Column:
    """One of the names for each row, with the given probabilities, fixed by the key."""
    u = F.pmod(shuffled(seed, key), F.lit(1 << 30)) / float(1 << 30)
    names, upto, out = list(shares), 0.0, None
    for name in names[:-1]:
        upto += shares[name] / sum(shares.values())
        out = (F if out is None else out).when(u < upto, F.lit(name))
    return out.otherwise(F.lit(names[-1])) if out is not None else F.lit(names[0])


def newest(df: DataFrame, sequence: str, capacity: int) -> DataFrame:
    """The newest `capacity` rows by sequence, with their slot in a ring."""
    return df.orderBy(F.desc(sequence)).limit(capacity).withColumn("slot", F.pmod(F.col(sequence), F.lit(capacity)))


def rank_ranges(index: str, n: int, world: int) -> Column:
    """Rank of a dense index under contiguous ranges whose sizes differ by one at most, larger ones first."""
    size, extra = divmod(n, world)
    cut = extra * (size + 1)
    return F.when(F.col(index) < cut, F.floor(F.col(index) / (size + 1))).otherwise(F.lit(extra) + F.floor((F.col(index) - cut) / max(size, 1))).cast("long")


def fractional_rows(episodes: DataFrame, episode: str, rows: str, fractions: list[float]) -> DataFrame:
    """(episode, row): rows floor(f * (n - 1)) for each fraction, each once."""
    at = F.array_distinct(F.array(*[F.floor(F.lit(float(f)) * (F.col(rows) - 1)).cast("long") for f in fractions]))
    return episodes.select(episode, F.explode(at).alias("row"))


#: Offsets from a drawn frame, by name of the mode.
TIMESTAMP_MODES = {"1_frame": (0,), "2_frames": (-1, 0), "2_frames_4_space": (-5, 0), "6_frames": (-5, -4, -3, -2, -1, 0)}


def timestamp_groups(episodes: DataFrame, episode: str, rows: str, mode: str, fps: float, seed: int, least: int = 5) -> DataFrame:
    """(episode, timestamps): a group of times around one frame of each episode, drawn from `least` on by hash of the key.

    Episodes of at most `least` frames have none.
    """
    at = F.pmod(shuffled(seed, episode), F.col(rows) - least) + least
    times = F.transform(F.array(*[F.lit(o) for o in TIMESTAMP_MODES[mode]]), lambda o: (F.col("_at") + o) / float(fps))
    return episodes.filter(F.col(rows) > least).withColumn("_at", at).select(episode, times.alias("timestamps"))


def even_ranks(index: str, n: int, world: int, strict: bool = False) -> Column:
    """Rank of a dense index under ranges of equal size, ceil(n / world); the last ranks may have fewer rows or none.

    strict: n must be a multiple of world.
    """
    if strict and n % world:
        raise ValueError(f"{n} rows do not divide by {world}")
    return F.floor(F.col(index) / max(1, -(-n // world))).cast("long")


def index_range(df: DataFrame, index: str, start: int, stop: int) -> DataFrame:
    """The rows of a sequential batch [start, stop)."""
    return df.filter((F.col(index) >= start) & (F.col(index) < stop)).orderBy(index)
