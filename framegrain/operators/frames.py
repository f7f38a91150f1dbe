"""Operators over frames: rows that belong to an episode and have an order in it.

Windows are partitioned by episode throughout; what spans episodes (offsets, dense numbers) is computed on a
table of one row for each episode and joined back, so no task ever sees all frames.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framegrain.operators.ranges import running


def _by(episode: str, *order: str) -> Window:
    return Window.partitionBy(episode).orderBy(*order)


def _back(episode: str, *order: str) -> Window:
    """From the last frame back to this one: a frame that ends at UNBOUNDED FOLLOWING would be summed anew for every row."""
    return Window.partitionBy(episode).orderBy(*[F.desc(c) for c in order])


def _whole(episode: str, *order: str) -> Window:
    return _by(episode, *order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def number_frames(df: DataFrame, episode: str, order: list[str]) -> DataFrame:
    """Adds frame_index (from 0) and episode_length."""
    return df.withColumn("frame_index", (F.row_number().over(_by(episode, *order)) - 1).cast("long")).withColumn("episode_length", F.count(F.lit(1)).over(Window.partitionBy(episode)))


def episode_bounds(df: DataFrame, episode: str) -> DataFrame:
    """(episode, length, from_index, to_index, dense_index): cumulative lengths in order of the episode's id."""
    lengths = running(df.groupBy(episode).agg(F.count(F.lit(1)).alias("length")), [episode], {"length": F.col("length")})
    start = F.col("before_length").cast("long")
    return lengths.select(episode, "length", start.alias("from_index"), (start + F.col("length")).alias("to_index"), F.col("number").alias("dense_index"))


def global_index(frames: DataFrame, episode: str) -> DataFrame:
    """Adds `index`, dense over all frames, from frame_index and the episodes' offsets."""
    return frames.join(episode_bounds(frames, episode).select(episode, "from_index", "dense_index"), episode).withColumn("index", F.col("from_index") + F.col("frame_index"))


def bounds_by_change(df: DataFrame, order: str, episode: str) -> DataFrame:
    """(run, episode, from_index, to_index) of consecutive rows of one episode in an already indexed table.

    `order` is a dense index. A run starts where the row before (by index) has another episode; that is a
    self-join on the index, so it needs no window over all rows.
    """
    before = df.select((F.col(order) + 1).alias(order), F.col(episode).alias("_before"), F.lit(True).alias("_has"))
    starts = df.select(order, episode).join(before, order, "left").filter(F.col("_has").isNull() | ~F.col("_before").eqNullSafe(F.col(episode)))
    runs = running(starts.select(order, episode), [order])
    nxt = runs.select((F.col("number") - 1).alias("number"), F.col(order).alias("_to"))
    last = df.agg((F.max(order) + 1).alias("_n"))
    out = runs.join(nxt, "number", "left").crossJoin(F.broadcast(last))  # one row
    return out.select(F.col("number").alias("run"), episode, F.col(order).alias("from_index"), F.coalesce("_to", "_n").alias("to_index"))


def forward_chunk(column: str, size: int, episode: str, order: list[str]) -> Column:
    """The values from this frame on, `size` of them; past the end the last value repeats."""
    ahead = F.collect_list(column).over(_by(episode, *order).rowsBetween(0, size - 1))
    return F.concat(ahead, F.array_repeat(F.element_at(ahead, -1), F.lit(size) - F.size(ahead)))


def chunk_padding(size: int, episode: str, order: list[str]) -> Column:
    """How many entries of forward_chunk are repeats."""
    return (F.lit(size) - F.count(F.lit(1)).over(_by(episode, *order).rowsBetween(0, size - 1))).cast("int")


def future_value(column: str, steps: int, episode: str, order: list[str]) -> Column:
    """The value `steps` frames ahead, or the episode's last."""
    return F.coalesce(F.lead(column, steps).over(_by(episode, *order)), F.last(column).over(_whole(episode, *order)))


def relative_values(df: DataFrame, column: str, offsets: list[int], episode: str, order: list[str]) -> DataFrame:
    """Adds `{column}_at` and `{column}_is_pad`: values at frame offsets, clamped to the episode."""
    w, ends = _by(episode, *order), _whole(episode, *order)
    inside = lambda o: F.lead(F.lit(1), o).over(w).isNotNull() if o >= 0 else F.lag(F.lit(1), -o).over(w).isNotNull()
    edge = lambda o: F.last(column).over(ends) if o >= 0 else F.first(column).over(ends)
    moved = lambda o: F.lead(column, o).over(w) if o >= 0 else F.lag(column, -o).over(w)
    values = F.array(*[F.when(inside(o), moved(o)).otherwise(edge(o)) for o in offsets])
    return df.withColumn(f"{column}_at", values).withColumn(f"{column}_is_pad", F.array(*[~inside(o) for o in offsets]))


def seconds_to_offsets(deltas: list[float], fps: float, tolerance: float) -> list[int]:
    """Frame offsets of time offsets; each must be a multiple of the frame time within the tolerance."""
    offsets = [round(d * fps) for d in deltas]
    wrong = [d for d, o in zip(deltas, offsets, strict=True) if abs(o / fps - d) > tolerance]
    if wrong:
        raise ValueError(f"not multiples of 1/{fps}: {wrong}")
    return offsets


def success_tail(success: Column, tail: int, episode: str, order: list[str], gain: float = 10.0, cost: float = -0.05) -> tuple[Column, Column]:
    """(reward, done): the last `tail` frames of a successful episode earn `gain` and are done."""
    left = F.row_number().over(_back(episode, *order))
    done = success & (left <= tail)
    return F.when(done, F.lit(gain)).otherwise(F.lit(cost)), done


def return_to_go(reward: str, episode: str, order: list[str]) -> Column:
    return F.sum(reward).over(_back(episode, *order).rowsBetween(Window.unboundedPreceding, 0))


def discounted_returns(df: DataFrame, reward: str, gamma: float, episode: str, order: list[str], index: str | None = None, into: str = "discounted_return", block: int = 4_096, level: int = 0) -> DataFrame:
    """Adds the sum over this and later frames of gamma^distance * reward; `index` is a frame index from 0, if there is one.

    Episodes are cut into blocks, so no task sees a whole episode's rewards. Within a block, gamma^place * reward
    is summed up from the end, where terms are smallest, and divided by gamma^place; blocks are short enough for
    that factor. What later blocks add is a discounted return over the blocks' own returns; where a block's factor
    is below 1e-20, only the next block adds anything that a double can hold.
    """
    if not 0 < gamma <= 1:
        raise ValueError("gamma must be above 0 and at most 1")
    last = gamma == 1 and level == 2  # one row for each block * block frames: a plain sum then
    width = 1 << 40 if last else block if gamma == 1 else max(1, min(block, int(230 / -math.log(gamma))))  # gamma^width stays above 1e-100
    rows = df.withColumn("_at", F.col(index)) if index else number_frames(df, episode, order).withColumnRenamed("frame_index", "_at").drop("episode_length")
    rows = rows.withColumn("_b", F.floor(F.col("_at") / width).cast("long")).withColumn("_k", F.pow(F.lit(float(gamma)), F.pmod(F.col("_at"), F.lit(width))))
    back = Window.partitionBy(episode, "_b").orderBy(F.desc("_at")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_g", F.sum(F.col(reward) * F.col("_k")).over(back) / F.col("_k"))
    heads = rows.filter(F.pmod(F.col("_at"), F.lit(width)) == 0).select(episode, "_b", "_g")
    step = float(gamma) ** width
    if step > 1e-20 and not last:
        own = heads.select(episode, F.col("_b").alias("_n"), F.col("_g").alias("_r"))
        heads = discounted_returns(own, "_r", step, episode, ["_n"], "_n", "_sum", block, level + 1).select(episode, F.col("_n").alias("_b"), F.col("_sum").alias("_g"))
    later = heads.select(episode, (F.col("_b") - 1).alias("_b"), F.col("_g").alias("_later"))
    left = F.when(F.col("_later").isNull(), F.lit(0.0)).otherwise(F.col("_later") * step / F.col("_k"))
    return rows.join(later, [episode, "_b"], "left").withColumn(into, F.col("_g") + left).drop("_at", "_b", "_k", "_g", "_later")


def terminal_return(reward: Column, gamma: float, episode: str, order: list[str]) -> Column:
    """The discounted return where only the last frame is rewarded, scaled to [-1, 1]."""
    left = F.row_number().over(_back(episode, *order)) - 1
    scaled = F.pow(F.lit(gamma), left)
    return F.when(reward > 0, 2 * scaled - 1).otherwise(2 * reward * scaled - 1)


def next_states(df: DataFrame, columns: list[str], episode: str, order: list[str], sparse_reward: bool = False) -> DataFrame:
    """Adds next_{column}, done and truncated; the last frame of an episode keeps its own state."""
    w = _by(episode, *order)
    last = F.lead(F.lit(1)).over(w).isNull()
    out = df.withColumns({f"next_{c}": F.when(last, F.col(c)).otherwise(F.lead(c).over(w)) for c in columns})
    out = out.withColumn("done", last).withColumn("truncated", F.lit(False) if sparse_reward else last)
    return out.withColumn("reward", F.when(last, F.lit(1.0)).otherwise(F.lit(0.0))) if sparse_reward else out


def drop_edge_frames(df: DataFrame, episode: str, order: list[str], first: int = 0, last: int = 0, episodes: list | None = None) -> DataFrame:
    """Frames of the chosen episodes without the first `first` and last `last` of each."""
    if episodes is not None:
        df = df.filter(F.col(episode).isin(episodes))
    numbered = df.withColumn("_i", F.row_number().over(_by(episode, *order))).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(episode)))
    return numbered.filter((F.col("_i") > first) & (F.col("_i") <= F.col("_n") - last)).drop("_i", "_n")


def timestamp_gaps(df: DataFrame, seconds: str, fps: float, tolerance: float, episode: str, order: list[str]) -> DataFrame:
    """Frames whose distance to the next one in the episode is not 1 / fps within the tolerance."""
    gap = F.lead(seconds).over(_by(episode, *order)) - F.col(seconds)
    return df.withColumn("gap", gap).filter(F.abs(F.col("gap") - 1.0 / fps) > tolerance)


def trailing_stall(df: DataFrame, seconds: str, episode: str, order: list[str]) -> DataFrame:
    """(episode, stall): length of the last run of timestamps that do not increase."""
    w = _by(episode, *order)
    moved = F.when(F.col(seconds) > F.lag(seconds).over(w), F.row_number().over(w) - 1)
    return df.withColumn("_m", moved).groupBy(episode).agg((F.count(F.lit(1)) - 1 - F.coalesce(F.max("_m"), F.lit(0))).alias("stall"))


def forward_fill(column: str, episode: str, order: list[str]) -> Column:
    return F.last(column, ignorenulls=True).over(_by(episode, *order).rowsBetween(Window.unboundedPreceding, 0))


def latest_record(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in order, as a partial aggregate."""
    packed = F.max_by(F.struct(*[c for c in df.columns if c not in keys]), F.struct(*order))
    return df.groupBy(*keys).agg(packed.alias("_r")).select(*keys, "_r.*")


def first_seen_codes(df: DataFrame, column: str, order: str, reserve: int = 0) -> DataFrame:
    """(column, code): dense codes in order of first appearance, from `reserve`."""
    seen = df.groupBy(column).agg(F.min(order).alias("first_seen"))
    return running(seen, ["first_seen", column]).select(column, "first_seen", (F.col("number") + reserve).alias("code"))


def sample_size(n: Column, power: float = 0.75, least: int = 100, most: int = 10_000) -> Column:
    return F.least(n, F.greatest(F.lit(least), F.least(F.lit(most), F.pow(n, power).cast("long")))).cast("long")


def evenly_spaced(df: DataFrame, episode: str, order: list[str], k: Column) -> DataFrame:
    """Frames round(i * (n - 1) / (k - 1)) for i = 0..k-1 of each episode, halves to even; k may use episode_length."""
    frames = number_frames(df, episode, order)
    ends = frames.select(episode, "episode_length").distinct().withColumn("_k", k)
    at = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_k") - 1), lambda i: F.rint(i * (F.col("episode_length") - 1) / F.greatest(F.col("_k") - 1, F.lit(1))).cast("long"))
    picks = ends.select(episode, F.explode(F.array_distinct(at)).alias("frame_index"))
    return frames.join(picks, [episode, "frame_index"])


def velocity(column: str, dt: float, episode: str, order: list[str]) -> Column:
    """Change since the frame before over dt; 0 on the first frame."""
    return F.coalesce((F.col(column) - F.lag(column).over(_by(episode, *order))) / dt, F.lit(0.0))


def flip_penalty(command: str, state: str, episode: str, order: list[str], low: float, high: float, penalty: float) -> Column:
    """`penalty` where the command closes what the frame before had open, or opens what it had closed."""
    before = F.lag(state).over(_by(episode, *order))
    flips = ((F.col(command) < low) & (before > high)) | ((F.col(command) > high) & (before < low))
    return F.when(flips, F.lit(penalty)).otherwise(F.lit(0.0))


def finished_episodes(done: str, order: list[str], stream: str) -> Column:
    """Episode number within a stream of frames that is cut after each done frame."""
    return F.coalesce(F.sum(F.col(done).cast("long")).over(_by(stream, *order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def continuous_quaternions(df: DataFrame, column: str, episode: str, order: list[str]) -> DataFrame:
    """Unit quaternions whose sign never flips against the frame before.

    The sign of a frame is the parity of the negative dot products of raw neighbours up to it.
    """
    w = _by(episode, *order)
    norm = F.sqrt(F.aggregate(column, F.lit(0.0), lambda s, x: s + x * x))
    unit = df.withColumn(column, F.transform(column, lambda x: x / norm))
    dot = F.aggregate(F.zip_with(F.col(column), F.lag(column).over(w), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    turns = F.sum(F.when(F.col("_dot") < 0, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = unit.withColumn("_dot", dot).withColumn("_turns", turns)
    return out.withColumn(column, F.when(F.col("_turns") % 2 == 1, F.transform(column, lambda x: -x)).otherwise(F.col(column))).drop("_dot", "_turns")


def resumed(new: DataFrame, old: DataFrame, index: str) -> DataFrame:
    """`new` with its index continuing after the largest one of `old`."""
    top = old.agg((F.coalesce(F.max(index), F.lit(-1)) + 1).alias("_shift"))
    return new.crossJoin(F.broadcast(top)).withColumn(index, F.col(index) + F.col("_shift")).drop("_shift")


def truncated_at(df: DataFrame, most: int) -> DataFrame:
    """Adds at_limit: whether the step limit is reached."""
    return df.withColumn("at_limit", F.col("frame_index") + 1 >= most)
