"""Ordered products over whole episodes: prefix scans over monoids that need not commute.

A scan cuts an episode into blocks of frames. Each block is scanned on its own (in log2(block) steps over all its frames at
once), the products of the blocks are scanned the same way, and what lies before a block is put in front of its frames.
No task and no row ever holds an episode. Values are arrays of doubles of a fixed width.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framegrain.functions import geometry
from framegrain.session import stored

BLOCK = 4_096


class Monoid(NamedTuple):
    """combine(earlier, later) on arrays of shape (rows, width), associative."""

    width: int
    combine: Callable[[np.ndarray, np.ndarray], np.ndarray]


def _poses(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    turn = a[:, :9].reshape(-1, 3, 3)
    moved = (turn @ b[:, 9:, None])[:, :, 0] + a[:, 9:]
    return np.hstack([(turn @ b[:, :9].reshape(-1, 3, 3)).reshape(-1, 9), moved])


def _clamps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    step, low, high = b[:, 0], b[:, 1], b[:, 2]
    return np.stack([a[:, 0] + step, np.clip(a[:, 1] + step, low, high), np.clip(a[:, 2] + step, low, high)], axis=1)


#: Rigid transforms: nine numbers of a row-major rotation, then a translation; the later one acts in the earlier one's frame.
POSES = Monoid(12, _poses)
#: x -> min(high, max(low, x + step)) as (step, low, high): sums that are clipped at every step.
CLAMPS = Monoid(3, _clamps)


def prefixes(values: np.ndarray, monoid: Monoid, starts: np.ndarray | None = None) -> np.ndarray:
    """Products of the rows up to and with each, from the last of `starts` (row numbers, the first is 0) on."""
    out, step = values.copy(), 1
    starts = np.zeros(1, np.int64) if starts is None else starts
    place = np.arange(len(out)) - np.repeat(starts, np.diff(np.append(starts, len(out)))) if len(out) else np.zeros(0, np.int64)
    while step <= place.max(initial=0):
        at = np.flatnonzero(place >= step)
        out[at] = monoid.combine(out[at - step], out[at])
        step *= 2
    return out


def _starts(table, names: list[str]) -> np.ndarray:
    """Rows of a sorted table whose named values are not those of the row before; nulls are alike."""
    import pyarrow as pa
    import pyarrow.compute as pc

    new = np.arange(table.num_rows) == 0
    for n in names:
        column = table.column(n).combine_chunks()
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        here, before = column.slice(1), column.slice(0, max(len(column) - 1, 0))
        other = pc.or_kleene(pc.fill_null(pc.not_equal(here, before), False), pc.xor(here.is_null(), before.is_null()))
        new[1:] |= other.to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _matrix(column, width: int) -> np.ndarray:
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten()
    if len(flat) != width * len(column) or flat.null_count:
        raise ValueError(f"a value has not {width} numbers")
    return flat.to_numpy(zero_copy_only=False).reshape(-1, width)


def _listed(values: np.ndarray):
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel()))


def ordered_scan(df: DataFrame, value: str, monoid: Monoid, episode: str, index: str, into: str, block: int = BLOCK) -> DataFrame:
    """Adds `into`: the product of the values of this and all earlier frames of the episode.

    `index` numbers an episode's frames from 0 without gaps; a value that is null or of another width fails the job. Rows
    travel with all their columns, so df should be narrow. Null episodes are one episode.
    """
    width, names = monoid.width, df.columns
    rows = df.withColumn("_block", F.floor(F.col(index) / block).cast("long"))
    kind = T.StructType([*rows.schema.fields, T.StructField("_inside", T.ArrayType(T.DoubleType()))])

    def inside(batches):
        """Blocks of sorted rows; the last one of a batch waits for its rest."""
        import pyarrow as pa

        def scanned(table, starts):
            table = table.combine_chunks()
            return table.append_column("_inside", _listed(prefixes(_matrix(table.column(value), width), monoid, starts))).combine_chunks().to_batches()

        held = None
        for b in batches:
            table = pa.Table.from_batches([b])
            held = pa.concat_tables([held, table]).combine_chunks() if held is not None and held.num_rows else table
            starts = _starts(held, [episode, "_block"])
            if len(starts) > 1:
                yield from scanned(held.slice(0, starts[-1]), starts[:-1])
                held = held.slice(starts[-1])
        if held is not None and held.num_rows:
            yield from scanned(held, _starts(held, [episode, "_block"]))

    near = rows.repartition(episode, "_block").sortWithinPartitions(episode, "_block", index)
    scanned = stored(near.mapInArrow(inside, kind), "scan")
    # What a whole block multiplies to, as frame number `_block` of a shorter episode.
    heads = scanned.filter(F.pmod(F.col(index), F.lit(block)) == block - 1).select(episode, F.col("_block").alias("_n"), F.col("_inside").alias("_product"))
    if heads.isEmpty():
        return scanned.withColumnRenamed("_inside", into).drop("_block")
    before = ordered_scan(heads, "_product", monoid, episode, "_n", "_before", block).select(F.col(episode).alias("_episode"), (F.col("_n") + 1).alias("_at"), "_before")
    met = scanned.join(before, scanned[episode].eqNullSafe(before["_episode"]) & (scanned["_block"] == before["_at"]), "left").drop("_episode", "_at")

    def joined(batches):
        import pyarrow as pa

        for b in batches:
            out = _matrix(b.column("_inside"), width).copy()
            ahead = b.column("_before")
            some = np.flatnonzero(ahead.is_valid().to_numpy(zero_copy_only=False))
            if len(some):
                out[some] = monoid.combine(_matrix(ahead.drop_null(), width), out[some])
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], _listed(out)], [*names, into])

    return met.select(*names, "_inside", "_before").mapInArrow(joined, T.StructType([*df.schema.fields, T.StructField(into, T.ArrayType(T.DoubleType()))]))


def integrated(df: DataFrame, action: str, start: DataFrame, scales: tuple[float, float, float], episode: str, index: str, six: bool = False, block: int = BLOCK) -> DataFrame:
    """Adds position, rotation and gripper of each frame after its action, from where the episode starts.

    action: steps in the frame of the pose before, as `geometry.decode_action` reads them; its last channel is a step of the
    gripper, which is clipped to 0..1 after every frame. start: (episode, position, rotation, gripper), one row an episode.
    """
    step = geometry.decode_action(F.col(action), *scales, six=six)
    first = start.select(episode, F.concat("rotation", "position").alias("_p0"), F.col("gripper").cast("double").alias("_g0"))
    # The pose and the grip before frame 0 come first in their products.
    rows = df.withColumn("_d", step).withColumn("_pose", F.concat("_d.rotation", "_d.translation")).withColumn("_grip", F.array(F.col("_d.gripper"), F.lit(0.0), F.lit(1.0))).drop("_d")
    rows = ordered_scan(ordered_scan(rows, "_pose", POSES, episode, index, "_moved", block), "_grip", CLAMPS, episode, index, "_held", block).join(first, episode)
    at = lambda c, i: F.get(c, F.lit(i))
    turn, shift = F.slice("_p0", 1, 9), F.slice("_p0", 10, 3)
    pose = geometry.advanced(shift, turn, F.struct(F.slice("_moved", 10, 3).alias("translation"), F.slice("_moved", 1, 9).alias("rotation")))
    grip = F.least(at("_held", 2), F.greatest(at("_held", 1), F.col("_g0") + at("_held", 0)))
    return rows.withColumn("_e", pose).select(*df.columns, F.col("_e.position").alias("position"), F.col("_e.rotation").alias("rotation"), grip.alias("gripper"))


def roundtrip_errors(moved: DataFrame, recorded: DataFrame, episode: str, index: str) -> DataFrame:
    """(episode, frames, position, degrees, gripper): largest differences of integrated and recorded frames of an episode.

    Both: (episode, index, position, rotation, gripper). Frames that one side lacks are left out; `frames` counts the others.
    """
    theirs = recorded.select(episode, index, F.col("position").alias("_p"), F.col("rotation").alias("_r"), F.col("gripper").alias("_g"))
    both = moved.join(theirs, [episode, index])
    return both.groupBy(episode).agg(
        F.count(F.lit(1)).alias("frames"), F.max(geometry.norm(geometry.minus(F.col("position"), F.col("_p")))).alias("position"),
        F.max(geometry.angle_between(F.col("rotation"), F.col("_r"))).alias("degrees"), F.max(F.abs(F.col("gripper") - F.col("_g"))).alias("gripper"),
    )
