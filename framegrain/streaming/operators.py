"""Stream operators: routing, similarity filter, chunk merging, rates and bounded views.

State is keyed, so it is spread over the state stores by stream; each operator's state has a stated bound.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: The weight of the newer value, by name, where two chunks have an action for one timestep.
NEWER_WEIGHT = {"weighted_average": 0.7, "average": 0.5, "conservative": 0.3, "latest": 1.0}


def combined(name: str, older, newer):
    """The action for a timestep that two chunks cover: numbers or columns."""
    share = NEWER_WEIGHT[name]
    return newer if share == 1 else older + (newer - older) * share


def in_order(batches: Iterator, by: list[str], slice_rows: int = 1_000) -> Iterator:
    """A key's rows of one micro-batch in order, in pandas slices, however many Arrow batches they come in.

    They are held and sorted as Arrow columns; only a slice at a time becomes Python objects.
    """
    import pyarrow as pa

    held = [pa.Table.from_pandas(pdf, preserve_index=False) for pdf in batches]
    if held:
        table = pa.concat_tables(held)
        order = pa.compute.sort_indices(table, sort_keys=[(c, "ascending") for c in by])
        for at in range(0, len(order), slice_rows):
            yield table.take(order.slice(at, slice_rows)).to_pandas()


def finite(vectors: list[str]) -> Column:
    """Whether all vector columns have finite elements only."""
    out = F.lit(True)
    for v in vectors:
        out = out & ~F.coalesce(F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))
    return out


def route(stream: DataFrame, online: str, offline: str, checkpoint: str, flag: str = "is_intervention", vectors: tuple[str, ...] = (), once: bool = True):
    """Appends finite rows to `online` and flagged ones to `offline` too, as Parquet.

    A batch is written under its number, replacing what an earlier attempt left: replays add nothing twice.
    """
    def write(batch: DataFrame, number: int) -> None:
        rows = batch.filter(finite(list(vectors))) if vectors else batch
        rows.write.mode("overwrite").parquet(f"{online}/batch={number}")
        rows.filter(flag).write.mode("overwrite").parquet(f"{offline}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed(stream: DataFrame, time: str, keys: list[str], aggregates: list[Column], size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Tumbling or sliding windows with a watermark; rows later than `late` are dropped."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return stream.withWatermark(time, late).groupBy(w, *keys).agg(*aggregates)


def sessions(stream: DataFrame, time: str, key: str, gap: str, aggregates: list[Column], late: str = "1 hour") -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(*aggregates)


def similarity_filter(stream: DataFrame, key: str, step: str, state: str, must: str, atol: float) -> DataFrame:
    """Rows (key, step, state) that must go, are their key's first, or have a new step and moved by atol or more.

    State of a key: the last admitted vector and all admitted steps, as ranges of consecutive ones. Nothing is
    forgotten, so the state grows with the gaps between a key's admitted steps; a new episode is a new key.
    """
    key_type, step_type = stream.schema[key].dataType.simpleString(), stream.schema[step].dataType.simpleString()

    def task(keys: tuple, batches: Iterator, held: GroupState) -> Iterator:
        from bisect import bisect_right

        import numpy as np
        import pandas as pd

        last, starts, ends = (list(x) for x in held.get) if held.exists else ([], [], [])
        for pdf in in_order(batches, [step]):
            out = []
            for row in pdf.itertuples(index=False):
                s, v = getattr(row, step), np.asarray(getattr(row, state), float)
                at = bisect_right(starts, s)  # ranges before `at` start at s or before
                known = at > 0 and s <= ends[at - 1]
                moved = not last or float(np.linalg.norm(v - np.asarray(last))) >= atol
                if getattr(row, must) or not last or (not known and moved):
                    out.append((keys[0], s, v.tolist()))
                    last = v.tolist()
                    if not known:
                        left, right = at > 0 and ends[at - 1] == s - 1, at < len(starts) and starts[at] == s + 1
                        if left and right:
                            ends[at - 1] = ends.pop(at)
                            del starts[at]
                        elif left:
                            ends[at - 1] = int(s)
                        elif right:
                            starts[at] = int(s)
                        else:
                            starts.insert(at, int(s))
                            ends.insert(at, int(s))
            yield pd.DataFrame(out, columns=[key, step, state])
        held.update((last, starts, ends))

    return stream.select(key, step, state, must).groupBy(key).applyInPandasWithState(
        task, f"{key} {key_type}, {step} {step_type}, {state} array<double>", "last array<double>, starts array<bigint>, ends array<bigint>", "append", GroupStateTimeout.NoTimeout
    )


def merge_chunks(stream: DataFrame, key: str, order: str, first: str, actions: str, executed: str, combine: str = "weighted_average") -> DataFrame:
    """Queue of a key after each chunk: (key, order, step, action).

    A chunk covers steps first, first + 1, ... Steps up to `executed` are dropped as late; steps that the old
    queue has too are combined; old steps that the chunk lacks are discarded. State is one chunk a key. A key's
    chunks of one micro-batch are sorted as Arrow columns; maxFilesPerTrigger bounds them. Queues leave as they are made.
    """
    kinds = {c: stream.schema[c].dataType.simpleString() for c in (key, order)}

    def task(keys: tuple, batches: Iterator, held: GroupState) -> Iterator:
        import pandas as pd

        steps, values = (list(x) for x in held.get) if held.exists else ([], [])
        queue = dict(zip(steps, values, strict=True))
        for pdf in in_order(batches, [order], 100):
            out = []
            for row in pdf.itertuples(index=False):
                new = {}
                for k, a in enumerate(getattr(row, actions)):
                    s = int(getattr(row, first)) + k
                    if s > getattr(row, executed):
                        new[s] = combined(combine, queue[s], float(a)) if s in queue else float(a)
                queue = new
                out += [(keys[0], getattr(row, order), s, a) for s, a in queue.items()]
            yield pd.DataFrame(out, columns=[key, order, "step", "action"])
        held.update((list(queue), list(queue.values())))

    return stream.select(key, order, first, actions, executed).groupBy(key).applyInPandasWithState(
        task, f"{key} {kinds[key]}, {order} {kinds[order]}, step long, action double", "steps array<bigint>, values array<double>", "append", GroupStateTimeout.NoTimeout
    )


def merged_batch(old: DataFrame, new: DataFrame, executed: DataFrame, keys: list[str], combine: str = "weighted_average") -> DataFrame:
    """The same merge of two tables (*keys, step, action), for all keys at once.

    `executed` has (*keys, executed); the latest one of a key counts. A key without any has executed nothing yet.
    """
    late = executed.groupBy(*keys).agg(F.max("executed").alias("_e"))
    both = new.select(*keys, "step", F.col("action").alias("_n")).join(late, keys, "left").filter(F.col("_e").isNull() | (F.col("step") > F.col("_e")))
    both = both.join(old.select(*keys, "step", F.col("action").alias("_o")), [*keys, "step"], "left")
    mixed = combined(combine, F.col("_o"), F.col("_n"))
    return both.select(*keys, "step", F.when(F.col("_o").isNull(), F.col("_n")).otherwise(mixed).alias("action"))


def running_rate(stream: DataFrame, key: str, seconds: str) -> DataFrame:
    """(key, n, rate) after each batch: (n - 1) / (last - first). State is three numbers a key."""
    kind = stream.schema[key].dataType.simpleString()

    def task(keys: tuple, batches: Iterator, held: GroupState) -> Iterator:
        import pandas as pd

        first, last, n = held.get if held.exists else (float("inf"), float("-inf"), 0)
        for pdf in batches:
            first, last, n = min(first, pdf[seconds].min()), max(last, pdf[seconds].max()), n + len(pdf)
        held.update((float(first), float(last), int(n)))
        yield pd.DataFrame([(keys[0], n, (n - 1) / (last - first) if last > first else None)], columns=[key, "n", "rate"])

    return stream.select(key, seconds).groupBy(key).applyInPandasWithState(task, f"{key} {kind}, n long, rate double", "first double, last double, n long", "append", GroupStateTimeout.NoTimeout)


def latest_only(stream: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The latest value of each key, for a throttled trigger in complete or update mode."""
    return stream.groupBy(key).agg(F.max_by(value, order).alias(value))


def reassembled(parts: DataFrame, message: str, order: str, kind: str, payload: str) -> DataFrame:
    """(message, payload, complete) from BEGIN, MIDDLE and END parts; any other kind fails."""
    checked = F.when(F.col(kind).isin("BEGIN", "MIDDLE", "END"), F.col(kind)).otherwise(F.raise_error(F.concat(F.lit("unknown part: "), F.col(kind))).cast("string"))
    rows = parts.select(message, order, checked.alias(kind), payload)
    pieces = F.array_sort(F.collect_list(F.struct(order, kind, payload)))
    out = rows.groupBy(message).agg(pieces.alias("_p"))
    body = F.array_join(F.transform("_p", lambda p: p[payload]), "")
    whole = (F.element_at("_p", 1)[kind].isin("BEGIN", "END")) & (F.element_at("_p", -1)[kind] == "END")
    return out.select(message, body.alias(payload), whole.alias("complete"))


def in_parts(df: DataFrame, message: str, payload: str, size: int) -> DataFrame:
    """Messages cut to parts of `size` characters: (message, part, kind, payload); a single part is an END."""
    n = F.greatest(F.ceil(F.length(payload) / size), F.lit(1)).cast("int")
    rows = df.withColumn("_n", n).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    kind = F.when(F.col("part") == F.col("_n") - 1, "END").when(F.col("part") == 0, "BEGIN").otherwise("MIDDLE")
    return rows.select(message, "part", kind.alias("kind"), F.substring(payload, F.col("part") * size + 1, F.lit(size)).alias(payload))


def poll(spark, source: str, schema, done: Callable[[], DataFrame], key: str, work: Callable[[DataFrame, int], None], checkpoint: str, fmt: str = "parquet"):
    """Runs work(batch, number) on rows of new files whose key is not done, then stops.

    `done` gives the table of what is done; it is asked anew for each batch, so what an earlier batch or another job has done
    since is left out. Files that come late are new files whatever their time.
    """
    def each(batch: DataFrame, number: int) -> None:
        work(batch.join(done().select(key), key, "left_anti"), number)

    stream = spark.readStream.schema(schema).format(fmt).load(source)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
