"""Stream operators whose state has timers: leases that run out, and values that are pushed no more often than allowed.

Timers run on event time, so a replayed stream gives the same rows: what is due when the watermark passes is put out then.
State is one row a key. The state store must be RocksDB (`framegrain.session.session` sets it).
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from framegrain.streaming.operators import in_order

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: How a lease ends.
RELEASED, EXPIRED, TAKEN = "released", "expired", "taken over"


def _ms(value) -> int:
    return value.value // 1_000_000  # of pandas, in nanoseconds


def in_order_columns(batches: Iterator, by: list[str], names: list[str], slice_rows: int = 1_000) -> Iterator:
    """A key's rows of one micro-batch in order, as tuples of the named columns in slices; the first one is a time and counts in milliseconds.

    They are held and sorted as columns; only a slice at a time becomes Python objects. Rows alike in `by` keep their order.
    """
    import numpy as np
    import pandas as pd

    held = list(batches)
    if held:
        pdf = held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
        order = np.lexsort([pdf[c].to_numpy() for c in reversed(by)])
        columns = [pdf[c] for c in names]
        ms = columns[0].to_numpy().astype("datetime64[ns]").astype(np.int64) // 1_000_000
        for at in range(0, len(order), slice_rows):
            some = order[at : at + slice_rows]
            yield zip(ms[some].tolist(), *(c.to_numpy()[some].tolist() for c in columns[1:]), strict=True)


def _at(ms: int) -> datetime:
    return datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(milliseconds=ms)


class Leases(StatefulProcessor):
    """One lease a key: (holder, began, until) in milliseconds."""

    def __init__(self, key: str, time: str, order: str, holder: str, release: str, lease_ms: int):
        self.names, self.lease_ms = (key, time, order, holder, release), lease_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("lease", "holder string, began bigint, until bigint")

    def _ended(self, key, lease, at, why):
        return key[0], lease[0], _at(lease[1]), _at(at), why

    def _kept(self, before, lease) -> None:
        """One timer a key, at the end of its lease; a key whose lease stays as it was needs nothing."""
        if lease == before:
            return
        if before is not None:
            self.handle.deleteTimer(before[2])
        if lease is None:
            self.held.clear()
        else:
            self.held.update(lease)
            self.handle.registerTimer(lease[2])

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        _, time, order, holder, release = self.names
        state, out = self.held.get(), []
        before = lease = tuple(state) if state is not None else None
        for part in in_order_columns(rows, [time, order], [time, holder, release]):
            for now, who, gives in part:
                if lease and lease[2] <= now:
                    out.append(self._ended(key, lease, lease[2], EXPIRED))
                    lease = None
                if gives:
                    if lease and lease[0] == who:
                        out.append(self._ended(key, lease, now, RELEASED))
                        lease = None
                elif lease and lease[0] != who:
                    out.append(self._ended(key, lease, now, TAKEN))
                    lease = (who, now, now + self.lease_ms)
                else:
                    lease = (who, lease[1] if lease else now, now + self.lease_ms)
        self._kept(before, lease)
        if out:
            yield pd.DataFrame(out, columns=["key", "holder", "began", "ended", "reason"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        lease = tuple(self.held.get()) if self.held.exists() else None
        out = []
        if lease and lease[2] <= expiredTimerInfo.getExpiryTimeInMs():
            out.append(self._ended(key, lease, lease[2], EXPIRED))
            self.held.clear()
        yield pd.DataFrame(out, columns=["key", "holder", "began", "ended", "reason"])

    def close(self) -> None:
        pass


class Throttle(StatefulProcessor):
    """What a key's receiver has been sent: (last push, value waiting) in milliseconds."""

    def __init__(self, key: str, time: str, order: str, value: str, every_ms: int):
        self.names, self.every_ms = (key, time, order, value), every_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("pushed", "last bigint, waiting boolean, value double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        _, time, order, value = self.names
        last, waiting, held = tuple(self.held.get()) if self.held.exists() else (None, False, 0.0)
        out = []
        for pdf in in_order(rows, [time, order]):
            for r in pdf.itertuples(index=False):
                now = _ms(getattr(r, time))
                if waiting and last + self.every_ms <= now:
                    last, waiting = last + self.every_ms, False
                    out.append((key[0], _at(last), held))
                if last is None or last + self.every_ms <= now:
                    last = now
                    out.append((key[0], _at(now), float(getattr(r, value))))
                else:
                    waiting, held = True, float(getattr(r, value))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.held.update((last, waiting, held))
        if waiting:
            self.handle.registerTimer(last + self.every_ms)
        yield pd.DataFrame(out, columns=["key", "at", "value"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        last, waiting, held = tuple(self.held.get())
        out = []
        if waiting and last + self.every_ms <= expiredTimerInfo.getExpiryTimeInMs():
            last += self.every_ms
            out.append((key[0], _at(last), held))
            self.held.update((last, False, held))
        yield pd.DataFrame(out, columns=["key", "at", "value"])

    def close(self) -> None:
        pass


def leases(stream: DataFrame, key: str, time: str, order: str, holder: str, release: str, seconds: float, late: str = "0 seconds") -> DataFrame:
    """(key, holder, began, ended, reason) of leases that have ended.

    A row of a holder takes or extends the lease of its key for `seconds`; one with `release` gives it back. A lease ends when
    it is released, when another holder takes it over, or when it runs out: then at the time it ran out, as soon as a later row
    of the key or the watermark shows that. Rows of one time come in order of `order`. Times count in milliseconds.
    """
    kind = stream.schema[key].dataType.simpleString()
    rows = stream.select(key, time, order, holder, release).withWatermark(time, late)
    return rows.groupBy(key).transformWithStateInPandas(
        Leases(key, time, order, holder, release, round(seconds * 1000)), f"key {kind}, holder string, began timestamp, ended timestamp, reason string", "append", "eventTime"
    )


def throttled(stream: DataFrame, key: str, time: str, order: str, value: str, seconds: float, late: str = "0 seconds") -> DataFrame:
    """(key, at, value): a key's first value at once, then its latest one, no more often than every `seconds`.

    A value that comes too early waits; a newer one takes its place, and it is pushed when the time has passed.
    """
    kind = stream.schema[key].dataType.simpleString()
    rows = stream.select(key, time, order, value).withWatermark(time, late)
    return rows.groupBy(key).transformWithStateInPandas(Throttle(key, time, order, value, round(seconds * 1000)), f"key {kind}, at timestamp, value double", "append", "eventTime")


def stuck(moves: DataFrame, ended: DataFrame, key: str, source_there: str, destination_there: str) -> DataFrame:
    """(key, action): what to do with moves whose lease ran out, by what is there: `verify`, `again` or `lost`."""
    from pyspark.sql import functions as F

    gone = ended.filter(F.col("reason") == EXPIRED).select(F.col("key").alias(key)).distinct()
    action = F.when(F.col(destination_there) & ~F.col(source_there), "verify").when(F.col(source_there), "again").otherwise("lost")
    return moves.join(gone, key, "left_semi").select(key, action.alias("action"))
