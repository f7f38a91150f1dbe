"""Operator 3: removal of long repeated passages by a distributed merge sort of suffixes.

A byte goes when a string of `length` bytes that covers it starts anywhere else too. Sorting every suffix
would move each byte hundreds of times, so suffixes are sorted at anchors only. The anchor of a window of
`length` bytes is where, among its substrings of GRAM bytes, the one with the smallest hash starts: equal
windows have their anchor at the same offset, and windows next to each other mostly share it. An anchor
owns the run of window starts [s, e] that it is the anchor of; anchors whose substring occurs once in the
corpus own no repeated window. For the others:

1. each task writes its suffixes (text[a : e + length], with the text before the anchor beside them) as
   sorted, front-coded runs, split by the hash of the leading substring;
2. a reducer merges the runs of its share with a loser tree that keeps, for each run's head, its common
   prefix with the last string put out, and never compares bytes inside a known prefix;
3. the merge gives the common prefixes of neighbours to the right of the anchors, a second sort those to
   the left. Windows at offset o before their anchors are equal exactly when both agree, to o bytes left and
   length - o bytes right, which is a comparison of class numbers for each o.

Anchors that share one substring more than `hot` times are first split, as any merge sort may split its runs: windows at
offsets o1..o2 before their anchors all cover the o1 bytes before and the length - o2 bytes behind, so equal ones fall
into one class of these bytes. Offsets are halved until no class has more than `hot` distinct contexts; a context that
several anchors have is repeated whole and goes on once. Down to one offset a class is one context, so this ends, and no
task ever gets a larger group. Windows that repeat within one text are found there, compared byte by byte, and only their
first copy goes on, so periodic texts don't multiply anchors.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framegrain.llm.common import _BYTE, bloom_bits, bloom_hit, mix64, utf8, written

LENGTH = 400
GRAM = 64
#: Bytes of text whose windows are handled at once; positions take 20 bits.
CHUNK = 1 << 19
#: Bytes of suffixes that a reducer merges, about, and rows with one leading substring that it merges at most.
PART_BYTES = 8 << 20
HOT_ROWS = 50_000
#: Suffixes that a task holds before it writes a run.
RUN_BYTES = 32 << 20


def _doubled(h: np.ndarray, width: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = h[:-width] * np.uint64(0x9E3779B97F4A7C15 + 2 * width) + h[width:]
        return out ^ (out >> np.uint64(29))


def _powers(buf: np.ndarray, top: int) -> dict[int, np.ndarray]:
    """Hashes of all substrings of 1, 2, 4 ... top bytes."""
    out, width = {1: _BYTE[buf]}, 1
    while width < top:
        if len(out[width]) <= width:
            out[2 * width] = np.zeros(0, np.uint64)
        else:
            out[2 * width] = _doubled(out[width], width)
        width *= 2
    return out


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of v[i : i + width] for each i."""
    n = len(v) - width + 1
    padded = np.full(-(-len(v) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(v)] = v
    table = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def _window_hashes(buf: np.ndarray, length: int) -> np.ndarray:
    parts, at = None, 0
    powers = _powers(buf, 1 << (length.bit_length() - 1))
    n = len(buf) - length + 1
    with np.errstate(over="ignore"):
        for width in sorted(powers, reverse=True):
            if length & width:
                h = powers[width][at : at + n]
                parts = h if parts is None else mix64(parts) * np.uint64(0xD1B54A32D192ED03) + h
                at += width
    return mix64(parts)


def window_classes(text: bytes, length: int) -> np.ndarray:
    """A number for each window of the text, equal exactly where the bytes are.

    Hashes say which windows to compare; each is compared with the first of its hash, neighbours at one
    distance in one comparison. Where a hash holds different windows, they are told apart by their bytes.
    """
    h = _window_hashes(np.frombuffer(text, np.uint8), length)
    _, first, classes = np.unique(h, return_index=True, return_inverse=True)
    first = first[classes]
    at = np.flatnonzero(first != np.arange(len(h)))
    apart = at - first[at]
    order = np.lexsort((at, apart))
    at, apart = at[order], apart[order]
    cut = np.flatnonzero(np.concatenate(([True], (apart[1:] != apart[:-1]) | (at[1:] != at[:-1] + 1)))) if len(at) else at
    mixed: set[int] = set()
    for x, y in zip(cut.tolist(), [*cut[1:].tolist(), len(at)], strict=False):
        lo, hi, d = int(at[x]), int(at[y - 1]) + length, int(apart[x])
        if text[lo:hi] != text[lo - d : hi - d]:
            mixed.update(classes[at[x:y]].tolist())
    if mixed:
        names: dict[bytes, int] = {}
        top = int(classes.max()) + 1
        for i in np.flatnonzero(np.isin(classes, list(mixed))).tolist():
            classes[i] = names.setdefault(text[i : i + length], top + len(names))
    return classes


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM):
    """(owner, key, a, s, e, repeats): anchors of the windows of each text, and window starts [lo, hi] that
    repeat within a text, as rows (owner, lo, hi). Positions count from the start of the text."""
    found, repeats = [], []
    group, size = [], 0

    def flush():
        if group:
            a, r = _anchors(group, length, gram)
            found.append(a)
            repeats.extend(r)
            group.clear()

    for i, t in enumerate(texts):
        for at in range(0, len(t) - length + 1, CHUNK):
            piece = t[at : at + CHUNK + length - 1]
            if size + len(piece) > CHUNK:
                flush()
                size = 0
            group.append((i, at, piece))
            size += len(piece)
    flush()
    cols = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 5
    return (*cols, repeats)


def _anchors(pieces, length, gram):
    buf = np.frombuffer(b"".join(p for _, _, p in pieces), np.uint8)
    sizes = np.array([len(p) for _, _, p in pieces])
    first = np.cumsum(sizes) - sizes
    value = mix64(_powers(buf, gram)[gram])
    mask = np.uint64((1 << 20) - 1)
    low = _sliding_min((value & ~mask) | np.arange(len(value), dtype=np.uint64), length - gram + 1)
    counts = sizes - length + 1
    piece = np.repeat(np.arange(len(pieces)), counts)
    start = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + first[piece]
    at = (low[start] & mask).astype(np.int64)
    keep = np.ones(len(start), bool)
    repeats = []
    cut = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (piece[1:] != piece[:-1]))))
    # Texts in which an anchor's substring comes twice may repeat windows of their own.
    pair = np.lexsort((value[at[cut]], piece[cut]))
    again = (value[at[cut]][pair][1:] == value[at[cut]][pair][:-1]) & (piece[cut][pair][1:] == piece[cut][pair][:-1])
    begin = np.cumsum(counts) - counts
    for k in np.unique(piece[cut][pair][1:][again]):
        _, where, inverse, n = np.unique(window_classes(pieces[k][2], length), return_index=True, return_inverse=True, return_counts=True)
        once = np.zeros(len(inverse), bool)
        once[where] = True
        keep[begin[k] : begin[k] + counts[k]] = once
        twice = np.concatenate(([0], (n > 1)[inverse].astype(np.int8), [0]))
        owner, base, _ = pieces[k]
        repeats += [(owner, base + int(x), base + int(y) - 1) for x, y in zip(np.flatnonzero(np.diff(twice) == 1), np.flatnonzero(np.diff(twice) == -1), strict=True)]
    start, at, piece = start[keep], at[keep], piece[keep]
    if not len(start):
        return tuple(np.zeros(0, np.int64) for _ in range(5)), repeats
    cut = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1) | (piece[1:] != piece[:-1]))))
    stop = np.append(cut[1:], len(start)) - 1
    shift = np.array([b for _, b, _ in pieces])[piece[cut]] - first[piece[cut]]
    owner = np.array([o for o, _, _ in pieces])[piece[cut]]
    return (owner, value[at[cut]].view(np.int64), at[cut] + shift, start[cut] + shift, start[stop] + shift), repeats


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which `known` bytes are not read."""
    most, at = min(len(a), len(b)), known
    while at < most:
        x, y = a[at : at + 64], b[at : at + 64]
        if x == y:
            at += len(x)
            continue
        k = min(len(x), len(y))
        odd = int.from_bytes(x[:k], "big") ^ int.from_bytes(y[:k], "big")
        return min(most, at + k - (odd.bit_length() + 7) // 8) if odd else at + k
    return most


def front_coded(strings: list[bytes]) -> tuple[list[int], list[bytes]]:
    """(common prefix with the string before, what follows it) of sorted strings."""
    prefixes, tails, last = [], [], b""
    for s in strings:
        k = common_prefix(last, s)
        prefixes.append(k)
        tails.append(s[k:])
        last = s
    return prefixes, tails


def merged(runs: list[tuple[list[int], list[bytes]]]):
    """Merges front-coded sorted runs: yields (run, position in it, common prefix with the last one put out).

    A loser tree over the runs' heads. Each node keeps its loser and the loser's common prefix with the
    winner that passed it; of two heads the one with the longer prefix is smaller, and only heads with
    equal prefixes are compared, from there on.
    """
    k = len(runs)
    place, head = [0] * k, [r[1][0] if r[1] else None for r in runs]
    losers, prefix = [-1] * k, [0] * k

    def duel(a: int, la: int, b: int, lb: int):
        """(winner, its prefix, loser, its prefix); both prefixes are with the last string put out."""
        if head[a] is None:
            return b, lb, a, la
        if head[b] is None:
            return a, la, b, lb
        if la != lb:
            return (a, la, b, lb) if la > lb else (b, lb, a, la)
        x, y = head[a], head[b]
        h = common_prefix(x, y, la)
        if x[h : h + 1] < y[h : h + 1] or (x[h : h + 1] == y[h : h + 1] and a < b):
            return a, la, b, h
        return b, lb, a, h

    def build(node: int) -> tuple[int, int]:
        if node >= k:
            return node - k, 0
        a, la = build(2 * node)
        b, lb = build(2 * node + 1)
        w, lw, losers[node], prefix[node] = duel(a, la, b, lb)
        return w, lw

    if not k:
        return
    w, lw = build(1) if k > 1 else (0, 0)
    while head[w] is not None:
        yield w, place[w], lw
        place[w] += 1
        heads, tails = runs[w]
        if place[w] < len(tails):
            lw = heads[place[w]]
            head[w] = head[w][:lw] + tails[place[w]]
        else:
            head[w], lw = None, 0
        node = (w + k) // 2
        while node:
            w, lw, losers[node], prefix[node] = duel(w, lw, losers[node], prefix[node])
            node //= 2


def repeated_offsets(right: np.ndarray, rank: np.ndarray, lefts: list[bytes], low: np.ndarray, high: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """marks[i, o]: whether member i's window that starts o bytes before its anchor equals another member's.

    right: common prefixes of neighbours in right order; rank: each member's place in that order; lefts:
    reversed texts before the anchors; low, high: the offsets that a member owns.
    """
    m = len(lefts)
    order = sorted(range(m), key=lefts.__getitem__)
    left = np.fromiter((common_prefix(lefts[a], lefts[b]) for a, b in zip(order[:-1], order[1:], strict=True)), np.int64, max(0, m - 1))
    place = np.empty(m, np.int64)
    place[order] = np.arange(m)
    marks = np.zeros((m, length + 1), bool)
    for o in range(int(low.min()), int(high.max()) + 1):
        own = np.flatnonzero((low <= o) & (o <= high))
        if len(own) < 2:
            continue
        by_right = np.concatenate(([0], np.cumsum(right < length - o)))[rank[own]]
        by_left = np.concatenate(([0], np.cumsum(left < o)))[place[own]]
        both = by_right * m + by_left
        s = np.argsort(both, kind="stable")
        same = both[s][1:] == both[s][:-1]
        marks[own[s], o] = np.concatenate((same, [False])) | np.concatenate(([False], same))
    return marks


def _packed(rows) -> bytes:
    import pickle

    import pyarrow as pa

    raw = pickle.dumps(rows, protocol=5)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(blob: bytes):
    import pickle

    import pyarrow as pa

    return pickle.loads(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True))


def _runs(rows, parts: int, length: int):
    """(part, blob): sorted front-coded runs of ((d1, d2, a, s, e), right, left) rows, one blob a part."""
    by_part: dict[int, list] = {}
    for part, *row in rows:
        by_part.setdefault(part, []).append(row)
    for part, held in sorted(by_part.items()):
        held.sort(key=lambda r: r[1])
        prefixes, tails = front_coded([r[1] for r in held])
        yield part, _packed((prefixes, tails, [r[2] for r in held], [r[0] for r in held]))


MARKS = "d1 long, d2 long, lo int, hi int"


def repeated_windows(df: DataFrame, length: int = LENGTH, gram: int = GRAM, part_bytes: int = PART_BYTES, hot: int = HOT_ROWS) -> DataFrame:
    """Window starts [lo, hi] of (d1, d2) that repeat; df has d1, d2 and text."""
    spark = df.sparkSession
    docs = df.select("d1", "d2", F.col("text").cast("string").alias("text"))

    def find(batches):
        import pyarrow as pa

        for b in batches:
            owner, key, a, s, e, repeats = anchors(utf8(b.column(2)), length, gram)
            rep = np.array(repeats, np.int64).reshape(-1, 3)
            who = pa.array(np.concatenate((owner, rep[:, 0])).astype(np.int64))
            ints = [pa.array(np.concatenate(x).astype(np.int32)) for x in ((a, np.full(len(rep), -1)), (s, rep[:, 1]), (e, rep[:, 2]))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(who), b.column(1).take(who), pa.array(np.concatenate((key, np.zeros(len(rep), np.int64)))), *ints], ["d1", "d2", "key", "a", "s", "e"])

    found = written(docs.mapInArrow(find, "d1 long, d2 long, key long, a int, s int, e int"), "anchors")
    local = found.filter("a < 0").select("d1", "d2", F.col("s").alias("lo"), F.col("e").alias("hi"))
    shared = found.filter("a >= 0").groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    some = written(found.filter("a >= 0").join(shared, "key"), "shared-anchors")
    total = some.agg(F.coalesce(F.sum(F.col("e") - F.col("s") + length), F.lit(0))).first()[0]
    parts = max(2 * spark.sparkContext.defaultParallelism, total // part_bytes)
    lists = some.groupBy("d1", "d2").agg(F.collect_set(F.struct("key", "a", "s", "e", (F.col("n") > hot).alias("hot"))).alias("at"))
    filled = spark.sparkContext.broadcast(bloom_bits(some.select(F.col("d1").alias("k"))))

    def only(batches):
        for b in batches:
            hit = bloom_hit(filled.value, b.column(0).to_numpy(zero_copy_only=False))
            yield b.take(np.flatnonzero(hit)) if not hit.all() else b

    picked = docs.mapInArrow(only, "d1 long, d2 long, text string").join(lists, ["d1", "d2"])

    def cut(batches, want_hot=False):
        for b in batches:
            texts, d1, d2 = utf8(b.column(2)), b.column(0).to_pylist(), b.column(1).to_pylist()
            for t, x, y, at in zip(texts, d1, d2, b.column(3).to_pylist(), strict=True):
                for r in at:
                    if r["hot"] == want_hot:
                        yield x, y, r["key"], r["a"], r["s"], r["e"], t

    def write_runs(batches):
        import pyarrow as pa

        def out(held):
            got = list(_runs(held, parts, length))
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in got], pa.int32()), pa.array([x for _, x in got], pa.binary())], ["part", "blob"])

        held, size = [], 0
        for key, x, y, a, s, e, t in batches:  # t: the text from s to e + length
            held.append((key % parts, (x, y, a, s, e), t[a - s :], t[: a - s][::-1]))
            size += len(t)
            if size >= RUN_BYTES:
                yield out(held)
                held, size = [], 0
        if held:
            yield out(held)

    def merge(pdf):
        import pandas as pd

        runs, lefts, who = [], [], []
        for blob in pdf.blob:
            prefixes, tails, left, rows = _unpacked(blob)
            runs.append((prefixes, tails))
            lefts.append(left)
            who.append(rows)
        got = list(merged(runs))
        rows = np.array([who[r][i] for r, i, _ in got], np.int64)
        d1, d2, a, s, e = rows.T
        marks = repeated_offsets(np.array([p for _, _, p in got], np.int64)[1:], np.arange(len(got)), [lefts[r][i] for r, i, _ in got], a - e, a - s, length)
        edge = np.diff(np.pad(marks.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        m, begin = np.nonzero(edge == 1)
        _, stop = np.nonzero(edge == -1)
        return pd.DataFrame({"d1": d1[m], "d2": d2[m], "lo": (a[m] - stop + 1).astype(np.int32), "hi": (a[m] - begin).astype(np.int32)})

    def of_texts(batches):
        yield from write_runs((key, x, y, a, s, e, t[s : e + length]) for x, y, key, a, s, e, t in cut(batches))

    def of_contexts(batches):
        yield from write_runs(row for b in batches for row in zip(*[c.to_pylist() for c in b.columns], strict=True))

    runs = picked.mapInArrow(of_texts, "part int, blob binary")
    if not shared.filter(F.col("n") > hot).isEmpty():
        def contexts(batches):
            import pyarrow as pa

            for b in batches:
                rows = [(key, x, y, a, s, e, t[s : e + length]) for x, y, key, a, s, e, t in cut([b], True)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(_kinds())], CONTEXT)

        few, whole = _split(written(picked.mapInArrow(contexts, ", ".join(f"{c} {k}" for c, k in zip(CONTEXT, CONTEXT_TYPES, strict=True))), "contexts"), length, gram, hot)
        runs = runs.unionByName(few.select(*CONTEXT).mapInArrow(of_contexts, "part int, blob binary"))
        local = local.unionByName(whole)
    return local.unionByName(runs.groupBy("part").applyInPandas(merge, MARKS))


#: An anchor with the text that its windows cover; `class` is what all that meet in a task have in common.
CONTEXT = ["class", "d1", "d2", "a", "s", "e", "bytes"]
CONTEXT_TYPES = ["long", "long", "long", "int", "int", "int", "binary"]


def _kinds():
    import pyarrow as pa

    return [{"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[k] for k in CONTEXT_TYPES]


def _split(rows: DataFrame, length: int, gram: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """(contexts in classes of at most `hot`, marks): contexts of hot anchors, split by offset; and those that repeat whole."""
    top = length - gram + 1  # offsets are 0 .. top - 1
    few = whole = None
    size = top
    while True:
        size = -(-size // 2)

        def cells(batches, size=size):
            import hashlib

            import pyarrow as pa

            for b in batches:
                out = []
                for key, x, y, a, s, e, t in zip(*[c.to_pylist() for c in b.columns], strict=True):
                    for o1 in range((a - e) // size * size, a - s + 1, size):
                        o2 = min(o1 + size, top) - 1
                        lo, hi = max(s, a - o2), min(e, a - o1)
                        at = a - s  # the anchor's place in t
                        name = hashlib.blake2b(b"%d %d %d " % (key, size, o1) + t[at - o1 : at + length - o2], digest_size=24).digest()
                        part = t[lo - s : hi - s + length]
                        out.append((int.from_bytes(name[:8], "little", signed=True), x, y, a, lo, hi, part, hashlib.blake2b(name + b"%d %d " % (a - lo, a - hi) + part, digest_size=32).digest()))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate([*_kinds(), pa.binary()])], [*CONTEXT, "context"])

        kinds = ", ".join(f"{c} {k}" for c, k in zip([*CONTEXT, "context"], [*CONTEXT_TYPES, "binary"], strict=True))
        found = written(rows.select(*CONTEXT).mapInArrow(cells, kinds), "cells")
        per = written(found.groupBy("context").agg(F.count(F.lit(1)).alias("n"), F.first(F.struct(*CONTEXT)).alias("r")), "distinct-contexts")
        marks = found.join(per.filter("n > 1").select("context"), "context").select("d1", "d2", F.col("s").alias("lo"), F.col("e").alias("hi"))
        classes = written(per.groupBy("r.class").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "classes")
        own = per.select("r.*").join(classes, "class")
        small = own.filter(F.col("m") <= hot)
        few, whole = (small, marks) if few is None else (few.unionByName(small), whole.unionByName(marks))
        rows = own.filter(F.col("m") > hot)
        if size == 1 or classes.filter(F.col("m") > hot).isEmpty():
            return few, whole


def covered(intervals, length: int) -> list[tuple[int, int]]:
    """Byte ranges [lo, hi + length) of window starts [lo, hi], joined where they meet."""
    out: list[list[int]] = []
    for lo, hi in sorted(intervals):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi + length)
        else:
            out.append([lo, hi + length])
    return [(a, b) for a, b in out]


def remove_repeats(df: DataFrame, length: int = LENGTH, gram: int = GRAM, part_bytes: int = PART_BYTES, hot: int = HOT_ROWS, with_text: bool = False, id_col="doc_id", text_col="text") -> DataFrame:
    """One row for each input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, has_repeat, spans (and the bytes kept, `kept`).

    has_repeat: whether the text lost a byte.

    Texts are UTF-8 bytes, null is empty; texts shorter than `length` lose nothing. Rows that repeat a text
    are copies of each other like any others, also under one id. An empty input gives an empty result;
    other columns are ignored.
    """
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    docs = docs.select("doc_id", F.xxhash64("text", "doc_id").alias("d1"), F.xxhash64("doc_id", "text", F.lit(7)).alias("d2"), "text")
    marks = repeated_windows(docs, length, gram, part_bytes, hot)
    marks = written(marks.groupBy("d1", "d2").agg(F.collect_set(F.struct("lo", "hi")).alias("marks")), "marks")
    filled = spark.sparkContext.broadcast(bloom_bits(marks.select(F.col("d1").alias("k"))))

    def measured(batches):
        import hashlib

        import pyarrow as pa

        for b in batches:
            texts = utf8(b.column(3))
            hit = bloom_hit(filled.value, b.column(1).to_numpy(zero_copy_only=False))
            sha = [hashlib.sha256(t).hexdigest() for t in texts]
            kept = [t if h or with_text else None for t, h in zip(texts, hit, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([len(t) for t in texts], pa.int64()), pa.array(sha), pa.array(kept, pa.binary())], ["doc_id", "d1", "d2", "n_bytes", "sha", "bytes"])

    rows = docs.mapInArrow(measured, "doc_id long, d1 long, d2 long, n_bytes long, sha string, bytes binary")

    def finish(batches):
        import hashlib

        import pyarrow as pa

        for b in batches:
            out = []
            for n, sha, t, at in zip(*(b.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True):
                spans = covered([(m["lo"], m["hi"]) for m in at], length) if at else []
                if spans:
                    ends = [0, *[x for s in spans for x in s], n]
                    t = b"".join(t[x:y] for x, y in zip(ends[::2], ends[1::2], strict=True))
                    sha = hashlib.sha256(t).hexdigest()
                out.append((n, sum(y - x for x, y in spans), len(spans), sha, [{"lo": x, "hi": y} for x, y in spans], t if with_text else None))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(list(c), k) for c, k in zip(cols, types, strict=True)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    out = rows.join(marks, ["d1", "d2"], "left").select("doc_id", "n_bytes", "sha", "bytes", "marks")
    out = out.mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<lo:long,hi:long>>, kept binary")
    out = out.withColumn("has_repeat", F.col("n_removed") > 0)
    return out if with_text else out.drop("kept")


def op3_suffix_dedup(spark, sf_dir):
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")


#: The contract by brute force as DuckDB SQL: every window of every text, which suits small tables.
OP3_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS MATERIALIZED (SELECT rid, i, md5(substr(h, 2 * i + 1, {2 * LENGTH})) AS m FROM (SELECT rid, h, unnest(range(n - {LENGTH - 1})) AS i FROM d WHERE n >= {LENGTH})),
s AS (SELECT rid, i, CASE WHEN i <= lag(i) OVER o + {LENGTH} THEN 0 ELSE 1 END AS fresh FROM w JOIN (SELECT m FROM w GROUP BY m HAVING count(*) > 1) USING (m) WINDOW o AS (PARTITION BY rid ORDER BY i)),
g AS (SELECT rid, i, sum(fresh) OVER (PARTITION BY rid ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM s),
p AS (SELECT rid, k, min(i) AS lo, max(i) + {LENGTH} AS hi FROM g GROUP BY rid, k),
q AS (SELECT *, coalesce(lag(hi) OVER (PARTITION BY rid ORDER BY k), 0) AS before FROM p),
c AS (SELECT rid, sum(hi - lo)::BIGINT AS n_removed, count(*) AS n_spans, max(hi) AS last, string_agg(substr(h, 2 * before + 1, 2 * (lo - before)), '' ORDER BY k) AS front FROM q JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(CASE WHEN c.rid IS NULL THEN h ELSE front || substr(h, 2 * last + 1) END)) AS kept_sha256, coalesce(n_removed, 0) > 0 AS has_repeat
FROM d LEFT JOIN c ON c.rid = d.rid"""
