"""Operator 7: SentencePiece encoding and decoding over a relational lattice.

Texts fall into units (a run of word marks and what follows it, up to the next mark, tab or line end):
no piece of such a vocabulary crosses a unit's border, so a text's ids are its units' ids in order.

Spark explodes every substring of a unit up to the longest piece, equi-joins the substrings to the piece table,
groups the edges by unit and folds each unit's lattice with the higher-order function `aggregate`: Viterbi for
unigram models, the merges in the model's order for BPE models (whose ids the best-scoring path does not give).

`encode` and `round_trip` do so for the most frequent units of the corpus, as many as a broadcast dictionary of
DICTIONARY entries holds; tasks then walk through whole texts, and fold a unit outside the dictionary where they
meet it, by the same rules. `encode_relational` does it for every unit and joins the ids back to the texts.
"""

from __future__ import annotations

import heapq
import re
import struct
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framegrain.llm.common import written
from framegrain.llm.textstats import let

MARK = "▁"
#: Characters that no piece contains (checked when a model is read); each is a unit of its own.
BLANK = "\t\n"
UNIT = f"{MARK}+[^{MARK}{BLANK}]*|[^{MARK}{BLANK}]+|[{BLANK}]"
DICTIONARY = 1 << 17
#: Parts, by hash, of the units that occur equally often, when not all of them fit.
GRAINS = 1_024
#: Units that a task remembers besides the dictionary: the first ones that it meets, so mostly frequent ones.
REMEMBERED = 100_000
#: Unit length beyond which merges are replayed with a heap, by the tasks: the fold in Spark grows with the cube of the length.
LONG = 40
#: An edge from i to j has the key i * SPAN + j; units in the lattice are shorter.
SPAN = 1 << 15
#: Characters of text whose units are folded together.
CHUNK = 1 << 20


class Model(NamedTuple):
    pieces: list[str]
    scores: list[float]
    kinds: list[int]  # 1 normal, 2 unknown, 3 control, 4 user defined, 5 unused, 6 byte
    unigram: bool
    prefix: bool
    squeeze: bool

    @property
    def unknown(self) -> int:
        return self.kinds.index(2)

    @property
    def first_byte(self) -> int | None:
        return self.kinds.index(6) if 6 in self.kinds else None

    def usable(self) -> dict[str, tuple[int, float]]:
        """Pieces that encoding can give, with id and score."""
        return {p: (i, s) for i, (p, s, k) in enumerate(zip(self.pieces, self.scores, self.kinds, strict=True)) if k in (1, 4)}


def _fields(raw: bytes):
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value = varint()
        else:
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            value = raw[at : at + size]
            at += size
        yield tag >> 3, value


def load_model(raw: bytes) -> Model:
    """A model from the bytes of its file. Only identity normalisation is supported."""
    pieces, trainer, normalizer = [], {}, {}
    for number, value in _fields(raw):
        if number == 1:
            pieces.append(dict(_fields(value)))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normalizer = dict(_fields(value))
    if normalizer.get(2):
        raise NotImplementedError("only identity normalisation is supported")
    model = Model(
        [p[1].decode() for p in pieces], [struct.unpack("<f", p.get(2, b"\0\0\0\0"))[0] for p in pieces], [p.get(3, 1) for p in pieces],
        trainer.get(3, 1) == 1, bool(normalizer.get(3, 1)), bool(normalizer.get(4, 1)),
    )
    if any(re.search(f"[^{MARK}]{MARK}|[{BLANK}]", p) for p, k in zip(model.pieces, model.kinds, strict=True) if k in (1, 4)):
        raise NotImplementedError("a piece crosses the border of units")
    return model


def read_model(spark: SparkSession, path: str) -> Model:
    """A model file that Spark reads, from any file system."""
    return load_model(bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]))


def marked(text: str, model: Model) -> str:
    if model.squeeze:
        text = re.sub(" +", " ", text).strip(" ")
    return (MARK if model.prefix else "") + text.replace(" ", MARK) if text else ""


# --- the fold in tasks -------------------------------------------------------------------------------------


def merge_fold(unit: str, scores: dict[str, float]) -> list[str]:
    """Merges neighbours into the piece of the highest score, the leftmost first, until none is left."""
    parts = list(unit)
    if len(parts) > LONG:
        return _heap_fold(parts, scores)
    get, none = scores.get, float("-inf")
    ready = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
    while ready:
        best = max(ready)
        if best == none:
            break
        k = ready.index(best)
        joined = parts[k] = parts[k] + parts.pop(k + 1)
        del ready[k]
        if k < len(ready):
            ready[k] = get(joined + parts[k + 1], none)
        if k:
            ready[k - 1] = get(parts[k - 1] + joined, none)
    return parts


def _heap_fold(parts: list[str], scores: dict[str, float]) -> list[str]:
    n = len(parts)
    after, before = [*range(1, n), -1], [-1, *range(n - 1)]
    heap: list = []

    def offer(a):
        b = after[a]
        if b >= 0:
            got = scores.get(parts[a] + parts[b])
            if got is not None:
                heapq.heappush(heap, (-got, a, parts[a], parts[b]))

    for a in range(n - 1):
        offer(a)
    while heap:
        _, a, x, y = heapq.heappop(heap)
        b = after[a] if parts[a] == x else -1
        if b < 0 or parts[b] != y or not x:
            continue
        parts[a], parts[b] = x + y, ""
        after[a] = after[b]
        if after[b] >= 0:
            before[after[b]] = a
        if before[a] >= 0:
            offer(before[a])
        offer(a)
    return [p for p in parts if p]


def viterbi_fold(unit: str, usable: dict, longest: int, penalty: float) -> list[str]:
    """The path of the highest total score; a character without a piece costs `penalty`."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for j in range(1, len(unit) + 1):
        top = None
        for i in range(max(0, j - longest), j):
            got = usable.get(unit[i:j])
            score = got[1] if got else penalty if i == j - 1 else None
            if score is not None and (top is None or best[i][0] + score > top[0]):
                top = (best[i][0] + score, i)
        best.append(top)
    out, j = [], len(unit)
    while j:
        out.append(unit[best[j][1] : j])
        j = best[j][1]
    return out[::-1]


def unit_ids(parts: list[str], usable: dict, model: Model) -> list[int]:
    out = []
    for p in parts:
        if p in usable:
            out.append(usable[p][0])
        elif model.first_byte is None:
            out.append(model.unknown)
        else:
            out += [model.first_byte + b for b in p.encode()]
    return out


#: Symbols from here on stand for characters without a piece.
LOOSE = 1 << 21


class Merges(NamedTuple):
    """Every way to join two symbols (pieces by id, other characters as LOOSE + code point) to a piece."""

    keys: np.ndarray  # left << 32 | right, sorted
    made: np.ndarray
    score: np.ndarray
    symbol: np.ndarray  # of each code point


def merge_table(model: Model) -> Merges:
    usable = model.usable()
    symbol = np.arange(LOOSE, LOOSE + 0x110000, dtype=np.int32)
    for p, (i, _) in usable.items():
        if len(p) == 1:
            symbol[ord(p)] = i
    name = lambda x: usable[x][0] if x in usable else int(symbol[ord(x)]) if len(x) == 1 else None
    rows = []
    for p, (i, score) in usable.items():
        for k in range(1, len(p)):
            left, right = name(p[:k]), name(p[k:])
            if left is not None and right is not None:
                rows.append((left << 32 | right, i, score))
    rows.sort()
    keys, made, score = zip(*rows, strict=True) if rows else ((-1,), (0,), (0.0,))
    return Merges(np.array(keys, np.int64), np.array(made, np.int32), np.array(score), symbol)


def merge_many(units: list[str], table: Merges) -> dict[str, bytes]:
    """merge_fold of many units at once: ids (int32, as bytes) of those whose parts are all pieces.

    Units of one length are rows of a matrix of symbols; each step joins the best pair of every row.
    """
    none, out = float("-inf"), {}

    def pairs(left, right):
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(table.keys, key)
        at[at == len(table.keys)] = 0
        hit = (table.keys[at] == key) & (right >= 0)
        return np.where(hit, table.score[at], none), table.made[at]

    by_length: dict[int, list[str]] = {}
    for u in units:
        by_length.setdefault(len(u), []).append(u)
    for width, group in by_length.items():
        parts = table.symbol[np.frombuffer("".join(group).encode("utf-32-le", "surrogatepass"), np.uint32)].reshape(-1, width)
        names, done = np.arange(len(group)), []
        if width > 1:
            score, made = pairs(parts[:, :-1], parts[:, 1:])
            columns = np.arange(width)
        while width > 1 and len(names):
            k = score.argmax(axis=1)
            row = np.arange(len(names))
            live = score[row, k] > none
            done.append((names[~live], parts[~live]))
            names, parts, score, made, k = names[live], parts[live], score[live], made[live], k[live]
            row = row[: len(names)]
            parts[row, k] = made[row, k]
            # Close the gap behind the joined symbol and its pair.
            parts = np.take_along_axis(parts, np.minimum(columns + (columns > k[:, None]), width - 1), axis=1)
            parts[:, -1] = -1
            gap = np.minimum(columns[:-1] + (columns[:-1] >= k[:, None]), width - 2)
            score, made = np.take_along_axis(score, gap, axis=1), np.take_along_axis(made, gap, axis=1)
            score[:, -1] = none
            for shift in (0, -1):
                at = k + shift
                ok = (at >= 0) & (at < width - 1)
                r, c = row[ok], at[ok]
                score[r, c], made[r, c] = pairs(parts[r, c], parts[r, c + 1])
        if width == 1:
            done.append((names, parts))
        for who, rows in done:
            whole = (rows < LOOSE).all(axis=1)
            ends = (rows >= 0).sum(axis=1) * 4
            raw = np.ascontiguousarray(rows, "<i4").tobytes()
            for j in np.flatnonzero(whole).tolist():
                out[group[who[j]]] = raw[j * width * 4 : j * width * 4 + ends[j]]
    return out


class Units(dict):
    """Ids (int32, as bytes) of a unit. What the dictionary lacks is folded, and remembered while there is room."""

    def __init__(self, model: Model, known: dict[str, bytes], table: Merges | None = None):
        super().__init__(known)
        self.model, self.usable, self.most, self.table = model, model.usable(), len(known) + REMEMBERED, table
        self.longest = max(map(len, self.usable))
        self.penalty = min(model.scores[i] for i, _ in self.usable.values()) - 10.0
        self.score = {p: s for p, (_, s) in self.usable.items()}

    def __missing__(self, unit: str) -> bytes:
        parts = viterbi_fold(unit, self.usable, self.longest, self.penalty) if self.model.unigram else merge_fold(unit, self.score)
        ids = np.array(unit_ids(parts, self.usable, self.model), "<i4").tobytes()
        if len(unit) <= LONG and len(self) < self.most:
            self[unit] = ids
        return ids

    def of_texts(self, texts: list[list[str]]) -> list[bytes]:
        """Ids of texts that are given as their units."""
        fresh = {}
        if self.table is not None and not self.model.unigram:
            fresh = merge_many([u for u in set().union(*texts) if u not in self and len(u) <= LONG], self.table)
            room = max(0, self.most - len(self))
            self.update(fresh if len(fresh) <= room else dict(list(fresh.items())[:room]))
        if all(u in self for u in fresh):
            return [b"".join([self[u] for u in t]) for t in texts]
        return [b"".join([fresh[u] if u in fresh else self[u] for u in t]) for t in texts]


# --- the relational lattice --------------------------------------------------------------------------------


def units_of(text: Column, model: Model) -> Column:
    """The units of a text, in order."""
    if model.squeeze:
        text = F.btrim(F.regexp_replace(text, " +", " "), F.lit(" "))
    text = F.translate(F.concat(F.lit(" " if model.prefix else ""), text), " ", MARK)
    return F.regexp_extract_all(text, F.lit(UNIT), F.lit(0))


def frequent_units(df: DataFrame, model: Model, text_col: str, dictionary: int = DICTIONARY) -> DataFrame:
    """(unit): the most frequent units of at most LONG characters; all of them, where they fit into `dictionary` rows.

    Where to cut is read off a histogram of the counts' logarithms (some thousand rows at any size), and inside the grade that
    does not fit whole, off one of the units' hashes in GRAINS parts: what stays free is about one part of that grade.
    """
    units = df.filter(F.length(F.col(text_col)) > 0).select(F.explode(units_of(F.col(text_col), model)).alias("unit"))
    counts = written(units.groupBy("unit").agg(F.count(F.lit(1)).alias("n")).filter(F.length("unit") <= LONG), "units")
    grade, grain = F.floor(64 * F.log2("n")), F.pmod(F.xxhash64("unit"), F.lit(GRAINS))
    held, cut = 0, None
    for g, n in counts.groupBy(grade.alias("g")).agg(F.count(F.lit(1)).alias("m")).orderBy(F.desc("g")).collect():
        if held + n > dictionary:
            cut = g
            break
        held += n
    if cut is None:
        return counts.select("unit")
    last = -1
    for g, n in counts.filter(grade == cut).groupBy(grain.alias("g")).agg(F.count(F.lit(1)).alias("m")).orderBy("g").collect():
        if held + n > dictionary:
            break
        held, last = held + n, g
    return counts.filter((grade > cut) | (grade == cut) & (grain <= last)).select("unit")


def _merge_lattice(n: Column, edges: Column) -> Column:
    """Borders of the pieces: those that remain when merges have removed all others they can."""
    tables = F.struct(F.transform(edges, lambda e: e["i"] * SPAN + e["j"]).alias("keys"), F.transform(edges, lambda e: e["score"]).alias("scores"))

    def fold(t: Column) -> Column:
        def step(borders: Column, _: Column) -> Column:
            score = lambda b, k: F.get(t["scores"], F.array_position(t["keys"], b * SPAN + F.get(borders, k + 2)).cast("int") - 1)
            pairs = F.transform(F.slice(borders, F.lit(1), F.greatest(F.size(borders) - 2, F.lit(0))), lambda b, k: F.struct(score(b, k).alias("score"), (-k).alias("at")))
            return let(F.array_max(pairs), lambda best: F.when(best["score"].isNull(), borders).otherwise(F.array_remove(borders, F.get(borders, 1 - best["at"]))))

        return F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), F.sequence(F.lit(0), n), step)

    return let(tables, fold)


def _viterbi_lattice(n: Column, edges: Column, penalty: float) -> Column:
    """Borders of the pieces on the path of the highest total score; ties go to the longer last piece."""
    start = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("from")))

    def step(best: Column, j: Column) -> Column:
        ends = F.filter(edges, lambda e: e["j"] == j)
        alone = F.struct((F.get(best, j - 1)["score"] + penalty).alias("score"), (1 - j).alias("back"))
        paths = F.transform(ends, lambda e: F.struct((F.get(best, e["i"])["score"] + e["score"]).alias("score"), (-e["i"]).alias("back")))
        single = F.exists(ends, lambda e: e["i"] == j - 1)
        top = F.array_max(F.when(single, paths).otherwise(F.concat(paths, F.array(alone))))
        return F.concat(best, F.array(F.struct(top["score"].alias("score"), (-top["back"]).alias("from"))))

    best = F.aggregate(F.sequence(F.lit(1), n), start, step)
    back = lambda b: F.aggregate(F.sequence(F.lit(1), n), F.array(n), lambda a, _: F.when(F.get(a, 0) == 0, a).otherwise(F.concat(F.array(F.get(b, F.get(a, 0))["from"]), a)))
    return F.element_at(F.transform(F.array(best), back), 1)


def lattice_ids(units: DataFrame, model: Model) -> DataFrame:
    """(unit, ids) for distinct units, which should be short: the fold of one grows with the cube of its length."""
    spark, usable = units.sparkSession, model.usable()
    table = spark.createDataFrame([(p, i, float(s)) for p, (i, s) in usable.items()], "piece string, id int, score double")
    longest = max(map(len, usable))
    spread = units.select("unit", F.length("unit").alias("n")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    spread = spread.withColumn("j", F.explode(F.sequence(F.col("i") + 1, F.least(F.col("n"), F.col("i") + longest))))
    edges = spread.withColumn("piece", F.substring("unit", F.col("i") + 1, F.col("j") - F.col("i"))).join(F.broadcast(table), "piece")  # the vocabulary
    lattice = edges.groupBy("unit").agg(F.collect_list(F.struct("i", "j", "score", "id")).alias("edges"))
    lattice = units.join(lattice, "unit", "left").withColumn("edges", F.coalesce("edges", F.array().cast("array<struct<i:int,j:int,score:double,id:int>>")))
    n = F.length("unit")
    wide = F.filter("edges", lambda e: e["j"] - e["i"] > 1)
    borders = _viterbi_lattice(n, F.col("edges"), min(s for _, s in usable.values()) - 10.0) if model.unigram else _merge_lattice(n, wide)

    def bytes_of(char: Column) -> Column:
        if model.first_byte is None:
            return F.array(F.lit(model.unknown))
        code = F.hex(F.encode(char, "UTF-8"))
        return F.transform(F.sequence(F.lit(1), F.length(code), F.lit(2)), lambda k: F.conv(F.substring(code, k, F.lit(2)), 16, 10).cast("int") + model.first_byte)

    tables = F.struct(borders.alias("b"), F.transform("edges", lambda e: e["i"] * SPAN + e["j"]).alias("keys"), F.transform("edges", lambda e: e["id"]).alias("ids"))

    def piece_ids(t: Column) -> Column:
        def one(i: Column, k: Column) -> Column:
            j = F.get(t["b"], k + 1)
            known = F.get(t["ids"], F.array_position(t["keys"], i * SPAN + j).cast("int") - 1)
            return let(known, lambda x: F.when(x.isNotNull(), F.array(x)).otherwise(bytes_of(F.substring("unit", i + 1, j - i))))

        return F.flatten(F.transform(F.slice(t["b"], F.lit(1), F.size(t["b"]) - 1), one))

    return lattice.select("unit", let(tables, piece_ids).alias("ids"))


# --- whole texts -------------------------------------------------------------------------------------------


#: Rows of an Arrow batch that are in Python at once.
SLICE = 256


def _slices(batches):
    for b in batches:
        for at in range(0, b.num_rows, SLICE):
            yield b.slice(at, SLICE)


def parts_of(text: str, size: int = CHUNK):
    """A marked text in parts that end where a unit ends; a part is longer than `size` where its last unit is."""
    begin = re.compile(f"(?<=[^{MARK}]){MARK}")
    at = 0
    while at < len(text):
        cut = begin.search(text, at + size) if at + size < len(text) else None
        stop = cut.start() if cut else len(text)
        yield text[at:stop]
        at = stop


class Encoder:
    """What tasks need to encode: the model, the dictionary and the table of merges."""

    def __init__(self, df: DataFrame, model: Model, text_col: str, dictionary: int):
        units = frequent_units(df, model, text_col, dictionary)
        table = lattice_ids(units, model).toArrow()  # at most `dictionary` rows
        lists = table["ids"].combine_chunks()
        ends, flat = 4 * lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<i4").tobytes()
        known = {u: flat[x:y] for u, x, y in zip(table["unit"].to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True)}
        self.held = df.sparkSession.sparkContext.broadcast((model, known, None if model.unigram else merge_table(model)))

    def __call__(self):
        """A function from texts to their ids (int32, as bytes)."""
        units, find = Units(*self.held.value), re.compile(UNIT).findall

        def ids(texts: list) -> list[bytes]:
            found, part, size = [], [], 0
            for t in texts:
                t = marked(t, units.model) if t else ""
                if len(t) > 2 * CHUNK:
                    found += units.of_texts(part) if part else []
                    found.append(b"".join(units.of_texts([find(p)])[0] for p in parts_of(t)))
                    part, size = [], 0
                    continue
                part.append(find(t))
                size += len(t)
                if size >= CHUNK:
                    found += units.of_texts(part)
                    part, size = [], 0
            return found + units.of_texts(part) if part else found

        return ids


def _id_lists(found: list[bytes]):
    import pyarrow as pa

    ends = np.concatenate(([0], np.cumsum([len(x) // 4 for x in found]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), "<i4")))


def _piece_bytes(model: Model) -> list[bytes]:
    return [bytes([i - model.first_byte]) if k == 6 else b"" if k in (2, 3) else p.replace(MARK, " ").encode() for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True))]


def _decoder(raw: list[bytes], prefix: bool):
    """A function from an array of ids to UTF-8 bytes."""
    pieces = np.empty(len(raw), object)
    pieces[:] = raw

    def text(ids: np.ndarray) -> bytes:
        t = b"".join(pieces[ids].tolist())
        return t[1:] if prefix and t[:1] == b" " else t

    return text


def encode(df: DataFrame, model: Model, text_col: str = "text", ids_col: str = "ids", dictionary: int = DICTIONARY) -> DataFrame:
    """df with the column `ids_col` (array of int): the ids of each whole text.

    Null and empty texts have no ids. Other columns pass through, except one that is named like `ids_col`,
    which is replaced. Repeated rows are encoded alike; an empty input gives an empty result.
    """
    encoder = Encoder(df, model, text_col, dictionary)
    columns = [c for c in df.columns if c != ids_col]
    at = columns.index(text_col)

    def task(batches):
        import pyarrow as pa

        ids = encoder()
        for b in _slices(batches):
            yield pa.RecordBatch.from_arrays([*b.columns, _id_lists(ids(b.column(at).to_pylist()))], [*columns, ids_col])

    return df.select(*columns).mapInArrow(task, df.select(*columns).schema.add(ids_col, T.ArrayType(T.IntegerType())))


def encode_relational(df: DataFrame, model: Model, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """The same as `encode` with the ids of every unit joined back by unit instead of looked up in a dictionary.

    Each distinct unit is folded once: in the lattice, or beyond LONG characters by a task. Occurrences travel to
    the units and back to their texts, so this moves the texts several times.
    """
    columns = [c for c in df.columns if c != ids_col]
    rows = written(df.select(F.monotonically_increasing_id().alias("_row"), F.struct(*columns).alias("_all"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")), "rows")
    placed = rows.filter("_text != ''").select("_row", F.posexplode(units_of(F.col("_text"), model)).alias("_at", "unit"))
    distinct = placed.select("unit").distinct()
    held = df.sparkSession.sparkContext.broadcast(model)

    def fold(batches):
        import pyarrow as pa

        known = Units(held.value, {})
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _id_lists([known[u] for u in b.column(0).to_pylist()])], ["unit", "ids"])

    short = F.length("unit") <= LONG
    ids = written(lattice_ids(distinct.filter(short), model).unionByName(distinct.filter(~short).mapInArrow(fold, "unit string, ids array<int>")), "unit-ids")
    found = placed.join(ids, "unit").groupBy("_row").agg(F.collect_list(F.struct("_at", "ids")).alias("_ids"))
    found = found.select("_row", F.flatten(F.transform(F.sort_array("_ids"), lambda x: x["ids"])).alias(ids_col))
    return rows.join(found, "_row", "left").select("_all.*", F.coalesce(ids_col, F.array().cast("array<int>")).alias(ids_col))


def decode(df: DataFrame, model: Model, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """df with the column `text_col`: the text of each row's ids.

    Null and empty lists give the empty text. Control and unknown ids give nothing; ids outside the
    vocabulary fail. Bytes that form no character become U+FFFD.
    """
    columns = [c for c in df.columns if c != text_col]
    at = columns.index(ids_col)
    held = df.sparkSession.sparkContext.broadcast((_piece_bytes(model), model.prefix))

    def task(batches):
        import pyarrow as pa

        text = _decoder(*held.value)
        for b in _slices(batches):
            ids = b.column(at)
            ends, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False)
            out = [text(flat[x:y]).decode("utf-8", "replace") for x, y in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [*columns, text_col])

    return df.select(*columns).mapInArrow(task, df.select(*columns).schema.add(text_col, T.StringType()))


def round_trip(df: DataFrame, model: Model, keep: list[str], text_col: str = "text", dictionary: int = DICTIONARY) -> DataFrame:
    """The columns `keep`, n_ids, ids, and round_trip: whether decoding the ids gives the text, word marks as spaces.

    The same as encode, decode and a comparison, in one pass over the texts. Null counts as the empty text.
    """
    encoder = Encoder(df, model, text_col, dictionary)
    raw = df.sparkSession.sparkContext.broadcast((_piece_bytes(model), model.prefix))
    schema = df.select(*keep).schema.add("n_ids", T.IntegerType()).add("ids", T.ArrayType(T.IntegerType())).add("round_trip", T.BooleanType())

    def task(batches):
        import pyarrow as pa

        ids, text = encoder(), _decoder(*raw.value)
        for b in _slices(batches):
            texts = b.column(len(keep)).to_pylist()
            found = ids(texts)
            same = [text(np.frombuffer(x, "<i4")) == (t or "").replace(MARK, " ").encode() for x, t in zip(found, texts, strict=True)]
            lists = _id_lists(found)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array([len(x) // 4 for x in found], pa.int32()), lists, pa.array(same)], [*keep, "n_ids", "ids", "round_trip"])

    return df.select(*keep, F.col(text_col).alias("_text")).mapInArrow(task, schema)


def default_model_path() -> str:
    import public_tokenizers

    return f"file://{public_tokenizers.path('piece_bpe_32k.model')}"


def op7_sentencepiece(spark, sf_dir, path: str | None = None):
    model = read_model(spark, path or default_model_path())
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), model, ["doc_id"])
