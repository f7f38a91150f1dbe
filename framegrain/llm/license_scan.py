"""Operator 12: licences named in texts, exactly and with a bounded number of edits.

A text becomes its lower-cased words with one space between them. A notice that may have k edits is cut into k + 1 pieces:
one of them stands unchanged in whatever is within k edits of the notice (pigeonhole), so exact search for the pieces finds
every candidate place. Only there the regex library matches the notice with at most k edits, counts them and reports the
span. Whole texts are searched, in bytes; texts are independent, so Spark maps over them.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framegrain.llm.common import utf8


class Notice(NamedTuple):
    label: str
    exact: str  # words at the start that must stand unchanged
    fuzzy: str  # what follows them, within `errors` edits (characters put in, left out or replaced)
    errors: int


#: Phrases that count wherever their words stand in a row, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Short notices as their licences word them, and about one edit for each twelve characters.
NOTICES = (
    Notice("mit", "mit", " license", 1),
    Notice("mit", "", "permission is hereby granted free of charge to any person obtaining a copy of this software", 7),
    Notice("apache", "", "apache license", 1),
    Notice("apache", "", "licensed under the apache license version 2 0", 3),
    Notice("gpl", "gnu", " general public license", 2),
    Notice("gpl", "", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", 9),
    Notice("lgpl", "gnu", " lesser general public license", 2),
    Notice("agpl", "gnu", " affero general public license", 2),
    Notice("bsd", "", "redistribution and use in source and binary forms with or without modification are permitted", 7),
    Notice("isc", "", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 9),
    Notice("mpl", "", "subject to the terms of the mozilla public license", 4),
    Notice("cc-by", "", "creative commons attribution", 2),
    Notice("cc-by-nc", "cc by nc", "", 0),
    Notice("cc-by-sa", "cc by sa", "", 0),
    Notice("unlicense", "", "this is free and unencumbered software released into the public domain", 5),
)
#: A-Z lower-cased, other ASCII characters than letters and digits as spaces; bytes above 0x7F stay.
_PLAIN = bytes((c + 32 if 65 <= c <= 90 else c) if chr(c).isalnum() or c > 127 else 32 for c in range(256))
RESULT = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label: string, first_word: long, n_words: int, start: long, stop: long, edits: int>>"
)


def plain(text: bytes) -> tuple[bytes, np.ndarray]:
    """The words with one space before, between and after them, and which bytes of the text those between the outer spaces are."""
    flat = np.frombuffer(text.translate(_PLAIN), np.uint8)
    word = flat != 32
    kept = word.copy()
    kept[1:] |= word[:-1]  # one space behind each word
    return b" " + flat[kept].tobytes().rstrip(b" ") + b" ", kept


@lru_cache(maxsize=None)
def pieces(notice: Notice) -> tuple[tuple[int, bytes], ...]:
    """(offset in the notice, piece): errors + 1 pieces of the part that may be edited, or the exact part."""
    part, first = (notice.fuzzy, len(notice.exact)) if notice.fuzzy else (notice.exact, 0)
    cuts = [len(part) * i // (notice.errors + 1) for i in range(notice.errors + 2)]
    return tuple((first + a, part[a:b].encode()) for a, b in zip(cuts, cuts[1:], strict=False))


def _found(text: bytes, piece: bytes):
    at = text.find(piece)
    while at >= 0:
        yield at
        at = text.find(piece, at + 1)


def windows(text: bytes, notice: Notice) -> list[tuple[int, int]]:
    """Places, from space to space, that hold every span within the notice's edits. A character has four bytes at most."""
    slack, size = 4 * notice.errors + 1, len(notice.exact) + len(notice.fuzzy)
    around = sorted((at - offset - slack, at - offset + size + slack) for offset, piece in pieces(notice) for at in _found(text, piece))
    out: list[tuple[int, int]] = []
    for a, b in around:
        a, b = max(0, a), min(len(text) - 1, b)
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = out[-1][0], text.find(b" ", b)
        else:
            a, b = text.rfind(b" ", 0, a + 1), text.find(b" ", b)
            if out and a <= out[-1][1]:
                a = out.pop()[0]
            out.append((a, b))
    return out


@lru_cache(maxsize=None)
def _pattern(notice: Notice):
    import regex

    body = regex.escape(notice.exact, special_only=True) + (f"(?:{regex.escape(notice.fuzzy, special_only=True)}){{e<={notice.errors}}}" if notice.errors else notice.fuzzy)
    return regex.compile(rf"(?b)(?<![^ ]){body}(?![^ ])")


@lru_cache(maxsize=8_192)
def matches(window: str, notice: Notice) -> tuple[tuple[int, int, int], ...]:
    """(start, stop, edits) in a window: the span of fewest edits, the first of these, then those left and right of it."""
    out, todo = [], [(0, window)]
    while todo:
        at, part = todo.pop()
        found = _pattern(notice).search(part)
        if not found:
            continue
        a, b = found.span()
        a, b = a + len(part[a:b]) - len(part[a:b].lstrip(" ")), b - len(part[a:b]) + len(part[a:b].rstrip(" "))
        if b > a:
            out.append((at + a, at + b, sum(found.fuzzy_counts)))
            todo += [(at, part[:a]), (at + b, part[b:])]
    return tuple(sorted(out))


#: Bytes of a text that are counted as one when a place is sought.
_PART = 1 << 16


def _place(kept: np.ndarray, flags: np.ndarray, k: int) -> int:
    """Where the k-th kept byte stands; flags are running counts by part."""
    part = int(np.searchsorted(flags, k, "right"))
    before = int(flags[part - 1]) if part else 0
    return part * _PART + int(np.flatnonzero(kept[part * _PART : (part + 1) * _PART])[k - before])


def scan(text: bytes, notices: tuple[Notice, ...] = NOTICES, base: dict[str, str] = BASE) -> tuple:
    """What RESULT has of one text, without its id."""
    flat, kept = plain(text)
    n_words = 0 if flat == b"  " else flat.count(b" ") - 1
    if not n_words:
        return 0, 0, None, None, "", "", 0.0, []
    places = [(at, label) for phrase, label in base.items() for at in _found(flat, f" {phrase} ".encode())]
    spans = []
    for notice in notices:
        for a, b in windows(flat, notice):
            window = flat[a:b].decode()
            for start, stop, edits in matches(window, notice):
                lead = len(window[:start].encode())
                spans.append((notice, a + lead, a + lead + len(window[start:stop].encode()), edits))
    if not places and not spans:
        return n_words, 0, None, None, "", "", 0.0, []
    gaps = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)  # word k starts behind gap k
    flags = np.add.reduceat(kept, np.arange(0, len(kept), _PART), dtype=np.int64).cumsum()
    word = lambda at: int(np.searchsorted(gaps, at, "right")) - 1
    character = lambda at: int(np.count_nonzero((np.frombuffer(text, np.uint8, at) & 0xC0) != 0x80))
    starts = [word(at) for at, _ in places]
    named = sorted({label for _, label in places})
    rows = []
    for notice, a, b, edits in sorted(spans, key=lambda s: (s[1], s[2], s[0].label)):
        rows.append({"label": notice.label, "first_word": word(a), "n_words": word(b - 1) - word(a) + 1, "start": character(_place(kept, flags, a - 1)), "stop": character(_place(kept, flags, b - 2) + 1), "edits": edits})
    score = max([1.0] * bool(places) + [1 - edits / len(notice.exact + notice.fuzzy) for notice, *_, edits in spans])
    return n_words, len(places), min(starts, default=None), max(starts, default=None), ",".join(named), ",".join(sorted({*named, *(s[0].label for s in spans)})), score, rows


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """One row for each input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    base_*: places where a phrase of BASE stands word for word. labels adds the notices found within their edits; score is the
    share of the best of these that is unedited, 1 with any base phrase and 0 without any licence. A span has its words, its
    place in the text in code points (stop excluded) and its edits. Null and empty texts, and texts without a word, have no
    places, empty labels, null first_word and last_word and score 0. Null ids stay null; repeated rows each come back; other
    columns are ignored; an empty input gives an empty result.
    """
    def task(batches):
        import pyarrow as pa

        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        span = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()), ("edits", pa.int32())])
        for b in batches:
            columns = list(zip(*(scan(t, notices) for t in utf8(b.column(1))), strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(columns, [*kinds, pa.list_(span)], strict=True)]], ["doc_id", *names])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(task, RESULT)


def op12_license_scan(spark, sf_dir):
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The exact part of the result: all columns but labels, score and spans, which regular expressions with edits decide.
BASE_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
p(phrase, label) AS (VALUES (['gnu', 'general', 'public', 'license'], 'gpl'), (['apache', 'license'], 'apache'), (['cc', 'by'], 'cc-by'), (['mit', 'license'], 'mit')),
h AS (
    SELECT doc_id, label, unnest(list_filter(range(len(words)), lambda i: words[i + 1:i + len(phrase)] = phrase)) AS place
    FROM w, p WHERE list_has_all(words, phrase)
)
SELECT w.doc_id, len(words) AS n_words, count(place) AS n_base, min(place) AS first_word, max(place) AS last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels
FROM w LEFT JOIN h USING (doc_id) GROUP BY w.doc_id, words
"""
