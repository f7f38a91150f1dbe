"""Strings, paths, dates, hashes, JSON and maps of governance tables, as column expressions."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(text: Column, fallback: str = "unnamed") -> Column:
    """White space and characters outside [A-Za-z0-9._-] to single underscores, none at the ends."""
    joined = F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9._-]+", "_"), "_+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(joined, "^[._]+|[._]+$", ""), F.lit("")), F.lit(fallback))


def uri_parts(uri: Column) -> Column:
    """struct(store, path, leaf) of a URI: without scheme, doubled and trailing separators."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(uri, "^[a-zA-Z][a-zA-Z0-9+.-]*://", ""), "/+", "/"), "/$", "")
    parts = F.split(bare, "/")
    return F.struct(F.element_at(parts, 1).alias("store"), F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), "/").alias("path"), F.element_at(parts, -1).alias("leaf"))


def hyperlink(formula: Column, label: bool = False) -> Column:
    """Target or label of a spreadsheet HYPERLINK formula; doubled quotes stand for one."""
    found = F.regexp_extract(formula, '(?i)HYPERLINK\\(\\s*"((?:[^"]|"")*)"\\s*[,;]\\s*"((?:[^"]|"")*)"', 2 if label else 1)
    return F.nullif(F.replace(found, F.lit('""'), F.lit('"')), F.lit(""))


def last_date(name: Column) -> Column:
    """The last YYYYMMDD in a name that is a date."""
    found = F.filter(F.transform(F.regexp_extract_all(name, F.lit("(?<![0-9])(20[0-9]{6})(?![0-9])"), F.lit(1)), lambda d: F.try_to_date(d, "yyyyMMdd")), lambda d: d.isNotNull())
    return F.get(found, F.size(found) - 1)


def dated_from(name: Column, least: str) -> Column:
    """Whether the date in the name is `least` (YYYYMMDD) or later; undated names fail, an empty `least` passes all."""
    return F.lit(True) if not least else F.coalesce(F.date_format(last_date(name), "yyyyMMdd") >= least, F.lit(False))


def without_affixes(name: Column, prefixes: list[str]) -> Column:
    """The name without a leading robot prefix and a trailing date."""
    heads = "|".join(prefixes)
    return F.regexp_replace(F.regexp_replace(name, f"^(?:{heads})[_-]", "") if prefixes else name, "[_-]20[0-9]{6}$", "")


def byte_size(n: Column) -> Column:
    """IEC units with two decimals, halves to even; plain bytes below 1024."""
    units = ("B", "KiB", "MiB", "GiB", "TiB", "PiB")
    out = F.format_string("%d B", n)
    for k, u in enumerate(units[1:], 1):
        out = F.when(n >= 1 << (10 * k), F.format_string(f"%.2f {u}", F.bround(n / float(1 << (10 * k)), 2))).otherwise(out)
    return out


def record_id(*parts: Column, length: int = 16) -> Column:
    """Leading hex digits of sha256 over NUL-joined parts; null parts are empty."""
    joined = F.concat_ws("\x00", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.substring(F.sha2(joined, 256), 1, length)


def canonical(value) -> str:
    """JSON with sorted keys and without spaces."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def fingerprint(*values) -> str:
    return hashlib.sha256("\0".join(canonical(v) for v in values).encode()).hexdigest()


def canonical_map(m: Column) -> Column:
    """A map's JSON with keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))


def pairs(text: Column) -> Column:
    """`k=v,k=v` as a map; a part without `=` or without key fails."""
    wrong = F.exists(F.split(text, ","), lambda p: ~p.rlike("^[^=]+="))
    return F.when(wrong, F.raise_error(F.concat(F.lit("not k=v: "), text)).cast("map<string,string>")).otherwise(F.str_to_map(text, F.lit(","), F.lit("=")))


def number_at(m: Column, key: str) -> Column:
    """A number under a key of a string map; null for absent keys, other text and booleans."""
    return F.try_element_at(m, F.lit(key)).try_cast("double")


def classified(text: Column, words: dict[str, list[str]], unknown: str | None = "unknown") -> Column:
    """The first class one of whose words the text contains, whatever the case; unknown=None fails instead."""
    low, out = F.lower(text), None
    for name, keys in words.items():
        hit = low.rlike("|".join(keys))
        out = (F if out is None else out).when(hit, F.lit(name))
    return out.otherwise(F.lit(unknown) if unknown is not None else F.raise_error(F.concat(F.lit("unclassified: "), text)).cast("string"))


def layout(path: Column) -> Column:
    """struct(station, task, batch, episode) from a path of three, four or five parts; shorter ones have no station."""
    p = F.split(path, "/")
    n = F.size(p)
    part = lambda k: F.when(n + k >= 0, F.get(p, n + k))
    return F.struct(F.when(n >= 5, part(-5)).alias("station"), F.when(n >= 4, part(-4)).alias("task"), part(-3).alias("batch"), part(-2).alias("episode"))


def structure(paths: Column) -> Column:
    """Kind of a collection from its relative paths: empty, flat, nested, partial or mixed."""
    deep, partial = F.exists(paths, lambda p: p.contains("/")), F.exists(paths, lambda p: p.endswith(".partial"))
    return F.when(F.size(paths) == 0, "empty").when(partial, "partial").when(~deep, "flat").when(F.forall(paths, lambda p: p.contains("/")), "nested").otherwise("mixed")


def collection_name(date: Column, period: Column, outcome: Column) -> Column:
    return F.concat_ws("_", F.date_format(date, "MMdd"), F.lower(period), F.lower(outcome))


def collapsed(name: Column) -> Column:
    """A signal's name with each run of digits as one `#`, so that numbered signals fall together."""
    return F.regexp_replace(name, "[0-9]+", "#")
