"""Brute-force versions and odd rows that several tests share."""

import collections
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOREM = " ".join(f"word{i}x" for i in range(60))
#: Null ids, texts and sources, empty and blank texts, repeated rows, ties, one long text, and columns whose names operators use inside.
ODD = [
    (1, LOREM, "en", "a"), (2, LOREM, "en", "a"), (2, LOREM, "en", "a"), (3, LOREM.upper(), "en", None), (None, LOREM + " tail", None, "b"), (None, None, None, None),
    (4, None, "en", "a"), (5, "", "en", "a"), (5, "", "en", "a"), (6, " \n\t ", "de", "b"), (7, "one", "de", "b"), (8, "one", "de", "b"), (9, "a b c d", "de", "b"),
    (10, "lang " + " ".join(f"w{i % 997}" for i in range(20_000)), "de", "b"), (11, "ÄÖ é 🙂 ▁ x y", "fr", "é"), (12, "x" * 5_000, "fr", "é"), (13, "ab " * 700, "fr", "z"),
]


def words(t):
    return WORD.findall(t or "")


def shingles(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near_groups(texts):
    sets = [shingles(t) for t in texts]
    links, parent = [0] * len(sets), list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    return links, [root(i) for i in range(len(sets))]


def lowered(t):
    return (t or "").encode().lower()  # bytes.lower changes A-Z only


def base_stats(t):
    w = words(t)
    n = len(w)
    grams = collections.Counter(tuple(w[i : i + 5]) for i in range(n - 4))
    repeated = {k for i in range(n - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(repeated)
