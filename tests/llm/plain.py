"""Plain-Python versions of what the operators compute, and odd documents to try them on."""

from __future__ import annotations

import collections
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, size long, kept string, word string, rid string, hash int, "
          "score string, row string, cell int, id long, n long, target string, slot string, h string, x string, label string, key long, component string")
EXTRA = ("z", "z", "z", "z", 1, "z", "z", 1, 1, 1, "z", "z", "z", "z", "z", 1, "z")


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def fold(doc_id) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5


def odd_rows() -> list[tuple]:
    base = " ".join(f"w{i}" for i in range(60))
    texts = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, None), (4, base, "en", "b"), (4, base, "en", "b"),
        (5, base + " tail", "en", "b"), (None, base, "en", "b"), (None, None, None, None), (6, "x" * 50_000, "fr", None),
        (7, " ".join(["lorem ipsum dolor sit amet"] * 4000), "la", "c"), (8, "one two", "en", "c"), (9, "ONE two", "en", "c"),
        (10, "é ü ß 漢字 😀 don't <|endoftext|> a<|b", "fr", "d"), (11, "12 34 !!", "en", "d"), (12, "line one here\nline one here\n\nother", "en", "d"),
        (13, base.upper(), "en", "e"), (14, "  ", "en", "e"), (15, base.replace("w3 ", "v3 "), "en", ""),
    ]
    return [(i, t, lang, src, None if t is None else len(t), 7, *EXTRA[1:]) for i, t, lang, src in texts]


def odd_docs(spark, rows=None):
    rows = odd_rows() if rows is None else rows
    return spark.createDataFrame([r[: len(SCHEMA.split(","))] for r in rows], SCHEMA)


def shingles(text: str | None) -> frozenset:
    w = words((text or "").translate(SMALL))
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


class Groups:
    """Union-find whose root is the smallest member."""

    def __init__(self):
        self.of = {}

    def find(self, x):
        self.of.setdefault(x, x)
        while self.of[x] != x:
            self.of[x] = self.of[self.of[x]]
            x = self.of[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.of[max(a, b)] = min(a, b)


def near_duplicates(rows) -> dict:
    """(n_shingles, component) by doc_id, by all pairs that share a shingle."""
    sets = {i: shingles(t) for i, t in rows}
    having = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            having[x].append(i)
    groups = Groups()
    for i, s in sets.items():
        shared = collections.Counter(j for x in s for j in having[x] if j > i)
        for j, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                groups.join(i, j)
    return {i: (len(s), groups.find(i)) for i, s in sets.items()}


def base_rules(text: str | None) -> tuple:
    t = text or ""
    w = words(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    at = collections.defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    inside = {k for starts in at.values() if len(starts) > 1 for i in starts for k in range(i, i + 8)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(inside), len(w) < 20 or 100 * len(inside) > 30 * len(w))
