"""Awkward tables that the tests of several operators share."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n, stem="abcdefghij"):
    return " ".join("".join(rng.choice(stem) for _ in range(rng.randint(1, 6))) for _ in range(n))


def awkward_rows():
    """Nulls in any column, empty and very long texts, ties and rows that repeat."""
    rng = random.Random(5)
    long = sentence(rng, 30_000)
    base = sentence(rng, 120)
    other = base.split()
    other[60] = "changed"
    rows = [
        (1, base, "en", "a", 5), (2, base, "en", "a", 5), (2, base, "en", "a", 5), (3, " ".join(other), "en", "b", 5), (4, base.upper(), None, None, None),
        (5, None, "en", "a", None), (6, "", "fr", "b", 0), (7, " \t\n ", "fr", None, 3), (None, base, "en", "a", 5), (None, None, None, None, None), (None, "alone here", "en", "c", 1),
        (8, long, "en", "a", 9), (9, long + " tail", "en", "b", 9), (10, "x", "en", "a", 1), (11, "x", "fr", "b", 1), (12, "Ünïcödé ßtraße 漢字 \U0001f600", "de", "a", 2),
        (13, "1234 !!! 5678", "en", "a", 2), (14, "a b c d", "en", "c", 2), (15, base + " " + base, "en", "a", 2), (16, sentence(rng, 50), "en", "c", 2), (16, sentence(rng, 50), "en", "c", 2),
    ]
    return rows


def as_rows(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=str)
