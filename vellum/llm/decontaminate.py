"""Benchmark decontamination by pigeonhole edit matching.

An item of ``m`` characters may occur with up to ``k = floor(rate * m)`` edits. Cut into ``k + 1`` pieces, at
least one piece of such an occurrence is unchanged. An Aho-Corasick automaton finds all exact piece
hits in one pass over a document; around the hits of an item, Myers' bit-parallel algorithm computes the
smallest edit distance between the item and any substring.

Texts are compared lower-cased with runs of white space as one blank. An item under ``min_chars`` characters is too
short to tell an edited copy from chance: it has budget 0 and counts only between characters that are no letter or
digit. Items are handled in blocks whose text is bounded (``block_chars``), so what is broadcast and what a task
holds is bounded however large the benchmark is. One block needs one narrow pass over the documents, without a
shuffle; of more, each is a pass of its own that writes its hits, which are then joined with the documents.

Cases: null and empty texts are clean; null and blank items match nothing; very long texts are searched whole; equal
items tie and the smallest ``item_id`` is named, a null one last; items with equal ids count once in a block; a null ``doc_id``,
repeated rows and other columns pass through; an empty table gives an empty result, an empty benchmark leaves all
documents clean; an item beyond ``block_chars`` makes a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, bound_batches

MATCH = "items long, item_id long, distance int"


def normalise(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """``budget + 1`` pieces of nearly equal length, with their offsets."""
    n, cuts = len(item), budget + 1
    bounds = [n * i // cuts for i in range(cuts + 1)]
    return [(a, item[a:b]) for a, b in zip(bounds, bounds[1:], strict=False) if a < b]


def myers(item: str, text: str) -> int:
    """Smallest edit distance between ``item`` and any substring of ``text``."""
    m = len(item)
    full, high, peq = (1 << m) - 1, 1 << (m - 1), {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    plus, minus, score, best = full, 0, m, m
    for c in text:
        eq = peq.get(c, 0)
        x = eq | minus
        h = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | (full & ~(h | plus)), plus & h
        if up & high:
            score += 1
        elif down & high:
            score -= 1
            best = min(best, score)
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | (full & ~(x | up)), up & x
    return best


class Matcher:
    """The automaton of a block of items. ``items``: ``(item_id, normalised text)``."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float, min_chars: int):
        import ahocorasick

        self.items = [(i, t, int(rate * len(t)) if len(t) >= min_chars else -1) for i, t in items]  # -1: whole words only
        self.automaton, found = ahocorasick.Automaton(), {}
        for n, (_, text, budget) in enumerate(self.items):
            for at, piece in pieces(text, max(budget, 0)):
                found.setdefault(piece, []).append((n, at))
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        if found:
            self.automaton.make_automaton()
        self.empty = not found

    def matches(self, text: str) -> dict[int | None, int]:
        """Distance by item id, for the items within their budget."""
        if self.empty or not text:
            return {}
        spans: dict[int, list[list[int]]] = {}
        out: dict[int | None, int] = {}
        for end, (length, where) in self.automaton.iter(text):
            for n, at in where:
                key, item, budget = self.items[n]
                if budget < 0:
                    if not (text[end - length : end - length + 1].isalnum() and end >= length) and not text[end + 1 : end + 2].isalnum():
                        out[key] = 0
                    continue
                start = end - length + 1 - at  # of the item, had nothing been inserted or deleted
                a, b = max(0, start - budget), min(len(text), start + len(item) + budget)
                own = spans.setdefault(n, [])
                if own and a <= own[-1][1]:
                    own[-1][0], own[-1][1] = min(own[-1][0], a), max(own[-1][1], b)
                else:
                    own.append([a, b])
        for n, own in spans.items():
            key, item, budget = self.items[n]
            d = min(0 if item in text[a:b] else myers(item, text[a:b]) for a, b in own)
            if d <= budget:
                out[key] = min(d, out.get(key, d))
        return out


def _blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int | None, str]]]:
    """The items, a block after another; the driver holds one block at a time."""
    block, size = [], 0
    for r in benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long"), "text").toLocalIterator():
        if text := normalise(r["text"]):
            if block and size + len(text) > block_chars:
                yield block
                block, size = [], 0
            block.append((r["item_id"], text))
            size += len(text)
    if block:
        yield block


def _match(df: DataFrame, text: Column, block: list[tuple[int | None, str]], rate: float, min_chars: int) -> Column:
    """``MATCH`` of a text: the number of items found, and the id and distance of the closest one."""
    shared = df.sparkSession.sparkContext.broadcast(block)

    @F.pandas_udf(MATCH)
    def match(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(shared.value, rate, min_chars)
        for series in texts:
            rows = []
            for text in series:
                found = matcher.matches(normalise(text)) if text else {}
                d, _, i = min((d, i is None, i) for i, d in found.items()) if found else (None, None, None)
                rows.append((len(found), i, d))
            yield pd.DataFrame({"items": [r[0] for r in rows], "item_id": pd.array([r[1] for r in rows], "Int64"), "distance": pd.array([r[2] for r in rows], "Int32")})

    return match(text)


def _key(text: Column) -> Column:
    """128 bits for a text, null as empty."""
    own = F.coalesce(text, F.lit(""))
    return F.struct(F.xxhash64(own), F.xxhash64(F.lit(1), own))


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.05, min_chars: int = 25, block_chars: int = 4_000_000) -> DataFrame:
    """``_row``, a struct of the columns of ``docs``, with ``_leak``: the number of items found, and the id and distance of the closest one."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.struct("*").alias("_row"))
    text = F.col("_row.text").cast("string")
    blocks = _blocks(benchmark, block_chars)
    block, more = next(blocks, []), next(blocks, None)
    if more is None:
        return rows.withColumn("_leak", _match(rows, text, block, rate, min_chars))
    ws, parts = Workspace(docs.sparkSession, "leaks"), []
    keyed = docs.select(_key(F.col("text").cast("string")).alias("k"), F.col("text").cast("string").alias("text"))
    for k, own in enumerate(chain([block, more], blocks)):
        hits = keyed.withColumn("m", _match(keyed, F.col("text"), own, rate, min_chars)).where("m.items > 0")
        parts.append(ws.write(hits.select("k", F.col("m.items").alias("items"), "m.distance", "m.item_id").distinct(), f"hits-{k}"))
    hits = reduce(DataFrame.unionByName, parts).groupBy("k").agg(F.sum("items").alias("items"), F.min(F.struct("distance", F.col("item_id").isNull().alias("no_id"), "item_id")).alias("best"))
    hits = ws.write(hits.select("k", F.struct("items", "best.item_id", "best.distance").alias("_found")), "hits")
    ws.keep("hits")
    none = F.struct(F.lit(0).cast("long").alias("items"), F.lit(None).cast("long").alias("item_id"), F.lit(None).cast("int").alias("distance"))
    joined = rows.withColumn("_k", _key(text)).join(hits.hint("merge"), F.col("_k") == F.col("k"), "left")
    return joined.select("_row", F.coalesce("_found", none).alias("_leak"))


def leak_report(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """``doc_id, contaminated, items, item_id, distance`` for each document."""
    found = find_leaks(docs.select("doc_id", "text"), benchmark, **params)
    return found.select("_row.doc_id", (F.col("_leak.items") > 0).alias("contaminated"), "_leak.items", "_leak.item_id", "_leak.distance")


def remove_leaks(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """The documents without any benchmark item, with their columns."""
    return find_leaks(docs, benchmark, **params).where("_leak.items = 0").select("_row.*")
