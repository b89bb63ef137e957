"""Language identification by cross-parsing entropy.

The suffix automaton of a language's labelled text accepts exactly the substrings of that text. A document is
parsed greedily: each phrase is the longest match in the labelled text from where the last one ended. A
language needs ``c`` phrases for ``n`` symbols; ``c * log2(N) / n``, with ``N`` symbols of labelled text, estimates
the cross entropy in bits a symbol, and the language with the smallest wins.

The automata are trained on a bounded sample: whole documents of moderate length, in the order of a hash of
their id, up to ``chars`` symbols for each language. Where a language has too few of them, the beginnings of its longer
documents follow, then its shorter ones. They become one dense table ``(state, symbol) -> (state,
phrases ended)``, so that numpy parses thousands of blocks of text in lockstep, for all languages at once. Whole
texts are parsed, in blocks of ``BLOCK`` symbols; a phrase ends with its block.

Symbols are lower-cased letters; each run of anything else is one separator, so digits and punctuation carry no
weight. The ``SINGLE`` most frequent letters of all samples are a symbol each; any other letter is ``OTHER`` and ``DIGITS``
symbols for its code point, so no letter is merged with another, whatever the script.

Cases: null texts and texts without a letter are ``und`` with score 0; so is everything if nothing is labelled; very long
texts are parsed whole; ties go to the first language by name; repeated rows are judged alike; an empty table gives an
empty result; null or repeated ids and other columns do no harm (a null id is never in training).
"""

from __future__ import annotations

import functools
import math
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bound_batches

SYMBOLS, OTHER, PAD, BLOCK, LOCKSTEP = 64, 62, 63, 256, 8192
SINGLE, DIGITS = 45, 6  # the symbols between SINGLE and OTHER are the 16 digits of a code point
PARTS = 40  # by hash, in which short texts are ranked
POINTS = 0x110000


@functools.lru_cache(1)
def letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: is it a letter; is it a letter or a mark."""
    kinds = np.fromiter((ord(unicodedata.category(chr(i))[0]) for i in range(POINTS)), np.uint8, POINTS)
    return kinds == ord("L"), (kinds == ord("L")) | (kinds == ord("M"))


class SuffixAutomaton:
    """Online construction; ``next[s]`` maps symbols to states, state 0 is the root."""

    def __init__(self, symbols: list[int]):
        self.next, self.link, self.length = [{}], [-1], [0]
        last = 0
        for c in symbols:
            cur = self._add({}, self.length[last] + 1, 0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                if self.length[q] == self.length[p] + 1:
                    self.link[cur] = q
                else:
                    clone = self._add(dict(self.next[q]), self.length[p] + 1, self.link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = clone
                        p = self.link[p]
                    self.link[q] = self.link[cur] = clone
            last = cur

    def _add(self, edges: dict[int, int], length: int, link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1


def alphabet(texts: list[str]) -> dict[int, int]:
    """Symbols 1 to ``SINGLE`` for the most frequent lower-cased letters."""
    count = Counter(c for t in texts for c in t.lower() if unicodedata.category(c)[0] in "LM")
    return {ord(c): i + 1 for i, (c, _) in enumerate(sorted(count.items(), key=lambda x: (-x[1], x[0]))[:SINGLE])}


@functools.lru_cache(1)
def lower_case() -> np.ndarray:
    """For each code point, that of its lower-case letter."""
    out = np.arange(POINTS, dtype=np.uint32)
    for i in np.flatnonzero(letters()[1]):
        out[i] = ord(chr(i).lower()[0])
    return out


def symbol_table(symbols: dict[int, int]) -> np.ndarray:
    """Symbol of each code point: 0 for what is no letter, the lower-case letter's for a letter."""
    return _symbol_table(tuple(sorted(symbols.items())))


@functools.lru_cache(4)
def _symbol_table(pairs: tuple[tuple[int, int], ...]) -> np.ndarray:
    symbols, known = dict(pairs), letters()[1]
    table = np.where(known, OTHER, 0).astype(np.uint8)
    for i in np.flatnonzero(known):
        table[i] = symbols.get(int(lower_case()[i]), OTHER)
    return table


def encode(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts, how many each text has, and which texts have a letter."""
    raw = [t.encode("utf-32-le", "surrogatepass") for t in texts]
    size = np.array([len(r) // 4 for r in raw], np.int64)
    points = np.frombuffer(b"".join(raw), "<u4")
    owner = np.repeat(np.arange(len(texts)), size)
    symbols = table[points]
    has_letter = np.zeros(len(texts), bool)
    has_letter[owner[letters()[0][points]]] = True
    keep = np.ones(len(symbols), bool)  # of a run of separators, the first of a text stays
    keep[1:] = (symbols[1:] != 0) | (symbols[:-1] != 0) | (owner[1:] != owner[:-1])
    symbols, points, owner = symbols[keep], points[keep], owner[keep]
    rare = symbols == OTHER
    if rare.any():
        times = np.where(rare, DIGITS + 1, 1)
        at = (np.cumsum(times) - times)[rare]
        symbols, owner = np.repeat(symbols, times), np.repeat(owner, times)
        code = lower_case()[points[rare]]
        for k in range(DIGITS):
            symbols[at + 1 + k] = SINGLE + 1 + (code >> np.uint32(4 * (DIGITS - 1 - k)) & np.uint32(15))
    return symbols, np.bincount(owner, minlength=len(texts)), has_letter


class Model:
    """The automata of all languages as one table; ``bits[l]`` is log2 of a language's labelled symbols."""

    def __init__(self, samples: dict[str, list[str]], chars: int):
        self.langs = sorted(samples)
        self.symbols = alphabet([t for lang in self.langs for t in samples[lang]])
        table, parts, self.roots, self.bits, base = symbol_table(self.symbols), [], [], [], 0
        for lang in self.langs:
            text: list[int] = []
            for t in samples[lang]:
                if len(text) < chars:
                    text += [*encode([t], table)[0].tolist(), 0]
            sam = SuffixAutomaton(text)
            parts.append(self._dense(sam, base))
            self.roots.append(base)
            self.bits.append(math.log2(len(text) + 2))
            base += len(sam.next)
        self.table = np.concatenate(parts).ravel() if parts else np.zeros(0, np.int32)

    @staticmethod
    def _dense(sam: SuffixAutomaton, base: int) -> np.ndarray:
        n = len(sam.next)
        own = np.full((n, SYMBOLS), -1, np.int64)
        for s, edges in enumerate(sam.next):
            for c, t in edges.items():
                own[s, c] = t
        root = own[0]
        # no edge: the phrase ends, and the symbol begins the next; an unseen symbol is a phrase of its own
        restart = np.where(root >= 0, (root + base) * 4 + 1, base * 4 + 2)
        out = np.where(own >= 0, (own + base) * 4, restart[None, :])
        out[0] = np.where(root >= 0, (root + base) * 4, base * 4 + 1)
        out[:, PAD] = (np.arange(n) + base) * 4
        return out.astype(np.int32)

    def phrases(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Phrases by language and text."""
        out = np.zeros((len(self.langs), len(sizes)), np.int64)
        blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(sizes)), blocks)
        starts = np.cumsum(sizes) - sizes
        number = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin = starts[owner] + number * BLOCK
        length = np.minimum(BLOCK, sizes[owner] - number * BLOCK)
        roots = np.array(self.roots, np.int32)[:, None]
        padded = np.concatenate([symbols, np.full(BLOCK, PAD, np.uint8)])
        for a in range(0, len(owner), LOCKSTEP):
            b, n = begin[a : a + LOCKSTEP], length[a : a + LOCKSTEP]
            steps = np.arange(BLOCK)
            grid = padded[b[None, :] + steps[:, None]]
            grid[steps[:, None] >= n[None, :]] = PAD
            grid = grid[: n.max(initial=0)].astype(np.int32)
            state = np.repeat(roots * 4, len(b), axis=1)
            count, ended = np.zeros_like(state), np.zeros_like(state)
            for row in grid:
                state <<= 4
                state += row
                state = self.table.take(state)
                np.bitwise_and(state, 3, out=ended)
                count += ended
                state -= ended
            count += state != roots * 4
            for k in range(len(self.langs)):
                out[k] += np.bincount(owner[a : a + LOCKSTEP], weights=count[k], minlength=len(sizes)).astype(np.int64)
        return out

    def predict(self, texts: list[str], table: np.ndarray) -> tuple[list[str], np.ndarray]:
        symbols, sizes, has_letter = encode(texts, table)
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        entropy = self.phrases(symbols, sizes) * np.array(self.bits)[:, None] / np.maximum(sizes, 1)
        best = entropy.argmin(axis=0)
        if len(self.langs) > 1:
            two = np.partition(entropy, 1, axis=0)
            score = np.where(two[1] > 0, 1 - two[0] / np.maximum(two[1], 1e-12), 0.0)
        else:
            score = np.ones(len(texts))
        return [self.langs[i] if ok else "und" for i, ok in zip(best, has_letter, strict=True)], np.where(has_letter, score, 0.0)


HELD_OUT = "coalesce(crc32(cast(cast(doc_id AS string) AS binary)) % 4 = 2, true)"


def train(labelled: DataFrame, chars: int = 20_000, least: int = 200, most: int = 6_000, documents: int = 100) -> Model:
    """Trains on a bounded sample of ``doc_id, text, lang``: of each language, up to ``chars`` symbols.

    ``documents`` rows of ``least`` to ``most`` characters come first, then the first ``most`` characters of as many
    longer ones, then shorter ones, each of which gives a symbol at least, so ``chars`` of them are enough.
    """
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").withColumn("_n", F.length("text"))
    langs = rows.select("lang").distinct().count()
    if langs > 128:
        raise ValueError(f"{langs} languages; the table of automata is bounded for 128")
    chars = min(chars, 320_000 // max(langs, 1))  # 160 MB for all languages together
    kind = F.when(F.col("_n").between(least, most), 0).when(F.col("_n") > most, 1).otherwise(2)
    # the row number limit is applied in each task before the exchange; Spark does so up to 1,000, hence the parts of short texts
    part = F.when(F.col("_kind") == 2, F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))).otherwise(0)
    order = Window.partitionBy("lang", "_kind", "_part").orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    rows = rows.where("_n > 0").select("doc_id", "lang", kind.alias("_kind"), F.substring("text", 1, most).alias("text")).withColumn("_part", part)
    pick = rows.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= max(chars // PARTS, documents))
    pick = pick.where(F.col("_k") <= F.when(F.col("_kind") == 2, chars // PARTS).otherwise(documents)).select("lang", "_kind", "_part", "_k", "text")
    samples: dict[str, list[str]] = {}
    for r in sorted(pick.collect(), key=lambda r: (r["lang"], r["_kind"], r["_part"], r["_k"])):
        samples.setdefault(r["lang"], []).append(r["text"])
    return Model(samples, chars)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, from the text alone."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        table = symbol_table(shared.value.symbols)
        for s in series:
            texts, langs, scores = [t or "" for t in s], [], []
            at = 0
            while at < len(texts):  # about a million characters at once
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) < 1_000_000):
                    size += len(texts[end])
                    end += 1
                lang, score = shared.value.predict(texts[at:end], table)
                langs += lang
                scores += score.tolist()
                at = end
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    return docs.withColumn("_p", predict(F.col("text").cast("string"))).withColumns({"lang_pred": F.col("_p.lang_pred"), "score": F.col("_p.score")}).drop("_p")


def language_report(docs: DataFrame) -> DataFrame:
    """Trains on documents outside the held-out fold and predicts all: ``doc_id, held_out, lang_pred, score``."""
    docs = docs.select("doc_id", "text", "lang").withColumn("held_out", F.expr(HELD_OUT))
    model = train(docs.where("NOT held_out"))
    return identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")
