"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is of characters, of order ``ORDER``, one for each value of lang. Characters rather than words, since they
judge words never seen. A symbol is a whole code point, of any script; only digits are one symbol, as are blanks.

1. *Packing.* One narrow pass packs the documents of a task into compressed chunks of one language and about ``CHUNK``
   characters. Labels are joined here: broadcast up to ``MOST_LABELS`` trusted ids, which are counted first, by a merge
   join beyond. Of trusted documents, every ``FOLDS``-th by a hash of its id is held out of training.
2. *Counting.* Each chunk gives its distinct n-grams, with their counts in text of training and a 0 for those that
   only occur elsewhere.
3. *Sharded joins.* Counts of lower orders are numbers of left extensions. By order, the n-grams of the corpus are
   joined with their counts and with their contexts' totals, all sharded by n-gram, which gives the
   interpolated probability of each n-gram that occurs, seen in training or not.
4. *Scoring.* The distinct n-grams of each chunk are joined with the sharded probabilities and meet the chunk in one
   task: each document gets its mean negative log probability a character. A task holds one chunk and its n-grams,
   the driver none; rows are n-grams of chunks, so they are fewer than characters and grow with the corpus.
5. *Words.* A word's surprise is its mean negative log probability a character, with the white space after it. The
   ``rare`` most surprising part of a language's held-out words sets the bound from which a word is odd. A mean over
   thousands of characters hides a few words that trusted text never has, such as insults; their share doesn't. Odd
   words within ``NEAR`` words of the one before count once: a sentence in another language is one odd place, scattered
   insults are many.
6. *Thresholds* are quantiles of held-out trusted documents, by language (of those of training where none is held out): of
   the perplexity and of the share of odd words, both at ``1 - reject / 4``, and of odd places to a word, at
   ``1 - reject / 2``; so about ``reject`` of trusted documents are over one of them. Perplexities are drawn towards the language's
   median as if ``prior`` more characters had it, and shares and places towards 0 by ``WORDS`` words, so that a short
   document isn't rejected for a few rare letters.

Cases: null and empty texts have no perplexity and are kept, as is everything without trusted text in its
language; a null language is a language of its own; a very long text is a chunk of its own, never cut; of repeated or
contradicting labels of a document, all must trust it; null ids are never trusted; documents that tie with a limit are
kept; repeated rows count as often as they occur; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import bz2
import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, bound_batches

ORDER, FOLDS, CHUNK, MOST_LABELS = 4, 3, 1 << 23, 2_000_000
WORDS = 100  # words without surprise that each document is given
LEVELS = 8  # of a word's surprise, for each nat
LEAST = 0.1  # of a discount, so that what was never seen has a probability
NEAR = 20  # words from the odd one before within which another is part of the same place
BLANK, BREAK, DIGIT = 32, 10, 48
PACKED = "chunk long, lang string, ids array<string>, keys array<long>, folds array<int>, sizes array<int>, texts binary"
GRAMS = "chunk long, lang string, gram string, n long"
SCORED = "lang string, id string, key long, fold int, chars long, nats double, words long, levels array<long>, places array<long>"


@functools.lru_cache(1)
def symbol_table() -> np.ndarray:
    """Symbol of each code point: itself, but for digits and white space; 0 stands before a text and for nothing else."""
    table = np.arange(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        kind = unicodedata.category(chr(i))[0]
        if kind in "NZ":
            table[i] = DIGIT if kind == "N" else BLANK
    table[[0, 9, 11, 12]] = BLANK
    table[13] = BREAK
    return table


def symbols(text: str) -> np.ndarray:
    return symbol_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]


def grams(own: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """For each symbol of all texts, the number of its n-gram, which ends with it; and the n-grams by number.

    N-grams are numbered in the order in which they first occur. Arrays are as narrow as their numbers allow.
    """
    pad, total = ORDER - 1, len(own)
    if not total:
        return np.zeros(0, np.int32), []
    inside = np.ones(total + pad * len(sizes), bool)
    before = np.cumsum(sizes) - sizes + pad * np.arange(len(sizes))
    for k in range(pad):
        inside[before + k] = False
    row = np.zeros(len(inside), np.uint32)
    row[inside] = own
    alphabet = np.flatnonzero(np.bincount(row))
    width = len(alphabet)
    number = np.zeros(alphabet[-1] + 1, np.uint16 if width < 1 << 16 else np.uint32)
    number[alphabet] = np.arange(width)
    single = number[row]
    code = single.astype(np.uint32 if width**ORDER < 1 << 32 else np.int64)
    for k in range(1, ORDER):
        if width * len(alphabet) >= 1 << 62:
            code, distinct = pd.factorize(code)
            width = len(distinct)
        high = single[:-k].astype(code.dtype)
        high *= code.dtype.type(width)
        code[k:] += high
        width *= len(alphabet)
    del single, high
    code, distinct = pd.factorize(code[inside])
    code = code.astype(np.int32)
    first = np.flatnonzero(np.diff(np.maximum.accumulate(code), prepend=np.int32(-1)) > 0)
    first = first + pad * (np.searchsorted(np.cumsum(sizes), first, side="right") + 1)
    text = row[first[:, None] + np.arange(-pad, 1)].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return code, [text[i : i + ORDER] for i in range(0, len(text), ORDER)]


def surprises(own: np.ndarray, nats: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Each text's number of words; its words by level of surprise, ``level << 32 | words``; and for each level that a
    word of it exceeds, how many places such words make, ``level << 32 | places``."""
    blank, ends = (own == BLANK) | (own == BREAK), np.cumsum(sizes)
    first = np.concatenate([[True], blank[:-1]]) if len(own) else np.zeros(0, bool)
    first[(ends - sizes)[sizes > 0]] = True  # white space ends a word, as does the end of a text
    at = np.flatnonzero(first)
    length = np.diff(np.append(at, len(own)))
    level = (np.add.reduceat(nats, at) * LEVELS / length).astype(np.int64) if len(at) else np.zeros(0, np.int64)
    letters = np.add.reduceat(~blank, at, dtype=np.int64) if len(at) else np.zeros(0, np.int64)
    owner = np.searchsorted(ends, at, side="right")
    kept = letters > 0  # further white space is no word
    owner, level = owner[kept], level[kept]
    pair, n = np.unique(owner << 32 | level, return_counts=True)
    cuts = np.searchsorted(pair >> 32, np.arange(1, len(sizes)))
    left, found = np.arange(len(level)), [np.zeros((0, 3), np.int64)]
    for bound in range(int(level.max(initial=-1))):
        left = left[level[left] > bound]
        new = np.ones(len(left), bool)
        new[1:] = (left[1:] > left[:-1] + NEAR) | (owner[left[1:]] != owner[left[:-1]])
        texts, places = np.unique(owner[left[new]], return_counts=True)
        found.append(np.stack([texts, np.full(len(texts), bound), places], axis=1))
    found = np.concatenate(found)
    found = found[np.argsort(found[:, 0], kind="stable")]
    ends = np.searchsorted(found[:, 0], np.arange(1, len(sizes)))
    return np.bincount(owner, minlength=len(sizes)), np.split((pair & 0xFFFFFFFF) << 32 | n, cuts), np.split(found[:, 1] << 32 | found[:, 2], ends)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """``_id`` of documents that all their labels trust (of good quality and not toxic), and ``_fold``: 1 to train, 2 held out."""
    good = F.coalesce((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0), F.lit(False))
    ids = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min(good.cast("int")).alias("_trusted"))
    fold = F.when(F.pmod(F.xxhash64("_id"), F.lit(FOLDS)) == 0, 2).otherwise(1)
    return ids.where("_trusted = 1").select("_id", fold.alias("_fold"))


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    task, made, open_, size = TaskContext.get().partitionId() << 32, 0, {}, {}

    def close(lang: str) -> pd.DataFrame:
        nonlocal made
        ids, keys, folds, texts = zip(*open_.pop(lang), strict=True)
        size.pop(lang)
        made += 1
        data = bz2.compress("".join(texts).encode("utf-8", "surrogatepass"))
        return pd.DataFrame({"chunk": [task | made], "lang": np.array([lang], object), "ids": [list(ids)], "keys": [list(keys)], "folds": [list(folds)], "sizes": [[len(t) for t in texts]], "texts": [data]})

    for batch in batches:
        for lang, *row, text in zip(*[batch[c] for c in ("lang", "id", "key", "fold", "text")], strict=True):
            open_.setdefault(lang, []).append((*row, text))
            size[lang] = size.get(lang, 0) + len(text) + 16
            if size[lang] >= CHUNK:
                yield close(lang)
            elif sum(size.values()) >= 2 * CHUNK:
                yield close(max(size, key=size.get))
    for lang in list(open_):
        yield close(lang)


def pack(docs: DataFrame, labels: DataFrame, ws: Workspace) -> DataFrame:
    """``PACKED`` chunks of all documents; null texts are empty. ``lang`` is a key: empty for null, else after an ``=``."""
    ids = ws.write(trusted_ids(labels), "trusted")
    ids = F.broadcast(ids) if ids.count() <= MOST_LABELS else ids.hint("merge")
    rows = keyed(docs).withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = rows.join(ids, F.col("_key_id") == F.col("_id"), "left")
    rows = rows.select(F.col("_key_lang").alias("lang"), F.col("_key_id").cast("string").alias("id"), F.col("_key_text").alias("key"), F.coalesce("_fold", F.lit(0)).alias("fold"), "text")
    return ws.write(rows.mapInPandas(_pack, PACKED), "chunks")


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with the three parts of a key by which its scores are found."""
    text, lang = F.coalesce(docs["text"].cast("string"), F.lit("")), docs["lang"].cast("string")
    return docs.withColumns({"_key_id": docs["doc_id"].cast("long"), "_key_text": F.xxhash64(text), "_key_lang": F.coalesce(F.concat(F.lit("="), lang), F.lit(""))})


def _unpack(texts: bytes) -> np.ndarray:
    return symbols(bz2.decompress(texts).decode("utf-8", "surrogatepass"))


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for chunk, lang, folds, sizes, texts in zip(*[batch[c] for c in ("chunk", "lang", "folds", "sizes", "texts")], strict=True):
            code, names = grams(_unpack(texts), np.asarray(sizes))
            own = np.repeat(np.asarray(folds) == 1, sizes)
            if names:
                yield pd.DataFrame({"chunk": chunk, "lang": np.full(len(names), lang, object), "gram": np.array(names, object), "n": np.bincount(code[own], minlength=len(names))})


def probabilities(counts: DataFrame, ws: Workspace) -> DataFrame:
    """``lang, gram, p``: interpolated modified Kneser-Ney probability of each row's last symbol after the others.

    Of ``counts`` (``lang, gram, n``) those with an ``n`` of 0 were not seen in training. Below the lowest order each of the
    symbols that a language's documents have is as probable. The tables of each order are written, so that each join
    is planned by itself and with true sizes.
    """
    need, seen = {ORDER: counts.select("lang", "gram")}, {ORDER: counts.where("n > 0")}
    for k in range(ORDER - 1, 0, -1):
        # of each n-gram of the corpus, n is the number of its left extensions in text of training
        left = ws.write(counts.groupBy("lang", F.substring("gram", 2, k).alias("gram")).agg(F.count_if(F.col("n") > 0).alias("n")), f"counts-{k}")
        counts, need[k], seen[k] = left, left.select("lang", "gram"), left.where("n > 0")
    lower = None
    for k in range(1, ORDER + 1):
        own, context = seen[k], F.substring("gram", 1, k - 1).alias("context")
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        cut = [F.greatest(F.coalesce(F.try_divide(F.lit(-(i + 1.0)) * y * F.col(f"n{i + 1}"), F.col(f"n{i}")) + i, F.lit(0.5 * i)), F.lit(LEAST)).alias(f"d{i}") for i in (1, 2, 3)]
        exact = [F.count_if(F.col("n") == i).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)]
        cuts = ws.write(own.groupBy("lang").agg(*exact).withColumn("n1", F.greatest("n1", F.lit(1.0))).select("lang", *cut), f"cuts-{k}")
        kinds = [F.count_if(F.col("n") == 1).alias("k1"), F.count_if(F.col("n") == 2).alias("k2"), F.count_if(F.col("n") >= 3).alias("k3")]
        totals = own.groupBy("lang", context).agg(F.sum("n").alias("total"), *kinds).join(cuts, "lang")
        rest = F.col("d1") * F.col("k1") + F.col("d2") * F.col("k2") + F.col("d3") * F.col("k3")
        totals = totals.select("lang", "context", "total", "d1", "d2", "d3", rest.alias("rest"))
        rows = need[k].withColumn("context", context).join(own, ["lang", "gram"], "left").join(totals, ["lang", "context"], "left")
        if lower is None:
            rows = rows.join(ws.write(need[1].groupBy("lang").agg((1 / F.count(F.lit(1))).alias("lower")), "uniform"), "lang")
        else:
            rows = rows.withColumn("_suffix", F.substring("gram", 2, k - 1))
            rows = rows.join(lower.select("lang", F.col("gram").alias("_suffix"), F.col("p").alias("lower")), ["lang", "_suffix"])
        n = F.coalesce("n", F.lit(0))
        d = F.when(n == 0, 0.0).when(n == 1, F.col("d1")).when(n == 2, F.col("d2")).otherwise(F.col("d3"))
        p = F.when(F.col("total").isNull(), F.col("lower")).otherwise((F.greatest(n - d, F.lit(0.0)) + F.col("rest") * F.col("lower")) / F.col("total"))
        lower = ws.write(rows.select("lang", "gram", p.alias("p")), f"probabilities-{k}")
    return lower


def _judge(model: pd.DataFrame, packed: pd.DataFrame) -> pd.DataFrame:
    """Scores of the documents of a chunk by ``gram, nats`` of its n-grams; without any, no model judges them."""
    parts = []
    for lang, ids, keys, folds, sizes, texts in zip(*[packed[c] for c in ("lang", "ids", "keys", "folds", "sizes", "texts")], strict=True):
        sizes, own = np.asarray(sizes, np.int64), _unpack(texts)
        nats, words = np.full(len(sizes), np.nan), np.zeros(len(sizes), np.int64)
        levels = places = [np.zeros(0, np.int64)] * len(sizes)
        if len(model) and len(own):
            code, names = grams(own, sizes)
            cost = pd.Series(model["nats"].to_numpy(), index=model["gram"]).reindex(names).to_numpy()[code]
            sums, ends = np.concatenate([[0], np.cumsum(cost)]), np.cumsum(sizes)
            nats = np.where(sizes > 0, sums[ends] - sums[ends - sizes], np.nan)
            words, levels, places = surprises(own, cost, sizes)
        parts.append(pd.DataFrame({"lang": np.full(len(sizes), lang, object), "id": np.array(ids, object), "key": keys, "fold": folds, "chars": sizes, "nats": nats, "words": words, "levels": levels, "places": places}))
    return pd.concat(parts)


def score(docs: DataFrame, labels: DataFrame, ws: Workspace) -> DataFrame:
    """``SCORED`` for each document: ``nats`` is the summed -log p, null where no model judges; ``levels`` and ``places``, see ``surprises``."""
    bound_batches(docs.sparkSession)
    chunks = pack(docs, labels, ws)
    found = ws.write(chunks.select("chunk", "lang", "folds", "sizes", "texts").mapInPandas(_count, GRAMS), "grams")
    p = probabilities(ws.write(found.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "counts"), ws)
    trained = ws.write(found.where("n > 0").select("lang").distinct(), "trained")
    p = p.join(trained, "lang", "left_semi").select("lang", "gram", (-F.log("p")).alias("nats"))
    model = found.select("chunk", "lang", "gram").join(p, ["lang", "gram"]).select("chunk", "gram", "nats")
    scored = model.groupBy("chunk").cogroup(chunks.groupBy("chunk")).applyInPandas(_judge, SCORED)
    return ws.write(scored.withColumn("nats", F.when(~F.isnan("nats"), F.col("nats"))), "scored")


def _of_fold(value: Column, name: str, how) -> list[Column]:
    """An aggregate of held-out documents, and one of those of training for languages without any."""
    return [how(F.when(F.col("fold") == f, value)).alias(f"{name}{f}") for f in (2, 1)]


def judge(docs: DataFrame, labels: DataFrame, ws: Workspace, reject: float = 0.01, prior: float = 40.0, rare: float = 0.002) -> DataFrame:
    """Per document ``id, key, lang`` (see ``pack``), ``perplexity`` of a character, ``drawn_perplexity``, ``odd_share``, ``odd_places``, their limits ``limit``, ``share_limit``, ``place_limit``, and ``kept``."""
    scored = score(docs, labels, ws)
    trusted = scored.where("fold > 0 AND nats IS NOT NULL")
    middle = trusted.groupBy("lang").agg(*_of_fold(F.col("nats") / F.col("chars"), "m", lambda c: F.percentile_approx(c, 0.5, 100_000))).select("lang", F.coalesce("m2", "m1").alias("median"))
    level, n = F.shiftright("_level", 32).cast("int"), F.col("_level").bitwiseAND(0xFFFFFFFF)
    words = trusted.select("lang", "fold", F.explode("levels").alias("_level")).groupBy("lang", "fold", level.alias("level")).agg(F.sum(n).alias("n"))
    own = Window.partitionBy("lang", "fold")  # some hundred levels
    words = words.withColumn("total", F.sum("n").over(own)).withColumn("below", F.sum("n").over(own.orderBy("level")))
    words = words.where(F.col("below") >= (1 - rare) * F.col("total")).groupBy("lang").agg(*_of_fold(F.col("level"), "l", F.min)).select("lang", F.coalesce("l2", "l1").alias("odd"))
    bounds = ws.write(middle.join(words, "lang", "left"), "bounds")
    total = lambda found: F.aggregate(found, F.lit(0).cast("long"), lambda a, x: a + x.bitwiseAND(0xFFFFFFFF)) / (F.col("words") + WORDS)
    share = total(F.filter("levels", lambda x: F.shiftright(x, 32) > F.col("odd")))
    places = total(F.filter("places", lambda x: F.shiftright(x, 32) == F.col("odd")))
    drawn = (F.col("nats") + prior * F.col("median")) / (F.col("chars") + prior)
    rows = scored.join(bounds, "lang", "left").select("id", "key", "lang", "fold", "nats", "chars", drawn.alias("drawn"), share.alias("share"), places.alias("places"))
    limits = {"drawn": 1 / 4, "share": 1 / 4, "places": 1 / 2}
    quantile = lambda part: lambda c: F.percentile_approx(c, 1 - part * reject, 100_000)
    high = rows.where("fold > 0 AND nats IS NOT NULL").groupBy("lang").agg(*[x for c, part in limits.items() for x in _of_fold(F.col(c), c, quantile(part))])
    high = ws.write(high.select("lang", *[F.coalesce(f"{c}2", f"{c}1").alias(f"{c}_limit") for c in limits]), "limits")
    rows = rows.join(high, "lang", "left")
    # without a limit there is nothing to exceed
    over = [F.coalesce(F.col(c) > F.col(f"{c}_limit"), F.lit(False)) for c in limits]
    named = [F.exp("drawn").alias("drawn_perplexity"), F.col("share").alias("odd_share"), F.col("places").alias("odd_places"), F.exp("drawn_limit").alias("limit"), "share_limit", F.col("places_limit").alias("place_limit")]
    return rows.select("id", "key", "lang", F.exp(F.col("nats") / F.col("chars")).alias("perplexity"), *named, (~(over[0] | over[1] | over[2])).alias("kept"))


def quality_report(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """``doc_id, lang``, the figures and limits of ``judge``, and ``kept``, for each document."""
    ws = Workspace(docs.sparkSession, "quality")
    found = judge(docs.select("doc_id", "text", "lang"), labels, ws, **params)
    lang = F.when(F.col("lang") != "", F.substring("lang", 2, 1 << 30))
    out = ws.write(found.withColumns({"doc_id": F.col("id").cast(docs.schema["doc_id"].dataType), "lang": lang}).drop("id", "key"), "report")
    ws.keep("report")
    return out


def keep_good(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """The documents that are kept, with their columns."""
    ws = Workspace(docs.sparkSession, "quality")
    found = judge(docs.select("doc_id", "text", "lang"), labels, ws, **params).where("kept")
    kept = ws.write(found.select(F.coalesce(F.col("id").cast("long"), F.lit(-(1 << 63))).alias("_key_id"), F.col("key").alias("_key_text"), F.col("lang").alias("_key_lang")).distinct(), "kept")
    ws.keep("kept")
    rows = keyed(docs.select(F.struct("*").alias("_row"), "doc_id", "text", "lang")).withColumn("_key_id", F.coalesce("_key_id", F.lit(-(1 << 63))))
    return rows.join(kept.hint("merge"), ["_key_id", "_key_text", "_key_lang"], "left_semi").select("_row.*")
