"""Substring dedup with suffix automata of reference shards.

A window is ``window`` consecutive words of a document. Each word that a window covers whose word sequence also
starts anywhere else, in any document, is removed; windows are judged on the input.

The reference is the corpus itself, so automata of all of it neither fit a broadcast nor can each document
be streamed against each of them (that is quadratic). Both are routed instead, without losing a window:

1. *Anchors.* The anchor of a window is its first word ``gram`` with the smallest hash. Equal windows have equal
   anchors, and about one word in 14 is an anchor. The anchors of each document are counted over the
   corpus; windows whose anchor occurs once can't repeat.
2. *Contexts.* The windows of one anchor occurrence are a run of starts; the words they cover are its
   context. Each window of a document lies in exactly one context.
3. *Shards.* Contexts go to reference shards by the hash of their anchor. A shard's suffix automaton is built
   over its distinct contexts, with the number of occurrences of each state; the contexts are streamed through it
   for matching statistics over states that occur twice, and matches of ``window`` words give maximal spans.
4. *Hot anchors*, more than ``hot`` occurrences, would make an automaton without bound. Their windows are
   counted instead, by 128-bit digests. Contexts are packed in batches of about ``BATCH`` words; a batch sends its
   digests to ranges of the digest, in one row for each range that it has any for, and gets back which of its windows
   repeat. So a row stands for many windows, no row or task holds an anchor, and an anchor that a third of all
   documents share is spread evenly. A batch sends ``MOST_RANGES`` rows at most: rows grow with the input.
5. Spans go back to their documents, and the words outside them are kept.

``remove_reference_spans`` is the plain form for a bounded reference table: automata of its shards are
broadcast, one after another, and documents are streamed through each.

Words are compared by 64 bits of their hash: two windows are taken for equal wrongly only if they differ in words
that all collide at the same place, or, of hot anchors, if 128 bits collide.

Cases: null and empty texts have no words and keep the digest of the empty string; documents shorter than
a window keep all; a very long text has as many contexts as it needs, none longer than two windows and a gram unless
its words repeat; ties of the smallest hash within a window go to the first; rows repeated in full count as occurrences each, and lose what they share;
null ids are kept apart by text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, bound_batches

BATCH, RANGE, MOST_RANGES = 1_000_000, 2_000_000, 1 << 16  # words of a packed batch; windows of a range; ranges
MIX = np.uint64(0x9E3779B97F4A7C15)


def split_words(text: str | None) -> list[bytes]:
    """bytes.split takes exactly the six ASCII white space characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def word_ids(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(29))


def window_anchors(ids: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window start: position of its anchor, and the anchor's hash."""
    n = len(ids) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.zeros(len(ids) - gram + 1, np.uint64)
    for k in range(gram):
        h = mixed(h + ids[k : k + len(h)])
    places, width = window - gram + 1, 1
    at, low = np.arange(len(h)), h
    while width < places:  # minimum, and its first place, of ever wider runs
        step = min(width, places - width)
        a, b = low[:-step], low[step:]
        take = b < a
        low, at = np.where(take, b, a), np.where(take, at[step:], at[:-step])
        width += step
    return at, low


def contexts(ids: np.ndarray, window: int, gram: int) -> list[tuple[int, int, int]]:
    """``(anchor hash as a signed long, first start, last start)`` of each run of windows with one anchor."""
    at, low = window_anchors(ids, window, gram)
    if not len(at):
        return []
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:], [len(at)]]) - 1
    return list(zip(low[first].view(np.int64).tolist(), first.tolist(), last.tolist(), strict=True))


def pack(ids: np.ndarray) -> bytes:
    return ids.astype("<u8").tobytes()


def unpack(data: bytes) -> list[int]:
    return (np.frombuffer(data, "<u8") & np.uint64((1 << 63) - 1)).tolist()


def window_digests(ids: np.ndarray, window: int) -> np.ndarray:
    """128 bits, as two columns, for each window start."""
    n = max(0, len(ids) - window + 1)
    out = np.empty((n, 2), np.uint64)
    for column, seed in enumerate((0x243F6A8885A308D3, 0x13198A2E03707344)):
        h = np.full(n, seed, np.uint64)
        for k in range(window):
            h = mixed(h * MIX + ids[k : k + n])
        out[:, column] = h
    return out


class WordAutomaton:
    """Suffix automaton of several word sequences, with the occurrences of each state."""

    def __init__(self, sequences: list[tuple[list[int], int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]
        nxt, link, length, count = self.next, self.link, self.length, self.count
        last, mark = 0, -1
        for words, weight in sequences:
            for c in (*words, mark):
                cur = len(nxt)
                nxt.append({})
                length.append(length[last] + 1)
                link.append(0)
                count.append(weight if c >= 0 else 0)
                p = last
                while p >= 0 and c not in nxt[p]:
                    nxt[p][c] = cur
                    p = link[p]
                if p >= 0:
                    q = nxt[p][c]
                    if length[q] == length[p] + 1:
                        link[cur] = q
                    else:
                        clone = len(nxt)
                        nxt.append(dict(nxt[q]))
                        length.append(length[p] + 1)
                        link.append(link[q])
                        count.append(0)
                        while p >= 0 and nxt[p].get(c) == q:
                            nxt[p][c] = clone
                            p = link[p]
                        link[q] = link[cur] = clone
                last = cur
            mark -= 1
        for s in sorted(range(1, len(nxt)), key=length.__getitem__, reverse=True):
            count[link[s]] += count[s]

    def matches(self, words: list[int], least: int) -> Iterator[tuple[int, int]]:
        """Matching statistics: ``(end, length)`` of the longest match at each place among what occurs ``least`` times."""
        nxt, link, length, count = self.next, self.link, self.length, self.count
        state, n = 0, 0
        for i, c in enumerate(words):
            while state and c not in nxt[state]:
                state = link[state]
                n = length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                n += 1
            while state and count[state] < least:
                state = link[state]
                n = length[state]
            if not state:
                n = 0
            yield i + 1, n


def spans(automaton: WordAutomaton, words: list[int], window: int, least: int) -> list[tuple[int, int]]:
    """Maximal spans covered by matches of at least ``window`` words."""
    out: list[list[int]] = []
    for end, n in automaton.matches(words, least):
        if n >= window:
            if out and end - n <= out[-1][1]:
                out[-1][0], out[-1][1] = min(out[-1][0], end - n), end
            else:
                out.append([end - n, end])
    return [(a, b) for a, b in out]


def repeated_spans(group: list[tuple[bytes, int]], window: int) -> list[list[tuple[int, int]]]:
    """Of each distinct context of a shard, given with its number of occurrences, the repeated spans."""
    words = [unpack(c) for c, _ in group]
    if any(n < 2 for _, n in group) and len(group) > 1:  # else every context repeats as a whole
        automaton = WordAutomaton([(w, min(n, 2)) for w, (_, n) in zip(words, group, strict=True)])
    else:
        automaton = None
    return [[(0, len(w))] if n >= 2 else spans(automaton, w, window, 2) if automaton else [] for w, (_, n) in zip(words, group, strict=True)]


SPAN = "k1 long, k2 long, a int, b int"


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    doc_id = docs["doc_id"].cast("long")
    return docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(-(1 << 63))).alias("k1"), F.xxhash64(text).alias("k2"), text.alias("text"))


def find_repeats(docs: DataFrame, ws: Workspace, window: int = 35, gram: int = 8, hot: int = 1000, shard_words: int = 50_000) -> DataFrame:
    """Spans of repeated words: ``k1, k2`` (of ``_rows``), first word ``a``, end ``b``."""

    def anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 200):
                some, parts = batch.iloc[at : at + 200], []
                for i, text in enumerate(some["text"]):
                    a, h = window_anchors(word_ids(split_words(text)), window, gram)
                    if len(a):
                        own, n = np.unique(h[np.concatenate([[True], a[1:] != a[:-1]])], return_counts=True)
                        parts.append((np.full(len(own), i), own, n))
                if parts:
                    i, own, n = (np.concatenate(x) for x in zip(*parts, strict=True))
                    yield pd.DataFrame({"anchor": own.view(np.int64), "n": n.astype(np.int32), "k1": some["k1"].to_numpy()[i], "k2": some["k2"].to_numpy()[i]})

    rows = _rows(docs)
    found = ws.write(rows.where(F.length("text") >= 2 * window - 1).mapInPandas(anchors, "anchor long, n int, k1 long, k2 long"), "anchors")
    counts = ws.write(found.groupBy("anchor").agg(F.sum("n").alias("all")).where("all > 1"), "counts")
    # the anchors of a document that repeat: as many as the document has words, at most
    mine = found.join(counts, "anchor").groupBy("k1", "k2").agg(F.collect_set(F.struct("anchor", (F.col("all") > hot).alias("hot"))).alias("anchors"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k1, k2, text, own in zip(batch["k1"], batch["k2"], batch["text"], batch["anchors"], strict=True):
                ids, wanted, seen = word_ids(split_words(text)), {x["anchor"]: x["hot"] for x in own}, {}
                for anchor, first, last in contexts(ids, window, gram):
                    if anchor in wanted:
                        seen.setdefault((anchor, pack(ids[first : last + window]), wanted[anchor]), []).append(first)
                out += [(anchor, key, is_hot, k1, k2, starts, len(starts)) for (anchor, key, is_hot), starts in seen.items()]
                if len(out) >= 5000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            yield pd.DataFrame(out, columns=names)

    names = ["anchor", "context", "hot", "k1", "k2", "starts", "n"]
    cuts = rows.join(mine, ["k1", "k2"]).select("k1", "k2", "text", "anchors").mapInPandas(cut, "anchor long, context binary, hot boolean, k1 long, k2 long, starts array<int>, n int")
    cuts = ws.write(cuts, "contexts")

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard: list[tuple[int, list]] = []  # whole anchors
        size = 0

        def flush() -> pd.DataFrame:
            out, distinct = [], []
            for _, items in shard:
                own: dict[bytes, list] = {}
                for x in items:
                    own.setdefault(x[0], []).append(x)
                distinct += own.items()
            found = repeated_spans([(c, sum(x[4] for x in xs)) for c, xs in distinct], window)
            for (_, xs), cut_spans in zip(distinct, found, strict=True):
                out += [(k1, k2, s + a, s + b) for _, k1, k2, starts, _ in xs for s in starts for a, b in cut_spans]
            return pd.DataFrame(out, columns=["k1", "k2", "a", "b"])

        for batch in batches:
            for anchor, context, k1, k2, starts, n in zip(batch["anchor"], batch["context"], batch["k1"], batch["k2"], batch["starts"], batch["n"], strict=True):
                if not shard or shard[-1][0] != anchor:
                    if size >= shard_words:
                        yield flush()
                        shard, size = [], 0
                    shard.append((anchor, []))
                shard[-1][1].append((context, k1, k2, starts.tolist(), n))
                size += len(context) // 8
        if shard:
            yield flush()

    cold = cuts.where("NOT hot").select("anchor", "context", "k1", "k2", "starts", "n").repartition("anchor").sortWithinPartitions("anchor").mapInPandas(match, SPAN)
    warm = _hot_spans(cuts.where("hot").select("context", "k1", "k2", "starts", "n"), ws, window)
    return cold.unionByName(warm)


PACKED = "batch long, k1 array<long>, k2 array<long>, starts array<array<int>>, n array<int>, sizes array<int>, words binary"


def _pack_contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    task, made, rows, size = TaskContext.get().partitionId() << 32, 0, [], 0

    def close() -> pd.DataFrame:
        contexts, k1, k2, starts, n = zip(*rows, strict=True)
        return pd.DataFrame({"batch": [task | made], "k1": [list(k1)], "k2": [list(k2)], "starts": [[x.tolist() for x in starts]], "n": [list(n)], "sizes": [[len(c) // 8 for c in contexts]], "words": [b"".join(contexts)]})

    for batch in batches:
        for row in zip(*[batch[c] for c in ("context", "k1", "k2", "starts", "n")], strict=True):
            rows.append(row)
            size += len(row[0]) // 8
            if size >= BATCH:
                made += 1
                yield close()
                rows, size = [], 0
    if rows:
        made += 1
        yield close()


def _hot_spans(cuts: DataFrame, ws: Workspace, window: int) -> DataFrame:
    """Spans of the contexts of hot anchors: windows that repeat are found by counting digests in ranges."""
    total = cuts.agg(F.coalesce(F.sum(F.octet_length("context")), F.lit(0))).first()[0] // 8
    ranges = min(MOST_RANGES, 1 + total // RANGE)
    packed = ws.write(cuts.mapInPandas(_pack_contexts, PACKED), "hot")

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for batch, n, sizes, words in zip(rows["batch"], rows["n"], rows["sizes"], rows["words"], strict=True):
                sizes, digests = np.asarray(sizes), window_digests(np.frombuffer(words, "<u8"), window)
                ends = np.repeat(np.cumsum(sizes), sizes)[: len(digests)]
                at = np.arange(len(digests))
                at = at[at + window <= ends]  # windows within one context
                # a context that its document has twice repeats by itself
                at = np.concatenate([at, at[np.repeat(np.asarray(n), sizes)[at] > 1]])
                to = digests[at, 0] % np.uint64(ranges)
                order = np.argsort(to, kind="stable")
                at, to = at[order], to[order]
                cut = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else []
                yield pd.DataFrame({"range": to[cut].astype(np.int32), "batch": batch, "digests": [digests[x].tobytes() for x in np.split(at, cut[1:])] if len(to) else [], "places": [x.astype(np.int32).tobytes() for x in np.split(at, cut[1:])] if len(to) else []})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, parts = None, []

        def flush() -> pd.DataFrame:
            digests = np.frombuffer(b"".join(x[1] for x in parts), "<u8").reshape(-1, 2)
            order = np.lexsort(digests.T)
            same = (digests[order[1:]] == digests[order[:-1]]).all(axis=1)
            again, cuts_ = np.zeros(len(digests), bool), np.cumsum([len(x[2]) // 4 for x in parts])[:-1]
            again[order[1:][same]] = again[order[:-1][same]] = True
            found = [(b, np.unique(np.frombuffer(places, np.int32)[mask]).tobytes()) for (b, _, places), mask in zip(parts, np.split(again, cuts_), strict=True) if mask.any()]
            return pd.DataFrame(found, columns=["batch", "places"])

        for batch in batches:
            for r, *part in zip(batch["range"], batch["batch"], batch["digests"], batch["places"], strict=True):
                if r != key and parts:
                    yield flush()
                    parts = []
                key = r
                parts.append(part)
        if parts:
            yield flush()

    def mark(found: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(found):
            at = np.unique(np.concatenate([np.frombuffer(x, np.int32) for x in found["places"]]))
            for k1, k2, starts, sizes in zip(rows["k1"], rows["k2"], rows["starts"], rows["sizes"], strict=True):
                first = np.cumsum(sizes) - sizes
                owner = np.searchsorted(first, at, side="right") - 1
                new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (at[1:] > at[:-1] + window)])
                begins = np.flatnonzero(new)
                lasts = np.append(begins[1:], len(at)) - 1
                for i, j in zip(begins, lasts, strict=True):
                    o = owner[i]
                    out += [(k1[o], k2[o], s + at[i] - first[o], s + at[j] - first[o] + window) for s in starts[o]]
        return pd.DataFrame(out, columns=["k1", "k2", "a", "b"])

    sent = packed.select("batch", "n", "sizes", "words").mapInPandas(send, "range int, batch long, digests binary, places binary")
    found = sent.repartition("range").sortWithinPartitions("range").mapInPandas(count, "batch long, places binary")
    owners = packed.select("batch", "k1", "k2", "starts", "sizes")
    return ws.write(found.groupBy("batch").cogroup(owners.groupBy("batch")).applyInPandas(mark, SPAN), "hot-spans")


def _clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for doc_id, text, own in zip(batch["doc_id"], batch["text"], batch["spans"], strict=True):
            words = split_words(text)
            keep = np.ones(len(words), bool)
            for x in () if own is None else own:
                keep[x["a"] : x["b"]] = False
            kept = b" ".join(words if keep.all() else [w for w, k in zip(words, keep.tolist(), strict=True) if k])
            out.append((doc_id, len(words), int(len(words) - keep.sum()), hashlib.sha256(kept).hexdigest(), kept))
        yield pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])


def remove_repeats(docs: DataFrame, with_text: bool = False, **params) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for each document, and ``kept_text`` if asked for."""
    bound_batches(docs.sparkSession)
    ws = Workspace(docs.sparkSession, "substring")
    own = find_repeats(docs, ws, **params).groupBy("k1", "k2").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    own = ws.write(own, "spans")
    ws.keep("spans")
    rows = _rows(docs).join(own, ["k1", "k2"], "left").select(F.col("doc_id").cast("string").alias("doc_id"), "text", "spans")
    out = rows.mapInPandas(_clean if with_text else _digests, "doc_id string, n_words long, n_removed long, kept_sha256 string" + ", kept_text binary" * with_text)
    return out.withColumn("doc_id", F.col("doc_id").cast("long")).withColumns({"kept_text": F.col("kept_text").cast("string")} if with_text else {})


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in _clean(batches):
        yield batch.drop(columns="kept_text")


def remove_reference_spans(docs: DataFrame, reference: DataFrame, window: int = 35, shard_words: int = 200_000, most_words: int = 5_000_000) -> DataFrame:
    """``docs`` (``doc_id, text``) without maximal spans of ``window`` words or more that occur in ``reference`` (``text``).

    The reference is read shard by shard, ``shard_words`` words each, ``most_words`` altogether: a larger
    one is an error, since each shard is one more broadcast and one more pass.
    """

    def shards() -> Iterator[list[list[int]]]:
        out, size, all_ = [], 0, 0
        for r in reference.where("text IS NOT NULL").select("text").toLocalIterator():
            out.append(word_ids(split_words(r["text"])).view(np.int64).tolist())
            size, all_ = size + len(out[-1]), all_ + len(out[-1])
            if all_ > most_words:
                raise ValueError(f"the reference has more than {most_words} words")
            if size >= shard_words:
                yield out
                out, size = [], 0
        if out:
            yield out

    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("spans", F.array().cast("array<struct<a:int,b:int>>"))
    for shard in shards():
        shared = docs.sparkSession.sparkContext.broadcast(WordAutomaton([([w & (1 << 63) - 1 for w in words], 1) for words in shard]))

        def stream(batches: Iterator[pd.Series], shared=shared) -> Iterator[pd.Series]:
            for texts in batches:
                ids = [[w & (1 << 63) - 1 for w in word_ids(split_words(t)).view(np.int64).tolist()] for t in texts]
                yield pd.Series([[{"a": a, "b": b} for a, b in spans(shared.value, w, window, 1)] for w in ids])

        udf = F.pandas_udf(stream, "array<struct<a:int,b:int>>", F.PandasUDFType.SCALAR_ITER)
        rows = rows.withColumn("spans", F.concat("spans", udf("text")))
    out = rows.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "spans").mapInPandas(_clean, "doc_id string, n_words long, n_removed long, kept_sha256 string, kept_text binary")
    return out.withColumns({"doc_id": F.col("doc_id").cast("long"), "kept_text": F.col("kept_text").cast("string")})


#: DuckDB SQL for the rows of ``remove_repeats`` over ``documents``.
ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 34), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM w)),
r AS (SELECT g FROM p GROUP BY g HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, i + unnest(range(35)) AS i FROM (SELECT doc_id, i FROM p JOIN r USING (g))),
k AS (SELECT x.doc_id, count(*) AS n, string_agg(x.word, ' ' ORDER BY x.i) AS kept
      FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w) x LEFT JOIN c ON x.doc_id = c.doc_id AND x.i = c.i WHERE c.i IS NULL GROUP BY x.doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(len(w.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""
