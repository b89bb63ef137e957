"""Mixing sources to target weights. DataFrame functions only.

1. *Targets.* Sources share all words by weight; no target exceeds ``most`` times its source, and what is cut
   is shared again by weight among the others until none is above.
2. *Packing.* The documents of a source, in a hashed order, form one stream of words that is cut into blocks
   of ``block`` words. Positions come from prefix sums over hash buckets, so a source with a third of
   all rows is never in one task.
3. *Draws.* Source ``s`` gets ``K_s`` draws, its target in blocks. A keyed pseudorandom permutation deals all draws to
   the slots of the output shards. So the counts of sources in a shard are those of a multinomial draw given that the
   shards together hold exactly ``K_s`` of each (multivariate hypergeometric counts): they vary from shard to shard, and
   each source lands on its target and not only in expectation.
4. *Slots to blocks.* Draw ``k`` of a source goes to block ``P(k mod blocks)``, where ``P`` is a permutation of
   the source's indices with its own key for each pass. A block is drawn ``ceil(K_s / blocks)`` times at
   most, hence never more than ``most`` times.
5. *Join by index* gives each block its draws and each document the words it contributes; ``packed_shards`` gives the
   blocks themselves by shard and slot.

Permutations of ``0 .. n - 1`` are Feistel networks over a grid of ``a * b >= n`` cells, walked on until they are back
below ``n``: column expressions of a keyed hash, without a table and without a shuffle.

The table of sources (one row for each, a mixture has a weight for each) is planned on the driver.

Cases: null and empty texts have size 0 and take nothing; a null source is a source, the last; a very long text spans
many blocks; ties in the order of a source's documents are broken by id and text, and rows that tie in all are
interchangeable; repeated rows are mixed as rows of their own; an empty table gives an empty result; other columns are
ignored, and carried by ``mix_documents``.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, Workspace, rank_in_groups, word_count

BUCKET = 100_000  # rows of a bucket in which places are counted


def targets(sizes: Sequence[int], weights: Sequence[float], most: float = 3) -> list[float]:
    """Words that the mix takes of each source."""
    out, open_, rest = [0.0] * len(sizes), {i for i, n in enumerate(sizes) if n > 0}, float(sum(sizes))
    while open_:
        share = sum(weights[i] for i in open_)
        full = [i for i in open_ if rest * weights[i] / share > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = rest * weights[i] / share
            break
        for i in full:
            out[i] = float(most * sizes[i])
        open_ -= set(full)
        rest = sum(sizes) - sum(out[i] for i in range(len(sizes)) if i not in open_)
    return out


ROUNDS, WALK = 6, 16


def grid(n: int) -> tuple[int, int]:
    """Sides of the smallest grid of whole rows that holds ``n`` cells, nearly square."""
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, max(1, -(-n // a))


def permuted(x: Column, n: Column, a: Column, b: Column, *key: Column) -> Column:
    """Place of ``x`` in a pseudorandom permutation of ``0 .. n - 1``; ``a, b`` is ``grid(n)``.

    Each round adds to one coordinate a keyed hash of the other, which is a bijection of the grid. Fewer than ``a`` cells
    lie beyond ``n``; from those, the walk goes on. No walk is longer than the number of such cells, and one
    of over ``WALK`` steps has a chance of about ``n ** (-WALK / 2)``.
    """

    def network(x: Column) -> Column:
        row, col = F.floor(x / b).cast("long"), (x % b).cast("long")
        state = F.struct(row.alias("r"), col.alias("c"))

        def turn(s: Column, i: Column) -> Column:
            r = F.pmod(s["r"] + F.pmod(F.xxhash64(*key, i, s["c"]), a), a)
            c = F.pmod(s["c"] + F.pmod(F.xxhash64(*key, -i, r), b), b)
            return F.struct(r.alias("r"), c.alias("c"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS // 2)), state, turn, lambda s: s["r"] * b + s["c"])

    step = lambda x, i: F.when((i == 0) | (x >= n), network(x)).otherwise(x)
    return F.aggregate(F.sequence(F.lit(0), F.lit(WALK)), x.cast("long"), step)


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: int = 3, block: int = 128, slots: int = 4096, seed: int = 7, key: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Per document ``doc_id, _text, size, source_size, target, taken`` (``_text``: ``key``, by default a hash of the text), and the draws.

    Draws: ``shard, slot, src, pass, index``, one row for each slot of the mix; joined by ``(src, index)`` with
    packed blocks they are the output shards.
    """
    packed, drawn = _plan(docs, weights, most, block, slots, seed, key)
    times = drawn.groupBy("src", "index").agg(F.count(F.lit(1)).alias("times"))
    pieces = _pieces(packed, block)
    # the size of generated draws can't be estimated, so a broadcast is ruled out
    taken = pieces.join(times.hint("merge"), ["src", "index"]).groupBy("src", "_bucket", "_n").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    out = packed.join(taken, ["src", "_bucket", "_n"], "left")
    return out.select("doc_id", "_text", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")), drawn


def _pieces(packed: DataFrame, block: int) -> DataFrame:
    """``packed`` with a row for each block that a document has words in: ``index``, and ``words``, how many."""
    b = F.lit(block).cast("long")
    first, last = F.floor(F.col("start") / b), F.floor((F.col("start") + F.col("size") - 1) / b)
    pieces = packed.where("size > 0").select("*", F.explode(F.sequence(first, last)).alias("index"))
    return pieces.withColumn("words", F.least(F.col("start") + F.col("size"), (F.col("index") + 1) * b) - F.greatest(F.col("start"), F.col("index") * b))


def _plan(docs: DataFrame, weights: Sequence[float], most: int, block: int, slots: int, seed: int, key: Column | None = None, with_text: bool = False) -> tuple[DataFrame, DataFrame]:
    """Documents with their place in their source, ``start``; and the draws."""
    spark = docs.sparkSession
    text = docs["text"].cast("string")
    own = F.xxhash64(F.coalesce(text, F.lit(""))) if key is None else key
    rows = docs.select("doc_id", own.alias("_text"), docs["source"].cast("string").alias("source"), word_count(text).alias("size"), *[text.alias("text")] * with_text)
    rows = Workspace(spark, "mixing").write(rows, "sizes")  # words are counted once
    found = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")).collect()
    buckets = max(16, -(-sum(r["rows"] for r in found) // BUCKET))
    found = sorted(found, key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sizes = [r["size"] for r in found]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], most)
    plan, at = [], 0
    for i, r in enumerate(found):
        n = -(-sizes[i] // block)
        draws = round(goal[i] * n / sizes[i]) if n else 0
        side = grid(n)
        plan.append({"source": r["source"], "src": i, "source_size": sizes[i], "target": goal[i], "blocks": n, "draws": draws, "first": at, "a": side[0], "b": side[1]})
        at += draws
    schema = "array<struct<source:string,src:int,source_size:bigint,target:double,blocks:bigint,draws:bigint,first:bigint,a:bigint,b:bigint>>"
    # one row for each source, which the driver has planned: bounded by the mixture
    table = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(plan)), schema)))
    t = F.broadcast(table.select(F.col("source").alias("_source"), "src", "source_size", "target"))
    rows = rows.join(t, F.col("source").eqNullSafe(F.col("_source"))).select("doc_id", "_text", "src", "size", "source_size", "target", *["text"] * with_text)
    packed = rank_in_groups(rows, ["src"], F.pmod(F.xxhash64(F.lit(seed), "doc_id", "_text"), F.lit(buckets)), [F.xxhash64("doc_id", F.lit(seed)), F.col("doc_id"), F.col("_text")], "start", F.col("size"))
    return packed, draw(table, at, slots, seed)


def draw(table: DataFrame, total: int, slots: int, seed: int) -> DataFrame:
    """One row for each slot: ``shard, slot, src, pass, index``."""
    chunk = 1 << 14  # draws are generated in chunks of a source, so that a large source is spread
    n = F.greatest(F.col("draws") - F.col("chunk") * chunk, F.lit(0))
    k = F.explode(F.sequence(F.col("chunk") * chunk, F.col("chunk") * chunk + F.least(n, F.lit(chunk)) - 1))
    chunks = table.where("draws > 0").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("draws") - 1) / chunk))))
    draws = chunks.repartition("src", "chunk").select("src", "blocks", "first", "a", "b", k.alias("k"))
    every, (rows, columns) = F.lit(total).cast("long"), grid(total)
    at = permuted(F.col("first") + F.col("k"), every, F.lit(rows).cast("long"), F.lit(columns).cast("long"), F.lit(seed))
    draws = draws.withColumn("pass", F.floor(F.col("k") / F.col("blocks")).cast("int"))
    index = permuted(F.col("k") % F.col("blocks"), F.col("blocks"), F.col("a"), F.col("b"), F.lit(seed), F.col("src"), F.col("pass"))
    return draws.select(at.alias("_at"), "src", "pass", index.alias("index")).select(F.floor(F.col("_at") / slots).alias("shard"), (F.col("_at") % slots).alias("slot"), "src", "pass", "index")


def shard_counts(drawn: DataFrame) -> DataFrame:
    """Slots of each source in each shard: ``shard, src, slots``."""
    return drawn.groupBy("shard", "src").agg(F.count(F.lit(1)).alias("slots"))


def packed_shards(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: int = 3, block: int = 128, slots: int = 4096, seed: int = 7) -> DataFrame:
    """The mix itself: ``shard, slot, src, n_words, text``, a row for each slot, with a block of ``block`` words of its source.

    The last block of a source may be shorter. A block is gathered from the documents that have words in it, ``block`` at most.
    """
    packed, drawn = _plan(docs, weights, most, block, slots, seed, with_text=True)
    start, size, b = F.col("start"), F.col("size"), F.lit(block).cast("long")
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))

    def piece(all_: Column, index: Column) -> Column:
        at = F.greatest(start, index * b)
        n = F.least(start + size, (index + 1) * b) - at
        return F.struct(index.alias("index"), at.alias("at"), F.slice(all_, (at - start + 1).cast("int"), n.cast("int")).alias("own"))

    # the pieces of a document together are as long as the document
    cut = F.aggregate(F.array(words), F.lit(None).cast("array<struct<index:bigint,at:bigint,own:array<string>>>"), lambda _, w: F.transform(F.sequence(F.floor(start / b), F.floor((start + size - 1) / b)), lambda i: piece(w, i)))
    pieces = packed.where("size > 0").select("src", F.explode(cut).alias("_p")).select("src", "_p.*")
    parts = F.sort_array(F.collect_list(F.struct("at", "own")))
    blocks = pieces.groupBy("src", "index").agg(F.flatten(F.transform(parts, lambda p: p["own"])).alias("own"))
    blocks = blocks.select("src", "index", F.size("own").cast("long").alias("n_words"), F.array_join("own", " ").alias("text"))
    return drawn.join(blocks.hint("merge"), ["src", "index"]).select("shard", "slot", "src", "n_words", "text")


def copies(taken: Column, size: Column, key: Column, most: int = 3) -> Column:
    """Whole copies of a document for the words taken of it: rounded up or down by a hash, right in expectation."""
    share = F.when(size > 0, taken / size).otherwise(F.lit(0.0))
    u = F.pmod(F.xxhash64(F.lit("copies"), key), F.lit(1 << 20)) / float(1 << 20)
    return F.least(F.floor(share + u), F.lit(most)).cast("int")


def mix_documents(docs: DataFrame, **params) -> DataFrame:
    """The documents of the mix, with their columns: each as often as the words taken of it ask for, on average.

    A document of which a part is taken is kept whole or left out by a hash, so documents stay whole and
    sources still come near their targets. Rows that are equal in all columns are mixed as one, with their copies added up.
    """
    most = params.get("most", 3)
    plain = [F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in t else F.col(f"`{c}`") for c, t in docs.dtypes]
    row = F.xxhash64(F.lit(1), *[x for c in plain for x in (c.isNull(), c)])
    taken = mix(docs, **params, key=row)[0]
    times = taken.select("doc_id", "_text", copies(F.col("taken"), F.col("size"), F.col("_text"), most).alias("_copies"))
    times = times.groupBy(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("_k1"), F.col("_text").alias("_k2")).agg(F.sum("_copies").cast("int").alias("_copies")).where("_copies > 0")
    rows = docs.select(F.struct("*").alias("_row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("_k1"), row.alias("_k2"))
    one = rows.join(times, ["_k1", "_k2"]).dropDuplicates(["_k1", "_k2"])
    return one.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*")
