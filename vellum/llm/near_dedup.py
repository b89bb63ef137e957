"""MinHash near-dedup with sequential Bayesian verification.

Texts are lower-cased (A-Z) and shingled; documents whose sets of shingles have a Jaccard similarity of at least
``percent`` / 100 are linked, and a group is a connected component.

1. *Signatures.* One pass gives each document its set's digest, size and signature of minimum hashes. Equal sets are
   one class from here on, so exact copies cost nothing more. ``layout`` picks the bands: so many that a pair at the
   threshold shares none with a chance of ``MISS`` at most.
2. *Star.* Classes that agree on a band share a bucket. Each class is compared with one other only: the smallest class
   of most of its buckets. So a table of pairs has a row for each class at most, and nearly equal texts come together.
3. *Blocks.* In buckets that still hold several components, members of different components are compared, block by
   block within a task. A block is bounded in members and in bytes. What a component has beyond a block goes to blocks
   of its own, which are not compared with each other. A pair is compared in the first bucket that it shares.
4. *Verification.* Signatures are compared a batch of hashes at a time. With ``m`` of ``n`` hashes equal, the
   similarity has the posterior Beta(m + 1, n - m + 1); a pair is pruned once the chance that it reaches
   the threshold is below ``MISS``. Survivors are verified on their full sets in the same task: their intersections
   are one product of incidence matrices. A task returns links that join components and no pairs.

A class is missed with chance ``MISS`` at most by the bands, and by each pruning. Nothing is capped or sampled: a bucket of
``m`` members of which ``u`` are outside its large components costs ``m * u / MEMBERS`` rows of signatures and sets.

Full sets are 64-bit digests of shingles.

Cases: null, empty and blank texts have an empty set and are linked with nothing; with fewer words than a
shingle, the whole sequence is one; very long texts have long sets, of which a block holds few; ties between heads of
buckets go to the smallest; a null ``doc_id`` is linked like any other but never names a component that
has another id; repeated rows are copies; an empty table gives an empty result; other columns pass by.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, bound_batches
from .components import components

MISS, HASHES = 1e-5, 150  # chance; hashes of a signature at most
MEMBERS, BYTES = 512, 4 << 20  # of a block at most, but for a single larger set
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct digests of a text's shingles."""
    tokens = text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []
    if not tokens:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    width = min(words, len(ids))
    h = np.full(len(ids) - width + 1, width, np.uint64)
    for k in range(width):
        h = (h ^ ids[k : k + len(h)]) * MIX
        h ^= h >> np.uint64(31)
    return np.unique(h)


@functools.lru_cache(1)
def hash_family() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20240229)
    return draw.integers(0, 1 << 32, HASHES, np.uint32)[:, None] | np.uint32(1), draw.integers(0, 1 << 32, HASHES, np.uint32)[:, None]


def signature(own: np.ndarray, percent: int) -> np.ndarray:
    bands, rows = layout(percent)
    a, b = (x[: bands * rows] for x in hash_family())
    x, out = (own >> np.uint64(32)).astype(np.uint32), None
    for at in range(0, len(x), 512):
        low = (a * x[None, at : at + 512] + b).min(axis=1)
        out = low if out is None else np.minimum(out, low)
    return out


@functools.lru_cache(8)
def layout(percent: int) -> tuple[int, int]:
    """Bands and rows of a band: the longest bands of which ``HASHES`` give enough for ``MISS``."""
    for rows in range(HASHES, 0, -1):
        chance = (percent / 100) ** rows
        bands = math.ceil(math.log(MISS) / math.log1p(-chance)) if chance < 1 else 1
        if bands * rows <= HASHES:
            return bands, rows
    raise ValueError(f"no bands of {HASHES} hashes find a similarity of {percent} %")


def band_keys(sig: np.ndarray, percent: int) -> list[int]:
    bands, rows = layout(percent)
    return [xxhash.xxh3_64_intdigest(sig[i * rows : (i + 1) * rows].tobytes(), seed=i) - (1 << 63) for i in range(bands)]


@functools.lru_cache(8)
def least_matches(percent: int) -> tuple[int, ...]:
    """For each number of batches, the fewest equal hashes with which a pair stays.

    The posterior chance of reaching ``t`` is that of at most ``m`` successes in ``n + 1`` trials of chance ``t``.
    """
    (batch, times), t, out = layout(percent), percent / 100, []
    for n in range(batch, batch * times + 1, batch):
        chance, m = 0.0, -1
        while chance < MISS and m < n:
            m += 1
            chance += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def sequential(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Signatures ``a[i]`` and ``b[j]`` compared batch by batch: numbers of the pairs that stay."""
    batch, left, equal = layout(percent)[0], np.arange(len(i)), np.zeros(len(i), np.int32)
    for k, least in enumerate(least_matches(percent)):
        cut = slice(k * batch, (k + 1) * batch)
        equal = equal + (a[i[left], cut] == b[j[left], cut]).sum(axis=1, dtype=np.int32)
        stay = equal >= least
        left, equal = left[stay], equal[stay]
    return left


def _signatures(signed: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(signed), np.uint32).reshape(len(signed), -1)


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    doc_id = docs["doc_id"].cast("long")
    return docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(-(1 << 63))).alias("k1"), F.xxhash64(text).alias("k2"), text.alias("text"))


def sign(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """``doc_id, k1, k2, n_shingles, node, bands, sig``: node is the digest of the set; null without shingles."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                some, out = batch.iloc[at : at + 1000], []
                for text in some["text"]:
                    own = shingles(text, words)
                    if len(own):
                        sig = signature(own, percent)
                        out.append((len(own), xxhash.xxh3_128_digest(own.tobytes()), band_keys(sig, percent), sig.tobytes()))
                    else:
                        out.append((0, None, None, None))
                yield pd.concat([some[["k1", "k2", "doc_id"]].reset_index(drop=True), pd.DataFrame(out, columns=["n_shingles", "node", "bands", "sig"])], axis=1)

    rows = _rows(docs).select("k1", "k2", F.col("doc_id").cast("string").alias("doc_id"), "text")
    out = rows.mapInPandas(run, "k1 long, k2 long, doc_id string, n_shingles long, node binary, bands array<long>, sig binary")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def intersections(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of ``one`` with each of ``two``, exactly: a product of incidence matrices."""
    def flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])

    (x, of_x), (y, of_y) = flat(one), flat(two)
    common = np.intersect1d(x, y)
    out, step = np.zeros((len(one), len(two)), np.int64), 2048
    at_x, at_y = np.searchsorted(common, x), np.searchsorted(common, y)
    if not len(common):
        return out
    for at, of in ((at_x, x), (at_y, y)):
        at[common[np.minimum(at, len(common) - 1)] != of] = -1
    by_x, by_y = np.argsort(at_x, kind="stable"), np.argsort(at_y, kind="stable")
    at_x, of_x, at_y, of_y = at_x[by_x], of_x[by_x], at_y[by_y], of_y[by_y]
    for low in range(0, len(common), step):
        parts = []
        for at, of, n in ((at_x, of_x, len(one)), (at_y, of_y, len(two))):
            own = slice(*np.searchsorted(at, [low, low + step]))
            m = np.zeros((n, step), np.float32)
            m[of[own], at[own] - low] = 1
            parts.append(m)
        out += (parts[0] @ parts[1].T).astype(np.int64)  # sums of up to ``step`` ones, hence exact
    return out


def similar(x: int, y: int, both: int, percent: int) -> bool:
    return 100 * both >= percent * (x + y - both)


def _verify(percent: int):
    """Pairs of the star: signatures first, then full sets."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            k = np.arange(len(batch))
            left = sequential(_signatures(batch["sig_a"]), _signatures(batch["sig_b"]), k, k, percent)
            some, good = batch.iloc[left], []
            for a, b in zip(some["set_a"], some["set_b"], strict=True):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                good.append(similar(len(x), len(y), len(np.intersect1d(x, y, assume_unique=True)), percent))
            yield some[["a", "b"]][np.array(good, bool)]

    return run


def _numbers(part: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each row."""
    h = np.zeros(len(part), np.uint64)
    for k in range(part.shape[1]):
        h = (h ^ part[:, k]) * MIX
        h ^= h >> np.uint64(29)
    return h


def block_links(rows: list[tuple], band: int, percent: int) -> list[tuple[bytes, bytes]]:
    """Links between components of one block, or of two, of a bucket of ``band``.

    A row is (side, component, signature, set); side 0 is the block with the smaller number. Links are pairs of
    components, as few as join what is similar.
    """
    width = layout(percent)[1]
    sides = [[r for r in rows if r[0] == s] for s in (0, 1)]
    alone = not sides[1]
    one, two = sides[0], sides[1] or sides[0]
    if not one:
        return []
    names = sorted({r[1] for r in rows})
    comp = {c: i for i, c in enumerate(names)}
    ca, cb = (np.array([comp[r[1]] for r in side]) for side in (one, two))
    na, nb = (np.array([len(r[3]) // 8 for r in side]) for side in (one, two))
    # the sizes of similar sets differ by the threshold at most
    open_ = (ca[:, None] != cb[None, :]) & (100 * np.minimum(na[:, None], nb[None, :]) >= percent * np.maximum(na[:, None], nb[None, :]))
    if alone:
        open_ = np.triu(open_, 1)
    sig_a, sig_b = _signatures([r[2] for r in one]), _signatures([r[2] for r in two])
    for k in range(band):  # a pair that shares an earlier band is compared there
        cut = slice(k * width, (k + 1) * width)
        open_ &= _numbers(sig_a[:, cut])[:, None] != _numbers(sig_b[:, cut])[None, :]
    i, j = np.nonzero(open_)
    left = [at + sequential(sig_a, sig_b, i[at : at + (1 << 16)], j[at : at + (1 << 16)], percent) for at in range(0, len(i), 1 << 16)]
    if not left or not len(left := np.concatenate(left)):
        return []
    i, j = i[left], j[left]
    own_a, at_a = np.unique(i, return_inverse=True)
    own_b, at_b = np.unique(j, return_inverse=True)
    both = intersections([np.frombuffer(one[k][3], np.uint64) for k in own_a], [np.frombuffer(two[k][3], np.uint64) for k in own_b])[at_a, at_b]
    good = 100 * both >= percent * (na[i] + nb[j] - both)
    ends = np.unique(np.stack([ca[i[good]], cb[j[good]]], axis=1), axis=0)
    root, out = list(range(len(names))), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in ends.tolist():
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((names[x], names[y]))
    return out


def _across(percent: int):
    """Links within the blocks of buckets, which come sorted by bucket and blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, rows, found = None, [], set()

        def close() -> None:
            if len({r[1] for r in rows}) > 1:
                found.update(block_links(rows, key[3], percent))

        for batch in batches:
            for bucket, band, x, y, *row in zip(*[batch[c] for c in ("bucket", "band", "x", "y", "side", "label", "sig", "set")], strict=True):
                if (bucket, x, y, band) != key:
                    close()
                    key, rows = (bucket, x, y, band), []
                    if len(found) > 10_000:
                        yield pd.DataFrame(list(found), columns=["a", "b"])
                        found = set()
                rows.append(tuple(row))
        close()
        if found:
            yield pd.DataFrame(list(found), columns=["a", "b"])

    return run


def _blocks(named: DataFrame, ws: Workspace) -> DataFrame:
    """``bucket, band, node, label`` of the members of open buckets, with ``own``, their block, and ``others``, those to compare it with.

    ``named`` has ``bucket, band, node, n_shingles, label``. Blocks from 0 on are mixed; a component that fills more than
    one has blocks of its own, after those.
    """
    long_ = lambda c: c.cast("long")
    need = lambda n, w: F.greatest(F.ceil(n / MEMBERS), F.ceil(w / BYTES))
    weight = F.sum(F.lit(1000) + 8 * F.col("n_shingles"))
    held = ws.write(named.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"), weight.alias("w")), "held")
    large = F.col("blocks") > 1
    sized = held.withColumn("blocks", need(F.col("n"), F.col("w")))
    rest = lambda c: F.sum(F.when(large, 0).otherwise(F.col(c)))
    open_ = sized.groupBy("bucket").agg(F.count(F.lit(1)).alias("labels"), need(rest("n"), rest("w")).alias("mixed"), F.sum(F.when(large, F.col("blocks")).otherwise(0)).alias("pure")).where("labels > 1")
    open_ = ws.write(open_.select("bucket", long_(F.col("mixed")).alias("mixed"), long_(F.col("mixed") + F.col("pure")).alias("total")), "open")
    before = Window.partitionBy("bucket").orderBy("label").rowsBetween(Window.unboundedPreceding, -1)
    own = sized.where(large).select("bucket", "label", long_(F.col("blocks")).alias("blocks"), long_(F.coalesce(F.sum("blocks").over(before), F.lit(0))).alias("low"))
    rows = named.join(open_, "bucket").join(own.hint("merge"), ["bucket", "label"], "left")
    hashed = F.xxhash64("node")
    low = F.col("mixed") + F.col("low")
    block = F.when(F.col("blocks").isNull(), F.pmod(hashed, F.greatest("mixed", F.lit(1)))).otherwise(low + F.pmod(hashed, F.col("blocks")))
    every = F.sequence(F.lit(0).cast("long"), F.col("total") - 1)
    others = F.when(F.col("blocks").isNull(), every).otherwise(F.filter(every, lambda x: (x < low) | (x >= low + F.col("blocks"))))
    return rows.select("bucket", "band", "node", "label", block.alias("own"), others.alias("others"))


def near_components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``k1, k2, doc_id, n_shingles, component_id, kept`` for each document, with the keys of ``_rows``."""
    spark = docs.sparkSession
    bound_batches(spark)
    ws = Workspace(spark, "near")
    signed = ws.write(sign(docs, words, percent), "signed")
    full = signed.where("node IS NOT NULL")
    classes = ws.write(full.groupBy("node").agg(F.min("doc_id").alias("least"), F.min(F.struct("k1", "k2")).alias("key"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), F.first("bands").alias("bands")), "classes")

    # buckets with several classes, and each member's smallest class there
    banded = classes.select("node", "n_shingles", F.posexplode("bands").alias("band", "bucket"))
    buckets = ws.write(banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.min("node").alias("first")).where("members > 1"), "buckets")
    members = ws.write(banded.join(buckets, "bucket").select("bucket", "band", "node", "n_shingles", "first"), "members")
    involved = members.select("node").distinct()
    sets = ws.write(_sets(docs, classes.join(involved, "node").select("node", "key.k1", "key.k2", "sig"), words), "sets")

    star = members.where("node <> first").groupBy("node", "first").agg(F.count(F.lit(1)).alias("n"))
    star = star.groupBy(F.col("node").alias("a")).agg(F.min_by("first", F.struct(-F.col("n"), "first")).alias("b"))
    for c in ("a", "b"):
        star = star.join(sets.select(F.col("node").alias(c), F.col("sig").alias(f"sig_{c}"), F.col("set").alias(f"set_{c}")), c)
    tested = ws.write(star.select("a", "b", "sig_a", "sig_b", "set_a", "set_b").mapInPandas(_verify(percent), "a binary, b binary"), "star")
    labels = ws.write(components(tested, ws, "cc-star"), "labels")

    named = members.join(labels, "node", "left").select("bucket", "band", "node", "n_shingles", F.coalesce("label", "node").alias("label"))
    blocks = _blocks(named, ws).join(sets, "node").withColumn("other", F.explode("others"))
    blocks = blocks.select("bucket", "band", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") > F.col("other")).cast("int").alias("side"), "label", "sig", "set")
    links = blocks.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y", "band").mapInPandas(_across(percent), "a binary, b binary")
    merged = ws.write(components(ws.write(links, "links"), ws, "cc-blocks"), "merged")

    ids = classes.select("node", "least").join(labels, "node", "left").select("node", "least", F.coalesce("label", "node").alias("label"))
    ids = ids.join(merged.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", "least", F.coalesce("to", "label").alias("label"))
    ids = ws.write(ids, "joined")
    named = ids.groupBy("label").agg(F.min("least").alias("component_id"))
    ids = ws.write(ids.join(named, "label").select("node", "component_id"), "ids")
    out = ws.write(signed.select("k1", "k2", "doc_id", "n_shingles", "node").join(ids, "node", "left").select("k1", "k2", "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")), "out")
    ws.keep("out")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``node, sig, set`` of the classes that share a bucket."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                some = batch.iloc[at : at + 500]
                yield pd.DataFrame({"node": some["node"].tolist(), "sig": some["sig"].tolist(), "set": [shingles(t, words).tobytes() for t in some["text"]]})

    rows = _rows(docs).select("k1", "k2", "text").join(wanted, ["k1", "k2"]).select("node", "sig", "text")
    # rows repeated in full would give a class several times
    return rows.mapInPandas(run, "node binary, sig binary, set binary").dropDuplicates(["node"])


def near_report(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each document."""
    return near_components(docs.select("doc_id", "text"), words, percent).select("doc_id", "n_shingles", "component_id", "kept")


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, with its columns: that with the smallest id, once if its row is repeated."""
    found = near_components(docs.select("doc_id", "text"), words, percent)
    kept = found.where("kept").select("k1", "k2").distinct()
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("_k1"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("_k2")]
    rows = docs.select(F.struct("*").alias("_row"), *key)
    kept = kept.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"))
    return rows.join(kept, ["_k1", "_k2"], "left_semi").dropDuplicates(["_k1", "_k2"]).select("_row.*")


#: DuckDB SQL for the rows of ``near_report`` over ``documents`` with three words and 85 %.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 2), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
      WHERE 100 * x.n >= 85 * y.n AND 100 * y.n >= 85 * x.n GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
c AS (SELECT doc_id, doc_id AS least FROM documents UNION SELECT e.b, c.least FROM c JOIN e ON c.doc_id = e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(c.least) AS component_id, d.doc_id = min(c.least) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.doc_id = d.doc_id GROUP BY d.doc_id, n.n
"""
