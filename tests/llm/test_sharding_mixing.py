import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from cases import as_rows, awkward_rows
from pyspark.sql import functions as F

from vellum.llm import mixing, sharding


def test_ring_walk():
    owners = sharding.ring_owners(8, 64, 12)
    assert len(owners) == 4096 and set(owners) == set(range(8))
    plan = sharding.place({0: 10, 5: 3, 4095: 4}, [0] * 2048 + [1] * 2048, [9, 8])
    assert sum(p[2] for p in plan) == 17 and Counter({s: sum(p[2] for p in plan if p[3] == s) for s in (0, 1)}) == {0: 9, 1: 8}
    assert plan[0] == (0, 0, 9, 0, 0) and plan[1] == (0, 9, 1, 1, 0)  # the overflow goes on clockwise
    with pytest.raises(ValueError):
        sharding.ring_owners(8, 64, 8)


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_shards(spark, shards):
    df = spark.range(1003).select(F.col("id").alias("doc_id"), F.concat(F.lit("é"), F.col("id")).alias("text"))
    got = sharding.ring_shards(df, shards).collect()
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
        text = f"é{r['doc_id']}".encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(text) + 1, zlib.crc32(text), "rows", None)
    assert len(got) == 1003 and set(by) == set(range(shards))
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert sorted(map(tuple, sharding.ring_shards(df.repartition(7), shards).collect())) == sorted(map(tuple, got))


def test_few_keys_move(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    a, b = ({r["doc_id"]: r["shard"] for r in sharding.ring_shards(df, n).collect()} for n in (8, 9))
    assert sum(a[i] != b[i] for i in a) < 1.4 * len(a) / 9


def test_awkward_shards(awkward, clashing, nothing):
    got = sharding.ring_shards(clashing, 4, carry=True)
    assert got.count() == len(awkward_rows()) and sorted(got.columns) == sorted(clashing.columns)
    assert got.where("size = 'clash' AND law = 'clash' AND shard BETWEEN 0 AND 3").count() == len(awkward_rows())
    own = sharding.ring_shards(awkward, 4)
    assert as_rows(got, "doc_id", "shard", "slot") == as_rows(own, "doc_id", "shard", "slot")
    assert sharding.ring_shards(nothing).count() == 0 and sharding.ring_shards(nothing, carry=True).count() == 0
    assert {(r["size"], r["text_crc32"]) for r in own.where("doc_id IN (5, 6)").collect()} == {(1, 0)}


def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == [187.5, 75.0, 37.5]
    assert mixing.targets([10, 100, 100], [5, 2, 1]) == [30.0, 120.0, 60.0]
    assert mixing.targets([1, 1, 1000], [5, 2, 1]) == [3.0, 3.0, 996.0]
    assert mixing.targets([0, 5], [5, 2]) == [0.0, 5.0] and mixing.targets([], []) == [] and mixing.targets([0], [1]) == [0.0]


def xx(*values):
    """Spark's xxhash64 of ints (Python's int here) and longs (given as one-element tuples)."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(struct.pack("<q", v[0]) if isinstance(v, tuple) else struct.pack("<i", v), seed=h)
    return h - (1 << 64) if h >> 63 else h


def place(x, n, *key):
    """``mixing.permuted`` in plain Python."""
    a, b = mixing.grid(n)
    while True:
        r, c = divmod(x, b)
        for i in range(1, mixing.ROUNDS // 2 + 1):
            r = (r + xx(*key, i, (c,)) % a) % a
            c = (c + xx(*key, -i, (r,)) % b) % b
        x = r * b + c
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 10, 97, 1000, 4099])
def test_permuted(spark, n):
    a, b = (F.lit(v).cast("long") for v in mixing.grid(n))
    got = [r["p"] for r in spark.range(n).orderBy("id").select("id", mixing.permuted(F.col("id"), F.lit(n).cast("long"), a, b, F.lit(7), F.lit(3)).alias("p")).orderBy("id").collect()]
    assert sorted(got) == list(range(n)) and got == [place(i, n, 7, 3) for i in range(n)]


def test_grid():
    for n in (1, 2, 12, 10**6, 10**12 + 7):
        a, b = mixing.grid(n)
        assert 0 <= a * b - n < a + 1


def check_mix(got, rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    totals = Counter()
    for r in rows:
        totals[r[3]] += size(r[1])
    names = sorted(totals, key=lambda s: (s is None, s or ""))
    goals = dict(zip(names, mixing.targets([totals[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))]), strict=True))
    taken, source = Counter(), {(r[0], size(r[1])): r[3] for r in rows}
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(r[0]), size(r[1])) for r in rows)
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        s = source[(r["doc_id"], r["size"])]
        taken[s] += r["taken"]
        if [x[3] for x in rows if (x[0], size(x[1])) == (r["doc_id"], r["size"])].count(s) == sum((x[0], size(x[1])) == (r["doc_id"], r["size"]) for x in rows):
            assert r["source_size"] == totals[s] and abs(r["target"] - goals[s]) < 1e-6
    return taken, goals


def test_mix(spark):
    rows = [(i, "w " * (1 + i * 37 % 400), None, f"s{i % 7}" if i % 3 else "s0", 0) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out, drawn = mixing.mix(df, block=16, slots=500)
    taken, goals = check_mix(out.collect(), rows)
    assert all(abs(taken[s] - goals[s]) <= 0.01 * goals[s] + 32 for s in goals)
    again = mixing.mix(df.repartition(5), block=16, slots=500)[0]
    assert as_rows(out, "doc_id", "taken") == as_rows(again, "doc_id", "taken")
    # the slots of a shard are filled without a gap
    slots = drawn.groupBy("shard").agg(F.count("*").alias("n"), F.count_distinct("slot").alias("d")).orderBy("shard").collect()
    assert all(r["n"] == r["d"] == 500 for r in slots[:-1])
    mixed = mixing.mix_documents(df)
    assert mixed.columns == df.columns and mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    words = Counter()
    for r in mixed.collect():
        words[r["source"]] += r["text"].count("w")
    assert all(abs(words[s] - goals[s]) <= 0.15 * goals[s] for s in goals)


def test_counts_vary_as_multinomial_draws_do(spark):
    """Slots of each source in shards: mean and variance of multivariate hypergeometric counts."""
    plan = [{"src": i, "draws": d, "blocks": d, "first": f} for i, (d, f) in enumerate(((100_000, 0), (60_000, 100_000), (40_000, 160_000)))]
    table = spark.createDataFrame([(p["src"], p["draws"], p["blocks"], p["first"], *mixing.grid(p["blocks"])) for p in plan], "src int, draws long, blocks long, first long, a long, b long")
    drawn = mixing.draw(table, 200_000, 500, 7).cache()
    assert drawn.select("shard", "slot").distinct().count() == drawn.select("src", "pass", "index").distinct().count() == 200_000
    for p in plan:
        counts = [r["slots"] for r in mixing.shard_counts(drawn).where(F.col("src") == p["src"]).collect()]
        share = p["draws"] / 200_000
        want = 500 * share * (1 - share) * (200_000 - 500) / (200_000 - 1)
        assert len(counts) == 400 and abs(np.mean(counts) - 500 * share) < 1e-9
        assert 0.8 * want < np.var(counts) < 1.2 * want
    # neighbouring draws don't walk the blocks in a stride
    steps = Counter(b - a for a, b in zip(*(lambda x: (x, x[1:]))([r["index"] for r in drawn.where("src = 0").orderBy("shard", "slot").limit(5000).collect()]), strict=False))
    assert max(steps.values()) < 10
    drawn.unpersist()


def brute_mix(rows, block, slots, seed=7, most=3):
    """Words taken of each row, by the definition: streams of words, blocks, draws, slots."""
    text = lambda r: xxhash.xxh64_intdigest((r[1] or "").encode(), seed=42)
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    buckets = max(16, -(-len(rows) // mixing.BUCKET))
    names = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    by = {s: sorted((r for r in rows if r[3] == s), key=lambda r: (xx(seed, (r[0],), (signed(text(r)),)) % buckets, xx((r[0],), seed), r[0], signed(text(r)))) for s in names}
    sizes = [sum(map(size, by[s])) for s in names]
    goals = mixing.targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))], most)
    taken, shards, first = Counter(), {}, 0
    blocks = [-(-n // block) for n in sizes]
    draws = [round(g * b / n) if n else 0 for g, b, n in zip(goals, blocks, sizes, strict=True)]
    for src, s in enumerate(names):
        stream = [(r, w) for r in by[s] for w in re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")]
        for k in range(draws[src]):
            turn, at = divmod(k, blocks[src])
            index = place(at, blocks[src], seed, src, turn)
            words = stream[index * block : (index + 1) * block]
            shards[divmod(place(first + k, sum(draws), seed), slots)] = " ".join(w for _, w in words)
            taken.update(r[0] for r, _ in words)
        first += draws[src]
    return taken, shards


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(rng.choice([0, 1, 3, 40, 300]))), None, rng.choice(["a", "b", "c", None]), 0) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    taken, shards = brute_mix(rows, 16, 50)
    assert {r["doc_id"]: r["taken"] for r in mixing.mix(df, block=16, slots=50)[0].collect()} == {r[0]: taken[r[0]] for r in rows}
    assert {(r["shard"], r["slot"]): r["text"] for r in mixing.packed_shards(df, block=16, slots=50).collect()} == shards


def test_rows_of_each_source_stay_apart(spark):
    rows = [(1, "w " * 50, "en", "x", 1), (1, "w " * 50, "en", "y", 1)] + [(i, "v " * 50, "en", "xy"[i % 2], 1) for i in range(2, 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = mixing.mix_documents(df, block=8).where("doc_id = 1").groupBy("source").count().collect()
    assert {r["source"] for r in got} <= {"x", "y"} and all(r["count"] <= 3 for r in got)
    n = {s: sum(r["taken"] for r in mixing.mix(df.where(F.col("source") == s), block=8)[0].collect()) for s in "xy"}
    assert n["x"] and n["y"] and any(r["source"] == "x" for r in got)


def ring_walk(rows, shards, vnodes=64, bits=12):
    """Shard and slot of each row: ranks of each cell's keys, then a walk from cell to cell, one key at a time."""
    owners, cells = sharding.ring_owners(shards, vnodes, bits), defaultdict(list)
    quota = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
    for doc_id, text in rows:
        raw = xxhash.xxh64_intdigest((text or "").encode(), seed=42)
        digest = hashlib.md5(f"{'none' if doc_id is None else doc_id}/{raw - (1 << 64) if raw >> 63 else raw}".encode()).hexdigest()
        cells[int(digest[:8], 16) % (1 << bits)].append((digest, doc_id))
    used, out = [0] * shards, {}
    for cell in sorted(cells):
        for _, doc_id in sorted(cells[cell], key=lambda x: x[0]):
            at = cell
            while used[owners[at]] == quota[owners[at]]:
                at = (at + 1) % (1 << bits)
            out[doc_id] = (owners[at], used[owners[at]])
            used[owners[at]] += 1
    return out


@pytest.mark.parametrize("shards", [1, 5, 8])
def test_ring_against_brute_force(spark, shards):
    rows = [(i, None if i % 50 == 0 else f"text {i % 300}") for i in range(3000)] + [(None, "x")]
    got = sharding.ring_shards(spark.createDataFrame(rows, "doc_id long, text string"), shards).collect()
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in got} == ring_walk(rows, shards)


def test_awkward_mix(awkward, clashing, nothing):
    check_mix(mixing.mix(awkward)[0].collect(), awkward_rows())
    assert as_rows(mixing.mix(clashing)[0], "doc_id", "size", "taken") == as_rows(mixing.mix(awkward)[0], "doc_id", "size", "taken")
    assert mixing.mix(nothing)[0].count() == 0 and mixing.mix_documents(nothing).count() == 0
    assert mixing.mix_documents(clashing).count() > 0
