import random
from collections import defaultdict

import numpy as np
import pytest
from cases import awkward_rows, sentence

from vellum.llm import near_dedup as N
from vellum.llm.common import Workspace
from vellum.llm.components import components

LOWER = {c: chr(ord(c) + 32) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def sets_of(rows, words):
    out = []
    for r in rows:
        w = "".join(LOWER.get(c, c) for c in r[1] or "").encode().split()
        out.append(frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset())
    return out


def brute_force(rows, words, percent):
    """(doc_id, set size, smallest id of the component) by comparing all pairs."""
    sets = sets_of(rows, words)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    distinct = sorted(set(sets) - {frozenset()}, key=len)
    first = {s: sets.index(s) for s in distinct}
    for i, s in enumerate(sets):
        if s:
            root[find(i)] = find(first[s])
    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if 100 * len(a) < percent * len(b):
                break
            if 100 * len(a & b) >= percent * len(a | b):
                root[find(first[a])] = find(first[b])
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    least = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
    return sorted(((rows[i][0], len(sets[i]), least[find(i)]) for i in range(len(rows))), key=str)


def got(df, words, percent):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in N.near_report(df, words, percent).collect()), key=str)


def chain(rng, n):
    """Each a small edit of the one before: linked neighbours, distant ends."""
    words, out = sentence(rng, 200).split(), []
    for _ in range(n):
        words = list(words)
        for _ in range(2):
            words[rng.randrange(len(words))] = sentence(rng, 1)
        out.append(" ".join(words))
    return out


def star(rng, n, edits):
    base, out = sentence(rng, 150).split(), []
    for _ in range(n):
        words = list(base)
        for _ in range(edits):
            words[rng.randrange(len(words))] = sentence(rng, 1)
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_against_brute_force(spark, words, percent):
    rng = random.Random(7)
    texts = chain(rng, 40) + [t for e in (1, 2, 3, 4) for t in star(rng, 12, e)] + [sentence(rng, rng.randint(0, 80)) for _ in range(60)]
    texts += texts[::9] + [t.upper() for t in texts[::11]]
    rng.shuffle(texts)
    rows = [(i, t) for i, t in enumerate(texts)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), words, percent) == brute_force(rows, words, percent)


@pytest.mark.parametrize(("members", "size"), [(8, 1 << 20), (512, 9000)])
def test_large_bucket(spark, monkeypatch, members, size):
    """Buckets of several blocks, with members that are close to the threshold."""
    monkeypatch.setattr(N, "MEMBERS", members)
    monkeypatch.setattr(N, "BYTES", size)
    rng = random.Random(8)
    rows = [(i, t) for i, t in enumerate(star(rng, 70, 3) + star(rng, 70, 5))]
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85) == brute_force(rows, 3, 85)


def test_awkward(awkward, clashing, nothing):
    want = brute_force(awkward_rows(), 5, 80)
    assert got(awkward, 5, 80) == want and got(clashing, 5, 80) == want
    kept = N.keep_one(clashing)
    assert kept.columns == clashing.columns
    assert N.near_report(nothing).count() == 0 and N.keep_one(nothing).count() == 0


def test_keeps_one_of_each(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    report = N.near_report(docs)
    kept = N.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in report.where("kept").collect())


def test_repeated_rows_stay_once(spark):
    text = sentence(random.Random(1), 30)
    df = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    assert [r["doc_id"] for r in N.keep_one(df).collect()] == [1]


def test_pruning_keeps_what_could_reach_the_threshold():
    rng = np.random.default_rng(1)
    for percent, similarity in ((85, 0.85), (80, 0.8), (85, 0.9)):
        bands, rows = N.layout(percent)
        a = rng.integers(0, 1 << 32, (20_000, bands * rows), np.uint32)
        b = np.where(rng.random(a.shape) < similarity, a, a + 1)
        k = np.arange(len(a))
        assert len(N.sequential(a, b, k, k, percent)) >= 19_995
        far = np.where(rng.random(a.shape) < similarity - 0.35, a, a + 1)
        assert len(N.sequential(a, far, k, k, percent)) < 20


def test_layout_bounds_the_chance_to_miss():
    for percent in (50, 70, 80, 85, 90, 99, 100):
        bands, rows = N.layout(percent)
        assert bands * rows <= N.HASHES and (1 - (percent / 100) ** rows) ** bands <= N.MISS


def test_intersections():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 9000, n, np.uint64)) for n in (1, 5, 4000, 8000, 3)]
    got = N.intersections(sets[:3], sets[2:])
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[2:]] for a in sets[:3]]
    assert N.intersections([sets[0] + np.uint64(10_000)], [sets[1]]).tolist() == [[0]]


def test_work_grows_with_a_group(spark, monkeypatch):
    """A group of near copies of which many are near but below the threshold: rows written and dealt grow with it, not with its square."""
    counts, write = {}, N.Workspace.write

    def counted(self, df, name):
        out = write(self, df, name)
        counts[name] = counts.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(N.Workspace, "write", counted)
    made = []
    for n in (300, 600):
        rng = random.Random(4)
        counts.clear()
        texts = [t for e in (1, 2, 3) for t in star(rng, n // 3, e)] + [sentence(rng, 60) for _ in range(n)]
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        N.near_report(df, 3, 85).count()
        made.append(dict(counts))
    for small, large in zip(made, made[1:], strict=False):
        # links join components, so they are fewer than those in each block
        grown = {k: (small.get(k, 0), n) for k, n in large.items() if not k.startswith(("cc-", "links", "merged")) and n > 2.5 * small.get(k, 0) + 20}
        assert not grown and large["links"] < large["classes"] and large["merged"] < large["classes"]


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    found = components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "t"), "c")
    own = {r["node"]: r["label"] for r in found.collect()}
    assert all(own.get(x, x) == find(x) for x in root) and found.count() == len(own)
    assert components(spark.createDataFrame([], "a long, b long"), Workspace(spark, "t"), "e").count() == 0
