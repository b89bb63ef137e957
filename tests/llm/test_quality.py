import math
import random
from collections import Counter, defaultdict

import numpy as np
from cases import awkward_rows, sentence
from pyspark.sql import functions as F

from vellum.llm import quality
from vellum.llm.common import Workspace

LABELS = "doc_id long, quality int, toxic int"
N = quality.ORDER


def brute_force(texts, alphabet):
    """p(w | h) of interpolated modified Kneser-Ney by its definition, for a list of symbol lists."""
    grams = Counter()
    for t in texts:
        s = [0] * (N - 1) + list(t)
        grams.update(tuple(s[i - N + 1 : i + 1]) for i in range(N - 1, len(s)))
    counts = {N: grams}
    for k in range(N - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])

    def cuts(c):
        n = Counter(c.values())
        n1, n2, n3, n4 = max(n[1], 1), n[2], n[3], n[4]
        y = n1 / (n1 + 2 * n2)
        d = lambda i, a, b: max(i - (i + 1) * y * b / a if a else 0.5 * i, quality.LEAST)
        return [0, d(1, n1, n2), d(2, n2, n3), d(3, n3, n4)]

    cut = {k: cuts(c) for k, c in counts.items()}
    after = {k: defaultdict(list) for k in counts}
    for k, c in counts.items():
        for g, n in c.items():
            after[k][g[:-1]].append(n)

    def p(g):
        if not g:
            return 1 / alphabet
        k, own = len(g), after[len(g)].get(g[:-1])
        if not own:
            return p(g[1:])
        n, d = counts[k][g], cut[k]
        return (max(n - d[min(n, 3)], 0) + sum(d[min(x, 3)] for x in own) * p(g[1:])) / sum(own)

    return p


def symbols(text):
    return quality.symbols(text).tolist()


def test_grams():
    for texts in (["ab", "", "c"], ["\U0001f600x漢 7\t8\r\n", "a" * 9]):
        own = [quality.symbols(t) for t in texts]
        code, names = quality.grams(np.concatenate(own), np.array([len(x) for x in own]))
        want = ["".join(map(chr, ([0] * (N - 1) + x.tolist())[i : i + N])) for x in own for i in range(len(x))]
        assert [names[i] for i in code] == want and len(set(names)) == len(names)
    assert symbols("a\t1२\u3000\r\0é") == [97, 32, 48, 48, 32, 10, 32, 233]


def test_grams_of_a_large_alphabet():
    own = np.random.default_rng(1).permutation(np.arange(0x4E00, 0x4E00 + 12_000, dtype=np.uint32))
    code, names = quality.grams(own, np.array([7000, 5000]))
    assert len(names) == 12_000 and names[code[6]] == "".join(map(chr, own[7 - N : 7])) and names[code[7000]] == "\0" * (N - 1) + chr(own[7000])


def test_probabilities(spark):
    rng = random.Random(1)
    good = [sentence(rng, 40, "abcdeжшя") for _ in range(16)]
    bad = [sentence(rng, 40, "vwxyz#") for _ in range(3)]
    rows = [(i, t, "en") for i, t in enumerate(good + bad)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < len(good)), 0) for i in range(len(rows))], LABELS)
    train = {r["_id"] for r in quality.trusted_ids(labels).where("_fold = 1").collect()}
    assert 6 <= len(train) < 16
    p = brute_force([symbols(t) for i, t in enumerate(good) if i in train], len({c for _, t, _ in rows for c in symbols(t)}))
    ws = Workspace(spark, "t")
    found = {(r["id"], r["chars"]): r["nats"] for r in quality.score(docs, labels, ws).collect()}
    for i, t, _ in rows:
        s = [0] * (N - 1) + symbols(t)
        want = sum(-math.log(p(tuple(s[k - N + 1 : k + 1]))) for k in range(N - 1, len(s)))
        assert math.isclose(found[str(i), len(t)], want, rel_tol=1e-9)
    for r in quality.quality_report(docs, labels).collect():
        assert r["doc_id"] < len(good) or not r["kept"]


def test_sums_to_one():
    alphabet = sorted(set(symbols("abracadabra cadabra")))
    p = brute_force([symbols("abracadabra cadabra")], len(alphabet))
    for h in ((0,) * (N - 1), tuple(symbols("abra")), tuple(symbols("xbra"))):
        assert math.isclose(sum(p((*h[-(N - 1) :], w)) for w in alphabet), 1)


def test_other_scripts_are_told_apart(spark):
    """Prose and one repeated letter in words of the same lengths, in a script without a Latin letter."""
    rng = random.Random(6)
    prose = [sentence(rng, 80, "абвгдеж") for _ in range(80)]
    junk = ["".join(c if c == " " else "ъ" for c in t) for t in prose[:5]]
    rows = [(i, t, "ru") for i, t in enumerate(prose + junk)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(len(prose))], LABELS)
    got = {r["doc_id"]: r for r in quality.quality_report(spark.createDataFrame(rows, "doc_id long, text string, lang string"), labels).collect()}
    assert all(not got[i]["kept"] and got[i]["perplexity"] > 2 * got[0]["perplexity"] for i in range(80, 85))


def test_each_language_has_its_own_model(spark):
    """Many languages, each with letters of its own and one document in the next one's."""
    rng, rows = random.Random(3), []
    for k in range(24):
        rows += [(len(rows) + i, sentence(rng, 60, "abcdefghijklmnopqrstuvwxyz"[k : k + 3]), f"l{k}") for i in range(20)]
    good = len(rows)
    rows += [(good + k, rows[20 * (k + 12) % good][1], f"l{k}") for k in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(good)], LABELS)
    got = {r["doc_id"]: r["kept"] for r in quality.quality_report(docs, labels).collect()}
    assert not any(got[good + k] for k in range(24)) and sum(got[i] for i in range(good)) > 0.9 * good


def test_labels_beyond_the_bound_give_the_same(spark, monkeypatch):
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, sentence(rng, 30), "en") for i in range(20)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)], LABELS)
    one = sorted(map(tuple, quality.quality_report(docs, labels).select("doc_id", "kept", F.round("perplexity", 9)).collect()))
    monkeypatch.setattr(quality, "MOST_LABELS", 3)
    assert one == sorted(map(tuple, quality.quality_report(docs, labels).select("doc_id", "kept", F.round("perplexity", 9)).collect()))


def test_languages_apart(spark):
    rng = random.Random(2)
    rows = [(i, sentence(rng, 60, "abcde" if i % 2 else "mnopq"), "x" if i % 2 else "y") for i in range(60)]
    rows += [(60, sentence(rng, 60, "abcde"), "y"), (61, sentence(rng, 60, "abcde"), "unknown"), (62, sentence(rng, 60, "abcde"), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)], LABELS)
    got = {r["doc_id"]: r for r in quality.quality_report(docs, labels).collect()}
    assert not got[60]["kept"] and sum(got[i]["kept"] for i in range(60)) > 50
    assert got[61]["kept"] and got[62]["kept"] and got[61]["perplexity"] is None and got[61]["limit"] is None


def test_awkward(spark, awkward, clashing, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (2, 1, 0), (3, 1, 0), (16, 1, None), (8, 1, 0), (8, 0, 0), (14, 1, 1), (None, 1, 0), (99, 1, 0), (10, None, None)], LABELS)
    got = quality.quality_report(clashing, labels)
    assert got.count() == len(awkward_rows()) and got.where("doc_id IN (5, 6)").where("NOT kept OR perplexity IS NOT NULL").count() == 0
    assert quality.keep_good(clashing, labels).columns == clashing.columns
    assert quality.trusted_ids(labels).agg(F.sort_array(F.collect_list("_id"))).first()[0] == [1, 2, 3, 16, 99]
    none = spark.createDataFrame([], LABELS)
    assert quality.quality_report(awkward, none).where("kept").count() == len(awkward_rows())
    assert quality.quality_report(nothing, labels).count() == 0


def test_separates(spark, sf_dir):
    """Junk of the test data is found, and clean text stays."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/../sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.quality_report(docs, labels).join(labels, "doc_id")
    clean = got.where("quality = 1 AND toxic = 0")
    assert clean.where("kept").count() >= 0.99 * clean.count()
    assert got.where("quality = 0 AND NOT kept").count() >= 0.75 * got.where("quality = 0").count()


def test_toxic(spark, sf_dir):
    """English text with insults that otherwise reads well is found, and clean text stays."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/../sf0.1/{t}.parquet").where("doc_id % 2 = 0") for t in ("documents", "labels"))
    got = quality.quality_report(docs.where("lang = 'en'"), labels).join(labels, "doc_id").where("quality = 1")
    n = {r["toxic"]: (r["n"], r["kept"]) for r in got.groupBy("toxic").agg(F.count("*").alias("n"), F.count_if("kept").alias("kept")).collect()}
    assert n[1][0] > 90 and n[1][1] <= 0.1 * n[1][0] and n[0][1] >= 0.99 * n[0][0]


def pairs(found):
    return [[(int(x) >> 32, int(x) & 0xFFFFFFFF) for x in t] for t in found]


def test_surprises():
    texts = ["ab  c", "", " d"]
    words, levels, places = quality.surprises(np.array(symbols("".join(texts))), np.array([32, 32, 32, 99, 16, 7, 48]) / 16, np.array([len(t) for t in texts]))
    assert words.tolist() == [2, 0, 1] and pairs(levels) == [[(8, 1), (16, 1)], [], [(24, 1)]]
    assert pairs(places) == [[(b, 1) for b in range(16)], [], [(b, 1) for b in range(24)]]


def test_places():
    """Odd words near each other are one place."""
    rng = random.Random(5)
    texts = [" ".join("xy"[rng.random() < 0.1] for _ in range(rng.randint(0, 120))) for _ in range(30)]
    own = np.array(symbols("".join(texts)))
    cost = np.where(own == ord("y"), 3.0, np.where(own == ord("x"), 1.0, 2.0))
    words, _, places = quality.surprises(own, cost, np.array([len(t) for t in texts]))
    for text, n, found in zip(texts, words, pairs(places), strict=True):
        at = [i for i, w in enumerate(text.split()) if w == "y"]
        want = sum(i == 0 or at[i] > at[i - 1] + quality.NEAR for i in range(len(at)))
        assert n == len(text.split()) and dict(found).get(16, 0) == want
