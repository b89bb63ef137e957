import random

import pytest
from cases import awkward_rows, sentence
from pyspark.sql import functions as F

from vellum.llm import decontaminate as D

ITEMS = "item_id long, text string"


def distance(item, text):
    """Smallest edit distance to a substring, by the full table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        i, kind = rng.randrange(len(out)), rng.randrange(3)
        if kind == 0:
            out[i] = rng.choice("abcdefgh")
        elif kind == 1:
            out.insert(i, rng.choice("abcdefgh"))
        elif len(out) > 1:
            del out[i]
    return "".join(out)


def test_myers():
    rng = random.Random(1)
    for _ in range(1500):
        item, text = ("".join(rng.choice("abc") for _ in range(rng.randint(lo, 14))) for lo in (1, 0))
        assert D.myers(item, text) == distance(item, text)


def test_pieces():
    for n in range(1, 60):
        for k in range(n + 2):
            got = D.pieces("x" * n, k)
            assert "".join(p for _, p in got) == "x" * n and len(got) == min(k + 1, n)


@pytest.mark.parametrize("block_chars", [300, 4_000_000])
def test_against_brute_force(spark, block_chars):
    rng = random.Random(2)
    items = [(i, sentence(rng, rng.randint(10, 40), "abcdefgh")) for i in range(12)]
    docs = []
    for i in range(150):
        text = sentence(rng, rng.randint(0, 60), "abcdefgh")
        if i % 2:
            item = items[rng.randrange(12)][1]
            text += " " + edited(rng, item.upper().replace(" ", " \n"), rng.randrange(12)) + " " + sentence(rng, 20, "abcdefgh")
        docs.append((i, text))
    got = {r["doc_id"]: r for r in D.leak_report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEMS), rate=0.06, block_chars=block_chars).collect()}
    leaks = 0
    for i, text in docs:
        own = D.normalise(text)
        found = {k: d for k, item in items if (d := distance(D.normalise(item), own)) <= int(0.06 * len(D.normalise(item)))}
        best = min(((d, k) for k, d in found.items()), default=(None, None))
        assert (got[i]["items"], got[i]["item_id"], got[i]["distance"], got[i]["contaminated"]) == (len(found), best[1], best[0], bool(found))
        leaks += bool(found)
    assert 20 < leaks < 75


def test_awkward(spark, awkward, clashing, nothing):
    long = next(r[1] for r in awkward_rows() if r[0] == 8)
    items = spark.createDataFrame([(3, long[-400:-100]), (2, long[-400:-100]), (4, None), (5, ""), (6, "X"), (None, long[:200])], ITEMS)
    for size in (4_000_000, 350):
        found = {r["doc_id"]: (r["items"], r["item_id"], r["distance"]) for r in D.leak_report(awkward, items, block_chars=size).where("contaminated").collect()}
        assert found == {8: (3, 2, 0), 9: (3, 2, 0), 10: (1, 6, 0), 11: (1, 6, 0)}
        kept = D.remove_leaks(clashing, items, block_chars=size)
        assert kept.columns == clashing.columns and kept.count() == len(awkward_rows()) - 4
    assert D.leak_report(nothing, items).count() == 0
    assert D.leak_report(awkward, items.limit(0)).where("contaminated").count() == 0


def test_short_items_match_as_whole_words(spark):
    items = spark.createDataFrame([(1, "What is  the capital?"), (2, "Rome")], ITEMS)
    texts = ["so: what is\nthe capital? Rome", "what is the capital", "romeo", "in rome.", "chrome", "(ROME)", "somewhat is the capital?"]
    got = D.leak_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), items).orderBy("doc_id").collect()
    assert [r["items"] for r in got] == [2, 0, 0, 1, 0, 1, 0]


def test_many_blocks_use_bounded_memory(spark):
    """Twenty blocks: each pass broadcasts one, and no plan holds more than one function."""
    rng = random.Random(9)
    items = [(i, sentence(rng, 12)) for i in range(20)]
    docs = spark.createDataFrame([(i, sentence(rng, 20) + " " + items[i % 20][1]) for i in range(60)] + [(99, sentence(rng, 20))], "doc_id long, text string")
    out = D.leak_report(docs, spark.createDataFrame(items, ITEMS), block_chars=1)
    assert "ArrowEvalPython" not in out._jdf.queryExecution().toString()
    assert {r["doc_id"]: r["item_id"] for r in out.collect()} == {i: i % 20 for i in range(60)} | {99: None}


def test_planted(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/../sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    whole = docs.join(F.broadcast(items.select(F.col("text").alias("t"))), F.expr("contains(text, t)"), "left_semi").select("doc_id")
    got = D.leak_report(docs, items).where("contaminated")
    assert whole.count() > 10 and whole.join(got, "doc_id", "left_anti").count() == 0
