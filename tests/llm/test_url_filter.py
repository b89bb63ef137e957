import math
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from vellum.llm import url_filter as U

PAGES = "page_id long, url string, html string"


def split(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")


def rule(host, path):
    fits = [(r, v) for r, v in U.RULES for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return max(fits, key=lambda x: len(x[0]), default=(None, None))


URLS = [
    "http://a.org/x", "https://EXAMPLE.org/en/1", "http://www.example.org/en/12?q", "http://example.org/es/", "http://example.org/es", "http://example.org", "http://notorg/x", "ftp://x.com/fr/1", "x.com/de/",
    "http://com/de/?x", "http://q.com?a=://b.org/", "://h.org/p", "a://b://c/d", None, "", "no scheme", "http://", "http:///path", "http://É.Com/fr/", "http://x.example.org/en/1#f", "http://u:p@h.org:80/", "http://a.com/fr\n/x", "\n://o.org/",
]


def test_rules(spark):
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(URLS)], PAGES).withColumns({c: F.lit("clash") for c in ("host", "path", "rule", "verdict", "score")})
    got = {r["page_id"]: r for r in U.url_verdicts(df).collect()}
    assert len(got) == len(URLS)
    for i, u in enumerate(URLS):
        host, path = split(u)
        name, verdict = rule(host, path)
        r = got[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, name), u
        assert r["verdict"] == (verdict or ("block" if r["score"] > 0.5 else "allow")) and 0 <= r["score"] <= 1
    assert got[URLS.index(None)]["verdict"] == "allow"


def test_training_against_plain_loops(spark):
    """The same gradient descent, written as loops."""
    rows = [("http://cheap.example.com/a", 1.0), ("http://cheap.example.net/b", 1.0), ("http://books.example.com/c", 0.0), ("http://x.example.org/", 0.0), ("http://x.example.org/", 0.0)]
    table = spark.createDataFrame([*rows, (None, 1.0), ("http://y/", None)], "url string, label double")
    dims, steps, rate, decay = 32, 25, 1.5, 0.01
    host, path = U.split_url(F.col("url"))
    grams = [(r["g"], r["label"]) for r in table.where("url IS NOT NULL AND label IS NOT NULL").select(U.gram_indices(host, path, dims).alias("g"), "label").collect()]
    xs = [[g.count(j) / len(g) ** 0.5 for j in range(dims)] + [1.0] for g, _ in grams]
    w = [0.0] * (dims + 1)
    for _ in range(steps):
        miss = [1 / (1 + math.exp(-sum(a * b for a, b in zip(x, w, strict=True)))) - y for x, (_, y) in zip(xs, grams, strict=True)]
        w = [v * (1 - rate * decay) - rate / len(xs) * sum(x[j] * m for x, m in zip(xs, miss, strict=True)) for j, v in enumerate(w)]
    assert U.train(table, dims, steps, rate, decay) == pytest.approx(w, abs=1e-9)
    with pytest.raises(ValueError):
        U.train(table.limit(0))


def test_scores_against_plain_python(spark):
    """Hashed n-grams and the score of a URL, without a column expression."""
    weights = U.train(U.labelled_urls(spark), 4096)
    rows = [u for u in URLS if u] + ["https://long.example.com/" + "pills/" * 3000]
    got = {r["page_id"]: r for r in U.url_verdicts(spark.createDataFrame([(i, u, None) for i, u in enumerate(rows)], PAGES)).collect()}
    for i, u in enumerate(rows):
        host, path = split(u)
        cells = []
        if host or path:
            for mark, text in (("h", f"^{host}$"), ("p", f"{path}$")):
                for n in (3, 4):
                    for k in range(len(text) - n + 1):
                        h = xxhash.xxh64_intdigest(text[k : k + n].encode(), seed=xxhash.xxh64_intdigest(mark.encode(), seed=42))
                        cells.append((h - (1 << 64) if h >> 63 else h) % 4096)
        z = weights[-1] + sum(weights[c] for c in cells) / max(1, len(cells)) ** 0.5
        assert got[i]["score"] == pytest.approx(1 / (1 + math.exp(-z)) if cells else 0, abs=1e-9)
        assert got[i]["verdict"] == (rule(host, path)[1] or ("block" if got[i]["score"] > 0.5 else "allow"))


def test_learns(spark):
    labelled = U.labelled_urls(spark)
    got = U.url_verdicts(labelled.select(F.col("label").cast("long").alias("page_id"), "url"), rules=())
    assert got.where("(page_id = 1) <> (verdict = 'block')").count() == 0
    unseen = [(1, "http://cheap-pills-here.example.com/q"), (1, "http://spam-farm-two.example.net/w"), (0, "http://www.library-two.example.com/en/9"), (0, "https://blog.thestory.example.net/fr/8")]
    got = U.url_verdicts(spark.createDataFrame(unseen, "page_id long, url string"), rules=())
    assert got.where("(page_id = 1) <> (verdict = 'block')").count() == 0


def test_no_python_on_executors(spark, sf_dir):
    plan = U.url_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty(spark):
    assert U.url_verdicts(spark.createDataFrame([], PAGES)).count() == 0
    assert U.url_verdicts(spark.createDataFrame([(None, None, None)] * 2, PAGES)).count() == 2
