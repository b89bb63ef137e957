import hashlib
from collections import Counter

from cases import as_rows, awkward_rows
from pyspark.sql import functions as F

from vellum.llm.exact_dedup import exact_groups

NAMES = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def expected(rows):
    texts = [(r[0], r[1] or "") for r in rows]
    size, keep = Counter(t for _, t in texts), {}
    for i, t in texts:
        keep[t] = max((x for x in (i, keep.get(t)) if x is not None), default=None)
    return sorted(((i, keep[t], size[t], i == keep[t], hashlib.sha256(t.encode()).hexdigest()) for i, t in texts), key=str)


def test_awkward(awkward, clashing):
    want = expected(awkward_rows())
    assert as_rows(exact_groups(awkward), *NAMES) == want
    assert as_rows(exact_groups(clashing), *NAMES) == want


def test_colliding_digests(awkward):
    """A digest that takes two values: full texts still decide."""
    weak = exact_groups(awkward, digest=lambda t: (F.length(t) % 2).cast("string"))
    assert as_rows(weak, *NAMES) == expected(awkward_rows())


def test_hot_group(spark):
    df = spark.range(0, 6000, 1, 16).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    got = exact_groups(df)
    assert got.where("text_sha256 = sha2('hot', 256) AND keep_id = 5997 AND group_size = 2000").count() == 2000 and got.where("kept").count() == 4001


def test_empty(nothing):
    assert exact_groups(nothing).count() == 0
