import re

import corpus_pipeline
from cases import awkward_rows

import __spark_entry__ as E
from vellum.llm import decontaminate, near_dedup, quality

NAMES = ["pipeline", *(f"op{n}_" for n in range(1, 11))]


def test_registered():
    names = list(E.queries())
    for n in NAMES:
        assert sum(x == n or (n[-1] == "_" and x.startswith(n)) for x in names) == 1
    assert set(E.oracle_sql()) <= set(names)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "near-duplicates", "benchmark decontamination", "mixing to target weights", "sharding"]


def test_stages(spark, sf_dir):
    """Each stage against what its operator reports on the stage's own input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "benchmark"))
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    reports = [lambda d: quality.quality_report(d, labels).where("kept"), lambda d: near_dedup.near_report(d).where("kept"), lambda d: decontaminate.leak_report(d, items).where("NOT contaminated")]
    for (_, stage), report in zip(corpus_pipeline.STAGES, reports, strict=False):
        kept = stage(spark, docs, sf_dir)
        assert kept.columns == docs.columns and ids(kept) == ids(report(docs))
        assert kept.exceptAll(docs).count() == 0
        docs = kept
    mixed = corpus_pipeline.mix_sources(spark, docs, sf_dir)
    assert mixed.columns == docs.columns and mixed.join(docs, "doc_id", "left_anti").count() == 0
    out = corpus_pipeline.assign_shards(spark, mixed, sf_dir)
    n = mixed.count()
    per = [r["count"] for r in out.groupBy("shard").count().collect()]
    assert sum(per) == n and max(per) - min(per) <= 1


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "text", "lang", "source", "n_chars", "shard", "slot"} <= set(out.columns) and out.count() > 50


def test_awkward_stages(spark, clashing, nothing, sf_dir):
    for docs in (clashing.drop("shard", "slot"), nothing):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            assert set(docs.columns) <= set(out.columns)
            assert out.count() <= 3 * len(awkward_rows())


def test_native_operators(spark, sf_dir):
    for name in ("op5_mixing", "op6_url_filter", "op7_sharding"):
        plan = E.queries()[name](spark, sf_dir)._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan) and "CartesianProduct" not in plan
