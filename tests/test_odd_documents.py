"""Queries over documents with odd lines and values, against their oracles."""

import duckdb
import pytest
from pyspark.sql import types as T

from vellum.plans import corpus_queries  # noqa: F401
from vellum.plans.registry import ORACLES, QUERIES

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(n, T.StringType()) for n in ("text", "lang", "source"))])


def folder_of(spark, tmp_path, texts, lang="en", source="src"):
    """A folder with a table of these documents, in two files."""
    rows = [(i, t, lang, source) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def both(spark, name, folder):
    """Rows of a query and of its SQL, sorted."""
    df = QUERIES[name](spark, folder)
    found = duckdb.execute(f"WITH documents AS (SELECT * FROM '{folder}/documents.parquet/*.parquet') SELECT {', '.join(df.columns)} FROM ({ORACLES[name]})").fetchall()
    return sorted(map(tuple, df.collect()), key=repr), sorted(found, key=repr)


XML = ["xml_pages_sibling", "xml_pages_document_order", "xml_nested_break", "xml_no_breaks", "xml_empty_pages"]


@pytest.mark.parametrize("name", XML)
def test_lines_with_digits_at_their_ends(spark, tmp_path, name):
    """Line i starts and ends with its own number, also alone on the line; one ends in a wide blank."""
    numbered = "\n".join(f"{i} of {i}" for i in range(12))
    texts = [numbered, "0\n1\n2\n3\n4", "0", "0\nx", "call 555-8970", "a\nb 11\nc\nd 3", "　a \n \nb & <c>"]
    ours, sql = both(spark, name, folder_of(spark, tmp_path, texts))
    assert ours == sql and ours


@pytest.mark.parametrize("name", XML[:4])
def test_pages_of_documents_without_source(spark, tmp_path, name):
    ours, sql = both(spark, name, folder_of(spark, tmp_path, ["a\nb\nc\nd", "e"], source=None))
    assert ours == sql and ours


def test_decode_moves_rare_ids_only(spark, tmp_path):
    """The 100 frequent words of each document are not joined by token or id; the texts are as before."""
    from pyspark.sql import functions as F

    from vellum.operators import tokens

    texts = [" ".join(f"word{k % 100}" for k in range(2000)) + f" once{i}" for i in range(50)] + ["", None, " \t "]
    folder = folder_of(spark, tmp_path, texts)
    ours, sql = both(spark, "decode_round_trip", folder)
    assert ours == sql and len(ours) == 50
    rows = tokens.token_rows(spark.read.parquet(f"{folder}/documents.parquet"), ["doc_id"], tokens.whitespace_tokens(F.col("text")))
    tokens.build_vocabulary(rows, counts=True).write.parquet(f"{tmp_path}/v")
    vocabulary = spark.read.parquet(f"{tmp_path}/v")
    for hot in (0, 1, 60, 1000):
        ids = tokens.encode(rows, vocabulary, hot=hot)
        assert sorted(map(tuple, tokens.decode(ids, vocabulary, ["doc_id"], hot=hot).collect()), key=repr) == ours
        assert tokens.decode(ids.where("FALSE"), vocabulary, ["doc_id"], hot=hot).count() == 0


def test_pages_are_returned_in_bounded_pieces(spark, monkeypatch):
    """A batch of many files doesn't hold all its pages before the first are returned."""
    import pyarrow as pa

    from vellum.sources import xml_pages

    taken = {}
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda self, run, schema: taken.update(run=run) or self)
    xml_pages.parse_pages(spark.createDataFrame([("a", b"")], "path string, content binary"), with_errors=True)
    page = b"<P>" + b"x" * 99_999 + b"</P>"
    files = [b"<ETS><EEBO><TEXT>" + page + b"</TEXT></EEBO></ETS>"] * 100 + [b"<ETS>", None]
    batch = pa.RecordBatch.from_pydict({"path": [str(i) for i in range(102)], "content": pa.array(files, pa.binary())})
    pieces = list(taken["run"](iter([batch])))
    assert max(p.num_rows for p in pieces) <= 12
    rows = [r for p in pieces for r in p.to_pylist()]
    assert [r["path"] for r in rows] == [str(i) for i in range(102)] and [r["error"] is None for r in rows] == [True] * 100 + [False] * 2
    assert {len(r["page_text"]) for r in rows[:100]} == {99_999} and {r["page_no"] for r in rows[:100]} == {0}


def test_csv_keeps_odd_texts(spark, tmp_path):
    """Missing-value spellings, empty texts, characters 0, quotes and returns come back as they are."""
    import random

    rnd = random.Random(1)
    pieces = ["ab", "\0", '"', "\n", " ", ",", "\r", "\r\n", "\\", "#", "\t"]
    odd = ["", "NA", "nan", "null", "None", None, "\0", '"', '""', " ", "\n", "\r", "a\0", '\0"', "#x", "\\", '\\"']
    texts = odd + ["".join(rnd.choices(pieces, k=rnd.randint(1, 30))) for _ in range(300)]
    ours, sql = both(spark, "csv_round_trip", folder_of(spark, tmp_path, texts, lang="", source=None))
    assert ours == sql and len(ours) == len(texts) - 1


def test_strip_and_draws_as_before(spark):
    """What replaced an expression over each blank or token gives what that gave."""
    from pyspark.sql import functions as F

    from vellum.functions.text import PY_SPACE, py_strip
    from vellum.operators import dataset, summary, tokens

    texts = ["", " ", None, "a", "　a b ​\n", "\x1c\x85a\x00\t", "﻿a ", "é  ", "a" + " " * 50 + "b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k long, t string")
    got = df.select(py_strip("t"), F.regexp_replace("t", rf"\A{PY_SPACE}+|{PY_SPACE}+\z", ""), tokens.whitespace_tokens(F.col("t"))).collect()
    assert [r[0] for r in got] == [r[1] for r in got] == [None if t is None else t.strip() for t in texts]
    assert [r[2] for r in got] == [None if t is None else [w for w in __import__("re").split("[\t-\r ]+", t) if w] for t in texts]
    p = dataset.PRIME
    digest = __import__("hashlib").md5(b"42:7").hexdigest()
    a, b, c = (int(digest[i : i + 8], 16) % p for i in (0, 8, 16))
    ids = F.array(*[F.lit(9)] * 500)
    row = spark.range(1).select(dataset.token_draws(42, F.lit(7), ids), summary.active_positions(F.array(*map(F.lit, (1, 0, 1)))), summary.active_positions(F.lit(None).cast("array<int>"))).first()
    assert row[0] == [((((a + b * (i + 1)) % p) ** 2 % p + c) % p) ** 2 % p for i in range(500)] and row[1:] == (2, None)
