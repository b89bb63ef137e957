"""Chunks, packing, splits, padding, labels, vocabularies and tables."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from vellum.operators import chunks, dataset, ranking, summary, tokens
from vellum.sources import page_tables

PAGE = "date string, page_text string"


def lengths(df):
    return sorted((r["chunk_no"], len(r["tokens"]), len(r["attention_mask"])) for r in df.collect())


def test_fixed_chunks(spark):
    page = spark.createDataFrame([("1633", "w " * 600)], PAGE)
    assert lengths(chunks.fixed_chunks(page)) == [(0, 254, 254), (1, 254, 254), (2, 104, 104)]
    rows = [(None, "a"), ("1", None), ("1", ""), ("1", " \n "), ("", "a b c")]
    got = chunks.fixed_chunks(spark.createDataFrame(rows, PAGE)).collect()
    assert [r["tokens"] for r in got] == [["[CLS]", "[TIME]", "a", "b", "c", "[SEP]"]]
    with pytest.raises(ValueError):
        chunks.fixed_chunks(page, size=0)
    assert chunks.fixed_chunks(page, size=-1).count() == 0


def test_long_dates(spark):
    page = spark.createDataFrame([("d " * 300, "w " * 250)], PAGE)
    assert chunks.fixed_chunks(page).count() == 0
    assert lengths(chunks.budgeted_chunks(page)) == [(0, 512, 512), (1, 344, 344)]
    assert chunks.budgeted_chunks(spark.createDataFrame([("d " * 509, "w")], PAGE)).count() == 0


def test_windows_keep_all_tokens(spark):
    words = [str(i) for i in range(1003)]
    got = chunks.fixed_chunks(spark.createDataFrame([("1", " ".join(words))], PAGE), size=7).orderBy("chunk_no").collect()
    assert [w for r in got for w in r["chunk"]] == words


def greedy(prefix, sentences, most):
    """(sentences, length) of each example."""
    out, n, size = [], 0, prefix
    for s in sentences:
        if size + s + 1 > most:
            if n:
                out.append((n, min(size, most)))
            n, size = 1, prefix + s + 1
        else:
            n, size = n + 1, size + s + 1
    return out + ([(n, min(size, most))] if n else [])


@pytest.mark.parametrize("most", [4, 12, 40])
def test_packing(spark, most):
    cases = [[3, 4, 5, 20, 2, 2], [1], [50, 1, 50], [2] * 30, [11, 12, 13], [39, 1, 38, 1]]
    rows = [("1633", ". ".join(" ".join(["w"] * n) for n in case)) for case in cases]
    got = chunks.pack_sentences(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {PAGE}"), max_length=most)
    for i, case in enumerate(cases):
        own = got.where(F.col("i") == i).orderBy("example_no").collect()
        assert [(r["sentences"], len(r["tokens"])) for r in own] == greedy(2, case, most)
    assert greedy(2, cases[0], 12) == [(2, 11), (1, 8), (1, 12), (2, 8)]


def test_sentences(spark):
    got = spark.createDataFrame([("A. B..  C",), ("...",), ("",)], "t string").select(chunks.split_sentences(F.col("t")).alias("s")).collect()
    assert [r["s"] for r in got] == [["A", "B", "C"], [], []]


def test_split(spark):
    df = spark.range(1003).withColumn("g", F.col("id") % 50)
    got = dataset.split(df, ["id"], 0.1, 42)
    assert got.where("split = 'test'").count() == 101 and got.count() == 1003
    again = dataset.split(df.orderBy(F.desc("id")), ["id"], 0.1, 42)
    assert got.exceptAll(again.select(*got.columns)).count() == 0
    assert dataset.split(df, ["id"], 0.1, 43).where("split = 'test'").join(got.where("split = 'test'"), "id").count() < 60
    grouped = dataset.split(df, ["id"], 0.1, 42, group=["g"])
    assert grouped.select("g", "split").distinct().count() == 50 and grouped.where("split = 'test'").select("g").distinct().count() == 5


def test_global_number(spark):
    df = spark.createDataFrame([(f"{i:05d}"[::-1],) for i in range(2000)], "k string")
    got = ranking.global_number(df, F.substring("k", 1, 2), ["k"], "n").orderBy("k").collect()
    assert [r["n"] for r in got] == list(range(1, 2001))


def test_null_keys_are_kept(spark):
    df = spark.createDataFrame([(1, "x"), (2, None), (3, None), (4, "y")], "id long, g string")
    grouped = dataset.split(df, ["id"], 0.5, 42, group=["g"]).collect()
    assert sorted(r["id"] for r in grouped) == [1, 2, 3, 4] and len({r["split"] for r in grouped if r["g"] is None}) == 1
    got = ranking.global_number(df, F.substring("g", 1, 1), ["g", "id"], "n").collect()
    assert {r["id"]: r["n"] for r in got} == {2: 1, 3: 2, 1: 3, 4: 4}
    nulls = spark.createDataFrame([(None, ["a"]), (None, ["b", "c"]), (1, ["d"])], "k long, tokens array<string>")
    assert dataset.pad(dataset.batches(nulls, ["k", "tokens"], 2, F.floor(F.col("k") / 8))).count() == 3
    assert tokens.build_vocabulary(spark.createDataFrame([("",), ("a",), (None,)], "token string")).count() == 2


def test_padding_and_labels(spark):
    df = spark.createDataFrame([(i, ["t"] * (i % 7)) for i in range(40)], "id long, tokens array<string>")
    got = dataset.pad(dataset.batches(df, ["id"], 16, F.floor(F.col("id") / 8))).collect()
    for r in got:
        longest = max(i % 7 for i in range(40) if i // 16 == r["batch_id"])
        assert len(r["tokens"]) == len(r["attention_mask"]) == longest and sum(r["attention_mask"]) == r["id"] % 7
    ids = spark.createDataFrame([(1, [5] * 4000), (2, [])], "k int, input_ids array<int>")
    got = {r["k"]: r for r in dataset.mlm(ids, "k").collect()}
    chosen = [x for x, y in zip(got[1]["input_ids"], got[1]["labels"], strict=True) if y == 5]
    assert got[2]["labels"] == [] and 500 < len(chosen) < 700
    assert 0.7 < chosen.count(103) / len(chosen) < 0.9 and 0.05 < chosen.count(5) / len(chosen) < 0.16
    assert all(x == 5 for x, y in zip(got[1]["input_ids"], got[1]["labels"], strict=True) if y == -100)
    labels = dataset.clm_labels(spark.createDataFrame([([1, 0, 2, 0],)], "input_ids array<int>")).first()["labels"]
    assert labels == [1, -100, 2, -100]


def test_vocabulary(spark):
    rows = tokens.token_rows(spark.createDataFrame([(1, "b a é b"), (2, "Z a")], "k int, t string"), ["k"], tokens.whitespace_tokens(F.col("t")))
    vocabulary = tokens.build_vocabulary(rows)
    assert {r["token"]: r["id"] for r in vocabulary.collect()} == {"Z": 0, "a": 1, "b": 2, "é": 3}
    more = tokens.add_tokens(vocabulary, ["[TIME]", "a", "[PAD]"])
    assert {r["token"]: r["id"] for r in more.where("id > 3").collect()} == {"[TIME]": 4, "[PAD]": 5}
    assert tokens.add_tokens(more, ["[TIME]"]).count() == 6
    text = {r["k"]: r["text"] for r in tokens.decode(tokens.encode(rows, vocabulary), vocabulary, ["k"]).collect()}
    assert text == {1: "b a é b", 2: "Z a"}
    assert tokens.encode(rows, vocabulary.where("token <> 'a'"), unknown_id=9).where("id = 9").count() == 2
    counted = tokens.build_vocabulary(rows, counts=True)
    for hot in (1, 2, 50):
        for v in (counted, counted.where("token <> 'Z'")):
            assert sorted(map(str, tokens.encode(rows, v, 9, hot).select("k", "pos", "id").collect())) == sorted(map(str, tokens.encode(rows, v, 9).select("k", "pos", "id").collect()))


def test_external_tokenizer(spark):
    P = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    path = P.path("byte_bpe_50k.json")
    own = tokenizers.Tokenizer.from_file(path)
    texts = ["The king returned.", "", None, "naïve café"]
    got = tokens.external_ids(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), "t", path).orderBy("i").collect()
    assert [r["input_ids"] for r in got] == [None if t is None else own.encode(t, add_special_tokens=False).ids for t in texts]


def test_ids_in_chunks_and_packs(spark, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    words = ["[UNK]", "the", "king", "##s", "re", "##turn", "16", "##33", ".", "[", "]", "time"]
    path = tokens.word_piece_file(words, str(tmp_path / "own.json"))
    own = lambda t: tokenizers.Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids
    assert own("The kings return") == [1, 2, 3, 4, 5]
    page = spark.createDataFrame([("1633", "The kings return. The king")], PAGE)
    got = chunks.fixed_chunks(page, size=4, tokenizer=tokens.external_tokenizer(spark, path), marks=(90, 91, 92)).orderBy("chunk_no").collect()
    ids = own("The kings return. The king")
    assert [r["tokens"] for r in got] == [[90, 6, 7, 91, *ids[:4], 92], [90, 6, 7, 91, *ids[4:], 92]]
    packed = chunks.pack_sentences(page, 40, tokens.external_tokenizer(spark, path), blank=99, tokenizer_of_lists=tokens.external_tokenizer(spark, path, of_lists=True)).collect()
    assert [r["tokens"] for r in packed] == [[*own("1633 [TIME] "), *own("The kings return"), 99, *own("The king"), 99]]

    @F.pandas_udf("array<string>")
    def halves(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [t[: len(t) // 2], t[len(t) // 2 :]])

    assert chunks.pack_sentences(page, 40, splitter=halves).first()["sentences"] == 2


def test_tables(spark, tmp_path):
    rows = [("a", "London", "1633", 'He said "yes",\nand\r\nleft \\ '), ("b", "NA", None, "  x  "), (None, "p", "1", "é,;")]
    df = spark.createDataFrame(rows, "author string, place string, date string, page_text string")
    page_tables.write_csv(df, str(tmp_path / "a"))
    got = page_tables.read_csv(spark, str(tmp_path / "a")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([rows[0], ("b", None, None, "  x  "), rows[2]], key=str)
    page_tables.write_csv(df.limit(0), str(tmp_path / "b"))
    assert page_tables.load_csvs(spark, [str(tmp_path / "a"), str(tmp_path / "b")]).count() == 3
    (tmp_path / "none").mkdir()
    for call in (lambda: page_tables.union_corpora([]), lambda: page_tables.load_csvs(spark, [str(tmp_path / "a"), str(tmp_path / "none")])):
        with pytest.raises(FileNotFoundError):
            call()
    page_tables.write_parquet(df, str(tmp_path / "c"), ["author"])
    assert spark.read.parquet(str(tmp_path / "c")).count() == 3


def test_summaries(spark):
    df = spark.createDataFrame([("a", "xy"), ("a", None), ("b", "")], "lang string, page_text string")
    assert {tuple(r) for r in summary.corpus_summary(df, ["lang"]).collect()} == {("a", 2, 1, 2), ("b", 1, 0, 0)}
    assert tuple(summary.steps(spark.range(35), 16, 3).first()) == (35, 2, 6)
    assert summary.first_rows(spark.range(9), 0, ["id"]).count() == 9
