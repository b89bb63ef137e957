"""Tokenizers and vocabularies.

The native tokenizers are column expressions. An external one, from a vocabulary file the user supplies, is an
Arrow-batched function. A vocabulary is a table ``(token, id)``; encoding and decoding are joins with it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.operators.ranking import global_number

CLS, SEP, PAD, MASK, TIME = "[CLS]", "[SEP]", "[PAD]", "[MASK]", "[TIME]"


def whitespace_tokens(text: Column) -> Column:
    """Words between runs of ASCII white space; an empty text has none."""
    return F.array_remove(F.split(text, r"[\t-\r ]+"), "")


def regex_tokens(text: Column, pattern: str = r"\w+|[^\w\s]") -> Column:
    """All matches of a pattern."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def external_tokenizer(spark: SparkSession, tokenizer_json: str, of_lists: bool = False) -> Callable[[Column], Column]:
    """A column function from texts to ids by a tokenizer file of the ``tokenizers`` library, without special tokens.

    With ``of_lists`` from lists of texts to lists of ids. The driver reads the file; its content goes to the executors,
    so they need not see the path. Null gives null.
    """
    with open(tokenizer_json, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())  # a vocabulary file, whose size doesn't grow with the data

    @F.pandas_udf("array<array<int>>" if of_lists else "array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(shared.value)
        tokenizer.encode_special_tokens = True

        def ids(texts: list[str | None]) -> list[list[int]]:
            return [e.ids for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]

        for values in batches:
            yield pd.Series([None if v is None else ids(list(v)) for v in values] if of_lists else ids(list(values)), dtype=object)

    return lambda c: F.when(c.isNotNull(), encode(c))


def external_ids(df: DataFrame, column: str, tokenizer_json: str, out: str = "input_ids") -> DataFrame:
    """Adds the ids of a column by ``external_tokenizer``."""
    return df.withColumn(out, external_tokenizer(df.sparkSession, tokenizer_json)(F.col(column)))


def word_piece_file(vocabulary: list[str], path: str, unknown: str = "[UNK]") -> str:
    """Writes a tokenizer file for a WordPiece vocabulary (a token a line in its usual file; ``##`` continues a word)."""
    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

    tokenizer = Tokenizer(models.WordPiece({t: i for i, t in enumerate(vocabulary)}, unk_token=unknown))
    tokenizer.normalizer, tokenizer.pre_tokenizer = normalizers.BertNormalizer(), pre_tokenizers.BertPreTokenizer()
    tokenizer.save(path)
    return path


def build_vocabulary(tokens: DataFrame, column: str = "token", first_id: int = 0, counts: bool = False) -> DataFrame:
    """``token, id`` of the distinct tokens, numbered in binary order; with ``counts`` also ``n``, how often each occurs."""
    distinct = tokens.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("token")).agg(F.count(F.lit(1)).alias("n"))
    numbered = global_number(distinct if counts else distinct.drop("n"), F.substring("token", 1, 3), ["token"], "_n", F.col("n") > 0 if counts else None)
    return numbered.select("token", (F.col("_n") - 1 + first_id).cast("long").alias("id"), *["n"] * counts)


def add_tokens(vocabulary: DataFrame, tokens: list[str]) -> DataFrame:
    """Appends tokens that are missing, with the ids after the largest; those present keep theirs."""
    spark = vocabulary.sparkSession
    wanted = spark.range(1).select(F.posexplode(F.array(*[F.lit(t) for t in dict.fromkeys(tokens)])).alias("pos", "token"))
    new = wanted.join(vocabulary, "token", "left_anti")  # a handful of rows
    last = vocabulary.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("last"))
    new = new.withColumn("_one", F.lit(1)).join(last.withColumn("_one", F.lit(1)), "_one")
    return vocabulary.unionByName(new.select("token", (F.col("last") + F.row_number().over(Window.orderBy("pos"))).cast("long").alias("id")))


def vocabulary_size(vocabulary: DataFrame) -> DataFrame:
    return vocabulary.agg(F.count(F.lit(1)).alias("tokens"))


def token_rows(df: DataFrame, key: list[str], tokens: Column) -> DataFrame:
    """``key, pos, token``: one row for each token."""
    return df.select(*key, F.posexplode(tokens).alias("pos", "token"))


def most_frequent(vocabulary: DataFrame, most: int) -> DataFrame:
    """``token, id`` of the tokens that occur most often, ``most`` at most, and more than once."""
    return vocabulary.where("n > 1").orderBy(F.desc("n"), "id").limit(most).select("token", "id")


def encode(rows: DataFrame, vocabulary: DataFrame, unknown_id: int | None = None, hot: int = 0) -> DataFrame:
    """Adds ``id`` to token rows; tokens that the vocabulary lacks get ``unknown_id``.

    With ``hot``, the vocabulary has counts (``n``), and its ``hot`` most frequent tokens, a bounded number, are broadcast: they are
    most rows of any text, and no task gets all rows of a frequent token. Only the other rows are joined by token.
    Rows are computed twice then, and the vocabulary should be a written table.
    """
    known = vocabulary.select("token", "id")
    if not hot:
        return rows.join(known, "token", "left").withColumn("id", F.coalesce("id", F.lit(unknown_id).cast("long")))
    frequent = most_frequent(vocabulary, hot)
    common = rows.join(F.broadcast(frequent), "token")
    rare = rows.join(F.broadcast(frequent.select("token")), "token", "left_anti").join(known, "token", "left")
    return common.unionByName(rare.withColumn("id", F.coalesce("id", F.lit(unknown_id).cast("long"))))


def decode(rows: DataFrame, vocabulary: DataFrame, key: list[str], separator: str = " ", hot: int = 0) -> DataFrame:
    """``key, text`` from rows of ``key, pos, id``; ids that the vocabulary lacks are left out.

    With ``hot`` as in ``encode``: the most frequent ids are named by a broadcast, where a row's neighbours still stand beside
    it, so that most of a text is put together before it is moved; only the other rows are joined by id.
    """
    ids, known = rows.select(*key, "pos", "id").where(F.col("id").isNotNull()), vocabulary.select("id", "token")
    if hot:
        frequent = most_frequent(vocabulary, hot)
        rare = ids.join(F.broadcast(frequent.select("id")), "id", "left_anti").join(known, "id")
        named = ids.join(F.broadcast(frequent), "id").unionByName(rare)
    else:
        named = ids.join(known, "id")
    # two flat lists, filled in the same order, take half the bytes of a list of structs
    lists = named.groupBy(*key).agg(F.collect_list("pos").alias("_pos"), F.collect_list("token").alias("_tokens"))
    parts = F.sort_array(F.zip_with("_pos", "_tokens", lambda p, t: F.struct(p.alias("pos"), t.alias("token"))))
    return lists.select(*key, F.array_join(F.transform(parts, lambda x: x["token"]), separator).alias("text"))
