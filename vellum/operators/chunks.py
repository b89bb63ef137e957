"""Pages to date-prefixed training sequences."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.text import py_strip
from vellum.operators.tokens import CLS, SEP, TIME, whitespace_tokens

Tokenizer = Callable[[Column], Column]
Splitter = Callable[[Column], Column]
MARKS = (CLS, TIME, SEP)  # of a sequence; ids where the tokenizer gives ids


def valid_rows(pages: DataFrame) -> DataFrame:
    """Pages with a text and a date; an empty date counts as one, an empty text doesn't."""
    return pages.where(F.col("page_text").isNotNull() & (F.col("page_text") != "") & F.col("date").isNotNull())


def windows(tokens: Column, size: Column) -> Column:
    """Consecutive windows of ``size`` tokens, the last one short; null for an empty list or no size."""
    last = F.floor((F.size(tokens) - 1) / size).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.slice(tokens, i * size + 1, size))
    return F.when((F.size(tokens) > 0) & (size > 0), cut)


def _tokenised(pages: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    return valid_rows(pages).withColumns({"_date": tokenizer(py_strip("date")), "_text": tokenizer(py_strip("page_text"))})


def _sequences(df: DataFrame, chunks: Column, marks: Sequence[str | int]) -> DataFrame:
    out = df.select("*", F.posexplode(chunks).alias("chunk_no", "chunk"))
    first, middle, last = (F.array(F.lit(m)) for m in marks)
    tokens = F.concat(first, F.col("_date"), middle, F.col("chunk"), last)
    out = out.withColumn("tokens", tokens).withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("tokens")))
    return out.drop("_date", "_text", "_size")


def fixed_chunks(pages: DataFrame, size: int = 250, max_length: int = 512, tokenizer: Tokenizer = whitespace_tokens, marks: Sequence[str | int] = MARKS) -> DataFrame:
    """One row for each window of ``size`` tokens: ``CLS date TIME window SEP``; sequences over ``max_length`` are dropped.

    The page's columns stay; ``chunk_no, chunk, tokens, attention_mask`` are added. ``marks`` are the three special tokens,
    as ids where the tokenizer (see ``tokens.external_tokenizer``) gives ids.
    """
    if size == 0:
        raise ValueError("the chunk size must not be 0")
    df = _tokenised(pages, tokenizer)
    return _sequences(df, windows(F.col("_text"), F.lit(size)), marks).where(F.size("tokens") <= max_length)


def budgeted_chunks(pages: DataFrame, size: int = 250, max_length: int = 512, tokenizer: Tokenizer = whitespace_tokens, marks: Sequence[str | int] = MARKS) -> DataFrame:
    """Like ``fixed_chunks``, but a long date shrinks the windows so that all fit; pages without room are dropped."""
    df = _tokenised(pages, tokenizer).withColumn("_size", F.least(F.lit(size), max_length - (F.size("_date") + len(marks))))
    return _sequences(df.where("_size > 0"), windows(F.col("_text"), F.col("_size")), marks)


def split_sentences(text: Column) -> Column:
    """Pieces between periods, stripped, without empty ones."""
    return F.filter(F.transform(F.split(text, r"\."), py_strip), lambda s: s != "")


def packing(lengths: Column, prefix: Column, max_length: int) -> Column:
    """Greedy packing of sentence lengths: an array of structs ``first`` (from 1), ``n`` and ``length`` for each example.

    A sentence takes one token more than its length; an example that would exceed ``max_length`` ends before it. Only
    the list of examples grows in the fold, not a list of tokens.
    """
    example = "struct<first:int,n:int,length:int>"
    start = F.struct(F.array().cast(f"array<{example}>").alias("done"), F.lit(1).alias("first"), F.lit(0).alias("n"), prefix.cast("int").alias("length"))

    def flushed(a: Column) -> Column:
        own = F.array(F.struct(a["first"].alias("first"), a["n"].alias("n"), F.least(a["length"], F.lit(max_length)).alias("length")))
        return F.when(a["n"] > 0, F.concat(a["done"], own)).otherwise(a["done"])

    def add(a: Column, x: Column) -> Column:
        full = a["length"] + x + 1 > max_length
        begin = F.struct(flushed(a).alias("done"), (a["first"] + a["n"]).alias("first"), F.lit(1).alias("n"), (prefix + x + 1).cast("int").alias("length"))
        more = F.struct(a["done"].alias("done"), a["first"].alias("first"), (a["n"] + 1).alias("n"), (a["length"] + x + 1).cast("int").alias("length"))
        return F.when(full, begin).otherwise(more)

    return F.aggregate(lengths, start, add, flushed)


def pack_sentences(pages: DataFrame, max_length: int = 512, tokenizer: Tokenizer = whitespace_tokens, splitter: Splitter = split_sentences, blank: str | int = " ", tokenizer_of_lists: Tokenizer | None = None) -> DataFrame:
    """Sentences packed greedily behind ``date TIME``, each followed by a blank token; cut at ``max_length``.

    The page's columns stay; ``example_no, sentences, tokens, attention_mask`` are added. ``splitter`` and ``tokenizer``
    are column functions, which an Arrow-batched ``pandas_udf`` is too; the tokenizer of sentences must be native, or
    ``tokenizer_of_lists`` must be given: from a column of lists of texts to one of lists of tokens.
    """
    df = valid_rows(pages)
    # both come out of a generator, so that filters and later columns don't split and strip again
    parts = F.struct(tokenizer(F.concat(py_strip("date"), F.lit(f" {TIME} "))).alias("prefix"), (tokenizer_of_lists or (lambda c: F.transform(c, tokenizer)))(splitter(py_strip("page_text"))).alias("sentences"))
    df = df.select("*", F.explode(F.array(parts)).alias("_p"))
    examples = packing(F.transform("_p.sentences", lambda s: F.size(s)), F.size("_p.prefix"), max_length)
    out = df.select("*", F.posexplode(examples).alias("example_no", "_e"))
    own = F.slice("_p.sentences", F.col("_e.first"), F.col("_e.n"))
    body = F.flatten(F.transform(own, lambda s: F.concat(s, F.array(F.lit(blank)))))
    out = out.withColumn("tokens", F.slice(F.concat("_p.prefix", body), 1, max_length)).withColumn("sentences", F.col("_e.n"))
    return out.withColumn("attention_mask", F.array_repeat(F.lit(1), F.col("_e.length"))).drop("_p", "_e")
