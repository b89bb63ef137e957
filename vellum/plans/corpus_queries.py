"""The corpus engine's operators as queries over the driver's tables, each with its oracle.

``documents`` stands for pages: its text is the page's, with a date from its id. Raw dates come from
``orders``, in six historical spellings. XML files are made from documents: a paragraph for each line and a page
break after every third.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import dates as D
from vellum.functions.text import missing_to_null, preview
from vellum.operators import chunks, dataset, summary, tokens
from vellum.plans.registry import query
from vellum.session import shared_folder
from vellum.sources import page_tables, xml_pages


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", (1500 + F.col("doc_id") % 400).cast("string").alias("date"), F.col("text").alias("page_text"), "lang", "source")


PAGES = "pages_ AS (SELECT doc_id, CAST(1500 + doc_id % 400 AS VARCHAR) AS date, text AS page_text, lang, source FROM documents)"
#: List of the words of a column.
WORDS = "list_filter(string_split_regex({}, '[\\t-\\r ]+'), lambda x: x <> '')"
SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip_sql(column: str) -> str:
    return f"regexp_replace({column}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def _joined(tokens_: Column | str) -> Column:
    return F.array_join(tokens_, " ")


# --- filters and chunks -------------------------------------------------------------------------


@query("valid_rows", f"WITH {PAGES} SELECT doc_id, date, length(page_text) AS chars FROM pages_ WHERE page_text IS NOT NULL AND page_text <> '' AND date IS NOT NULL")
def valid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.valid_rows(pages(spark, sf_dir)).select("doc_id", "date", F.length("page_text").cast("long").alias("chars"))


def _chunk_sql(size: str, date: str = "[date]", where: str = "TRUE", most: int = 512) -> str:
    return f"""
WITH {PAGES}, t AS (SELECT doc_id, {date} AS d, {WORDS.format("page_text")} AS w FROM pages_ WHERE page_text <> '' AND date IS NOT NULL),
s AS (SELECT doc_id, d, w, {size} AS k FROM t),
c AS (SELECT doc_id, d, w, k, unnest(range(0, len(w), k)) AS i FROM s WHERE k > 0)
SELECT doc_id, CAST(i // k AS INTEGER) AS chunk_no, CAST(len(d) + 3 + len(list_slice(w, i + 1, i + k)) AS INTEGER) AS tokens,
       '[CLS] ' || array_to_string(d, ' ') || ' [TIME] ' || array_to_string(list_slice(w, i + 1, i + k), ' ') || ' [SEP]' AS sequence
FROM c WHERE {where} AND len(d) + 3 + len(list_slice(w, i + 1, i + k)) <= {most}"""


def _chunk_columns(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.col("chunk_no").cast("int").alias("chunk_no"), F.size("tokens").alias("tokens"), _joined("tokens").alias("sequence"))


@query("chunk_fixed", _chunk_sql("250"))
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunk_columns(chunks.fixed_chunks(pages(spark, sf_dir)))


#: A date of 300 words for each fifth page, and one of 600 for each seventh.
LONG_DATE_SQL = "CASE WHEN doc_id % 7 = 0 THEN list_transform(range(600), lambda x: date) WHEN doc_id % 5 = 0 THEN list_transform(range(300), lambda x: date) ELSE [date] END"


def _long_dates(df: DataFrame) -> DataFrame:
    n = F.when(F.col("doc_id") % 7 == 0, 600).when(F.col("doc_id") % 5 == 0, 300).otherwise(1)
    return df.withColumn("date", F.array_join(F.array_repeat("date", n), " "))


@query("chunk_fixed_oversize_drop", _chunk_sql("250", LONG_DATE_SQL))
def chunk_fixed_oversize_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunk_columns(chunks.fixed_chunks(_long_dates(pages(spark, sf_dir))))


@query("chunk_budgeted", _chunk_sql("least(250, 512 - (len(d) + 3))", LONG_DATE_SQL))
def chunk_budgeted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunk_columns(chunks.budgeted_chunks(_long_dates(pages(spark, sf_dir))))


SENTENCES = f"list_filter(list_transform(string_split({_strip_sql('page_text')}, '.'), lambda x: {_strip_sql('x')}), lambda x: x <> '')"


@query("sentence_split", f"WITH {PAGES}, s AS (SELECT doc_id, {SENTENCES} AS s FROM pages_ WHERE page_text <> '') SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, s[i] AS sentence FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM s)")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = chunks.valid_rows(pages(spark, sf_dir))
    return p.select("doc_id", F.posexplode(chunks.split_sentences(chunks.py_strip("page_text"))).alias("pos", "sentence"))


@query(
    "sentence_pack",
    f"""
WITH RECURSIVE {PAGES},
w AS (SELECT doc_id, date, list_transform({SENTENCES}, lambda x: {WORDS.format("x")}) AS w FROM pages_ WHERE page_text <> ''),
s AS (SELECT doc_id, list_transform(w, lambda x: len(x)) AS n FROM w),
f AS (
  SELECT doc_id, n, 1 AS i, 2 AS cur, 0 AS cnt, 0 AS ex, CAST(NULL AS INTEGER) AS out_len, CAST(NULL AS INTEGER) AS out_n, CAST(NULL AS INTEGER) AS out_ex FROM s WHERE len(n) > 0
  UNION ALL
  SELECT doc_id, n, i + 1,
    CASE WHEN i > len(n) THEN -1 WHEN cur + n[i] + 1 > 128 THEN 2 + n[i] + 1 ELSE cur + n[i] + 1 END,
    CASE WHEN i <= len(n) AND cur + n[i] + 1 > 128 THEN 1 ELSE cnt + 1 END,
    CASE WHEN i <= len(n) AND cur + n[i] + 1 > 128 AND cnt > 0 THEN ex + 1 ELSE ex END,
    CASE WHEN cnt > 0 AND (i > len(n) OR cur + n[i] + 1 > 128) THEN CAST(least(cur, 128) AS INTEGER) END,
    CASE WHEN cnt > 0 AND (i > len(n) OR cur + n[i] + 1 > 128) THEN CAST(cnt AS INTEGER) END,
    CASE WHEN cnt > 0 AND (i > len(n) OR cur + n[i] + 1 > 128) THEN CAST(ex AS INTEGER) END
  FROM f WHERE cur >= 0)
SELECT doc_id, out_ex AS example_no, out_n AS sentences, out_len AS tokens,
  array_to_string(list_slice([date, '[TIME]'] || flatten(list_transform(list_slice(w, i - out_n, i - 1), lambda x: x || [' '])), 1, 128), '|') AS sequence
FROM (SELECT doc_id, i - 1 AS i, out_len, out_n, out_ex FROM f WHERE out_len IS NOT NULL) JOIN w USING (doc_id)""",
)
def sentence_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunks.pack_sentences(pages(spark, sf_dir), max_length=128)
    return out.select("doc_id", F.col("example_no").cast("int").alias("example_no"), "sentences", F.size("tokens").alias("tokens"), F.array_join("tokens", "|").alias("sequence"))


@query(
    "chunk_fixed_ids",
    f"""WITH {PAGES}, t AS (SELECT doc_id, list_transform({WORDS.format("page_text")}, lambda x: CAST(1000 + len(x) AS INTEGER)) AS w FROM pages_ WHERE page_text <> ''),
c AS (SELECT doc_id, w, unnest(range(0, len(w), 250)) AS i FROM t)
SELECT doc_id, CAST(i // 250 AS INTEGER) AS chunk_no, '101 1004 50368 ' || array_to_string(list_slice(w, i + 1, i + 250), ' ') || ' 102' AS ids FROM c""",
)
def chunk_fixed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tokenizer that gives ids, here by the length of a word."""
    by_length = lambda c: F.transform(tokens.whitespace_tokens(c), lambda x: F.length(x) + 1000)
    out = chunks.fixed_chunks(pages(spark, sf_dir), tokenizer=by_length, marks=(101, 50368, 102))
    return out.select("doc_id", F.col("chunk_no").cast("int").alias("chunk_no"), F.array_join(F.transform("tokens", lambda x: x.cast("string")), " ").alias("ids"))


# --- dates --------------------------------------------------------------------------------------

RAW_DATES_SQL = """raw_dates AS (
SELECT o_orderkey, CAST(year(o_orderdate) - 350 AS VARCHAR) AS y FROM orders),
dated AS (SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN y WHEN 1 THEN '[' || y || '?]' WHEN 2 THEN 'Printed ' || y || '.' WHEN 3 THEN '-[' || y WHEN 4 THEN replace(y, '1', 'l')
  WHEN 5 THEN 'April ' || y || ', London' WHEN 6 THEN '109 [i.e. ' || y || ']..' ELSE 'Anno .M.D.' || (o_orderkey % 13) || '..' END AS date FROM raw_dates),
st AS (SELECT o_orderkey, date, replace(date, 'l', '1') AS d FROM dated),
parts AS (SELECT *, substr(ltrim(ltrim(d, '['), '-'), 1, 4) AS s1, right(rtrim(rtrim(rtrim(d, '.'), ']'), '?'), 4) AS s2, regexp_extract(regexp_replace(d, '[\\[\\].]', '', 'g'), '(1[5-8][0-9]{2})', 1) AS s3 FROM st),
ints AS (SELECT *, CASE WHEN regexp_matches(trim(s1), '^[+-]?[0-9]+(_[0-9]+)*$') THEN TRY_CAST(replace(trim(s1), '_', '') AS INTEGER) END AS i1,
  CASE WHEN regexp_matches(trim(s2), '^[+-]?[0-9]+(_[0-9]+)*$') THEN TRY_CAST(replace(trim(s2), '_', '') AS INTEGER) END AS i2 FROM parts),
cleaned AS (SELECT o_orderkey, date, d, CASE WHEN coalesce(i1, i2) IS NOT NULL THEN CASE WHEN coalesce(i1, i2) > 1500 AND coalesce(i1, i2) < 1900 THEN coalesce(i1, i2) END
  WHEN s3 <> '' THEN CAST(s3 AS INTEGER) END AS year FROM ints)"""


def raw_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    y = (F.year("o_orderdate") - 350).cast("string")
    forms = [y, F.concat(F.lit("["), y, F.lit("?]")), F.concat(F.lit("Printed "), y, F.lit(".")), F.concat(F.lit("-["), y), F.translate(y, "1", "l"), F.concat(F.lit("April "), y, F.lit(", London")), F.concat(F.lit("109 [i.e. "), y, F.lit("]..")), F.concat(F.lit("Anno .M.D."), (k % 13).cast("string"), F.lit(".."))]
    date = forms[7]
    for i in range(6, -1, -1):
        date = F.when(k % 8 == i, forms[i]).otherwise(date)
    return table(spark, sf_dir, "orders").select("o_orderkey", date.alias("date"))


@query("date_normalise", f"WITH {RAW_DATES_SQL} SELECT o_orderkey, date, coalesce(CAST(year AS VARCHAR), d) AS date_convert, year FROM cleaned")
def date_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.clean_dates(raw_dates(spark, sf_dir))


@query("date_unresolved", f"WITH {RAW_DATES_SQL} SELECT DISTINCT d AS raw FROM cleaned WHERE year IS NULL")
def date_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.unresolved_dates(D.clean_dates(raw_dates(spark, sf_dir)))


@query("date_lookup_apply", f"WITH {RAW_DATES_SQL} SELECT o_orderkey, CASE WHEN year IS NOT NULL THEN CAST(year AS VARCHAR) WHEN d LIKE '109%' THEN substr(d, 11, 4) ELSE d END AS date_convert, year FROM cleaned")
def date_lookup_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = D.clean_dates(raw_dates(spark, sf_dir))
    found = D.resolve(D.unresolved_dates(cleaned), lambda values: [v[10:14] if v.startswith("109") else None for v in values])
    return D.apply_resolved(cleaned, found).select("o_orderkey", "date_convert", "year")


# --- splits, batches, labels --------------------------------------------------------------------


def _split_sql(share: float, seed: int) -> str:
    return f"SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('{seed}:' || doc_id), doc_id) <= ceil({share} * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split FROM documents"


@query("split_90_10", _split_sql(0.1, 42))
def split_90_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.split(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], 0.1, 42)


@query("split_80_20", _split_sql(0.2, 42))
def split_80_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.split(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], 0.2, 42)


@query("split_grouped", f"WITH {PAGES}, g AS (SELECT DISTINCT date FROM pages_), s AS (SELECT date, CASE WHEN row_number() OVER (ORDER BY md5('42:' || date), date) <= ceil(0.1 * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split FROM g) SELECT doc_id, date, split FROM pages_ JOIN s USING (date)")
def split_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.split(pages(spark, sf_dir).select("doc_id", "date"), ["doc_id"], 0.1, 42, group=["date"]).select("doc_id", "date", "split")


BATCHED = f"b AS (SELECT doc_id, {WORDS.format('text')} AS w, (row_number() OVER (ORDER BY doc_id) - 1) // 16 AS batch_id FROM documents)"


@query("dynamic_pad", f"WITH {BATCHED} SELECT doc_id, batch_id, CAST(max(len(w)) OVER (PARTITION BY batch_id) AS INTEGER) AS padded_length, CAST(len(w) AS INTEGER) AS active, CAST(max(len(w)) OVER (PARTITION BY batch_id) - len(w) AS INTEGER) AS pads FROM b")
def dynamic_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", tokens.whitespace_tokens(F.col("text")).alias("tokens"))
    out = dataset.pad(dataset.batches(d, ["doc_id"], 16, F.floor(F.col("doc_id") / 4096)))
    pads = F.size(F.filter("tokens", lambda x: x == tokens.PAD))
    return out.select("doc_id", "batch_id", "padded_length", summary.active_positions(F.col("attention_mask")).alias("active"), pads.alias("pads"))


IDS_SQL = f"ids AS (SELECT doc_id, list_transform({WORDS.format('text')}, lambda x: CAST(1000 + len(x) AS INTEGER)) AS ids FROM documents)"


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = tokens.whitespace_tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.transform(words, lambda x: F.length(x) + 1000).alias("input_ids"))


#: The draws of ``dataset.token_draws`` with seed 42.
DRAWS_SQL = f"""{IDS_SQL}, k AS (SELECT doc_id, ids, md5('42:' || doc_id) AS h FROM ids WHERE len(ids) > 0),
abc AS (SELECT doc_id, ids, CAST('0x' || substr(h, 1, 8) AS BIGINT) % 2147483647 AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % 2147483647 AS b, CAST('0x' || substr(h, 17, 8) AS BIGINT) % 2147483647 AS c FROM k),
x AS (SELECT doc_id, c, unnest(range(0, len(ids))) AS i, unnest(ids) AS id, a, b FROM abc),
y AS (SELECT doc_id, i, id, (((a + b * (i + 1)) % 2147483647) * ((a + b * (i + 1)) % 2147483647) % 2147483647 + c) % 2147483647 AS y FROM x),
h AS (SELECT doc_id, i, id, y * y % 2147483647 AS h FROM y)"""


@query(
    "mlm_mask",
    f"""WITH {DRAWS_SQL}
SELECT doc_id, string_agg(CASE WHEN h % 100 < 15 AND (h // 100) % 10 < 8 THEN 103 WHEN h % 100 < 15 AND (h // 100) % 10 = 8 THEN (h // 1000) % 30522 ELSE id END, ' ' ORDER BY i) AS ids,
  string_agg(CASE WHEN h % 100 < 15 THEN id ELSE -100 END, ' ' ORDER BY i) AS labels FROM h GROUP BY doc_id""",
)
def mlm_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dataset.mlm(_ids(spark, sf_dir), "doc_id").where(F.size("input_ids") > 0)
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), " ")
    return out.select("doc_id", joined("input_ids").alias("ids"), joined("labels").alias("labels"))


@query(
    "validation_report",
    f"""WITH {PAGES}, t AS (SELECT doc_id, {WORDS.format("page_text")} AS w, date FROM pages_ WHERE page_text <> ''),
c AS (SELECT doc_id, date, w, unnest(range(0, len(w), 250)) AS i FROM t),
q AS (SELECT doc_id, i // 250 AS n, ['[CLS]', date, '[TIME]'] || list_slice(w, i + 1, i + 250) || ['[SEP]'] AS s FROM c),
{DRAWS_SQL}, l AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 16 AS b, len(ids) AS n FROM ids),
r AS (SELECT (SELECT count(*) FROM q) AS sequences, (SELECT coalesce(sum(len(s)), 0) FROM q) AS tokens, (SELECT len(s) FROM q ORDER BY doc_id, n LIMIT 1) AS first_length,
  (SELECT array_to_string(list_slice(s, 1, 50), ' ') FROM q ORDER BY doc_id, n LIMIT 1) AS first_tokens, (SELECT count(DISTINCT b) FROM l) AS batches, (SELECT max(n) FROM l) AS batch_length, (SELECT count(*) FROM h WHERE h % 100 < 15) AS predicted)
SELECT 'sequences' AS item, CAST(sequences AS VARCHAR) AS value FROM r UNION ALL SELECT 'tokens', CAST(tokens AS VARCHAR) FROM r UNION ALL SELECT 'active', CAST(tokens AS VARCHAR) FROM r
UNION ALL SELECT 'first_length', CAST(first_length AS VARCHAR) FROM r UNION ALL SELECT 'first_tokens', first_tokens FROM r UNION ALL SELECT 'batches', CAST(batches AS VARCHAR) FROM r
UNION ALL SELECT 'batch_length', CAST(batch_length AS VARCHAR) FROM r UNION ALL SELECT 'predicted', CAST(predicted AS VARCHAR) FROM r""",
)
def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    sequences = chunks.fixed_chunks(pages(spark, sf_dir))
    batched = dataset.batches(_ids(spark, sf_dir), ["doc_id"], 16, F.floor(F.col("doc_id") / 4096))
    labelled = dataset.mlm(dataset.pad(batched.withColumn("own", F.col("input_ids")), "input_ids", F.lit(0)).drop("input_ids").withColumnRenamed("own", "input_ids"), "doc_id")
    return summary.validation_report(sequences, labelled, ["doc_id", "chunk_no"])


@query("element_access", f"WITH {IDS_SQL} SELECT doc_id, array_to_string(list_slice(ids, 1, 50), ' ') AS first_ids FROM ids ORDER BY doc_id LIMIT 1 OFFSET 3")
def element_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.element(_ids(spark, sf_dir), ["doc_id"], 3).select("doc_id", F.array_join(F.slice("input_ids", 1, 50).cast("array<string>"), " ").alias("first_ids"))


@query("clm_labels", f"WITH {IDS_SQL} SELECT doc_id, CAST(len(list_filter(ids, lambda x: x = 1003)) AS INTEGER) AS ignored, CAST(coalesce(list_sum(list_transform(ids, lambda x: CASE WHEN x = 1003 THEN -100 ELSE x END)), 0) AS BIGINT) AS label_sum FROM ids")
def clm_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dataset.clm_labels(_ids(spark, sf_dir), pad_id=1003)
    return out.select("doc_id", F.size(F.filter("labels", lambda x: x == dataset.IGNORED)).alias("ignored"), F.aggregate("labels", F.lit(0).cast("long"), lambda a, x: a + x).alias("label_sum"))


@query("attention_sum", f"WITH {PAGES} SELECT doc_id, CAST(sum(len(list_slice(w, i + 1, i + 250)) + 4) AS BIGINT) AS active FROM (SELECT doc_id, w, unnest(range(0, len(w), 250)) AS i FROM (SELECT doc_id, {WORDS.format('page_text')} AS w FROM pages_ WHERE page_text <> '')) GROUP BY doc_id")
def attention_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunks.fixed_chunks(pages(spark, sf_dir))
    return out.groupBy("doc_id").agg(F.sum(summary.active_positions(F.col("attention_mask"))).alias("active"))


# --- XML ----------------------------------------------------------------------------------------

LINES = "list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')"


def _lines() -> Column:
    """Lines of ``text`` without blanks (of any width) at their ends, and without empty ones; like ``LINES``.

    ``F.trim`` has a second parameter: given to ``F.transform`` as such it gets a line's number and trims its digits.
    """
    return F.filter(F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(x, r"\A\p{Zs}+|\p{Zs}+\z", "")), lambda x: x != "")


def xml_documents(spark: SparkSession, sf_dir: str, header: bool = True, every: int = 3, nested: bool = False) -> DataFrame:
    """``path, content``: a paragraph for each line, a page break after every third; every 11th file is malformed."""
    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    lines = _lines()
    item = lambda x, i: F.concat(F.lit("<P>"), escape(x), F.lit("</P>"), F.when(i % every == every - 1, F.lit("<PB/>")).otherwise(F.lit("")))
    body = F.array_join(F.transform(lines, item), "")
    about = F.concat(F.lit("<HEADER><FILEDESC><TITLESTMT><AUTHOR> "), F.coalesce("source", F.lit("")), F.lit(" </AUTHOR><AUTHOR>other</AUTHOR></TITLESTMT><SOURCEDESC><BIBLFULL><PUBLICATIONSTMT><PUBPLACE>"), F.coalesce("lang", F.lit("")), F.lit("</PUBPLACE>"),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("<DATE>"), 1500 + F.col("doc_id") % 400, F.lit("</DATE>"))).otherwise(F.concat(F.lit('<DATE VALUE="'), 1500 + F.col("doc_id") % 400, F.lit('"/>'))), F.lit("</PUBLICATIONSTMT></BIBLFULL></SOURCEDESC></FILEDESC></HEADER>"))
    text = F.concat(F.lit("<DIV>" if nested else ""), body, F.lit("</DIV><P>last</P>" if nested else ""))
    end = F.when(F.col("doc_id") % 11 == 10, F.lit("</TEXT></ETS>")).otherwise(F.lit("</TEXT></EEBO></ETS>"))
    xml = F.concat(F.lit("<ETS>"), about if header else F.lit(""), F.lit("<EEBO><TEXT>"), text, end)
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), xml.cast("binary").alias("content"))


def _page_rows(df: DataFrame) -> DataFrame:
    return df.select(F.col("path").cast("long").alias("doc_id"), "page_no", "page_text")


XML_SQL = f"x AS (SELECT doc_id, source, lang, {LINES} AS l FROM documents WHERE doc_id % 11 <> 10), g AS (SELECT doc_id, l, unnest(range(0, len(l), 3)) AS i FROM x)"


@query("xml_metadata", f"WITH {XML_SQL} SELECT doc_id, source AS author, lang AS place, CAST(1500 + doc_id % 400 AS VARCHAR) AS date, CAST(count(*) AS BIGINT) AS pages FROM g JOIN x USING (doc_id) GROUP BY ALL")
def xml_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = xml_pages.parse_pages(xml_documents(spark, sf_dir), "document_order")
    return found.groupBy(F.col("path").cast("long").alias("doc_id"), "author", "place", "date").agg(F.count(F.lit(1)).alias("pages"))


@query("xml_metadata_defaults", f"WITH {XML_SQL} SELECT doc_id, 'Unknown' AS author, 'Unknown' AS place, 'Unknown' AS date FROM x WHERE len(l) > 0")
def xml_metadata_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = xml_pages.parse_pages(xml_documents(spark, sf_dir, header=False), "document_order")
    return found.select(F.col("path").cast("long").alias("doc_id"), "author", "place", "date").distinct()


@query("xml_pages_sibling", f"WITH {XML_SQL} SELECT doc_id, CAST(i // 3 - 1 AS INTEGER) AS page_no, array_to_string(list_slice(l, i + 1, i + 3), ' ') AS page_text FROM g WHERE i > 0 UNION ALL SELECT doc_id, 0, array_to_string(l, ' ') FROM x WHERE len(l) BETWEEN 1 AND 2")
def xml_pages_sibling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_rows(xml_pages.parse_pages(xml_documents(spark, sf_dir)))


@query("xml_pages_document_order", f"WITH {XML_SQL} SELECT doc_id, CAST(i // 3 AS INTEGER) AS page_no, array_to_string(list_slice(l, i + 1, i + 3), ' ') AS page_text FROM g")
def xml_pages_document_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_rows(xml_pages.parse_pages(xml_documents(spark, sf_dir), "document_order"))


@query("xml_nested_break", f"WITH {XML_SQL} SELECT doc_id, CAST(i // 3 - 1 AS INTEGER) AS page_no, array_to_string(list_slice(l, i + 1, i + 3), ' ') AS page_text FROM g WHERE i > 0 UNION ALL SELECT doc_id, 0, array_to_string(list_append(l, 'last'), ' ') FROM x WHERE len(l) < 3")
def xml_nested_break(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_rows(xml_pages.parse_pages(xml_documents(spark, sf_dir, nested=True)))


@query("xml_no_breaks", f"WITH {XML_SQL} SELECT doc_id, 0 AS page_no, array_to_string(l, ' ') AS page_text FROM x WHERE len(l) > 0")
def xml_no_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_rows(xml_pages.parse_pages(xml_documents(spark, sf_dir, every=1_000_000)))


@query("xml_malformed_skipped", "SELECT doc_id, 'ParseError' AS error FROM documents WHERE doc_id % 11 = 10")
def xml_malformed_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = xml_pages.parse_pages(xml_documents(spark, sf_dir), with_errors=True).where("error IS NOT NULL")
    return found.select(F.col("path").cast("long").alias("doc_id"), F.substring_index("error", ":", 1).alias("error"))


@query("xml_missing_content", "SELECT doc_id, CAST(0 AS BIGINT) AS pages FROM documents WHERE FALSE")
def xml_missing_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = xml_pages.parse_pages(xml_documents(spark, sf_dir), content_tag="ECCO")
    return found.groupBy(F.col("path").cast("long").alias("doc_id")).agg(F.count(F.lit(1)).alias("pages"))


@query("xml_date_attr", "SELECT doc_id, CAST(1500 + doc_id % 400 AS VARCHAR) AS date FROM documents WHERE doc_id % 2 = 1")
def xml_date_attr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An empty date element with an attribute, an empty one without, or one with text."""
    year = 1500 + F.col("doc_id") % 400
    date = F.when(F.col("doc_id") % 2 == 1, F.concat(F.lit('<DATE VALUE=" '), year, F.lit(' "></DATE>'))).otherwise(F.lit("<DATE/>"))
    head = F.concat(F.lit("<HEADER><FILEDESC><SOURCEDESC><BIBLFULL><PUBLICATIONSTMT>"), date, F.lit("</PUBLICATIONSTMT></BIBLFULL></SOURCEDESC></FILEDESC></HEADER>"))
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.concat(F.lit("<ETS>"), head, F.lit("<EEBO><TEXT>x</TEXT></EEBO></ETS>")).cast("binary").alias("content"))
    return xml_pages.parse_pages(files).where(F.col("date") != xml_pages.UNKNOWN).select(F.col("path").cast("long").alias("doc_id"), "date")


@query("xml_empty_pages", f"WITH x AS (SELECT doc_id, {LINES} AS l FROM documents) SELECT doc_id, CAST(greatest(len(l) - 1, 0) AS BIGINT) AS siblings, CAST(len(l) AS BIGINT) AS ordered FROM x WHERE len(l) > 1")
def xml_empty_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two breaks after each line: every other page is empty and no page."""
    lines = _lines()
    clean = F.transform(lines, lambda x: F.concat(F.lit("<P>"), F.translate(x, "&<>", "   "), F.lit(".</P>")))
    xml = F.concat(F.lit("<ETS><EEBO><TEXT>"), F.array_join(clean, "<PB/><PB/>"), F.lit("</TEXT></EEBO></ETS>"))
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), xml.cast("binary").alias("content"), F.size(lines).alias("n")).where("n > 1")
    count = lambda mode, name: xml_pages.parse_pages(files, mode).groupBy(F.col("path").cast("long").alias("doc_id")).agg(F.count(F.lit(1)).alias(name))
    return count("sibling", "siblings").join(count("document_order", "ordered"), "doc_id")


def _book_folder(spark: SparkSession, sf_dir: str) -> str:
    """A folder with an XML file for each nation."""
    folder, name = shared_folder(spark, "books"), F.col("n_name")
    head = F.concat(F.lit("<HEADER><FILEDESC><TITLESTMT><AUTHOR>"), name, F.lit("</AUTHOR></TITLESTMT></FILEDESC></HEADER>"))
    xml = F.concat(F.lit("<ETS>"), head, F.lit("<EEBO><TEXT><P>"), name, F.lit("</P><PB/><P>of region "), F.col("n_regionkey"), F.lit("</P></TEXT></EEBO></ETS>"))
    table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("number"), xml.alias("value")).write.partitionBy("number").text(folder)
    return folder


@query("xml_batch_scan", "SELECT n_name AS author, 'Unknown' AS place, 'Unknown' AS date, 'of region ' || n_regionkey AS page_text FROM nation")
def xml_batch_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return xml_pages.read_pages(spark, _book_folder(spark, sf_dir), glob="*.txt")


@query("xml_file_sizes", "SELECT n_nationkey AS number, CAST(length('<ETS><HEADER><FILEDESC><TITLESTMT><AUTHOR></AUTHOR></TITLESTMT></FILEDESC></HEADER><EEBO><TEXT><P></P><PB/><P>of region </P></TEXT></EEBO></ETS>') + 2 * length(n_name) + length(CAST(n_regionkey AS VARCHAR)) + 1 AS BIGINT) AS bytes FROM nation")
def xml_file_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = xml_pages.file_sizes(spark, _book_folder(spark, sf_dir), "*.txt")
    number = F.regexp_extract("path", "number=([0-9]+)", 1).cast(table(spark, sf_dir, "nation").schema["n_nationkey"].dataType)
    return sizes.select(number.alias("number"), F.round(F.col("mb") * 1048576).cast("long").alias("bytes"))


# --- tables -------------------------------------------------------------------------------------


@query("csv_round_trip", f"WITH {PAGES} SELECT source AS author, lang AS place, date, page_text FROM pages_ WHERE page_text IS NOT NULL")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "csv")
    page_tables.write_csv(pages(spark, sf_dir).where("page_text IS NOT NULL").select(F.col("source").alias("author"), F.col("lang").alias("place"), "date", "page_text"), path, page_tables.NULL)
    return page_tables.read_csv(spark, path, na=False)


@query("csv_load_several", "SELECT source AS author, NULL AS place, lang AS date, 'even' AS page_text FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT source, 'odd', lang, NULL FROM documents WHERE doc_id % 2 = 1")
def csv_load_several(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, folders = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("author"), F.col("lang").alias("date")), []
    for k, (place, text) in enumerate((("null", "even"), ("odd", "NaN"))):
        folders.append(shared_folder(spark, f"csv{k}"))
        page_tables.write_csv(d.where(F.col("doc_id") % 2 == k).select("author", F.lit(place).alias("place"), "date", F.lit(text).alias("page_text")), folders[-1])
    return page_tables.load_csvs(spark, folders)


@query("column_drop", f"WITH {PAGES} SELECT date, CAST(count(*) AS BIGINT) AS sequences FROM (SELECT date, unnest(range(0, len({WORDS.format('page_text')}), 250)) FROM pages_ WHERE page_text <> '') GROUP BY date")
def column_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three columns go, the date stays beside the new rows."""
    out = chunks.fixed_chunks(pages(spark, sf_dir)).drop("doc_id", "page_text", "lang", "source")
    return out.groupBy("date").agg(F.count(F.lit(1)).alias("sequences"))


@query(
    "date_odd",
    """WITH o AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '1_650' WHEN 2 THEN '+165' WHEN 3 THEN ' 16 ' WHEN 4 THEN '--1' || (650 + o_orderkey % 50) ELSE '' END AS date FROM orders)
SELECT o_orderkey, date, CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '1_650' WHEN 2 THEN '+165' WHEN 3 THEN ' 16 ' WHEN 4 THEN CAST(1650 + o_orderkey % 50 AS VARCHAR) ELSE '' END AS date_convert,
  CASE WHEN o_orderkey % 6 = 4 THEN CAST(1650 + o_orderkey % 50 AS INTEGER) END AS year FROM o""",
)
def date_odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null, signed, underscored, blank and empty dates."""
    k = F.col("o_orderkey") % 6
    date = F.when(k == 0, None).when(k == 1, "1_650").when(k == 2, "+165").when(k == 3, " 16 ").when(k == 4, F.concat(F.lit("--1"), 650 + F.col("o_orderkey") % 50)).otherwise("")
    return D.clean_dates(table(spark, sf_dir, "orders").select("o_orderkey", date.alias("date")))


@query("csv_na_values", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN 'Na' ELSE lang END AS place FROM documents")
def csv_na_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 4
    return missing_to_null(table(spark, sf_dir, "documents").select("doc_id", F.when(k == 0, "NA").when(k == 1, "n/a").when(k == 2, "Na").otherwise(F.col("lang")).alias("place")))


@query("csv_union", "SELECT doc_id, lang, NULL AS source FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, NULL, source FROM documents WHERE doc_id % 2 = 1")
def csv_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return page_tables.union_corpora([d.where("doc_id % 2 = 0").select("doc_id", "lang"), d.where("doc_id % 2 = 1").select("doc_id", "source")])


@query("row_limit", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 100")
def row_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.first_rows(table(spark, sf_dir, "documents").select("doc_id", "lang"), 100, ["doc_id"])


@query("xml_max_files", "SELECT n_name AS author FROM nation ORDER BY CAST(n_nationkey AS VARCHAR) LIMIT 10")
def xml_max_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return xml_pages.read_pages(spark, _book_folder(spark, sf_dir), max_files=10, glob="*.txt").select("author")


@query("corpus_summary", f"WITH {PAGES} SELECT lang, count(*) AS pages, count(*) FILTER (WHERE page_text IS NOT NULL AND page_text <> '') AS with_text, CAST(coalesce(sum(length(page_text)), 0) AS BIGINT) AS chars FROM pages_ GROUP BY lang")
def corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.corpus_summary(pages(spark, sf_dir), ["lang"])


@query("steps_per_epoch", "SELECT count(*) AS rows, CAST(count(*) // 16 AS BIGINT) AS steps_per_epoch, CAST(count(*) // 16 * 3 AS BIGINT) AS total_steps FROM documents")
def steps_per_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.steps(table(spark, sf_dir, "documents"), 16, 3)


@query("value_preview", "SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS sample FROM documents")
def value_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", preview(F.col("text")).alias("sample"))


# --- vocabulary ---------------------------------------------------------------------------------

VOCABULARY = f"v AS (SELECT token, CAST(row_number() OVER (ORDER BY encode(token)) - 1 AS BIGINT) AS id FROM (SELECT DISTINCT unnest({WORDS.format('text')}) AS token FROM documents))"
TOKENS = f"r AS (SELECT doc_id, w, unnest(range(0, len(w))) AS pos FROM (SELECT doc_id, {WORDS.format('text')} AS w FROM documents))"


def _token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_rows(table(spark, sf_dir, "documents"), ["doc_id"], tokens.whitespace_tokens(F.col("text")))


@query("vocab_build", f"WITH {VOCABULARY} SELECT token, id FROM v")
def vocab_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.build_vocabulary(_token_rows(spark, sf_dir))


@query("vocab_size", f"WITH {VOCABULARY} SELECT count(*) AS tokens FROM v")
def vocab_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.vocabulary_size(tokens.build_vocabulary(_token_rows(spark, sf_dir)))


@query("vocab_add_time", f"WITH {VOCABULARY} SELECT token, id FROM v UNION ALL SELECT '[TIME]', CAST((SELECT max(id) FROM v) + 1 AS BIGINT)")
def vocab_add_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = tokens.add_tokens(tokens.build_vocabulary(_token_rows(spark, sf_dir)), [tokens.TIME])
    return once


@query("encode_ids", f"WITH {VOCABULARY}, {TOKENS} SELECT doc_id, CAST(count(*) AS BIGINT) AS tokens, CAST(sum(id * (pos + 1)) AS BIGINT) AS id_sum FROM r JOIN v ON r.w[r.pos + 1] = v.token GROUP BY doc_id")
def encode_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _token_rows(spark, sf_dir)
    path = shared_folder(spark, "vocabulary")
    tokens.build_vocabulary(rows, counts=True).write.parquet(path)
    ids = tokens.encode(rows, spark.read.parquet(path), hot=10_000)
    return ids.groupBy("doc_id").agg(F.count(F.lit(1)).alias("tokens"), F.sum(F.col("id") * (F.col("pos") + 1)).alias("id_sum"))


@query("decode_round_trip", f"SELECT doc_id, array_to_string({WORDS.format('text')}, ' ') AS text FROM documents WHERE len({WORDS.format('text')}) > 0")
def decode_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _token_rows(spark, sf_dir)
    path = shared_folder(spark, "vocabulary")
    tokens.build_vocabulary(rows, counts=True).write.parquet(path)
    vocabulary = spark.read.parquet(path)
    return tokens.decode(tokens.encode(rows, vocabulary, hot=100_000), vocabulary, ["doc_id"], hot=100_000)
