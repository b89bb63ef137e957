"""Book-level XML to page-level rows with bibliographic metadata.

Parsing is an Arrow-batched Python function: page breaks interleave with content, and built-in XML readers lose
the order of mixed content. A file that can't be parsed gives no page, and its error on request.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from vellum.schemas import PAGE_FIELDS, PARSED_PAGES

UNKNOWN, BREAK = "Unknown", "PB"
MODES = ("sibling", "document_order")
#: Characters and rows of pages after which a task returns what it holds.
PIECE, PIECE_ROWS = 1_000_000, 2_000


def spaced(element: ET.Element) -> str:
    """All text below an element: its segments joined by one blank, stripped outside."""
    return " ".join(element.itertext()).strip()


def _descend(element: ET.Element | None, *tags: str) -> ET.Element | None:
    """Along first children by tag."""
    for tag in tags:
        element = None if element is None else element.find(tag)
    return element


def bibliography(root: ET.Element) -> dict[str, str]:
    """``author, place, date``; what is missing or empty is ``Unknown``. Only the date may end up blank."""
    description = _descend(root, "HEADER", "FILEDESC")
    imprint = _descend(description, "SOURCEDESC", "BIBLFULL", "PUBLICATIONSTMT")
    author, place, date = _descend(description, "TITLESTMT", "AUTHOR"), _descend(imprint, "PUBPLACE"), _descend(imprint, "DATE")
    value = UNKNOWN
    if date is not None and (own := date.text or date.get("VALUE")):
        value = own.strip()
    return {
        "author": (spaced(author) if author is not None else "") or UNKNOWN,
        "place": (spaced(place) if place is not None else "") or UNKNOWN,
        "date": value,
    }


def sibling_pages(text: ET.Element) -> list[str]:
    """A page is what follows a break among its siblings, up to the next break or the parent's end.

    One walk in document order, with a stack of its own for any depth: a break opens a page, and each later child of
    the same parent is added to it.
    """
    pages: list[list[str]] = []
    stack: list[tuple[Iterator[ET.Element], list[str] | None]] = [(iter(text), None)]
    while stack:
        children, page = stack.pop()
        child = next(children, None)
        if child is None:
            continue
        if child.tag == BREAK:
            page = []
            pages.append(page)
        elif page is not None:
            page.append(spaced(child))
        stack += [(children, page), (iter(child), None)]
    return [p for p in (" ".join(filter(None, parts)).strip() for parts in pages) if p]


def ordered_pages(text: ET.Element) -> list[str]:
    """Every piece of text belongs to the page of the last break before it, page 0 included."""
    pages: list[list[str]] = [[]]
    stack: list[ET.Element | str | None] = [text]  # elements still to enter, and tails
    while stack:
        item = stack.pop()
        if not isinstance(item, ET.Element):
            if item and item.strip():
                pages[-1].append(item.strip())
            continue
        if item.tag == BREAK:
            pages.append([])
        for child in reversed(item):
            stack += [child.tail, child]
        stack.append(item.text)
    return [p for p in map(" ".join, pages) if p]


def parse_document(content: bytes, mode: str = "sibling", content_tag: str = "EEBO") -> list[dict[str, str]]:
    """Pages of one file; raises what the parser raises."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    root = ET.fromstring(content)
    about = bibliography(root)
    text = _descend(root, content_tag, "TEXT")
    if text is None:
        return []
    if next(text.iter(BREAK), None) is None:
        pages = [p] if (p := spaced(text)) else []
    else:
        pages = sibling_pages(text) if mode == "sibling" else ordered_pages(text)
    return [about | {"page_text": p} for p in pages]


def parse_pages(files: DataFrame, mode: str = "sibling", content_tag: str = "EEBO", with_errors: bool = False) -> DataFrame:
    """``path, author, place, date, page_text, page_no, error`` of ``files`` (``path, content``).

    ``error`` is null for pages; with ``with_errors`` a file that can't be parsed gives one row with its error. Files are read
    from their batch one at a time and pages returned in bounded pieces, so a task holds its batch, a file and a piece.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")

    schema = to_arrow_schema(PARSED_PAGES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, contents = batch.column("path"), batch.column("content")
            rows, held = [], 0
            for k in range(batch.num_rows):
                path = paths[k].as_py()
                try:
                    found = parse_document(bytes(contents[k].as_py()), mode, content_tag)
                except Exception as error:  # any failure skips the file, whatever the parser raised
                    if with_errors:
                        rows.append((path, None, None, None, None, None, f"{type(error).__name__}: {error}"))
                    continue
                rows += [(path, *(p[f] for f in PAGE_FIELDS), n, None) for n, p in enumerate(found)]
                held += sum(len(p["page_text"]) for p in found)
                if held > PIECE or len(rows) > PIECE_ROWS:
                    yield _record_batch(rows, schema)
                    rows, held = [], 0
            if rows:
                yield _record_batch(rows, schema)

    return files.select("path", "content").mapInArrow(run, PARSED_PAGES)


def _record_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def xml_files(spark: SparkSession, path: str | list[str], max_files: int | None = None, glob: str = "*.xml") -> DataFrame:
    """``path, content`` of XML files in the order of their paths.

    ``max_files`` keeps that many, 0 or None all, and a negative number drops as many from the end: names are
    listed first, and only the files that are kept are read.
    """
    paths = [path] if isinstance(path, str) else path
    source = spark.read.format("binaryFile").option("pathGlobFilter", glob)
    files = source.load(paths).select("path", "content")
    if not max_files:
        return files
    if max_files < 0:  # only the last names go to the driver
        last = source.load(paths).select("path").orderBy(F.desc("path")).limit(-max_files).collect()
        return files.where(F.col("path") < min(r["path"] for r in last)) if len(last) == -max_files else files.limit(0)
    names = [r["path"] for r in source.load(paths).select("path").orderBy("path").limit(max_files).collect()]
    return source.load(names).select("path", "content") if names else files.limit(0)


def read_pages(spark: SparkSession, path: str | list[str], max_files: int | None = None, mode: str = "sibling", content_tag: str = "EEBO", glob: str = "*.xml") -> DataFrame:
    """The four columns of the page table, from XML files."""
    return parse_pages(xml_files(spark, path, max_files, glob), mode, content_tag).select(*PAGE_FIELDS)


def file_sizes(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``path, mb``."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", (F.col("length") / 1048576).alias("mb"))
