"""Page segmentation and metadata, in both modes."""

import pytest

from vellum.sources import xml_pages as X


def book(text, header="", tag="EEBO"):
    return f"<ETS>{header}<{tag}><TEXT>{text}</TEXT></{tag}></ETS>".encode()


def header(author="", place="", date=""):
    return f"<HEADER><FILEDESC><TITLESTMT>{author}</TITLESTMT><SOURCEDESC><BIBLFULL><PUBLICATIONSTMT>{place}{date}</PUBLICATIONSTMT></BIBLFULL></SOURCEDESC></FILEDESC></HEADER>"


# (content of TEXT, pages by siblings, pages in document order)
CASES = {
    "one break": ("<P>alpha beta</P><PB/><P>gamma</P>", ["gamma"], ["alpha beta", "gamma"]),
    "no break": ("<P>alpha</P><P>beta</P>", ["alpha beta"], ["alpha beta"]),
    "empty": ("", [], []),
    "break after a division": ("<DIV><P>delta</P></DIV><PB/><P>epsilon</P>", ["epsilon"], ["delta", "epsilon"]),
    "two breaks in a row": ("<P>one</P><PB/><PB/><P>three</P><PB/>", ["three"], ["one", "three"]),
    "breaks in two parents": ("<FRONT><P>i</P><PB/><P>ii</P></FRONT><BODY><PB/><P>iii</P></BODY>", ["ii", "iii"], ["i", "ii", "iii"]),
    "inline": ("<P>red <I>green</I> and <B>blue</B></P><PB/><DIV><HEAD>no. 2</HEAD><P>grey</P></DIV>", ["no. 2 grey"], ["red green and blue", "no. 2 grey"]),
    "tail after a break": ("<PB/>tail <P>one</P> more", ["one"], ["tail one more"]),
    "break in a sibling": ("<PB/><DIV><P>a</P><PB/><P>b</P></DIV>", ["a b", "b"], ["a", "b"]),
    "page stays in its parent": ("<DIV><PB/><P>a</P></DIV><P>b</P>", ["a"], ["a b"]),
    "no pages at all": ("<PB/><PB/>", [], []),
    "unicode": ("<P>“Café” — naïve…</P><PB/><P>Ærø</P>", ["Ærø"], ["“Café” — naïve…", "Ærø"]),
}


@pytest.mark.parametrize("depth", [1_200, 10_000])
def test_deep_nesting(depth):
    content = "<DIV>" * depth + "<P>a</P><PB/><P>b</P>" + "</DIV>" * depth
    assert [p["page_text"] for p in X.parse_document(book(content), "sibling")] == ["b"]
    assert [p["page_text"] for p in X.parse_document(book(content), "document_order")] == ["a", "b"]


@pytest.mark.parametrize("name", CASES)
def test_pages(name):
    content, siblings, ordered = CASES[name]
    assert [p["page_text"] for p in X.parse_document(book(content), "sibling")] == siblings
    assert [p["page_text"] for p in X.parse_document(book(content), "document_order")] == ordered


def test_white_space_is_kept_inside():
    assert X.parse_document(book("<P>  a   b\n c </P>"))[0]["page_text"] == "a   b\n c"


@pytest.mark.parametrize(
    ("head", "expected"),
    [
        (header("<AUTHOR>A. Author</AUTHOR>", "<PUBPLACE>London</PUBPLACE>", "<DATE>1633</DATE>"), ("A. Author", "London", "1633")),
        (header("", "<PUBPLACE>London</PUBPLACE>"), ("Unknown", "London", "Unknown")),
        ("", ("Unknown",) * 3),
        (header("<AUTHOR>First</AUTHOR><AUTHOR>Second</AUTHOR>", "", '<DATE VALUE="1650"/>'), ("First", "Unknown", "1650")),
        (header("<AUTHOR>A <I>B</I> C</AUTHOR>", "<PUBPLACE> </PUBPLACE>", '<DATE VALUE="1650"> </DATE>'), ("A  B  C", "Unknown", "")),
        (header("", "", "<DATE>16<I>33</I></DATE>"), ("Unknown", "Unknown", "16")),
        ("<HEADER/>", ("Unknown",) * 3),
    ],
)
def test_metadata(head, expected):
    page = X.parse_document(book("<P>x</P>", head))[0]
    assert (page["author"], page["place"], page["date"]) == expected


def test_missing_content_and_other_tags():
    assert X.parse_document(b"<ETS><EEBO><DIV><TEXT>x</TEXT></DIV></EEBO></ETS>") == []
    assert X.parse_document(book("<P>x</P>", tag="ECCO")) == []
    assert len(X.parse_document(book("<P>x</P>", tag="ECCO"), content_tag="ECCO")) == 1
    with pytest.raises(ValueError, match="mode"):
        X.parse_document(book("x"), "other")


def test_files(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"d{i}.xml").write_bytes(book(f"<P>leaf no. {i}</P>", header(f"<AUTHOR>writer {i}</AUTHOR>", "", f"<DATE>160{i}</DATE>")))
    (tmp_path / "broken.xml").write_bytes(b"<ETS><EEBO>&mdash;</ETS>")
    (tmp_path / "other.txt").write_bytes(b"no XML")
    pages = X.read_pages(spark, str(tmp_path))
    assert pages.columns == ["author", "place", "date", "page_text"]
    assert sorted(r["date"] for r in pages.collect()) == [f"160{i}" for i in range(5)]
    errors = X.parse_pages(X.xml_files(spark, str(tmp_path)), with_errors=True).where("error IS NOT NULL").collect()
    assert len(errors) == 1 and errors[0]["path"].endswith("broken.xml") and errors[0]["error"].startswith("ParseError")
    for limit, n in ((2, 1), (3, 2), (0, 5), (None, 5), (-1, 4), (-6, 0), (-9, 0), (100, 5)):  # the broken file is the first by name
        assert X.read_pages(spark, str(tmp_path), max_files=limit).count() == n
    assert X.file_sizes(spark, str(tmp_path), "*.txt").first()["mb"] == 6 / 1048576


def test_no_pages_keep_the_schema(spark, tmp_path):
    (tmp_path / "a.xml").write_bytes(b"<ETS/>")
    assert X.read_pages(spark, str(tmp_path)).columns == ["author", "place", "date", "page_text"]
    assert X.read_pages(spark, str(tmp_path)).count() == 0


def test_stream(spark, tmp_path):
    from vellum.streaming import xml_stream

    source, out, mark = tmp_path / "in", tmp_path / "out", tmp_path / "mark"
    source.mkdir()
    for i in range(2):
        (source / f"{i}.xml").write_bytes(book(f"<P>{i}</P>"))
        xml_stream.append_pages(xml_stream.stream_pages(spark, str(source)), str(out), str(mark)).awaitTermination()
        assert spark.read.parquet(str(out)).count() == i + 1
