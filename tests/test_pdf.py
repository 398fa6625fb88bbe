"""PDF files: texts and boxes of hand-made files, files that can't be read, and files that go through Spark."""

import base64
import zlib

import pytest
from pyspark.sql import functions as F

from folioscope.__main__ import main
from folioscope.sources import files, pdf, readers


def file_of(content, fonts=b"/F 4 0 R", more=b"", page=b"", filters=b""):
    return b"""%%PDF-1.4
1 0 obj <</Type /Catalog /Pages 2 0 R>> endobj
2 0 obj <</Type/Pages /Kids [3 0 R] /Count 1 /MediaBox [10 20 210 320] /Resources <</Font <<%s>> /XObject <</X 9 0 R>>>>>> endobj
3 0 obj <</Type/Page /Parent 2 0 R /Contents 5 0 R %s>> endobj
4 0 obj <</Type/Font /Subtype/Type1 /BaseFont/Helvetica /FirstChar 65 /Widths [500 1000 250] /FontDescriptor <</Ascent 700 /Descent -300 /MissingWidth 400>>>> endobj
5 0 obj <</Length %d %s>> stream
%s
endstream endobj
%s
trailer <</Root 1 0 R>>
""" % (fonts, page, len(content), filters, content, more)


def spans(data):
    return [r[3:10] for r in pdf.spans_of("d", data)]


def only(content, **more):
    return [(r[2], *(round(x, 3) for x in r[3:])) for r in spans(file_of(content, **more))]


def test_places_and_widths():
    # the page's own corner is (10, 20) and it is 300 high
    assert only(b"BT /F 10 Tf 30 120 Td (ABC) Tj ET") == [("ABC", 20, 193, 37.5, 203)]
    # a matrix scales and moves; text matrices and the state come back after Q
    assert only(b"q 2 0 0 2 10 20 cm BT /F 10 Tf 1 0 0 1 5 5 Tm (A) Tj ET Q BT /F 10 Tf 10 20 Td (B) Tj ET") == [("A", 10, 276, 20, 296), ("B", 0, 293, 10, 303)]
    # lines by leading, by TD, and by the quote operators
    got = only(b"BT /F 10 Tf 12 TL 10 220 Td (A) Tj T* (A) Tj (A) ' 1 2 (A ) \" 0 -20 TD (A) Tj T* (A) Tj ET")
    assert [round(r[2]) for r in got] == [93, 105, 117, 129, 149, 169]
    # spacing of characters and words, horizontal scale, kerning
    assert only(b"BT /F 10 Tf 1 Tc 3 Tw 50 Tz 10 20 Td (A B) Tj ET")[0][3] == (5 + 1 + 4 + 1 + 3 + 10 + 1) / 2
    assert only(b"BT /F 10 Tf 10 20 Td [(A) -100 (A) -500 (B) 200 (C)] TJ ET") == [("AA BC", 0, 293, 5 + 1 + 5 + 5 + 10 - 2 + 2.5, 303)]


def test_strings():
    assert [r[0] for r in only(rb"BT /F 9 Tf (a\(b\) (c) \\ \101\n\
x) Tj <414 > Tj <4142> Tj (%no comment) Tj % (a comment) Tj" + b"\n (caf\xe9 \x80) Tj ET")] == ["a(b) (c) \\ A\nx", "A@", "AB", "%no comment", "café €"]


def test_fonts():
    two = b"""6 0 obj <</Type/Font /Subtype/Type0 /DescendantFonts [<</DW 800 /W [1 [100 200] 5 7 300]>>] /ToUnicode 7 0 R>> endobj
7 0 obj <</Length 999>> stream
2 beginbfchar <0001> <0066006C> <0002> <D83DDE00> endbfchar 2 beginbfrange <0005> <0007> <0078> <0008> <0009> [<0031> <0032>] endbfrange
endstream endobj
8 0 obj <</Type/Font /Subtype/Type1 /Encoding <</Differences [65 /x /uni65E5 /space /unknown]>>>> endobj"""
    got = only(b"BT /G 10 Tf <0001000200050007000800090063> Tj /H 10 Tf 0 5 Td (ABCDE) Tj /None 10 Tf (plain) Tj ET", fonts=b"/G 6 0 R /H 8 0 R", more=two)
    assert [r[0] for r in got] == ["fl😀xz12�", "x日 DE", "plain"]
    assert got[0][3] - got[0][1] == pytest.approx(1 + 2 + 3 + 3 + 8 + 8 + 8) and got[1][3] - got[1][1] == pytest.approx(25)


def test_streams_objects_and_forms():
    content = b"BT /F 10 Tf 10 20 Td (A) Tj ET"
    want = only(content)
    assert only(zlib.compress(content), filters=b"/Filter /FlateDecode") == want
    assert only(base64.a85encode(zlib.compress(content)) + b"~>", filters=b"/Filter [/ASCII85Decode /FlateDecode]") == want
    assert only(content.hex().encode() + b">", filters=b"/Filter/AHx") == want
    # a wrong length, and contents in parts
    assert only(content, filters=b"/Length 3") == want
    assert only(b"BT /F 10 Tf 10 20 Td", page=b"/Contents [5 0 R 8 0 R]", more=b"8 0 obj <</Length 11>> stream\n (A) Tj ET \nendstream endobj") == want
    # a form with a matrix of its own; one that shows itself ends
    form = b"9 0 obj <</Subtype/Form /Matrix [1 0 0 1 10 20] /Length 37>> stream\nBT /F 10 Tf 0 0 Td (A) Tj ET /X Do   \nendstream endobj"
    assert only(b"/X Do", more=form)[0] == want[0]
    # the page tree in a compressed object stream, as newer files have it; an inline image is passed over
    inner = b"1 0 2 40 <</Type /Catalog /Pages 2 0 R>>            <</Type/Pages /Kids [3 0 R] /MediaBox [10 20 210 320] /Resources <</Font <</F 4 0 R>>>>>>"
    packed = zlib.compress(inner[:9] + inner[9:])
    body = file_of(b"BI /W 1 ID (Tj EI BT /F 10 Tf 10 20 Td (A) Tj ET").split(b"3 0 obj", 1)[1]
    data = b"%%PDF-1.5\n8 0 obj <</Type/ObjStm /N 2 /First 9 /Length %d /Filter/FlateDecode>> stream\n%s\nendstream endobj\n3 0 obj" % (len(packed), packed) + body
    first = len(b"1 0 2 40 ")
    assert inner[first + 40 :].lstrip().startswith(b"<</Type/Pages") and [r[2] for r in spans(data)] == ["A"]


def test_later_objects_count_and_operands_may_be_missing():
    data = file_of(b"BT /F 10 Tf Td (A) Tj Tj ET Q 1 0 cm")
    assert [r[2] for r in spans(data)] == ["A"]
    newer = data + b"5 0 obj <</Length 33>> stream\nBT /F 10 Tf 10 20 Td (new) Tj ET \nendstream endobj"
    assert [r[2] for r in spans(newer)] == ["new"]


def test_made_files_round_trip():
    pages = [(800.0, [(50.0, 100.0, "Ä 日本 😀 (x)"), (70.5, 112.0, "second")]), (400.0, []), (800.0, [(1.0, 2.0, "last")])]
    rows = list(pdf.spans_of("d", pdf.made(pages)))
    assert [(r[1], r[2], r[5]) for r in rows] == [(1, 800, "Ä 日本 😀 (x)"), (1, 800, "second"), (2, 400, None), (3, 800, "last")]
    assert [(r[6], round(r[7], 6)) for r in rows if r[5]] == [(50, 100), (70.5, 112), (1, 2)]


def test_made_files_are_short_and_their_font_is_read_once(monkeypatch):
    """Pages share one font object, and strings are written in brackets, not as hex."""
    texts = ["(a) \\ b)) ((", "line\rend \r\n\n", "\u2829\u5c5c\u0d0a \U0001f600 \udc00", "%<>[]{}/ é"]
    data = pdf.made([(800.0, [(50.0, 100.0 + 40 * k, text) for k, text in enumerate(texts)])] * 3)
    read, fonts = [], []
    monkeypatch.setattr(pdf, "Font", lambda *given, kind=pdf.Font: fonts.append(kind(*given)) or fonts[-1])
    for row in pdf.spans_of("d", data):
        read.append((row[1], row[5]))
    assert read == [(page, text.encode("utf-16-be", "surrogatepass").decode("utf-16-be", "replace")) for page in (1, 2, 3) for text in texts]
    assert len(fonts) == 1
    file = pdf.File(data)
    assert len(file.stream(next(file.pages())["Contents"])) < 4 * sum(map(len, texts)) + 40 * len(texts)


def test_files_through_spark(spark, tmp_path):
    good = pdf.made([(800.0, [(50.0, 200.0, "Principle 1: Banks"), (50.0, 220.0, "They act"), (90.0, 220.5, "now."), (50.0, 780.0, "3")]), (800.0, [])])
    write = lambda rows, name: files.write_files(spark.createDataFrame(rows, "name string, content binary"), str(tmp_path / name))
    write([("a b.pdf", good), ("other.txt", b"no")], "in")
    lines, pages = readers.extract(spark, str(tmp_path / "in"), "PDF")
    assert [(r["doc_id"], r["page"], r["text"]) for r in lines.orderBy("line_no").collect()] == [("a b", 1, "Principle 1: Banks"), ("a b", 1, "They act now."), ("a b", 1, "3")]
    assert {tuple(r) for r in pages.collect()} == {("a b", 1, 800.0), ("a b", 2, 800.0)}
    write([("bad.pdf", b"%PDF-1.4 nothing"), ("locked.pdf", good.replace(b"/Size", b"/Encrypt 9 0 R/Size")), ("empty.pdf", b""), ("good.pdf", good)], "mixed")
    errors = {r["doc_id"]: r["error"] for r in pdf.read_pdfs(spark, str(tmp_path / "mixed")).filter("error is not null").collect()}
    assert set(errors) == {"bad", "locked"} and "encrypted" in errors["locked"]
    with pytest.raises(RuntimeError, match="Failed to open PDF"):
        readers.extract(spark, str(tmp_path / "mixed"), "pdf")
    write([], "none")
    assert readers.extract(spark, str(tmp_path / "none"), "pdf")[0].count() == 0


def test_pdf_on_the_command_line(spark, tmp_path):
    """Two versions as PDF files, compared from file to report."""
    for side, word in (("a", "act"), ("b", "react")):
        data = pdf.made([(800.0, [(50.0, 200.0, "Principle 1: Banks"), (50.0, 220.0, f"They {word} now."), (50.0, 240.0, "Principle 2: More"), (50.0, 260.0, "Same.")])])
        files.write_files(spark.createDataFrame([("act.pdf", data)], "name string, content binary"), str(tmp_path / side))
    main(["diff", str(tmp_path / "a"), str(tmp_path / "b"), "--output", str(tmp_path / "out"), "--backend", "pdf"], spark)
    (report,) = spark.read.json(str(tmp_path / "out/reports")).collect()
    assert report["pair_id"] == "act" and [d["status"] for d in report["diffs"]] == ["unchanged", "modified"] or sorted(d["status"] for d in report["diffs"]) == ["modified", "unchanged"]
    assert readers.reports(spark, str(tmp_path / "out/reports")).filter(F.col("status") == "modified").count() == 1
