"""Files of every format: what is read, what is written back, and what is left in it."""

import io
import json
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from haetae.plans.process import Config, process
from haetae.sinks import files as sinks
from haetae.sinks import reports
from haetae.sources import containers, hwp, pdf, text
from haetae.sources.files import extract, file_paragraphs, read_files, sniff

RRN, CARD, BIZ, MAIL = "900101-1234568", "4111-1111-1111-1111", "220-81-62517", "user@example.com"


def archive(**parts):
    return containers.write_parts([(k, v.encode()) for k, v in parts.items()])


def zipped(parts):
    return containers.write_parts([(k, v.encode() if isinstance(v, str) else v) for k, v in parts.items()])


def pdf_file(objects, trailer):
    body = b"%PDF-1.4\n" + b"".join(f"{i} 0 obj".encode() + o + b"endobj\n" for i, o in objects.items())
    return body + b"trailer" + trailer + b"\n%%EOF"


def page_pdf(content, page=b"", more=None, catalog=b""):
    objects = {1: b"<</Type/Catalog/Pages 2 0 R" + catalog + b">>", 2: b"<</Type/Pages/Kids[3 0 R]/Count 1>>", 3: b"<</Type/Page/Contents 4 0 R" + page + b">>", 4: b"<</Length %d>>stream\n" % len(content) + content + b"\nendstream "}
    return pdf_file({**objects, **(more or {})}, b"<</Root 1 0 R/Info 9 0 R>>")


FORM = zlib.compress(b"BT (%s) Tj ET" % CARD.encode())
PDFS = {
    "page.pdf": (page_pdf(b"BT (RRN " + RRN.encode() + b") Tj 0 -10 Td [(4111-1111-) -20 (1111-1111)] TJ ET"), {RRN, CARD}),
    "form.pdf": (page_pdf(b" ", b"/Resources<</XObject<</F 5 0 R>>>>", {5: b"<</Subtype/Form/Filter/FlateDecode/Length %d>>stream\n" % len(FORM) + FORM + b"\nendstream "}), {CARD}),
    "info.pdf": (page_pdf(b" ", more={9: b"<</Author(" + MAIL.encode() + b")/Title<FEFF003900300030003100300031002D0031003200330034003500360038>>>"}), {MAIL, RRN}),
    "outline.pdf": (page_pdf(b" ", more={5: b"<</First 6 0 R>>", 6: b"<</Title(" + RRN.encode() + b")/Next 7 0 R>>", 7: b"<</Title(" + MAIL.encode() + b")/Next 6 0 R>>"}, catalog=b"/Outlines 5 0 R"), {RRN, MAIL}),
    "note.pdf": (page_pdf(b" ", more={5: b"<</Type/Annot/Subtype/Text/Contents(" + CARD.encode() + b")>>", 6: b"<</FT/Tx/V(" + RRN.encode() + b")>>"}), {CARD, RRN}),
    "script.pdf": (page_pdf(b" ", more={5: b"<</S/JavaScript/JS(app.alert\\(" + RRN.encode() + b"\\))>>"}, catalog=b"/OpenAction 5 0 R"), {RRN}),
    "file.pdf": (page_pdf(b" ", more={5: b"<</Type/Filespec/F(x)/Desc(" + RRN.encode() + b")>>"}), {RRN}),
    "uri.pdf": (page_pdf(b" ", more={5: b"<</Type/Annot/Subtype/Link/A<</S/URI/URI(mailto:" + MAIL.encode() + b")>>>>"}), {MAIL}),
    "type_f.pdf": (page_pdf(b" ", more={5: b"<</Type/F/Desc(" + RRN.encode() + b")>>"}), {RRN}),
    "stream_js.pdf": (page_pdf(b" ", more={5: b"<</S/JavaScript/JS(" + RRN.encode() + b")/Length 1>>stream\nx\nendstream "}), {RRN}),
    "pa.pdf": (page_pdf(b" ", more={5: b"<</Type/Annot/PA<</S/URI/URI(mailto:" + MAIL.encode() + b")>>>>"}), {MAIL}),
    "field_uri.pdf": (page_pdf(b" ", catalog=b"/AcroForm<</Fields[<</T(x)/A<</S/URI/URI(mailto:" + MAIL.encode() + b")>>>>]>>"), {MAIL}),
    "leaves.pdf": (page_pdf(b" ", more={5: b"<</Kids[" + b"".join(b"%d 0 R " % i for i in range(100, 5200)) + b"]>>", **{i: b"<</Names[(d%d)[3 0 R]]>>" % i for i in range(100, 5199)}, 5199: b"<</Names[(" + RRN.encode() + b")[3 0 R]]>>"}, catalog=b"/Names<</Dests 5 0 R>>"), {RRN}),
    "dest.pdf": (page_pdf(b" ", more={5: b"<</Names[(" + RRN.encode() + b")[3 0 R]]>>"}, catalog=b"/Names<</Dests 5 0 R>>"), {RRN}),
    "alt.pdf": (page_pdf(b" ", more={5: b"<</Type/StructElem/Alt(" + RRN.encode() + b")>>"}), {RRN}),
}
W, A = "<w:p><w:r><w:t>{}</w:t></w:r></w:p>", "<a:p><a:r><a:t>{}</a:t></a:r></a:p>"
BOOK = {"xl/workbook.xml": "<workbook/>"}
SHOW = {"ppt/presentation.xml": "<p/>"}
ZIPS = {
    "body.docx": {"word/document.xml": f"<w:document><w:p><w:r><w:t>a 9001</w:t></w:r><w:r><w:t xml:space='preserve'>01-1234568 &amp; b</w:t></w:r></w:p>{W.format('x')}</w:document>"},
    "header.docx": {"word/document.xml": W.format("x"), "word/header1.xml": W.format(RRN)},
    "field.docm": {"word/document.xml": f"<w:p><w:instrText>HYPERLINK {RRN}</w:instrText></w:p>"},
    "custom.docx": {"word/document.xml": W.format("x"), "customXml/item1.xml": f"<r><v>{RRN}</v></r>"},
    "core.docx": {"word/document.xml": W.format("x"), "docProps/core.xml": f"<cp><dc:creator>{RRN}</dc:creator></cp>"},
    "rels.docx": {"word/document.xml": W.format("x"), "word/_rels/document.xml.rels": f'<R><Relationship Id="1" Target="http://x/{RRN}"/></R>'},
    "shared.xlsx": {**BOOK, "xl/sharedStrings.xml": f"<sst><si><r><t>9001</t></r><r><t>01-1234568</t></r></si></sst>"},
    "cell.xlsm": {**BOOK, "xl/worksheets/sheet1.xml": "<c r='A1' t='inlineStr'><is><t>" + RRN + "</t></is></c><c r='A2'><v>4111111111111111</v></c>"},
    "head.xlsx": {**BOOK, "xl/worksheets/sheet1.xml": f"<oddHeader></oddHeader><oddFooter>&amp;C {RRN}</oddFooter>"},
    "link.xlsx": {**BOOK, "xl/worksheets/sheet1.xml": f'<hyperlink display="{RRN}" tooltip="{MAIL}" location="{BIZ}"/>'},
    "sheet.xlsx": {"xl/workbook.xml": f'<sheet name="{RRN}"/><definedName name="{BIZ}">{MAIL}</definedName>'},
    "conn.xlsx": {**BOOK, "xl/connections.xml": f'<connection name="{RRN}" description="{BIZ}"><dbPr connection="u={MAIL}"/></connection>'},
    "comment.xlsx": {**BOOK, "xl/comments1.xml": f"<comments><commentList><comment ref='A1'><text><t>{RRN}</t></text></comment></commentList></comments>"},
    "table.xlsx": {**BOOK, "xl/tables/table1.xml": f'<table displayName="{BIZ}"><tableColumn name="{RRN}"/></table>'},
    "pivot.xlsx": {**BOOK, "xl/pivotCache/def1.xml": f'<sharedItems><s v="{RRN}"/></sharedItems>'},
    "drawing.xlsx": {**BOOK, "xl/drawings/drawing1.xml": A.format(RRN), "xl/charts/chart1.xml": A.format(MAIL)},
    "slide.pptx": {**SHOW, "ppt/slides/slide1.xml": A.format(RRN), "ppt/notesSlides/notesSlide1.xml": A.format(MAIL), "ppt/slideMasters/slideMaster1.xml": A.format(BIZ), "ppt/comments/comment1.xml": f"<c><p>{CARD}</p></c>"},
    "text.odt": {"content.xml": f"<t>{RRN}</t>", "META-INF/manifest.xml": "<m/>", "styles.xml": f"<h>{MAIL}</h>"},
    "table.ods": {"content.xml": f"<t>{RRN}</t>", "META-INF/manifest.xml": "<m/>"},
    "book.epub": {"META-INF/container.xml": "<c/>", "OPS/ch1.xhtml": f"<p>{RRN}</p>", "OPS/c.opf": f"<dc:creator>{MAIL}</dc:creator>"},
    "doc.hwpx": {"mimetype": "application/hwp+zip", "Contents/section0.xml": f"<hp:p><hp:run><hp:t>{RRN}</hp:t></hp:run></hp:p>"},
}
TEXTS = {
    "a.txt": f"계약자 {RRN}\r\nx\r\n".encode(),
    "a.md": f"﻿{RRN}".encode(),
    "le.txt": b"\xff\xfe" + f"{RRN}\n".encode("utf-16-le"),
    "be.txt": b"\xfe\xff" + f"{RRN}\n".encode("utf-16-be"),
    "kr.txt": f"번호 {RRN} 끝".encode("cp949"),
    "q.csv": f'이름,"메모\n{RRN}"\n"a ""b""",c\n'.encode(),
    "q.tsv": f'x\t"{RRN}\n"\n'.encode(),
    "o.json": f'{{"a\\"": "{RRN}", "n": 4111111111111111}}\n'.encode(),
    "noname": RRN.encode(),
}


def hwp5(section, preview=""):
    """A compound file with a header, one deflated section and a preview, in 512-byte sectors."""
    packer = zlib.compressobj(wbits=-15)
    body = packer.compress(section) + packer.flush()
    streams = [("FileHeader", hwp.SIGNATURE.ljust(36, b"\0") + struct.pack("<I", 1) + bytes(4096)), ("PrvText", preview.encode("utf-16-le").ljust(4096, b"\0")), ("Section0", body.ljust(4096, b"\0"))]
    sectors, fat, starts = [], [], {}
    for name, data in streams:
        n = -(-len(data) // 512)
        starts[name] = len(sectors)
        fat += [len(sectors) + i + 1 for i in range(n - 1)] + [0xFFFFFFFE]
        sectors += [data[i * 512 : (i + 1) * 512].ljust(512, b"\0") for i in range(n)]

    def entry(name, kind, left, right, child, start, size):
        raw = name.encode("utf-16-le")
        return raw.ljust(64, b"\0") + struct.pack("<HBBIII", len(raw) + 2, kind, 1, left, right, child) + bytes(36) + struct.pack("<IQ", start, size)

    none = 0xFFFFFFFF
    table = entry("Root Entry", 5, none, none, 2, 0xFFFFFFFE, 0) + entry("FileHeader", 2, none, none, none, starts["FileHeader"], len(streams[0][1])) + entry("BodyText", 1, 1, 3, 4, 0, 0) + entry("PrvText", 2, none, none, none, starts["PrvText"], 4096) + entry("Section0", 2, none, none, none, starts["Section0"], 4096)
    first_dir = len(sectors)
    n = -(-len(table) // 512)
    fat += [first_dir + i + 1 for i in range(n - 1)] + [0xFFFFFFFE]
    sectors += [table[i * 512 : (i + 1) * 512].ljust(512, b"\0") for i in range(n)]
    fat.append(0xFFFFFFFD)
    head = hwp.MAGIC + bytes(16) + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + bytes(10) + struct.pack("<IIIIIIII", 1, first_dir, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0)
    head += struct.pack("<I", len(sectors)) + struct.pack("<I", none) * 108
    return head.ljust(512, b"\0") + b"".join(sectors) + struct.pack(f"<{len(fat)}I", *fat).ljust(512, b"\xff")


def hwp_paragraph(line):
    data = line.encode("utf-16-le") + b"\r\0"
    return struct.pack("<I", hwp.PARA_TEXT | len(data) << 20) + data


ALL = {**{n: d for n, (d, _) in PDFS.items()}, **{n: zipped(p) for n, p in ZIPS.items()}, **TEXTS, "p.hwp": hwp5(hwp_paragraph(f"번호 {RRN}") + hwp_paragraph("x"), f"미리보기 {MAIL}")}


@pytest.fixture(scope="module")
def results(spark):
    df = spark.createDataFrame([*ALL.items(), ("bad.pdf", b"zzz"), ("other.zip", zipped({"x": RRN})), ("bad.docx", b"PK\3\4zzzz")], "filename string, content binary").repartition(4)
    made = process(df, Config(mode="full")).cache()
    return made, {r.filename: r for r in made.collect()}


def test_every_format_is_found_and_cleaned(results):
    for name in ALL:
        r = results[1][name]
        assert r.error is None and r.confirmed >= 1 and r.residual_confirmed == 0, (name, r.error, r.confirmed, r.residual_confirmed)
        again = extract(r.output_name, bytes(r.masked))
        assert not any(v in t for v in (RRN, CARD, BIZ, MAIL) for t in again["paragraphs"]), name


def test_pdf_surfaces(results):
    for name, (_, expected) in PDFS.items():
        r = results[1][name]
        assert {f.raw for f in r.findings} >= expected, name
        assert r.format == "pdf" and r.output_name == name.replace(".pdf", ".txt") and r.fallback_note
    assert pdf.extract(page_pdf(b" "))[1] == [pdf.WARN_NO_TEXT]
    twice = [t for _, t in pdf.extract(PDFS["script.pdf"][0])[0] if RRN in t]
    assert len(twice) == 2 and len([t for _, t in pdf.extract(PDFS["script.pdf"][0], dedupe=True)[0] if RRN in t]) == 1


def test_zip_surfaces(results):
    for name, parts in ZIPS.items():
        r = results[1][name]
        present = [v for v in (BIZ, MAIL, CARD) if v in json.dumps(parts)]
        assert {f.raw for f in r.findings} >= set(present), name
        with zipfile.ZipFile(io.BytesIO(bytes(r.masked))) as out:
            assert out.namelist() == list(parts) and out.testzip() is None
            body = b"".join(out.read(n) for n in parts).decode()
        assert not any(v in body for v in (RRN, BIZ, MAIL, CARD)), name


def test_runs_are_kept_where_nothing_changed():
    data = zipped({"word/document.xml": f"<w:p><w:t>a</w:t><w:t>b</w:t></w:p><w:p><w:t>{RRN}</w:t><w:t>!</w:t></w:p>"})
    assert containers.extract("docx", data) == [("word/document.xml", "ab"), ("word/document.xml", RRN + "!")]
    out = containers.read_parts(containers.rewrite("docx", data, ["ab", "<&>"]))
    assert out[0][1] == b"<w:p><w:t>a</w:t><w:t>b</w:t></w:p><w:p><w:t>&lt;&amp;&gt;</w:t><w:t></w:t></w:p>"
    with pytest.raises(ValueError):
        containers.rewrite("docx", data, ["ab", "c", "d"])


def test_paragraphs_within_paragraphs():
    data = zipped({"word/document.xml": "<w:p w:id='1'><w:t>a</w:t><w:txbxContent><w:p><w:t>b</w:t></w:p><w:p/></w:txbxContent><w:t>c</w:t></w:p><w:pPr/><w:p><w:t/></w:p>"})
    assert [t for _, t in containers.extract("docx", data)] == ["ac", "b", ""]
    out = containers.read_parts(containers.rewrite("docx", data, ["X", "Y", ""]))[0][1]
    assert out == b"<w:p w:id='1'><w:t>X</w:t><w:txbxContent><w:p><w:t>Y</w:t></w:p><w:p/></w:txbxContent><w:t></w:t></w:p><w:pPr/><w:p><w:t/></w:p>"


def test_shared_string_index_is_no_number():
    data = zipped({**BOOK, "xl/worksheets/sheet1.xml": "<c t=\"s\"><v>4111111111111111</v></c><c><v>5</v></c>"})
    assert [t for _, t in containers.extract("xlsx", data)] == ["5"]


def test_text_files_keep_encoding_and_layout(results):
    star = "******-*******"
    done = {n: bytes(results[1][n].masked) for n in TEXTS}
    assert done["a.txt"] == f"계약자 {star}\r\nx\r\n".encode() and done["a.md"] == f"﻿{star}".encode()
    assert done["le.txt"] == b"\xff\xfe" + f"{star}\n".encode("utf-16-le") and done["be.txt"] == b"\xfe\xff" + f"{star}\n".encode("utf-16-be")
    assert done["kr.txt"] == f"번호 {star} 끝".encode("cp949") and results[1]["kr.txt"].warnings == [text.WARN_KR]
    assert done["q.csv"].decode() == f'이름,"메모\n{star}"\n"a ""b""",c\n' and results[1]["q.csv"].paragraph_count == 3
    assert json.loads(done["o.json"]) == {'a"': star, "n": "*" * 16}


def test_unknown_and_broken(results):
    by = results[1]
    assert by["bad.pdf"].error and by["bad.docx"].error and bytes(by["bad.pdf"].masked) == b"zzz"
    assert by["other.zip"].format == "unknown" and len(by["other.zip"].warnings) == 3 and by["other.zip"].paragraph_count == 0


def test_fail_fast(spark):
    df = spark.createDataFrame([("bad.pdf", b"zzz")], "filename string, content binary")
    with pytest.raises(Exception, match="not a PDF"):
        process(df, Config(fail=True)).collect()


def test_without_masking(spark):
    df = spark.createDataFrame([("a.txt", RRN.encode())], "filename string, content binary")
    r = process(df, Config(mask=False)).first()
    assert r.confirmed == 1 and r.masked is None and r.diffs == [] and r.residual_confirmed == 0


def test_reports_and_bundle(results):
    made = results[0].filter("filename in ('a.txt', 'q.csv', 'other.zip')")
    rows = reports.csv_report(made).splitlines()
    assert rows[0] == ",".join(reports.COLUMNS) and rows[1] == "a.txt,resident_id,주민등록번호,1,1,0,0,0,0,계약자 ******-*******" and rows[2] == "other.zip,,,0,0,0,0,0,0,"
    files = json.loads(reports.json_report(made))["files"]
    assert [f["filename"] for f in files] == ["a.txt", "other.zip", "q.csv"] and files[0]["findings"][0]["raw"] == RRN
    page = reports.html_report(made)
    again = reports.from_json_report(made.sparkSession, reports.json_report(made))
    assert reports.csv_report(again) == reports.csv_report(made) and reports.html_report(again) == page
    assert "<h1>a.txt" in page and "탐지 없음" in page and "<del>계약자" in page
    with zipfile.ZipFile(io.BytesIO(sinks.zip_masked(made))) as out:
        assert sorted(out.namelist()) == ["a.txt", "other.zip", "q.csv"]
    assert zipfile.ZipFile(io.BytesIO(containers.bundle([("a.b", b"1"), ("a.b", b"2")]))).namelist() == ["a.b", "a (2).b"]


def test_files_under_their_names(spark, tmp_path):
    rows = [("a.txt", bytearray(b"1")), ("x/a.txt", bytearray(b"2")), ("b.docx", bytearray(b"3")), ("c", None), ("b.docx", bytearray(b"4")), ("b.docx", bytearray(b"3"))]
    df = spark.createDataFrame(rows, "output_name string, masked binary").withColumn("filename", F.lit("x"))
    assert sinks.write_files(df.limit(1), f"file://{tmp_path}/one") == 1 and (tmp_path / "one" / "a.txt").read_bytes() == b"1"
    assert sinks.write_files(df, str(tmp_path / "all"), numbered=True) == 5
    assert sorted(f.name for f in (tmp_path / "all").iterdir()) == ["a (2).txt", "a.txt", "b (2).docx", "b (3).docx", "b.docx"]
    assert sinks.write_files(df.limit(0), str(tmp_path / "none")) == 0


def test_hwp5_rewrite():
    control = struct.pack("<8H", 11, 1, 2, 3, 4, 5, 6, 11)
    text = f"가 {RRN}".encode("utf-16-le") + control + "끝😀\r".encode("utf-16-le")
    n = len(text) // 2
    record = hwp._record
    section = record(hwp.PARA_HEADER, struct.pack("<I", n) + bytes(18)) + record(hwp.PARA_TEXT, text) + record(hwp.PARA_SHAPE, struct.pack("<4I", 0, 7, n - 4, 8)) + record(99, b"z" * 5000)
    data = hwp5(section, f"{RRN} 미리")
    assert [t for _, t in hwp.extract(data)[0]] == [f"가 {RRN}끝😀", f"{RRN} 미리"]
    for new in ("가 ******-*******끝😀", "가 [주민번호]끝😀", "가 끝😀", "다른 글", "", f"가 {RRN}끝😀!" + "x" * 3000):
        out = hwp.rewrite(data, [new, "p"])
        assert [t for _, t in hwp.extract(out)[0]] == [new, "p"] and hwp.is_hwp5(out)
        rows = list(hwp.records(zlib.decompressobj(-15).decompress(hwp.CompoundFile(out).read("BodyText/Section0"))))
        assert struct.unpack_from("<I", rows[0][1])[0] == len(rows[1][1]) // 2 and control in rows[1][1] and rows[3] == (99, b"z" * 5000)
        first, _, second, shape = struct.unpack("<4I", rows[2][1])
        assert first == 0 and second <= len(rows[1][1]) // 2 and shape == 8
    assert hwp.CompoundFile(hwp.rewrite(data, ["a", "b"])).read("FileHeader") == hwp.CompoundFile(data).read("FileHeader")
    big = hwp.CompoundFile(data).write({"PrvText": bytes(range(256)) * 40_000})
    assert hwp.CompoundFile(big).read("PrvText") == bytes(range(256)) * 40_000 and len(big) > 10_000_000
    with pytest.raises(ValueError):
        hwp.rewrite(data, ["a", "b", "c"])


def test_sniff():
    expected = {"a.tsv": "csv", "a.LOG": "txt", "a.xyz": "txt", "x.pdf": "pdf", "dir.v1/readme": "txt", "a.hwp": "hwp"}
    assert {n: sniff(n, b"hello") for n in expected} == expected
    assert sniff("a.txt", zipped({"x": ""})) == "unknown" and sniff("a.dotx", zipped({"x": ""})) == "docx" and sniff("a.ots", zipped({"x": ""})) == "ods"
    assert sniff("a.bin", b"%PDF-") == "pdf" and sniff("a.txt", hwp.MAGIC3 + b"..") == "hwp3" and sniff("a.bin", ALL["p.hwp"]) == "hwp"


def test_decode_encode():
    for raw in (b"", b"abc", "가﻿".encode(), "힣똠방각하".encode("cp949"), b"\xff\xfe\x41\x00"):
        decoded, _, encoding = text.decode(raw)
        assert text.encode(decoded, encoding) == raw
    assert text.decode(b"\xff\xffa")[1] == text.WARN_KR_LOSSY and text.encode("가😀", text.EUC_KR) == "가".encode("cp949") + b"&#128512;"


def test_csv_records():
    assert text.csv_records('a,"b\r\nc"\r\nd\n') == [(0, 'a,"b\r\nc"'), (10, "d"), (12, "")]
    assert text.csv_records('x\n"y\nz') == [(0, "x"), (2, '"y\nz')] and text.csv_records("") == [(0, "")]


def test_read_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name, data in (("d/a.txt", TEXTS["a.txt"]), ("b.docx", ALL["body.docx"])):
        (tmp_path / name).write_bytes(data)
    files = read_files(spark, str(tmp_path))
    assert sorted(r.filename for r in files.collect()) == ["a.txt", "b.docx"]
    rows = file_paragraphs(files, ["filename"]).collect()
    assert sorted((r.filename, r.paragraph_index, r.text) for r in rows)[0] == ("a.txt", 0, f"계약자 {RRN}") and len(rows) == 5
    sinks.write_masked(process(files), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_pdf_without_silent_cuts(monkeypatch):
    """Links under any key, name trees of any size, and a warning for what could not be decoded."""
    shown = lambda data: [t for _, t in pdf.extract(data)[0] if t.strip()]
    uri = b"<</S/URI/URI(mailto:" + MAIL.encode() + b")>>"
    for more, catalog in (({}, b"/OpenAction" + uri), ({5: b"<</S/GoTo/Next" + uri + b">>"}, b""), ({5: b"<</PA[" + uri + b"]>>"}, b"")):
        assert shown(page_pdf(b" ", more=more, catalog=catalog)) == ["mailto:" + MAIL]
    many = {i: b"<</Names[(d%d)[3 0 R]]>>" % i for i in range(20, 5020)}
    kids = b" ".join(b"%d 0 R" % i for i in [*many, 11])
    assert shown(page_pdf(b" ", more={**many, 11: b"<</Kids[" + kids + b"]>>"}, catalog=b"/Names<</Dests 11 0 R>>")) == [f"d{i}" for i in many]
    lzw = page_pdf(b"BT (x) Tj ET", b"/Resources<</XObject<</F 5 0 R>>>>", {5: b"<</Subtype/Form/Filter/LZWDecode/Length 1>>stream\nx\nendstream "})
    assert pdf.extract(lzw)[1] == [pdf.WARN_FILTER + "LZWDecode"]
    form = PDFS["form.pdf"][0]
    assert pdf.extract(form)[1] == []
    monkeypatch.setattr(pdf, "MAX_STREAM", 5)
    assert pdf.WARN_PART in pdf.extract(form)[1]


def test_a_worker_holds_few_results_at_once(spark):
    """What is made of short rows may be large: it goes back in pieces, not as one array for a batch of thousands of rows."""
    from haetae.operators.arrow import struct_of

    class Held(bytes):
        alive = 0

        def __new__(cls, value):
            cls.alive += 1
            return super().__new__(cls, value)

        def __del__(self):
            type(self).alive -= 1

    make = lambda i: {"content": Held(bytes(2_000)), "alive": Held.alive}
    made = spark.range(0, 3_000, 1, 1).select("id", struct_of("content binary, alive int", make, F.when(F.col("id") != 7, F.col("id"))).alias("x"))
    rows = made.select("id", "x.alive", F.length("x.content").alias("n")).collect()
    assert [r["id"] for r in rows] == list(range(3_000)) and [r["n"] for r in rows] == [None if i == 7 else 2_000 for i in range(3_000)]
    assert max(r["alive"] for r in rows if r["n"]) <= 512


def test_an_archive_is_opened_once_to_be_read(monkeypatch):
    opened = []
    real = zipfile.ZipFile

    class Counted(real):
        def __init__(self, *args, **more):
            opened.append(args)
            super().__init__(*args, **more)

    data = zipped({"ppt/presentation.xml": "<p/>", "ppt/slides/slide1.xml": "<a:p><a:r><a:t>x</a:t></a:r></a:p>"})
    monkeypatch.setattr(zipfile, "ZipFile", Counted)
    assert extract("a.pptx", data)["paragraphs"] == ["x"] and len(opened) == 1


def test_parts_are_those_that_the_library_reads():
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as archive:
        for i, method in enumerate((zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2, zipfile.ZIP_LZMA)):
            archive.writestr(zipfile.ZipInfo(f"부분{i}/"), b"")
            archive.writestr(f"부분{i}/x", b"text" * i * 50, method)
        archive.writestr("last", b"")
    data = made.getvalue()
    for whole in (data, b"before" + data):
        archive = zipfile.ZipFile(io.BytesIO(whole))
        assert containers.read_parts(whole) == [(i.filename, archive.read(i)) for i in archive.infolist() if not i.is_dir()]
    for at in range(0, len(data), 3):  # one byte changed: the same parts or an error like the library's
        broken = data[:at] + bytes([data[at] ^ 0x15]) + data[at + 1 :]
        try:
            archive = zipfile.ZipFile(io.BytesIO(broken))
            expected = [(i.filename, archive.read(i)) for i in archive.infolist() if not i.is_dir()]
        except Exception as error:  # noqa: BLE001
            with pytest.raises(type(error)):
                containers.read_parts(broken)
        else:
            assert containers.read_parts(broken) == expected
