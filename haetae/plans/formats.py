"""Round trips of every file format: a customer's lines over all places of a file that hold text, masked, written, and read again."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haetae.operators.arrow import add_struct
from haetae.plans.process import Config, process
from haetae.sources import hwp
from haetae.sources.containers import write_parts
from haetae.sources.xml_slots import escape


def _archive(parts: dict[str, str]) -> bytes:
    return write_parts([(name, xml.encode()) for name, xml in parts.items()])


def _each(form: str, lines: Sequence[str]) -> str:
    return "".join(form.format(x) for x in lines)


_WORD, _DRAWN = "<w:p><w:r><w:t>{}</w:t></w:r></w:p>", "<a:p><a:r><a:t>{}</a:t></a:r></a:p>"


def docx(x: list[str]) -> bytes:
    return _archive({
        "word/document.xml": f"<w:document><w:body>{_each(_WORD, x[:5])}<w:p><w:instrText>{x[5]}</w:instrText></w:p></w:body></w:document>",
        "word/header1.xml": _each(_WORD, x[6:7]), "word/footnotes.xml": _each(_WORD, x[7:8]), "customXml/item1.xml": f"<r><v>{x[8]}</v></r>",
        "docProps/core.xml": f"<cp><dc:title>{x[9]}</dc:title><dc:creator>{x[10]}</dc:creator></cp>", "word/_rels/document.xml.rels": f'<Relationships><Relationship Id="r" Target="{x[11]}"/></Relationships>',
    })


def xlsx(x: list[str]) -> bytes:
    return _archive({
        "xl/workbook.xml": f'<workbook><sheets><sheet name="{x[0]}"/></sheets></workbook>', "xl/sharedStrings.xml": f"<sst><si><t>{x[1]}</t></si></sst>",
        "xl/worksheets/sheet1.xml": f'<worksheet><c r="A1" t="inlineStr"><is><t>{x[2]}</t></is></c><hyperlink display="{x[3]}"/><oddHeader>{x[4]}</oddHeader></worksheet>',
        "xl/connections.xml": f'<connections><connection name="{x[5]}"/></connections>', "xl/comments1.xml": f"<comments><comment><text><t>{x[6]}</t></text></comment></comments>",
        "xl/tables/table1.xml": f'<table displayName="{x[7]}"/>', "xl/pivotCache/pivotCacheDefinition1.xml": f'<sharedItems><s v="{x[8]}"/></sharedItems>',
        "xl/drawings/drawing1.xml": _each(_DRAWN, x[9:10]), "xl/charts/chart1.xml": _each(_DRAWN, x[10:11]), "docProps/app.xml": f"<Properties><Company>{x[11]}</Company></Properties>",
    })


def pptx(x: list[str]) -> bytes:
    return _archive({
        "ppt/presentation.xml": "<p/>", "ppt/slides/slide1.xml": _each(_DRAWN, x[:6]), "ppt/slides/slide2.xml": _each(_DRAWN, x[6:7]), "ppt/notesSlides/notesSlide1.xml": _each(_DRAWN, x[7:8]),
        "ppt/slideMasters/slideMaster1.xml": _each(_DRAWN, x[8:9]), "ppt/slideLayouts/slideLayout1.xml": _each(_DRAWN, x[9:10]), "ppt/comments/comment1.xml": f"<c><p>{x[10]}</p></c>", "docProps/core.xml": f"<cp><dc:subject>{x[11]}</dc:subject></cp>",
    })


def open_document(x: list[str]) -> bytes:
    return _archive({"META-INF/manifest.xml": "<m/>", "content.xml": f"<c>{_each('<p>{}</p>', x[:9])}</c>", "styles.xml": f"<s><h>{x[9]}</h></s>", "meta.xml": f"<m><t>{x[10]}</t><t>{x[11]}</t></m>"})


def epub(x: list[str]) -> bytes:
    return _archive({"mimetype": "application/epub+zip", "META-INF/container.xml": "<c/>", "OPS/one.xhtml": f"<body>{_each('<p>{}</p>', x[:6])}</body>", "OPS/two.html": f"<body>{_each('<p>{}</p>', x[6:11])}</body>", "OPS/book.opf": f"<dc:title>{x[11]}</dc:title>"})


def hwpx(x: list[str]) -> bytes:
    form = "<hp:p><hp:run><hp:t>{}</hp:t></hp:run></hp:p>"
    return _archive({"mimetype": "application/hwp+zip", "Contents/section0.xml": f"<s>{_each(form, x[:6])}</s>", "Contents/section1.xml": f"<s>{_each(form, x[6:10])}</s>", "Contents/header.xml": f"<h>{_each(form, x[10:11])}</h>", "Contents/content.hpf": f"<opf:title>{x[11]}</opf:title>"})


def hwp5(x: list[str]) -> bytes:
    """A compound file of 512-byte sectors: header, one deflated section of paragraphs, preview text."""
    sector, none, last = 512, 0xFFFFFFFF, 0xFFFFFFFE
    records = b"".join(struct.pack("<I", hwp.PARA_TEXT | len(data) << 20) + data for line in x[:11] if (data := line.encode("utf-16-le") + b"\r\0"))
    pack = zlib.compressobj(wbits=-15)
    streams = {"FileHeader": hwp.SIGNATURE.ljust(36, b"\0") + struct.pack("<I", 1), "PrvText": x[11].encode("utf-16-le"), "Section0": pack.compress(records) + pack.flush()}
    body, chain, begins = b"", [], {}

    def add(name: str, data: bytes) -> None:
        nonlocal body
        begins[name], n = len(chain), -(-len(data) // sector)
        chain.extend([*range(len(chain) + 1, len(chain) + n), last])
        body += data.ljust(n * sector, b"\0")

    for name, data in streams.items():
        add(name, data.ljust(4096, b"\0"))  # shorter ones would go to small sectors

    def entry(name: str, kind: int, left: int, right: int, child: int) -> bytes:
        raw = name.encode("utf-16-le")
        return raw.ljust(64, b"\0") + struct.pack("<HBBIII", len(raw) + 2, kind, 1, left, right, child) + bytes(36) + struct.pack("<IQ", begins.get(name, last), max(4096, len(streams[name])) if name in streams else 0)

    add("tree", entry("Root Entry", 5, none, none, 2) + entry("FileHeader", 2, none, none, none) + entry("BodyText", 1, 1, 3, 4) + entry("PrvText", 2, none, none, none) + entry("Section0", 2, none, none, none))
    chain.append(0xFFFFFFFD)
    head = hwp.MAGIC + bytes(16) + struct.pack("<5H", 62, 3, 0xFFFE, 9, 6) + bytes(10) + struct.pack("<8I", 1, begins["tree"], 0, 4096, last, 0, last, 0) + struct.pack("<109I", len(chain) - 1, *[none] * 108)
    return head + body + struct.pack(f"<{len(chain)}I", *chain).ljust(sector, b"\xff")


def pdf(x: list[str]) -> bytes:
    """Lines on the page, in a form, and in each of the other places that hold text."""
    shown = lambda line: b"BT (" + line.encode() + b") Tj ET"
    text = lambda line: b"(" + line.encode() + b")"
    page, form = b"BT " + b" 0 -12 Td ".join(text(line) + b" Tj" for line in x[:3]) + b" ET", zlib.compress(shown(x[3]))
    objects = [
        b"<</Type/Catalog/Pages 2 0 R/Outlines 6 0 R/Names<</Dests 8 0 R>>>>", b"<</Type/Pages/Kids[3 0 R]/Count 1>>", b"<</Type/Page/Contents 4 0 R/Resources<</XObject<</F 5 0 R>>>>>>",
        b"<</Length %d>>stream\n%s\nendstream" % (len(page), page), b"<</Subtype/Form/Filter/FlateDecode/Length %d>>stream\n%s\nendstream" % (len(form), form),
        b"<</First 7 0 R>>", b"<</Title" + text(x[4]) + b">>", b"<</Names[" + text(x[5]) + b" [3 0 R]]>>", b"<</Title<" + b"\xfe\xff".hex().encode() + x[6].encode("utf-16-be").hex().encode() + b">>>",
        b"<</Type/Annot/Subtype/Text/Contents" + text(x[7]) + b">>", b"<</S/JavaScript/JS" + text(x[8]) + b">>", b"<</Type/F/Desc" + text(x[9]) + b">>", b"<</PA<</S/URI/URI" + text(x[10]) + b">>>>", b"<</Type/StructElem/Alt" + text(x[11]) + b">>",
    ]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj%s endobj\n" % (i, o) for i, o in enumerate(objects, 1)) + b"trailer<</Root 1 0 R/Info 9 0 R>>\n%%EOF"


#: For each query: format, extension, the file of some lines, whether these are escaped for XML.
BUILDERS: dict[str, tuple[str, str, Callable[[list[str]], bytes], bool]] = {
    "docx": ("docx", "docx", docx, True),
    "xlsx": ("xlsx", "xlsx", xlsx, True),
    "pptx": ("pptx", "pptx", pptx, True),
    "odt": ("odt", "odt", open_document, True),
    "ods": ("ods", "ods", open_document, True),
    "epub": ("epub", "epub", epub, True),
    "hwpx": ("hwpx", "hwpx", hwpx, True),
    "hwp": ("hwp", "hwp", hwp5, False),
    "pdf": ("pdf", "pdf", pdf, False),
    "json": ("json", "json", lambda x: ("[\n" + ",\n".join(f'"{line}"' for line in x) + "\n]").encode(), False),
    "csv": ("csv", "csv", lambda x: "\n".join(f'"{a}\n{b}",x' for a, b in zip(x[::2], x[1::2])).encode(), False),
    "utf8_mark": ("txt", "txt", lambda x: b"\xef\xbb\xbf" + "\r\n".join(x).encode(), False),
    "utf16_le": ("txt", "txt", lambda x: b"\xff\xfe" + "\n".join(x).encode("utf-16-le"), False),
    "utf16_be": ("txt", "log", lambda x: b"\xfe\xff" + "\n".join(x).encode("utf-16-be"), False),
    "cp949": ("txt", "md", lambda x: "\n".join(x).encode("cp949"), False),
}


def round_trip(kind: str, texts: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query of a format: counts before and after masking in full, and a digest of the sorted lines of the written file."""
    extension, build, escaped = BUILDERS[kind][1:]

    def file_of(key: int, content: str) -> dict:
        lines = [escape(line) if escaped else line for line in content.split("\n")]
        return {"filename": f"{key}.{extension}", "content": build(lines)}

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        files = add_struct(texts(spark, sf_dir), "file", ["c_custkey", "text"], "filename string, content binary", file_of).select("c_custkey", "file.filename", "file.content")
        done = process(files, Config(mode="full"), ("c_custkey",), again=True, fields=())
        lines = F.sort_array(F.filter("again_paragraphs", lambda x: x != ""))
        return done.select("c_custkey", "format", "confirmed", "suspicious", "already_masked", "residual_confirmed", "residual_suspicious", "output_name", F.md5(F.array_join(lines, "\n").cast("binary")).alias("lines_md5"))

    return query
