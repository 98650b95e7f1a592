"""Files of any supported format as rows: what a file is, its paragraphs, and where they stand."""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haetae.functions.escapes import json_spans
from haetae.operators.arrow import struct_of
from haetae.operators.once import once
from haetae.operators.pieces import let, pinned, pinned_fields, replaced
from haetae.sources import containers, hwp, pdf, text

UNKNOWN = "unknown"
#: Extensions that decide where the content doesn't. Fixed values.
EXTENSIONS = {
    "json": "json", "csv": "csv", "tsv": "csv", "txt": "txt", "text": "txt", "log": "txt", "md": "txt", "hwp": "hwp", "hwpx": "hwpx", "hwp3": "hwp3", "pdf": "pdf",
    "docx": "docx", "docm": "docx", "dotx": "docx", "dotm": "docx", "xlsx": "xlsx", "xlsm": "xlsx", "xltx": "xlsx", "xltm": "xlsx", "pptx": "pptx", "pptm": "pptx", "potx": "pptx", "potm": "pptx",
    "odt": "odt", "ott": "odt", "ods": "ods", "ots": "ods", "epub": "epub",
}
#: Messages about files. Fixed values.
NOTE_FAILED, NOTE_PDF, NOTE_UNKNOWN = "원 포맷 재작성에 실패하여 TXT로 대체했습니다", "PDF 텍스트 레이어 재작성은 지원하지 않아 TXT로 대체 출력합니다.", "지원하지 않는 형식이라 원본을 그대로 둡니다."
WARN_UNKNOWN, WARN_ARCHIVE = "지원하지 않는 형식입니다", "ZIP 컨테이너이지만 지원하는 문서가 아닙니다."
TEXTS, ZIPS = ("txt", "csv", "json"), ("docx", "xlsx", "pptx", "odt", "ods", "epub", "hwpx")
EXTRACTED = "format string, paragraphs array<string>, places array<string>, offsets array<int>, warnings array<string>, encoding string, error string"
REWRITTEN = "content binary, name string, note string"
#: Files and bytes of a batch of files that are read by name, at most (or one file).
_FILES, _BYTES = 256, 4 << 20


def extension(name: str) -> str:
    base = name.replace("\\", "/").rpartition("/")[2]
    return base.rpartition(".")[2].lower() if "." in base else ""


def sniff(name: str, data: bytes, listed: set[str] | None = None) -> str:
    """The format by content first, then by extension; plain text where neither tells, unknown for other archives.

    ``listed`` are an archive's names, if they were read already.
    """
    ext = extension(name)
    by_name = EXTENSIONS.get(ext)
    if hwp.is_hwp5(data):
        return "hwp"
    if data.startswith(hwp.MAGIC3):
        return "hwp3"
    if data.startswith(b"%PDF"):
        return "pdf"
    if len(data) < 4 or data[:2] != b"PK":
        return by_name or "txt"
    names = containers.names_in(data) if listed is None else listed
    if "Contents/section0.xml" in names or "Contents/content.hpf" in names:
        return "hwpx"
    for kind, marks in (("docx", ("word/document.xml",)), ("xlsx", ("xl/workbook.xml", "xl/sharedStrings.xml")), ("pptx", ("ppt/presentation.xml", "ppt/slides/slide1.xml"))):
        if names & set(marks):
            return kind
    if by_name in ("hwpx", "docx", "xlsx", "pptx"):
        return by_name
    if {"content.xml", "META-INF/manifest.xml"} <= names:
        return "ods" if by_name == "ods" else "odt"
    if by_name in ("odt", "ods"):
        return by_name
    return "epub" if "META-INF/container.xml" in names or ext == "epub" else UNKNOWN


def extract(name: str, data: bytes) -> dict[str, Any]:
    """Format, paragraphs, place of each (offset in text files, part, page or section else), warnings and encoding."""
    listed = containers.directory(data) if data[:2] == b"PK" and len(data) >= 4 else None
    compound = hwp.opened(data)
    kind = "hwp" if compound else sniff(name, data, {info.filename for info in listed or ()})
    out: dict[str, Any] = {"format": kind, "paragraphs": [], "places": [], "offsets": [], "warnings": [], "encoding": None, "error": None}
    placed: list[tuple[str, str]] = []
    if kind in TEXTS:
        decoded, warning, out["encoding"] = text.decode(data)
        found = text.csv_records(decoded) if kind == "csv" else text.lines(decoded)
        out["offsets"], out["paragraphs"] = [a for a, _ in found], [t for _, t in found]
        out["places"] = [""] * len(found)
        out["warnings"] = [warning] if warning else []
        return out
    if kind == "pdf":
        placed, out["warnings"] = pdf.extract(data)
    elif kind == "hwp":
        placed, out["warnings"] = hwp.extract(data, compound)
    elif kind == "hwp3":
        out["warnings"] = [hwp.WARN_V3]
    elif kind in ZIPS:
        placed = containers.extract(kind, data, listed)
    else:
        out["warnings"] = [f"{WARN_UNKNOWN}: {name}", WARN_ARCHIVE]
    out["places"], out["paragraphs"] = [p for p, _ in placed], [t for _, t in placed]
    return out


def rewrite(name: str, data: bytes, kind: str, encoding: str | None, masked: list[str], changes: list[dict[str, Any]], offsets: list[int]) -> dict[str, Any]:
    """Bytes and name of the masked file, and a note where the format could not be kept.

    ``changes`` (paragraph_index, char_start, char_end, replacement) are written into text files at their place;
    in JSON a value outside quotes gets quotes. Documents get the masked paragraphs. Text files ask for no masked paragraphs, others for no changes and offsets.
    """
    if kind in TEXTS:
        decoded = text.decode(data)[0]
        spans = [(offsets[c["paragraph_index"]] + c["char_start"], offsets[c["paragraph_index"]] + c["char_end"], c["replacement"]) for c in changes]
        return {"content": text.encode(_splice(decoded, sorted(spans), kind == "json"), encoding or text.UTF8), "name": name, "note": None}
    plain = {"content": "\n".join(masked).encode(), "name": f"{name.rpartition('.')[0] or name}.txt"}
    if kind in ZIPS or kind == "hwp":
        try:
            return {"content": hwp.rewrite(data, masked) if kind == "hwp" else containers.rewrite(kind, data, masked), "name": name, "note": None}
        except Exception as error:  # noqa: BLE001  any failure to keep the format gives text and says so
            return {**plain, "note": f"{NOTE_FAILED}: {error}"}
    if kind == "pdf":
        return {**plain, "note": NOTE_PDF}
    return {"content": data, "name": name, "note": NOTE_UNKNOWN}


def _splice(source: str, spans: list[tuple[int, int, str]], json: bool) -> str:
    out, at, inside = [], 0, False
    for a, b, new in spans:
        if a < at:
            continue
        gap = source[at:a]
        if json:
            inside = _in_string(gap, inside)
            new = new.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")
            new = new if inside else f'"{new}"'
            inside_after = _in_string(source[a:b], inside)
        out += [gap, new]
        at = b
        if json:
            inside = inside_after
    return "".join([*out, source[at:]])


def _in_string(piece: str, inside: bool) -> bool:
    """Whether the end of ``piece`` is in a JSON string, given whether its begin is."""
    i = 0
    while i < len(piece):
        if inside and piece[i] == "\\":
            i += 2
            continue
        inside ^= piece[i] == '"'
        i += 1
    return inside


def _kind_by_name(name: Column) -> Column:
    base = F.substring_index(F.replace(name, F.lit("\\"), F.lit("/")), "/", -1)
    ext = F.when(F.contains(base, F.lit(".")), F.lower(F.substring_index(base, ".", -1))).otherwise("")
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair]), ext), F.lit("txt"))


def text_kind(name: Column, content: Column) -> Column:
    """txt, csv or json where ``sniff`` says so and the bytes are valid UTF-8, else null: those files need no Python."""
    kind = _kind_by_name(name)
    starts = lambda mark: F.substring(content, 1, len(mark)) == F.lit(mark)
    other = starts(hwp.MAGIC) | starts(hwp.MAGIC3) | starts(b"%PDF") | (starts(b"PK") & (F.octet_length(content) >= 4))
    return F.when(kind.isin(*TEXTS) & ~other & F.is_valid_utf8(content.cast("string")), kind)


def _marked(content: Column) -> Column:
    return F.substring(content, 1, 3) == F.lit(text.MARKS[0][1])


def _unmarked(content: Column) -> Column:
    """The characters of UTF-8 bytes, without a byte order mark."""
    return F.when(_marked(content), F.substr(content, F.lit(4))).otherwise(content).cast("string")


def _extracted_text(kind: Column, content: Column) -> Column:
    """What ``extract`` gives for valid UTF-8, as an expression."""
    spans = F.when(kind == "csv", text.csv_spans(_unmarked(content))).otherwise(text.line_spans(_unmarked(content)))
    made = lambda s: F.struct(
        kind.alias("format"), F.transform(s, lambda x: x["text"]).alias("paragraphs"), F.transform(s, lambda x: F.lit("")).alias("places"), F.transform(s, lambda x: x["at"]).alias("offsets"),
        F.array().cast("array<string>").alias("warnings"), F.when(_marked(content), text.UTF8_BOM).otherwise(text.UTF8).alias("encoding"), F.lit(None).cast("string").alias("error"),
    )
    return let(spans, made)


def with_extracted(df: DataFrame, out: str, name_col: str, content_col: str, fail: bool = False, text_only: bool = False) -> DataFrame:
    """``df`` with the fields of what ``extract`` finds as columns ``{out}_{field}``; a file that can't be read has an error and no paragraphs, or fails the job.

    Text, CSV and JSON files in UTF-8 are taken apart by expressions; the bytes of others alone go to Python. With ``text_only`` all
    files count as text in UTF-8, CSV or JSON by name, whatever they begin with, and the plan has no Python.
    """

    def run(name: str | None, content: bytes | None) -> dict[str, Any]:
        try:
            return extract(name or "", content or b"")
        except Exception as error:  # noqa: BLE001  a broken file is a row with an error
            if fail:
                raise
            return {"format": UNKNOWN, "paragraphs": [], "places": [], "offsets": [], "warnings": [str(error)], "encoding": None, "error": str(error) or type(error).__name__}

    name, content, kind = F.coalesce(name_col, F.lit("")), F.coalesce(content_col, F.lit(b"")), F.col("__kind__")
    if text_only:
        by_name = once(lambda: F.when(_kind_by_name(name).isin(*TEXTS), _kind_by_name(name)).otherwise("txt"), "kind_by_name", name_col)
        fields = once(lambda: _prefixed(_extracted_text(kind, content).cast(f"struct<{EXTRACTED}>"), EXTRACTED, out), "extracted_text", content_col, out)
        return pinned_fields(pinned(df, "__kind__", by_name), fields).drop("__kind__")
    df = pinned(df, "__kind__", once(lambda: text_kind(name, content), "text_kind", name_col, content_col, text_kind))
    other = struct_of(EXTRACTED, run, F.when(kind.isNull(), name), F.when(kind.isNull(), content))
    df = df.withColumn("__other__", other)
    made = lambda: F.when(kind.isNotNull(), _extracted_text(kind, content).cast(f"struct<{EXTRACTED}>")).otherwise(F.col("__other__"))
    return pinned_fields(df, once(lambda: _prefixed(made(), EXTRACTED, out), "extracted", content_col, out)).drop("__kind__", "__other__")


def _prefixed(made: Column, fields: str, prefix: str) -> Column:
    kinds = ",".join(f"{prefix}_{f.replace(' ', ':', 1)}" for f in fields.split(", "))
    return made.cast(f"struct<{kinds}>")


def with_rewritten(df: DataFrame, out: str, inputs: list[str], text_only: bool = False) -> DataFrame:
    """``df`` with columns ``{out}_content``, ``_name`` and ``_note`` of ``rewrite`` of the columns ``inputs``: name, content, format, encoding, masked, changes, offsets.

    Text, CSV and JSON files in UTF-8 are put together by expressions, as they are taken apart.
    """

    def run(name: str | None, content: bytes | None, *rest: Any) -> dict[str, Any]:
        return rewrite(name or "", content or b"", *rest)

    name, content, kind, encoding, _, changes, offsets = (F.col(c) for c in inputs)
    plain = F.coalesce(kind.isin(*TEXTS) & encoding.isin(text.UTF8, text.UTF8_BOM), F.lit(False))

    def made() -> Column:
        spans = F.transform(changes, lambda c: let(F.get(offsets, c["paragraph_index"]), lambda at: F.struct((at + c["char_start"]).alias("begin"), (at + c["char_end"]).alias("stop"), c["replacement"].alias("new"))))
        spans = F.when(kind == "json", json_spans(_unmarked(content), spans)).otherwise(spans)
        bytes_of = replaced(_unmarked(content), spans).cast("binary")
        marked = F.when(_marked(content), F.concat(F.lit(text.MARKS[0][1]), bytes_of)).otherwise(bytes_of)
        return F.struct(marked.alias("content"), name.alias("name"), F.lit(None).cast("string").alias("note"))

    if text_only:
        return pinned_fields(df, once(lambda: _prefixed(made(), REWRITTEN, out), "rewritten_text", *inputs, out))
    by_place = F.coalesce(kind.isin(*TEXTS), F.lit(False))
    asked = [~plain] * 4 + [~plain & ~by_place] + [~plain & by_place] * 2  # what a file's rewriting doesn't read needn't go to Python
    df = df.withColumn("__other__", struct_of(REWRITTEN, run, *[F.when(a, F.col(c)) for a, c in zip(asked, inputs, strict=True)]))
    fields = once(lambda: _prefixed(F.when(plain, made()).otherwise(F.col("__other__")), REWRITTEN, out), "rewritten", *inputs, out)
    return pinned_fields(df, fields).drop("__other__")


def read_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """path, filename (base name), content and length of every file under ``path``."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), "content", "length")


def read_named(names: DataFrame, folder: str) -> DataFrame:
    """path, filename, content and length of the files in ``folder`` that the column ``name`` names.

    ``read_files`` lists a folder on the driver and makes a task of every few files. Here the tasks of ``names`` read
    what their rows name, by any address that Arrow's file systems know, so many small files cost the driver nothing.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from haetae.sinks.stitch import file_system

        system, base = file_system(folder)
        made = lambda rows: pa.RecordBatch.from_pydict({"path": pa.array([f"{folder.rstrip('/')}/{n}" for n, _ in rows], pa.string()), "filename": pa.array([n for n, _ in rows], pa.string()), "content": pa.array([c for _, c in rows], pa.binary()), "length": pa.array([len(c) for _, c in rows], pa.int64())})
        for batch in batches:
            rows, size = [], 0
            for name in batch.column(0).to_pylist():
                with system.open_input_stream(posixpath.join(base, name)) as source:
                    rows.append((name, source.read()))
                size += len(rows[-1][1])
                if len(rows) >= _FILES or size >= _BYTES:
                    yield made(rows)
                    rows, size = [], 0
            yield made(rows)

    return names.select("name").mapInArrow(read, "path string, filename string, content binary, length long")


def file_paragraphs(files: DataFrame, keys: list[str], name_col: str = "filename", content_col: str = "content") -> DataFrame:
    """``keys``, format, paragraph_index, place and text of every paragraph."""
    made = with_extracted(files.select(*keys, F.col(name_col).alias("__name__"), F.col(content_col).alias("__content__")), "x", "__name__", "__content__")
    pairs = F.arrays_zip(F.col("x_paragraphs").alias("text"), F.col("x_places").alias("place"))
    return made.select(*keys, F.col("x_format").alias("format"), F.posexplode(pairs).alias("paragraph_index", "p")).select(*keys, "format", "paragraph_index", "p.place", "p.text")
