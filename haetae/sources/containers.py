"""Zip containers: office documents, OpenDocument, EPUB and HWPX as lists of texts, and back."""

from __future__ import annotations

import bisect
import functools
import io
import re
import struct
import zipfile
import zlib
from collections.abc import Callable

from haetae.sources import xml_slots as x

#: Limits against archives that unpack to far more than they are.
MAX_PARTS, MAX_BYTES = 20_000, 1 << 30
#: Flags, method and lengths of name and extra field in a part's own header.
_LOCAL = struct.Struct("<HH16xHH")
#: The records of an archive: a part's own header, its entry in the directory, the directory's end.
_PART, _ENTRY, _ENDING = struct.Struct("<4s5H3L2H"), struct.Struct("<4s6H3L5H2L"), struct.Struct("<4s4H2LH")
#: Versions that the library reads, and bytes up to which an archive surely needs no 64-bit records.
_VERSION, _SMALL = 63, 1 << 30

#: Document properties that are read. Fixed values.
PROPERTIES = ("dc:title", "dc:subject", "dc:description", "dc:creator", "cp:lastModifiedBy", "cp:keywords", "dc:identifier", "Application", "Company")
HEADERS = ("oddHeader", "oddFooter", "evenHeader", "evenFooter", "firstHeader", "firstFooter")

_WORD = x.in_order(x.runs("w:p", "w:t"), x.contents("w:instrText"))
_DRAWING = x.runs("a:p", "a:t")
_SHEET = x.in_order(x.cells, x.first_contents(*HEADERS, blank=True), x.attribute("hyperlink", "display"), x.attribute("hyperlink", "tooltip"), x.attribute("hyperlink", "location"))
_BOOK = x.in_order(x.attribute("sheet", "name"), x.attribute("definedName", "name"), x.contents("definedName"))
_CONNECTIONS = x.in_order(x.attribute("connection", "name"), x.attribute("connection", "description"), x.attribute("dbPr", "connection"))
_TABLE = x.by_place(x.attribute("table", "displayName"), x.attribute("tableColumn", "name"))
_TARGETS, _PROPERTIES, _PIVOT = x.attribute("Relationship", "Target"), x.first_contents(*PROPERTIES), x.attribute("s", "v")
_DRAWN = r"(ppt/(slides|notesSlides|slideMasters|slideLayouts)|xl/(drawings|charts))/(?!.*/?_rels/).*\.xml"

#: For each format: (pattern of the part's name, how its texts are found, place of such parts in the order of reading).
Kind = tuple[str, x.Finder, int]
_COMMON: list[Kind] = [(r"docProps/(core|app|custom)\.xml", _PROPERTIES, 8), (r".*_rels.*\.rels", _TARGETS, 9)]
KINDS: dict[str, list[Kind]] = {
    "docx": [(r"word/document\.xml", _WORD, 0), (r"word/(?!.*_rels/)(?!.*itemProps).*\.xml", _WORD, 1), (r"customXml/(?!.*_rels/)(?!.*itemProps).*\.xml", x.text_nodes, 1), *_COMMON],
    "xlsx": [
        (r"xl/sharedStrings\.xml", x.runs("si", "t"), 0),
        (r"xl/worksheets/.*\.xml", _SHEET, 1),
        (r"xl/(.*/)?workbook\.xml", _BOOK, 1),
        (r"xl/connections.*\.xml", _CONNECTIONS, 1),
        (r"xl/comments.*\.xml", x.runs("comment", "t"), 1),
        (r"xl/tables/(?!.*_rels).*\.xml", _TABLE, 1),
        (r"xl/pivotCache/(?!.*_rels).*\.xml", _PIVOT, 1),
        (_DRAWN, _DRAWING, 1),
        *_COMMON,
    ],
    "pptx": [(r"ppt/slides/(?!.*_rels/).*\.xml", _DRAWING, 0), (r"ppt/notesSlides/(?!.*_rels/).*\.xml", _DRAWING, 1), (r"ppt/comments(?!.*_rels/).*\.xml", x.text_nodes, 2), (_DRAWN, _DRAWING, 2), *_COMMON],
    "odt": [(r"content\.xml", x.text_nodes, 0), (r"(meta|styles)\.xml", x.text_nodes, 1)],
    "epub": [(r"(?i)(?!meta-inf/)(?!.*_rels/).*\.(xhtml|html?|opf)", x.text_nodes, 0)],
    "hwpx": [(r"Contents/section\d+\.xml", x.runs("hp:p", "hp:t"), 0), (r"Contents/(header|masterpage.*)\.xml", x.runs("hp:p", "hp:t"), 1), (r"Contents/content\.hpf", x.text_nodes, 2)],
}
KINDS["ods"] = KINDS["odt"]


def _plain_directory(data: bytes) -> list[zipfile.ZipInfo] | None:
    """What an archive lists whose directory ends the file and has no extra fields and comments; None for any other, which is for the library to judge."""
    if len(data) < 22 or data[-42:-38] == b"PK\6\7":
        return None
    mark, disk, first_disk, here, n, size, at, n_comment = _ENDING.unpack_from(data, len(data) - 22)
    if mark != b"PK\5\6" or disk or first_disk or here != n or n_comment or at + size != len(data) - 22:
        return None
    out, stop = [], at + size
    while at < stop:
        if at + 46 > stop:
            return None
        mark, made_by, version, flags, method, time, date, crc, packed, plain, n_name, n_extra, n_comment, _, _, outer, begin = _ENTRY.unpack_from(data, at)
        raw = data[at + 46 : at + 46 + n_name]
        at += 46 + n_name
        if mark != b"PK\1\2" or version & 0xFF > _VERSION or n_extra or n_comment or at > stop or b"\0" in raw:
            return None
        try:
            info = zipfile.ZipInfo(raw.decode("utf-8" if flags & 0x800 or raw.isascii() else "cp437"))
        except UnicodeDecodeError:
            return None
        info.flag_bits, info.compress_type, info.CRC, info.compress_size, info.file_size, info.header_offset, info.external_attr = flags, method, crc, packed, plain, begin, outer
        out.append(info)
    return out if len(out) == n else None


def directory(data: bytes) -> list[zipfile.ZipInfo] | None:
    """What an archive lists; None if it can't be read."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            return archive.infolist()
    except (zipfile.BadZipFile, ValueError, OSError, NotImplementedError):
        return None


def _plainly(data: bytes, info: zipfile.ZipInfo, stop: int) -> bytes | None:
    """A part that is stored or deflated, ends by ``stop`` and is in every way as listed; None for any other, which is for the library to judge."""
    at = info.header_offset
    if info.flag_bits & ~0x80E or info.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED) or at < 0 or data[at : at + 4] != b"PK\3\4" or len(data) < at + 30:
        return None
    flags, _, n_name, n_extra = _LOCAL.unpack_from(data, at + 6)
    begin = at + 30 + n_name + n_extra
    packed = data[begin : begin + info.compress_size]
    if flags != info.flag_bits or len(packed) != info.compress_size or begin + len(packed) > stop or data.find(b"PK\1\2", begin, begin + len(packed)) >= 0 or data[at + 30 : at + 30 + n_name] != info.orig_filename.encode("utf-8" if flags & 0x800 or info.orig_filename.isascii() else "cp437"):
        return None
    if info.compress_type == zipfile.ZIP_DEFLATED:
        try:
            unpack = zlib.decompressobj(-15)
            packed = unpack.decompress(packed, info.file_size + 1)
        except zlib.error:
            return None
        if not unpack.eof:
            return None
    return packed if len(packed) == info.file_size and zlib.crc32(packed) == info.CRC else None


def read_parts(data: bytes, listed: list[zipfile.ZipInfo] | None = None) -> list[tuple[str, bytes]]:
    """(name, bytes) of each file of an archive, in its order; ``listed`` is its ``directory``, if that was read already."""
    out, total, archive = [], 0, None
    try:
        if listed is None and (listed := _plain_directory(data)) is None:
            archive = zipfile.ZipFile(io.BytesIO(data))
            listed = archive.infolist()
        starts = sorted(info.header_offset for info in listed)
        for info in listed:
            if info.is_dir():
                continue
            total += info.file_size
            if len(out) >= MAX_PARTS or total > MAX_BYTES:
                raise ValueError("archive unpacks to too much")
            after = bisect.bisect_right(starts, info.header_offset)
            if (part := _plainly(data, info, starts[after] if after < len(starts) else len(data))) is None:
                archive = archive or zipfile.ZipFile(io.BytesIO(data))
                part = archive.read(archive.infolist()[listed.index(info)])
            out.append((info.filename, part))
    finally:
        if archive is not None:
            archive.close()
    return out


def write_parts(parts: list[tuple[str, bytes]]) -> bytes:
    """An archive of the parts, deflated; the first part of EPUB, OpenDocument and HWPX (mimetype) is stored.

    Small ones are put together here, byte by byte as the library does, which takes most of its time for open files.
    """
    if sum(len(data) + 200 for _, data in parts) < _SMALL and len(parts) < 0xFFFF and not any("\0" in name or len(name) > 9999 for name, _ in parts):
        return _small_archive(parts)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, data in parts:
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_STORED if name == "mimetype" else zipfile.ZIP_DEFLATED
            archive.writestr(info, data)
    return out.getvalue()


def _small_archive(parts: list[tuple[str, bytes]]) -> bytes:
    body, entries, at = [], [], 0
    for name, data in parts:
        raw = name.encode()
        flags, method = 0 if name.isascii() else 0x800, zipfile.ZIP_STORED if name == "mimetype" else zipfile.ZIP_DEFLATED
        packed = zlib.compress(data, wbits=-15) if method else data
        crc, sizes = zlib.crc32(data), (len(packed), len(data), len(raw))
        body += [_PART.pack(b"PK\3\4", 20, flags, method, 0, 0x21, crc, *sizes, 0), raw, packed]
        entries += [_ENTRY.pack(b"PK\1\2", 20 | 3 << 8, 20, flags, method, 0, 0x21, crc, *sizes, 0, 0, 0, 0, 0o600 << 16, at), raw]
        at += 30 + len(raw) + len(packed)
    return b"".join([*body, *entries, _ENDING.pack(b"PK\5\6", 0, 0, len(parts), len(parts), sum(map(len, entries)), at, 0)])


def names_in(data: bytes) -> set[str]:
    """Names of an archive's files; none if it can't be read."""
    return {info.filename for info in directory(data) or ()}


@functools.lru_cache(maxsize=10_000)
def _finder(kind: str, name: str) -> tuple[x.Finder, int] | None:
    key = name.replace("\\", "/")
    return next(((find, place) for pattern, find, place in KINDS[kind] if re.fullmatch(pattern, key)), None)


def _readable(kind: str, parts: list[tuple[str, bytes]]) -> list[tuple[int, x.Finder]]:
    """Positions of the parts with text, in the order of reading: by place, then by name (in workbooks by position)."""
    found = [(hit[1], i, hit[0]) for i, (name, _) in enumerate(parts) if (hit := _finder(kind, name))]
    natural = kind == "xlsx"
    found.sort(key=lambda f: (f[0], f[1] if natural or f[0] >= 8 else 0, parts[f[1]][0].replace("\\", "/")))
    return [(i, find) for _, i, find in found]


def extract(kind: str, data: bytes, listed: list[zipfile.ZipInfo] | None = None) -> list[tuple[str, str]]:
    """(part, text) of each slot; ``listed`` is the archive's ``directory``, if that was read already."""
    parts = read_parts(data, listed)
    return [(parts[i][0].replace("\\", "/"), slot.text) for i, find in _readable(kind, parts) for slot in find(parts[i][1].decode("utf-8", "replace"))]


def rewrite(kind: str, data: bytes, texts: list[str]) -> bytes:
    """The archive with the slots' texts, in the order of ``extract``; parts without a change keep their bytes."""
    parts, at = read_parts(data), 0
    for i, find in _readable(kind, parts):
        xml = parts[i][1].decode("utf-8", "replace")
        slots = find(xml)
        new = texts[at : at + len(slots)]
        at += len(slots)
        if any(slot.text != text for slot, text in zip(slots, new, strict=True)):
            parts[i] = (parts[i][0], x.fill(xml, slots, new).encode())
    if at != len(texts):
        raise ValueError("texts don't match the file")
    return write_parts(parts)


def bundle(files: list[tuple[str, bytes]]) -> bytes:
    """One archive of all files; a name that is there already gets a number."""
    seen: dict[str, int] = {}
    out = []
    for name, data in files:
        seen[name] = n = seen.get(name, 0) + 1
        stem, dot, ext = name.rpartition(".")
        out.append((name if n == 1 else f"{stem or ext} ({n}){dot}{ext if stem else ''}", data))
    return write_parts(out)


Extractor = Callable[[bytes], list[tuple[str, str]]]
