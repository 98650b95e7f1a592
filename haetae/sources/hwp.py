"""HWP 5 text by the published format: compound file, deflated sections, paragraph records, preview text; read and written."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

MAGIC, MAGIC3 = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", b"HWP Document File V3"
SIGNATURE = b"HWP Document File"
WARN_LOCKED, WARN_COPY = "암호가 걸린 HWP 문서는 읽을 수 없습니다.", "배포용 HWP 문서는 읽을 수 없습니다."
WARN_V3 = "HWP3 형식은 읽지 못합니다."
_END = 0xFFFFFFFA  # first of the special sector numbers
#: Paragraph records, and control characters that take eight code units. Fixed values.
PARA_HEADER, PARA_TEXT, PARA_SHAPE, PARA_LINES = 66, 67, 68, 69
_WIDE = {1, 2, 3, 4, 5, 6, 7, 8, 9, 11, 12, 14, 15, 16, 17, 18, 19, 20, 21, 22, 23}
_ENTRY = struct.Struct("<64sHBxIII36xIQ")
_SINGLE = {9: "\t", 10: "\n", 24: "-", 30: " ", 31: " "}
#: A control with all its units, and a text followed by controls that show nothing, where each unit is a character.
_CONTROL = re.compile("[%s](?s:.){0,7}|[\0-\x1f]" % "".join(map(chr, sorted(_WIDE))))
_PLAIN = re.compile("([^\0-\x1f]*)[%s]*" % "".join(chr(u) for u in range(32) if u not in _WIDE and u not in _SINGLE))


class CompoundFile:
    """Streams of a compound file by path."""

    def __init__(self, data: bytes) -> None:
        if not data.startswith(MAGIC) or len(data) < 512:
            raise ValueError("not a compound file")
        self.data = data
        shift, mini_shift = struct.unpack_from("<HH", data, 30)
        self.size, self.mini = 1 << shift, 1 << mini_shift
        _, first_dir, _, self.cutoff, first_mini, _, difat, n_difat = struct.unpack_from("<IIIIIIII", data, 44)
        sectors = [s for s in struct.unpack_from("<109I", data, 76) if s < _END]
        for _ in range(min(n_difat, 10_000)):
            if difat >= _END:
                break
            block = struct.unpack(f"<{self.size // 4}I", self._sector(difat))
            sectors += [s for s in block[:-1] if s < _END]
            difat = block[-1]
        self.fat = [n for s in sectors for n in struct.unpack(f"<{self.size // 4}I", self._sector(s))]
        self.entries = list(self._entries(self._chain(first_dir, self.fat)))
        self.first_dir = first_dir
        table = self._chain(first_mini, self.fat)
        self.mini_fat = list(struct.unpack(f"<{len(table) // 4}I", table))
        self.mini_data = self._chain(self.entries[0][4], self.fat) if self.entries else b""
        self.streams = dict(self._tree(self.entries[0][3], "")) if self.entries else {}

    def _sector(self, n: int) -> bytes:
        return self.data[(n + 1) * self.size : (n + 2) * self.size].ljust(self.size, b"\0")

    def _chain(self, at: int, fat: list[int], mini: bytes | None = None) -> bytes:
        out, seen, size = [], 0, self.size if mini is None else self.mini
        while at < _END and seen <= len(fat):
            first = last = at
            while True:  # sectors that stand behind each other are taken at once
                at = fat[last] if last < len(fat) else _END
                seen += 1
                if at != last + 1 or at >= _END or seen > len(fat):
                    break
                last = at
            n = last + 1 - first
            out.append(self.data[(first + 1) * size : (first + 1 + n) * size].ljust(n * size, b"\0") if mini is None else mini[first * size : (first + n) * size])
        return b"".join(out)

    def _entries(self, table: bytes) -> Iterator[tuple[str, int, tuple[int, int], int, int, int]]:
        for name, length, kind, left, right, child, start, size in _ENTRY.iter_unpack(table[: len(table) // 128 * 128]):
            yield name[: max(0, min(length, 64) - 2)].decode("utf-16-le", "replace"), kind, (left, right), child, start, size

    def _tree(self, root: int, path: str) -> Iterator[tuple[str, int]]:
        todo, seen = [(root, path)], set()
        while todo:
            at, path = todo.pop()
            if at >= len(self.entries) or at in seen:
                continue
            seen.add(at)
            name, kind, (left, right), child, _, _ = self.entries[at]
            todo += [(left, path), (right, path)]
            if kind == 2:
                yield path + name, at
            elif kind == 1:
                todo.append((child, f"{path}{name}/"))

    def read(self, path: str) -> bytes:
        _, _, _, _, start, size = self.entries[self.streams[path]]
        small = size < self.cutoff
        return self._chain(start, self.mini_fat if small else self.fat, self.mini_data if small else None)[:size]


    def write(self, changed: dict[str, bytes]) -> bytes:
        """The file with other contents of some streams: the directory as it was, streams laid out anew in 512-byte sectors."""
        table, laid, fat, mini, mini_fat = bytearray(self._chain(self.first_dir, self.fat)), [], [], bytearray(), []

        def lay(data: bytes) -> int:
            """Sectors for ``data``, chained; the first one's number."""
            n = -(-len(data) // 512)
            if not n:
                return _END + 4
            first = len(fat)
            laid.append(data.ljust(n * 512, b"\0"))
            fat.extend([*range(first + 1, first + n), _END + 4])
            return first

        for path, at in self.streams.items():
            data = changed.get(path, None)
            data = self.read(path) if data is None else data
            if len(data) < 4096:
                start, n = (len(mini) // 64, -(-len(data) // 64)) if data else (_END + 4, 0)
                mini += data.ljust(n * 64, b"\0")
                mini_fat += [*range(len(mini_fat) + 1, len(mini_fat) + n), *([_END + 4] if n else [])]
            else:
                start = lay(data)
            struct.pack_into("<IQ", table, at * 128 + 116, start, len(data))
        struct.pack_into("<IQ", table, 116, lay(bytes(mini)), len(mini))
        packed = struct.pack(f"<{len(mini_fat)}I", *mini_fat)
        n_mini = -(-len(packed) // 512)
        first_mini, first_dir = lay(packed.ljust(n_mini * 512, b"\xff")), lay(bytes(table))
        n_fat = n_difat = 0
        while True:
            needed = -(-(len(fat) + n_fat + n_difat) // 128)
            if needed == n_fat and n_difat == max(0, -(-(n_fat - 109) // 127)):
                break
            n_fat, n_difat = needed, max(0, -(-(needed - 109) // 127))
        places = list(range(len(fat), len(fat) + n_fat))
        first_difat = len(fat) + n_fat
        fat += [_END + 3] * n_fat + [_END + 2] * n_difat
        body = [*laid, struct.pack(f"<{len(fat)}I", *fat).ljust(n_fat * 512, b"\xff")]
        rest = places[109:]
        for i in range(n_difat):
            part = rest[i * 127 : (i + 1) * 127]
            body.append(struct.pack(f"<{len(part)}I", *part).ljust(508, b"\xff") + struct.pack("<I", first_difat + i + 1 if i + 1 < n_difat else _END + 4))
        head = bytearray(self.data[:512])
        struct.pack_into("<HHHHH", head, 24, 62, 3, 0xFFFE, 9, 6)
        struct.pack_into("<IIIIIIIII", head, 40, 0, n_fat, first_dir, 0, 4096, first_mini if n_mini else _END + 4, n_mini, first_difat if n_difat else _END + 4, n_difat)
        head[76:512] = struct.pack(f"<{min(109, n_fat)}I", *places[:109]).ljust(436, b"\xff")
        return bytes(head) + b"".join(body)


def opened(data: bytes) -> CompoundFile | None:
    """The compound file of an HWP 5 document; None for any other bytes."""
    if not data.startswith(MAGIC):
        return None
    try:
        file = CompoundFile(data)
        return file if file.read("FileHeader").startswith(SIGNATURE) else None
    except (KeyError, ValueError, struct.error, IndexError):
        return None


def is_hwp5(data: bytes) -> bool:
    return opened(data) is not None


def _characters(record: bytes) -> str | None:
    """The units of a text record as characters, if each unit is one; None where there are surrogates."""
    try:
        text = record[: len(record) // 2 * 2].decode("utf-16-le")
    except UnicodeDecodeError:
        return None
    return text if len(text) == len(record) // 2 else None


def paragraph_text(record: bytes) -> str:
    """Characters of a paragraph text record; controls are left out, but for tabs, line breaks and spaces."""
    if (text := _characters(record)) is not None:
        return _CONTROL.sub(lambda m: _SINGLE.get(ord(m[0][0]), ""), text)
    units = struct.unpack(f"<{len(record) // 2}H", record[: len(record) // 2 * 2])
    out, i = bytearray(), 0
    while i < len(units):
        u = units[i]
        if u < 32:
            out += _SINGLE.get(u, "").encode("utf-16-le")
            i += 8 if u in _WIDE else 1
            continue
        out += struct.pack("<H", u)
        i += 1
    return out.decode("utf-16-le", "replace")


def records(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(tag, body) of each record."""
    yield from ((head & 0x3FF, body) for head, body in headed(data))


def headed(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(head without size, body) of each record."""
    at = 0
    while at + 4 <= len(data):
        (head,) = struct.unpack_from("<I", data, at)
        at += 4
        size = head >> 20
        if size == 0xFFF and at + 4 <= len(data):
            (size,) = struct.unpack_from("<I", data, at)
            at += 4
        yield head & 0xFFFFF, data[at : at + size]
        at += size


def _record(head: int, body: bytes) -> bytes:
    size = len(body)
    return struct.pack("<I", head | size << 20) + body if size < 0xFFF else struct.pack("<II", head | 0xFFF << 20, size) + body


def replace_text(record: bytes, new: str) -> tuple[bytes, int, int]:
    """A text record with other text, where it begins to differ, and by how many units it grew.

    Controls stay between the characters between which they were; within what was replaced they follow it.
    """
    if (text := _characters(record)) is not None and (plain := _PLAIN.fullmatch(text)):
        old, wanted = plain[1], new.encode("utf-16-le")
        begin = next((i for i, (a, b) in enumerate(zip(old, new)) if a != b), min(len(old), len(new)))
        return wanted + text[len(old) :].encode("utf-16-le"), begin, len(wanted) // 2 - len(old)
    units = struct.unpack(f"<{len(record) // 2}H", record[: len(record) // 2 * 2])
    pieces, i = [], 0  # (unit or units of a control, is text)
    while i < len(units):
        u = units[i]
        n = 8 if u in _WIDE else 1
        pieces.append((units[i : i + n], u >= 32 or u in _SINGLE))
        i += n
    shown = [(k, struct.unpack("<H", _SINGLE[p[0]].encode("utf-16-le"))[0] if p[0] < 32 else p[0]) for k, (p, text) in enumerate(pieces) if text]
    old, wanted = [u for _, u in shown], list(struct.unpack(f"<{len(new.encode('utf-16-le')) // 2}H", new.encode("utf-16-le")))
    same = 0
    while same < min(len(old), len(wanted)) and old[same] == wanted[same]:
        same += 1
    tail = 0
    while tail < min(len(old), len(wanted)) - same and old[-1 - tail] == wanted[-1 - tail]:
        tail += 1
    gone = {k for k, _ in shown[same : len(shown) - tail]}
    first = shown[same][0] if same < len(shown) else (shown[-1][0] + 1 if shown else 0)
    out: list[int] = []
    for k, (p, _) in enumerate(pieces):
        if k == first:
            begin = len(out)
            out += wanted[same : len(wanted) - tail]
        if k not in gone:
            out += p
    if first >= len(pieces):
        begin = len(out)
        out += wanted[same : len(wanted) - tail]
    return struct.pack(f"<{len(out)}H", *out), begin, len(out) - len(units)


def _sections(file: CompoundFile) -> list[str]:
    return sorted((n for n in file.streams if n.startswith("BodyText/Section")), key=lambda n: int("0" + "".join(c for c in n if c.isdigit())))


def _moved(body: bytes, size: int, begin: int, grown: int) -> bytes:
    """Positions in units at the head of each entry of ``size`` bytes, moved with the text."""
    out = bytearray(body)
    for at in range(0, len(body) - size + 1, size):
        (place,) = struct.unpack_from("<I", body, at)
        struct.pack_into("<I", out, at, place if place <= begin else max(begin, place + grown))
    return bytes(out)


def rewrite(data: bytes, texts: list[str]) -> bytes:
    """The file with other texts, in the order of ``extract``; paragraphs keep their controls, shapes and lines."""
    file, left, changed = CompoundFile(data), list(texts), {}
    (flags,) = struct.unpack_from("<I", file.read("FileHeader"), 36)
    if flags & 6:
        raise ValueError("a locked file can't be written")
    for name in _sections(file):
        raw = file.read(name)
        rows, begin, grown, header, touched = [list(r) for r in headed(zlib.decompressobj(-15).decompress(raw) if flags & 1 else raw)], 0, 0, None, False
        for row in rows:
            tag = row[0] & 0x3FF
            if tag == PARA_HEADER:
                header, begin, grown = row, 0, 0
            elif tag == PARA_TEXT:
                new = left.pop(0)
                if new != paragraph_text(row[1]):
                    row[1], begin, grown = replace_text(row[1], new)
                    touched = True
                    if header and grown:
                        (count,) = struct.unpack_from("<I", header[1])
                        header[1] = struct.pack("<I", count + grown) + header[1][4:]
            elif grown and tag in (PARA_SHAPE, PARA_LINES):
                row[1] = _moved(row[1], 8 if tag == PARA_SHAPE else 36, begin, grown)
        if touched:
            body = b"".join(_record(head, part) for head, part in rows)
            packer = zlib.compressobj(wbits=-15)
            changed[name] = packer.compress(body) + packer.flush() if flags & 1 else body
    if left:
        changed["PrvText"] = left.pop(0).encode("utf-16-le")
    if left:
        raise ValueError("texts don't match the file")
    return file.write(changed)


def extract(data: bytes, file: CompoundFile | None = None) -> tuple[list[tuple[str, str]], list[str]]:
    """((section, text) of every paragraph, headers, notes and cells where they are anchored; warnings); ``file`` if it was opened already."""
    file = file or CompoundFile(data)
    (flags,) = struct.unpack_from("<I", file.read("FileHeader"), 36)
    out: list[tuple[str, str]] = []
    if flags & 6:
        return out, [WARN_LOCKED if flags & 2 else WARN_COPY]
    for name in _sections(file):
        section = file.read(name)
        if flags & 1:
            section = zlib.decompressobj(-15).decompress(section)
        out += [(name, paragraph_text(body)) for tag, body in records(section) if tag == PARA_TEXT]
    if "PrvText" in file.streams:
        preview = file.read("PrvText").decode("utf-16-le", "replace").split("\0")[0]
        if preview.strip():
            out.append(("PrvText", preview))
    return out, []
