"""Text files: character sets, lines and CSV records. Plain functions for the file readers, Column forms for text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from haetae.operators.pieces import let, running_sum, runs

UTF8, UTF8_BOM, UTF16_LE, UTF16_BE, EUC_KR = "utf8", "utf8_bom", "utf16_le", "utf16_be", "euc_kr"
#: Byte order marks, in the order in which they are looked for, and Python's codecs. EUC-KR means code page 949.
MARKS = ((UTF8_BOM, b"\xef\xbb\xbf"), (UTF16_LE, b"\xff\xfe"), (UTF16_BE, b"\xfe\xff"))
CODECS = {UTF8: "utf-8", UTF8_BOM: "utf-8", UTF16_LE: "utf-16-le", UTF16_BE: "utf-16-be", EUC_KR: "cp949"}
#: Messages about encodings. Fixed values.
WARN_KR, WARN_KR_LOSSY = "EUC-KR/CP949 로 해석했습니다.", "UTF-8이 아니어서 EUC-KR로 해석했습니다."


def decode(data: bytes) -> tuple[str, str | None, str]:
    """Text, warning and encoding: by a byte order mark, else strict UTF-8, else code page 949 with replacements."""
    for name, mark in MARKS:
        if data.startswith(mark):
            return data[len(mark) :].decode(CODECS[name], "replace"), None, name
    try:
        return data.decode("utf-8"), None, UTF8
    except UnicodeDecodeError:
        pass
    try:
        return data.decode("cp949"), WARN_KR, EUC_KR
    except UnicodeDecodeError:
        return data.decode("cp949", "replace"), WARN_KR_LOSSY, EUC_KR


def encode(text: str, encoding: str) -> bytes:
    """Back to the same encoding and mark; what code page 949 lacks becomes a numeric reference."""
    return dict(MARKS).get(encoding, b"") + text.encode(CODECS[encoding], "xmlcharrefreplace" if encoding == EUC_KR else "surrogatepass" if encoding.startswith("utf16") else "strict")


def lines(text: str) -> list[tuple[int, str]]:
    """(offset in characters, line) of each line, also an empty last one; carriage returns at its end are left out."""
    out, at = [], 0
    for piece in text.split("\n"):
        out.append((at, piece.rstrip("\r")))
        at += len(piece) + 1
    return out


def csv_records(text: str) -> list[tuple[int, str]]:
    """(offset, record): a line feed within quotes is part of the record.

    Each quote opens or closes, a doubled one does both, so the parity of the quotes so far tells where a record
    may end. An unbalanced quote takes in the rest of the file.
    """
    out, held, at, start, quotes = [], [], 0, 0, 0
    for piece in text.split("\n"):
        if not held:
            start = at
        held.append(piece)
        quotes += piece.count('"')
        at += len(piece) + 1
        if quotes % 2 == 0:
            out.append((start, "\n".join(held).rstrip("\r")))
            held = []
    if held:
        out.append((start, "\n".join(held).rstrip("\r")))
    return out


def replace_extension(name: Column, extension: str) -> Column:
    return F.concat(F.regexp_replace(name, r"\.[^.]*\z", ""), F.lit(f".{extension}"))


def text_lines(text: Column) -> Column:
    """Lines of a text column, without carriage returns at their end; null or empty text is one empty line."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.rtrim(x, F.lit("\r")))


def text_csv_records(text: Column) -> Column:
    """CSV records of a text column, by the parity of the quotes up to each line feed."""
    return F.transform(csv_spans(text), lambda r: r["text"])


def line_spans(text: Column) -> Column:
    """Lines as array<struct<at, text>>: where each begins, in characters, and the line as in ``text_lines``."""
    pieces = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    made = lambda p: F.zip_with(p, running_sum(F.transform(p, lambda x: F.length(x) + 1)), lambda x, at: F.struct(at.alias("at"), F.rtrim(x, F.lit("\r")).alias("text")))
    return let(pieces, made)


def csv_spans(text: Column) -> Column:
    """CSV records as array<struct<at, text>>: a record begins at each line with an even number of quotes before it."""

    def made(p: Column) -> Column:
        at = running_sum(F.transform(p, lambda x: F.length(x) + 1))
        quotes = running_sum(F.transform(p, lambda x: F.length(F.regexp_replace(x, '[^"]', ""))))
        begins = let(quotes, lambda q: F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: F.get(q, i) % 2 == 0))
        records = lambda b: F.transform(runs(p, b), lambda r: F.rtrim(F.array_join(r, "\n"), F.lit("\r")))
        return let(begins, lambda b: let(at, lambda a: F.zip_with(b, records(b), lambda i, r: F.struct(F.get(a, i).alias("at"), r.alias("text")))))

    return let(F.split(F.coalesce(text, F.lit("")), "\n", -1), made)


def full_text(paragraphs: Column) -> Column:
    """Paragraphs as one text with line feeds between; empty ones before the first text add none."""

    def join(p: Column) -> Column:
        first = F.array_position(F.transform(p, lambda x: x != ""), F.lit(True)).cast("int")
        return let(first, lambda at: F.when(at == 0, F.lit("")).otherwise(F.array_join(F.slice(p, at, F.size(p)), "\n")))

    return let(paragraphs, join)
