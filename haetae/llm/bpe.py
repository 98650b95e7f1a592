"""Byte-level BPE: encoding by the tokenizers library over Arrow batches, decoding by the reversed byte table."""

from __future__ import annotations

import base64
import codecs
import functools
import hashlib
import os
import re
import sys
import unicodedata
from array import array
from collections.abc import Callable, Iterable
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haetae.llm.common import add_columns


def byte_chars() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


def parts_below(token: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """What ``token`` is made of just before the merge that makes it: lowest rank first, leftmost on ties."""
    parts, own = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], own))
        if ranks.get(parts[best] + parts[best + 1], own) >= own:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts


def tokenizer_json(ranks: dict[bytes, int], pattern: str) -> str:
    """A tokenizer of the tokenizers library that applies ``ranks`` to each match of ``pattern`` separately."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    chars = byte_chars()
    text = lambda token: "".join(chars[b] for b in token)
    merges = [tuple(map(text, parts)) for token, _ in sorted(ranks.items(), key=lambda x: x[1]) if len(token) > 1 and len(parts := parts_below(token, ranks)) == 2]
    made = Tokenizer(models.BPE(vocab={text(token): rank for token, rank in ranks.items()}, merges=merges))
    made.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return made.to_str()


#: Classes of characters that a pattern may name if Python's own engine shall do.
CLASSES = {r"\p{L}": "", r"\p{N}": "", r"\s": "", r"\S": "^"}


@functools.lru_cache
def _ranges(name: str) -> str:
    """The characters of a class below U+10000, as the inside of brackets: what the ``regex`` module holds to be in it."""
    import regex

    codes = np.array([ord(c) for c in regex.findall(name, "".join(map(chr, (*range(0xD800), *range(0xE000, 0x10000)))))])
    first = codes[np.r_[True, np.diff(codes) > 1]]
    last = codes[np.r_[np.diff(codes) > 1, True]]
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(first, last))


def plain_pattern(pattern: str) -> str | None:
    """``pattern`` with its classes written out for Python's own engine, which is twice as fast; equal below U+10000.

    None if it holds anything in which the engines might differ: other escapes than those of ``CLASSES``, line
    feeds and carriage returns, groups but ``(?:`` and ``(?!``, possessive or lazy repetition, or sets within sets.
    """
    out, inside, at = [], False, 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            name = next((n for n in (*CLASSES, r"\n", r"\r") if pattern.startswith(n, at)), None)
            if name is None or inside and name == r"\S":
                return None
            made = name if name not in CLASSES else _ranges(name.lower() if name == r"\S" else name)
            out.append(made if inside or name not in CLASSES else f"[{CLASSES[name]}{made}]")
            at += len(name)
            continue
        if inside:
            if c in "[&|~" or c == "-" and pattern[at + 1 : at + 2] == "-":
                return None
            inside = c != "]"
        elif c == "(" and pattern[at : at + 3] not in ("(?:", "(?!") or c in "*+?}" and pattern[at + 1 : at + 2] in ("+", "?") and pattern[at + 1 : at + 2]:
            return None
        elif c == "[":
            if pattern.startswith(("[]", "[^]"), at):
                return None
            inside = True
        out.append(c)
        at += 1
    return "".join(out)


#: Matches of the pattern whose ids a worker remembers as the newer ones; as many older ones stay beside them.
REMEMBERED = 300_000


def _pack(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    made = array("I", ids)
    if sys.byteorder == "big":
        made.byteswap()
    return made.tobytes()


class Codec:
    """Encodes texts and decodes ids; one per Python worker."""

    def __init__(self, made: str, pattern: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.single = Tokenizer.from_str(made), Tokenizer.from_str(made)
        self.single.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)  # for one match of the pattern
        self.any_matches, plain = regex.compile(pattern).findall, plain_pattern(pattern)
        self.plain_matches = re.compile(plain).findall if plain else None
        self.beyond = re.compile("[\U00010000-\U0010ffff]").search
        self.packed, self.older = {}, {}
        back = {c: b for b, c in enumerate(byte_chars())}
        self.pieces = {i: bytes(back[c] for c in token) for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items()}
        self.by_id = np.full(max(self.pieces, default=-1) + 1, None, object)
        for i, piece in self.pieces.items():
            self.by_id[i] = piece

    def matches(self, text: str) -> list[str]:
        """The matches of the pattern; what lies beyond U+FFFF is left to the ``regex`` module."""
        if self.plain_matches and (text.isascii() or not self.beyond(text)):
            return self.plain_matches(text)
        return self.any_matches(text)

    def encode(self, texts: list[str]) -> list[Any]:
        return self.tokenizer.encode_batch(texts, add_special_tokens=False)

    def encode_packed(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers.

        The library gets each distinct match of the pattern in ``texts`` once, not every repetition of a word, and
        none that was met not long ago: of two generations of remembered matches the older one is forgotten when
        the newer one is full, and what is met in it moves on.
        Code points that Python's Unicode tables don't have yet may be letters to one regular expression engine
        and none to another: whole texts with such a one go to the library.
        """
        split = [self.matches(t) for t in texts]
        if len(self.packed) > REMEMBERED:
            self.packed, self.older = {}, self.packed
        new = set().union(*split).difference(self.packed)
        if known := new & self.older.keys():
            self.packed.update((part, self.older[part]) for part in known)
            new -= known
        odd = {part for part in new if not part.isascii() and any(unicodedata.category(c) == "Cn" for c in part)}
        if new := list(new - odd):
            self.packed.update(zip(new, (_pack(e.ids) for e in self.single.encode_batch(new, add_special_tokens=False))))
        return [b"".join(map(self.packed.__getitem__, parts)) if not odd or odd.isdisjoint(parts) else _pack(self.encode([text])[0].ids) for text, parts in zip(texts, split)]

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))

    def decode_packed(self, packed: bytes) -> bytes:
        """The bytes of ids that ``encode_packed`` made."""
        return b"".join(self.by_id[np.frombuffer(packed, "<u4")].tolist())

    def decode_stream(self, ids: Iterable[int]) -> list[str]:
        """The text that each token completes; a character split over tokens appears with the last of them."""
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        out = [decoder.decode(self.pieces[i]) for i in ids]
        if tail := decoder.decode(b"", True):
            out = [*out[:-1], out[-1] + tail] if out else [tail]
        return out


def _codec(df: DataFrame, path: str, pattern: str) -> Callable[[], Codec]:
    held = df.sparkSession.sparkContext.broadcast(tokenizer_json(load_ranks(path), pattern))  # 2 MB for 50,000 ranks
    return lambda: Codec(held.value, pattern)


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row.

    Null and empty texts have no tokens and the digests of no bytes. Null ids, repeated rows and other columns
    (not read) make no difference; an empty table gives no rows.
    """
    codec = _codec(docs, path, pattern)

    def make() -> Callable[[pa.Array], dict[str, Any]]:
        own = codec()

        def kernel(texts: pa.Array) -> dict[str, Any]:
            n, ids_sha, decoded_sha = [], [], []
            for packed in own.encode_packed(texts.cast(pa.large_string()).to_pylist()):
                n.append(len(packed) // 4)
                ids_sha.append(hashlib.sha256(packed).hexdigest())
                decoded_sha.append(hashlib.sha256(own.decode_packed(packed)).hexdigest())
            return {"n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": decoded_sha}

        return kernel

    return add_columns(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", "n_tokens long, ids_sha256 string, decoded_sha256 string", make, ["doc_id"])


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, and for each id the first and the last-plus-one character of the text that it touches.

    Tokens that share a split character have that character in their span. Null and empty texts give empty lists.
    """
    codec = _codec(docs, path, pattern)

    def make() -> Callable[[pa.Array], dict[str, Any]]:
        own = codec()

        def kernel(texts: pa.Array) -> dict[str, Any]:
            made = own.encode(texts.cast(pa.large_string()).to_pylist())
            return {"ids": [m.ids for m in made], "begins": [[a for a, _ in m.offsets] for m in made], "ends": [[b for _, b in m.offsets] for m in made]}

        return kernel

    return add_columns(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", "ids array<int>, begins array<int>, ends array<int>", make, ["doc_id"])


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the text of ``ids_col``; bytes that are no UTF-8 become U+FFFD. Null or empty ids give an empty text."""
    codec = _codec(encoded, path, pattern)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        own = codec()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(["".join(own.decode_stream(ids or [])) for ids in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    source = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, text string")
