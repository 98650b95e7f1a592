"""Token counts with a whole-token shortcut: strings proved to be one token are counted, only the rest is merged."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haetae.llm.common import add_columns

SPACE = "▁"  # what the library writes for a space
#: A pre-token: spaces and what follows them, or a line feed and what follows it.
PRETOKEN = re.compile(" +[^ \n]*|\n[^ \n]*")
#: Pre-tokens that a worker remembers before it starts anew.
REMEMBERED = 400_000


def cut_points(pieces: list[str]) -> tuple[bool, bool]:
    """Whether no piece reaches over the begin of a run of spaces, and whether no piece holds a line feed.

    A merge joins two neighbours into a piece of the vocabulary. So where no piece holds "not a space, space",
    no merge ever reaches over such a place, and the parts between them can be encoded one by one; likewise a
    line feed, which is in no piece, stays alone.
    """
    return not any(SPACE in p.lstrip(SPACE) for p in pieces), not any("\n" in p for p in pieces)


def prove(model: bytes) -> tuple[bool, list[str]]:
    """Whether pre-tokens may be counted one by one under ``model``, and the pre-tokens that are one token.

    Each vocabulary string of the form "space, rest" is encoded alone; it is taken if just its own id comes back.
    """
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    spec = sentencepiece_model_pb2.ModelProto.FromString(model)
    kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
    normal = spec.normalizer_spec
    plain = not normal.precompiled_charsmap and normal.add_dummy_prefix and normal.escape_whitespaces and not normal.remove_extra_whitespaces
    plain = plain and not spec.trainer_spec.treat_whitespace_as_suffix and not any(p.type == kinds.USER_DEFINED for p in spec.pieces) and spec.trainer_spec.model_type == 2
    strings = [p.piece for p in spec.pieces if p.type == kinds.NORMAL]
    if not plain or not all(cut_points(strings)):
        return False, []
    processor = SentencePieceProcessor(model_proto=model)
    found = [p[1:] for p in strings if p.startswith(SPACE) and SPACE not in p[1:]]
    return True, [w for w, ids in zip(found, processor.encode(found, num_threads=1)) if len(ids) == 1 and processor.id_to_piece(ids[0]) == SPACE + w]


class Counts(dict):
    """Tokens of a pre-token: 1 at once for the proved ones, else by the library's merges, remembered."""

    def __init__(self, model: bytes, whole: list[str]) -> None:
        from sentencepiece import SentencePieceProcessor

        self.processor = SentencePieceProcessor(model_proto=model)
        self.whole = dict.fromkeys((f" {w}" for w in whole), 1) | {" ": len(self.processor.encode("\n")) - 1}  # nothing after the space: an empty text would get none
        super().__init__(self.whole)

    def __missing__(self, pretoken: str) -> int:
        if len(self) > REMEMBERED + len(self.whole):
            self.clear()
            self.update(self.whole)
        # The library puts a space before what it gets: it stands for the first space here, and is one token of its own before a line feed.
        made = len(self.processor.encode(pretoken[1:])) if pretoken[0] == " " else len(self.processor.encode(pretoken)) - 1
        self[pretoken] = made
        return made

    def of(self, text: str) -> int:
        return sum(map(self.__getitem__, PRETOKEN.findall(" " + text.replace(SPACE, " ")))) if text else 0


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > ``limit``) of every row, as sentencepiece counts.

    Null and empty texts have no bytes and no tokens. Null ids, repeated rows and other columns (not read) make
    no difference; an empty table gives no rows. A model for which pre-tokens can't be proved independent is
    applied to whole texts instead.
    """
    with open(path, "rb") as file:
        model = file.read()
    held = docs.sparkSession.sparkContext.broadcast((model, *prove(model)))  # the model's own size, under 1 MB

    def make() -> Callable[[pa.Array], dict[str, Any]]:
        proto, independent, whole = held.value
        counts = Counts(proto, whole)
        of = counts.of if independent else lambda text: len(counts.processor.encode(text))

        def kernel(texts: pa.Array) -> dict[str, Any]:
            return {"n_tokens": [of(t) for t in texts.cast(pa.large_string()).to_pylist()]}

        return kernel

    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("n_bytes"))
    return add_columns(base, "text", "n_tokens long", make, ["doc_id", "n_bytes"]).withColumn("over_limit", F.col("n_tokens") > limit)
