"""Shared plumbing of the training-data operators: table reading, lineage cuts, Arrow batch mapping and byte kernels."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text handed to a kernel at once; one longer text goes alone.
SLICE_BYTES = 1 << 19
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of our own only where that is unset (tests, one machine)."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        found = f"file://{tempfile.gettempdir()}/haetae-checkpoints"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def delete(spark: SparkSession, folder: str) -> None:
    """A folder and all in it, on whatever file system it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(col: Any) -> Any:
    return F.translate(col, UPPER, LOWER)


def crc_bucket(col: Any, mod: int) -> Any:
    """crc32 of the id as text, modulo ``mod``; null for a null id."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % mod if isinstance(col, str) else F.crc32(col.cast("string").cast("binary")) % mod


def arrow_texts(column: pa.Array) -> pa.Array:
    """Strings as large binary without nulls (null: empty)."""
    if column.null_count:
        column = column.fill_null("")
    return column.cast(pa.large_binary())


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each."""
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
        yield at, min(to, len(texts))
        at = to


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a slice, and where each text begins and the last ends."""
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def add_columns(df: DataFrame, text: str, fields: str, make: Callable[[], Callable[[pa.Array], dict[str, Any]]], keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``df`` (all by default) and the ``fields`` that a kernel derives from ``text``.

    ``make`` runs once in each Python worker and returns the kernel; the kernel gets slices of texts as large
    binary (null: empty) and returns an array for each field. Rows stay in place, nothing is shuffled, memory
    is bounded by one Arrow batch (by the session's ``spark.sql.execution.arrow.maxBytesPerBatch``) and by the longest text.
    """
    keep = df.columns if keep is None else keep
    new = T._parse_datatype_string(fields)
    if clash := {c.lower() for c in keep} & {f.name.lower() for f in new}:
        raise ValueError(f"columns {sorted(clash)} exist already")
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [(f.name, to_arrow_type(f.dataType)) for f in new]
    own = keep.index(text) if text in keep else len(keep)  # a kept text isn't handed over twice
    source = df.select(*[F.col(f"`{c}`") for c in (keep if own < len(keep) else [*keep, text])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = make()
        for batch in batches:
            texts = arrow_texts(batch.column(own))
            for a, b in slices(texts):
                made = kernel(texts.slice(a, b - a))
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(a, b - a) for i in range(len(keep))] + [x if isinstance(x := made[n], pa.Array) else pa.array(x, kind) for n, kind in kinds], names=[*keep, *[n for n, _ in kinds]])

    return source.mapInArrow(run, T.StructType([*source.schema.fields[: len(keep)], *new.fields]))


# Byte kernels. A polynomial hash modulo 2**64 with an odd base: any substring's hash comes from two prefix sums.
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
MIX = np.uint64(0xD6E8FEB86659FD93)


class Powers:
    """Powers of BASE and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.n, self.up, self.down = 0, np.ones(0, np.uint64), np.ones(0, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 2 * self.n, 1 << 16)
            inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
            for name, base in (("up", BASE), ("down", inverse)):
                steps = np.full(self.n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


POWERS = Powers()


class Hasher:
    """Hashes of substrings of one byte array."""

    def __init__(self, data: np.ndarray) -> None:
        up, self.down = POWERS.get(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.down[start] + np.uint64(seed)
        h = (h ^ (h >> np.uint64(32))) * MIX
        return (h ^ (h >> np.uint64(29))) * BASE


#: For each byte: itself in lower case if it belongs to a word (digits, letters, beyond ASCII), else 0.
WORD = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], np.uint8)


def word_spans(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes (0 outside words), begin and end of each word, and the text that it is in."""
    low = WORD[data]
    inside = np.zeros(len(low) + 1, bool)
    inside[:-1] = low != 0
    edge = inside.copy()
    edge[1:] ^= inside[:-1]
    firsts = starts[1:-1]
    firsts = firsts[(firsts > 0) & (firsts < len(low))]
    cut = firsts[inside[firsts] & inside[firsts - 1]]  # texts that touch
    begin = np.flatnonzero(edge & inside)
    end = np.flatnonzero(edge & ~inside)
    if len(cut):
        cut = np.unique(cut)
        begin, end = np.sort(np.concatenate([begin, cut])), np.sort(np.concatenate([end, cut]))
    return low, begin, end, np.searchsorted(starts, begin, "right") - 1


class Private:
    """A frame with columns of its own beside those of ``docs``, under names that clash with none."""

    def __init__(self, frame: DataFrame, columns: list[str], prefix: str) -> None:
        self.frame, self.columns, self.prefix = frame, columns, prefix

    def private(self, name: str) -> Any:
        return F.col(f"{self.prefix}{name}")

    def filter(self, condition: Any) -> Private:
        return Private(self.frame.filter(condition), self.columns, self.prefix)

    def done(self) -> DataFrame:
        return self.frame.select(*[F.col(f"`{c}`") for c in self.columns])


def add_private(docs: DataFrame, text: str, fields: str, make: Callable[[], Callable[[pa.Array], dict[str, Any]]]) -> Private:
    """``add_columns`` for all columns of ``docs``; a filter can use the new ones, ``done`` drops them."""
    prefix = "__own_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix += "_"
    named = ", ".join(f"{prefix}{f.name} {f.dataType.simpleString()}" for f in T._parse_datatype_string(fields))

    def renamed() -> Callable[[pa.Array], dict[str, Any]]:
        kernel = make()
        return lambda texts: {f"{prefix}{k}": v for k, v in kernel(texts).items()}

    return Private(add_columns(docs, text, named, renamed), docs.columns, prefix)
