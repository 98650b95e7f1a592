"""Files written by many tasks: staged first, then put in place or stitched together, without their content on the driver.

Tasks write into a staging folder beside the target, each attempt into a place of its own; a manifest, written to the
shared folder, names what the attempts that count have left. Only then are files moved, or copied behind each other
into one. A job that fails leaves the target as it was, and an attempt that is repeated leaves nothing twice.
"""

from __future__ import annotations

import contextlib
import posixpath
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haetae.shared import written

#: Bytes copied at once.
BLOCK = 4 << 20
#: Blobs whose sizes come to the driver at once: one for each task.
_BLOBS = "part int, blob string, size long"


def file_system(path: str) -> tuple[Any, str]:
    """Arrow's file system and the path in it: of an address, or of this machine."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):  # as Hadoop writes it
        path = path.removeprefix("file:")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def reachable(spark: SparkSession, path: str) -> str:
    """``path``, if executors reach it: a bare path is each machine's own disk, so it is refused unless all runs on one."""
    if ":/" not in path and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{path!r} is a folder of each executor's own: give an address such as file:///shared/{path.strip('/')} or s3://...")
    return path


@contextlib.contextmanager
def staging(spark: SparkSession, folder: str) -> Iterator[str]:
    """A folder for staged files within ``folder``; it is gone afterwards, whatever happens."""
    made = f"{reachable(spark, folder).rstrip('/')}/.staging-{uuid.uuid4().hex}"
    system, base = file_system(made)
    there = system.get_file_info(posixpath.dirname(base)).type.name != "NotFound"
    system.create_dir(base, recursive=True)
    try:
        yield made
    except BaseException:
        system.delete_dir(base)
        if not there and not system.get_file_info(_selector(posixpath.dirname(base))):
            system.delete_dir(posixpath.dirname(base))
        raise
    system.delete_dir(base)


def _selector(path: str) -> Any:
    from pyarrow import fs

    return fs.FileSelector(path, allow_not_found=True)


def attempt(folder: str) -> tuple[Any, str, int]:
    """File system, folder of this attempt of a task (made), and the task's partition."""
    context = TaskContext.get()
    system, base = file_system(folder)
    mine = posixpath.join(base, f"{context.partitionId()}-{context.taskAttemptId()}")
    system.create_dir(mine, recursive=True)
    return system, mine, context.partitionId()


def blobs(rows: DataFrame, folder: str, of_batch: Callable[[pa.RecordBatch], Iterator[bytes]]) -> DataFrame:
    """part, blob and size: one staged file for each task of ``rows``, of the bytes that ``of_batch`` gives for its batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, mine, part = attempt(folder)
        blob, size = posixpath.join(mine, "blob"), 0
        with system.open_output_stream(blob) as out:
            for batch in batches:
                for piece in of_batch(batch):
                    out.write(piece)
                    size += len(piece)
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "blob": [blob], "size": pa.array([size], pa.int64())})

    return rows.mapInArrow(run, _BLOBS)


def stitched(spark: SparkSession, path: str, staged: list[tuple[str, int]], head: bytes = b"", tail: Callable[[], Iterator[bytes]] = lambda: iter(()), skip: int = 0) -> int:
    """One file at ``path`` out of ``head``, the staged blobs (path, size) in order, less the first ``skip`` bytes of the first one that isn't empty, and ``tail``; its size.

    Where files can be written at any place, as on disks and mounted stores, each blob is copied by a task of its own to where it belongs. Elsewhere one
    task sends them in blocks. The driver writes head and tail only. The file gets its name when all is there.
    """
    from pyarrow import fs

    system, target = file_system(reachable(spark, path))
    parts, at = [], len(head)
    for blob, size in staged:
        if size:
            parts.append((blob, skip, at, size - skip))
            at += size - skip
            skip = 0
    temporary = f"{target}.{uuid.uuid4().hex}.part"
    if isinstance(system, fs.LocalFileSystem):
        with open(temporary, "wb") as out:
            out.write(head)
            out.truncate(at)

        def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for blob, first, to, size in zip(*(c.to_pylist() for c in batch.columns)):
                    with open(blob, "rb") as source, open(temporary, "r+b") as out:
                        source.seek(first)
                        out.seek(to)
                        for data in iter(lambda: source.read(BLOCK), b""):
                            out.write(data)
                yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

        try:
            if parts:
                frame = spark.createDataFrame(parts, "blob string, first long, at long, size long").repartition(min(len(parts), 4096), "blob")
                frame.mapInArrow(copy, "n long").agg(F.sum("n")).first()
            with open(temporary, "r+b") as out:
                out.seek(at)
                for piece in tail():
                    out.write(piece)
                    at += len(piece)
            system.move(temporary, target)
        except BaseException:
            system.delete_file(temporary)
            raise
        return at
    ends = b"".join(tail())

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            there, where = file_system(path)
            with there.open_output_stream(where) as out:
                out.write(head)
                for blob, first, _, _ in parts:
                    with there.open_input_stream(blob) as source:
                        source.read(first)
                        while data := source.read(BLOCK):
                            out.write(data)
                out.write(ends)
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    spark.range(1).repartition(1).mapInArrow(send, "n long").agg(F.sum("n")).first()
    return at + len(ends)


def write_text(rows: DataFrame, column: str, path: str, head: str = "", between: str = "\n", tail: str = "") -> int:
    """One text file out of the rows of an ordered frame: ``head``, the rows with ``between`` in between, ``tail``; its size in bytes.

    Tasks write their rows side by side; the order is that of the frame's partitions, as ``orderBy`` leaves them.
    """
    spark, separator = rows.sparkSession, between.encode()

    def lines(batch: pa.RecordBatch) -> Iterator[bytes]:
        yield b"".join(separator + (v or "").encode() for v in batch.column(0).to_pylist())

    with staging(spark, posixpath.dirname(path) or ".") as folder:
        made = written(blobs(rows.select(column), folder, lines)).orderBy("part").collect()
        return stitched(spark, path, [(r["blob"], r["size"]) for r in made], head.encode(), lambda: iter([tail.encode()]), len(separator))
