"""Masked files out of a run: into a folder, or one archive."""

from __future__ import annotations

import posixpath
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haetae.shared import written
from haetae.sinks.stitch import attempt, file_system, staging, stitched
from haetae.sources.containers import bundle

_LIMIT, _MANY = 0xFFFFFFFF, 0xFFFF


class SameName(ValueError):
    """Several files have one name."""


def write_masked(results: DataFrame, path: str, mode: str = "overwrite") -> None:
    """output_name and masked bytes as a Parquet table, from all executors; the form for many files."""
    results.filter("masked is not null").select("filename", "output_name", "masked").write.mode(mode).parquet(path)


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with a number in the second and further files of one name, in the order of their digests."""
    at = F.row_number().over(Window.partitionBy("output_name").orderBy(F.sha2("masked", 256)))
    name = F.regexp_replace("output_name", r"^(.*?)(\.[^.]*)?\z", F.concat(F.lit("$1 ("), at.cast("string"), F.lit(")$2")))
    return rows.select(F.when(at == 1, F.col("output_name")).otherwise(name).alias("output_name"), "masked")


def write_files(results: DataFrame, path: str, numbered: bool = False) -> int:
    """Each masked file under the last part of its output_name in the folder ``path``, from the executors; the number of files.

    ``path`` is a folder that all executors reach, by any address that Arrow's file systems know (file://, hdfs://, s3://,
    gs://); a bare path only where all runs on one machine. Files are staged and moved into place when all are there, so a job
    that fails leaves nothing, and a task that runs again leaves nothing twice. Equal names are an error, unless ``numbered``, which gives
    further ones a number at the price of a shuffle by name. Files that are there already are replaced.
    """
    return _write(results, path, numbered)[0]


def write_named(results: DataFrame, path: str, numbered: bool = False) -> DataFrame:
    """As ``write_files``; the names of the files as column ``name``, kept in the shared folder, so that nobody need list ``path``."""
    return _write(results, path, numbered)[1]


def _write(results: DataFrame, path: str, numbered: bool) -> tuple[int, DataFrame]:
    spark = results.sparkSession
    base = F.element_at(F.split(F.replace(F.coalesce("output_name", F.lit("")), F.lit("\\"), F.lit("/")), "/"), -1)
    rows = results.filter("masked is not null").select(F.when(base == "", "_").otherwise(base).alias("output_name"), "masked")
    rows = _numbered(rows) if numbered else rows

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, mine, _ = attempt(folder)
        n = 0
        for batch in batches:
            names, places = [], []
            for name, data in zip(batch["output_name"], batch["masked"]):
                names.append(name.as_py())
                places.append(posixpath.join(mine, str(n)))
                n += 1
                with system.open_output_stream(places[-1]) as out:
                    out.write(data.as_buffer())
            yield pa.RecordBatch.from_pydict({"name": pa.array(names, pa.string()), "place": pa.array(places, pa.string())})

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(path)
        for batch in batches:
            for name, place in zip(batch["name"].to_pylist(), batch["place"].to_pylist()):
                target = posixpath.join(base, name)
                try:
                    system.move(place, target)
                except OSError:  # an attempt before this one has moved it
                    if system.get_file_info(place).type.name != "NotFound" or system.get_file_info(target).type.name == "NotFound":
                        raise
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    with staging(spark, path) as folder:
        manifest = written(rows.mapInArrow(stage, "name string, place string"))
        twice = manifest.groupBy("name").count().filter("count > 1").orderBy("name").limit(5).collect()
        if twice:
            raise SameName(f"several files are named {', '.join(r['name'] for r in twice)}: write them numbered, or into folders of their own")
        n = manifest.mapInArrow(move, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return n, manifest.select("name")


def zip_masked(results: DataFrame) -> bytes:
    """All masked files in one archive, for a few files on the driver; equal names get numbers."""
    rows = results.filter("masked is not null").select("output_name", "masked").orderBy("output_name").toLocalIterator()
    return bundle([(r["output_name"], bytes(r["masked"])) for r in rows])


_MEMBER = "name binary, part int, at long, crc long, packed long, plain long"


def _local_header(name: bytes, crc: int, packed: int, plain: int) -> bytes:
    return struct.pack("<4s5H3I2H", b"PK\x03\x04", 20, 0x800, 8, 0, 0x21, crc, packed, plain, len(name), 0) + name


def _directory_entry(name: bytes, crc: int, packed: int, plain: int, at: int) -> bytes:
    far = struct.pack("<2HQ", 1, 8, at) if at >= _LIMIT else b""
    return struct.pack("<4s6H3I5H2I", b"PK\x01\x02", 45 if far else 20, 45 if far else 20, 0x800, 8, 0, 0x21, crc, packed, plain, len(name), len(far), 0, 0, 0, 0, min(at, _LIMIT)) + name + far


def _directory_end(entries: int, size: int, at: int) -> bytes:
    end = struct.pack("<4s4H2IH", b"PK\x05\x06", 0, 0, min(entries, _MANY), min(entries, _MANY), min(size, _LIMIT), min(at, _LIMIT), 0)
    if entries < _MANY and size < _LIMIT and at < _LIMIT:
        return end
    return struct.pack("<4sQ2H2I4Q", b"PK\x06\x06", 44, 45, 45, 0, 0, entries, entries, size, at) + struct.pack("<4sIQI", b"PK\x06\x07", 0, at + size, 1) + end


def write_archive(results: DataFrame, path: str) -> int:
    """All masked files in one zip archive at ``path``, made by the executors; the number of files. Equal names get numbers.

    Each task packs its files into a staged blob of finished members; where each blob begins is a running sum of their sizes. Blobs are copied to their
    place in the archive side by side (``stitched``), and the driver writes the directory behind them, entry by entry, without any content. Beyond
    4 GB or 65,535 files the archive has the 64-bit records.
    """
    spark = results.sparkSession
    rows = _numbered(results.filter("masked is not null").select(F.coalesce("output_name", F.lit("_")).alias("output_name"), "masked"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, mine, part = attempt(folder)
        at = 0
        with system.open_output_stream(posixpath.join(mine, "blob")) as out:
            for batch in batches:
                made: list[tuple] = []
                for name, data in zip(batch["output_name"].to_pylist(), batch["masked"]):
                    content, own = data.as_buffer(), (name.replace("\\", "/").lstrip("/") or "_").encode()
                    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
                    packed, crc = packer.compress(content) + packer.flush(), zlib.crc32(content)
                    header = _local_header(own, crc, len(packed), len(content))
                    out.write(header)
                    out.write(packed)
                    made.append((own, part, at, crc, len(packed), len(content)))
                    at += len(header) + len(packed)
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), (pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))], names=[f.split()[0] for f in _MEMBER.split(", ")])
        yield pa.RecordBatch.from_pydict({"name": pa.array([posixpath.join(mine, "blob").encode()]), "part": pa.array([part], pa.int32()), "at": pa.array([at], pa.int64()), **{c: pa.array([None], pa.int64()) for c in ("crc", "packed", "plain")}})

    with staging(spark, posixpath.dirname(path) or ".") as folder:
        manifest = written(rows.mapInArrow(pack, _MEMBER))
        tasks = manifest.filter("crc is null").orderBy("part").collect()  # one row for each task
        begins, total = {}, 0
        for r in tasks:
            begins[r["part"]] = total
            total += r["at"]
        entries = 0

        def directory() -> Iterator[bytes]:
            nonlocal entries
            size = 0
            for r in manifest.filter("crc is not null").orderBy("part", "at").toLocalIterator():
                entry = _directory_entry(bytes(r["name"]), r["crc"], r["packed"], r["plain"], begins[r["part"]] + r["at"])
                entries, size = entries + 1, size + len(entry)
                yield entry
            yield _directory_end(entries, size, total)

        stitched(spark, path, [(bytes(r["name"]).decode(), r["at"]) for r in tasks], tail=directory)
        return entries
