"""Writing out of many tasks: folders, archives and reports, and what is left when something fails."""

import io
import json
import os
import zipfile

import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from haetae import shared
from haetae.plans import queries
from haetae.plans.process import Config, process, text_files
from haetae.sinks import files, reports, stitch
from haetae.sources.files import read_named


def masked(spark, rows):
    return spark.createDataFrame([(n, n, None if b is None else bytes(b)) for n, b in rows], "filename string, output_name string, masked binary").repartition(4)


ROWS = [(f"f{i}.txt", f"content {i} 가나다\n".encode() * (i % 50)) for i in range(300)] + [("big.bin", os.urandom(3_000_000)), ("none", None), ("empty.txt", b"")]


def held(folder):
    return {p.name: p.read_bytes() for p in folder.iterdir()}


def test_files_are_put_in_place(spark, tmp_path):
    assert files.write_files(masked(spark, ROWS), str(tmp_path / "out")) == 302
    assert held(tmp_path / "out") == {n: b for n, b in ROWS if b is not None}
    assert files.write_files(masked(spark, [("f1.txt", b"new")]), f"file://{tmp_path}/out") == 1
    assert held(tmp_path / "out")["f1.txt"] == b"new" and len(held(tmp_path / "out")) == 302


def failing(df, name):
    """``df``, whose job fails once it comes to ``name``."""
    return df.withColumn("masked", F.when(F.col("output_name") == name, F.raise_error(F.lit("on purpose")).cast("binary")).otherwise(F.col("masked")))


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    for write, target in ((files.write_files, tmp_path / "out"), (files.write_archive, tmp_path / "sub" / "a.zip")):
        with pytest.raises(Exception, match="on purpose"):
            write(failing(masked(spark, ROWS), "f77.txt"), str(target))
        assert not target.exists() and list(tmp_path.iterdir()) == []
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "kept.txt").write_bytes(b"kept")
    with pytest.raises(Exception, match="on purpose"):
        files.write_files(failing(masked(spark, ROWS), "f77.txt"), str(tmp_path / "old"))
    assert held(tmp_path / "old") == {"kept.txt": b"kept"}


def test_an_attempt_that_is_repeated_leaves_nothing_twice(spark, tmp_path):
    """Two attempts of one task: only what the manifest names is moved; moving twice is no error."""
    made = stitch.written(spark.range(1).select(F.lit("a").alias("name"), F.lit("b").alias("place")))
    assert made.count() == 1

    def again(batches):
        folders = []
        for _ in range(2):
            system, mine, part = stitch.attempt(str(tmp_path / f"try{len(folders)}"))
            folders.append(mine)
        assert part == TaskContext.get().partitionId() and len(set(folders)) == 2
        yield from batches

    spark.range(3).mapInArrow(again, "id long").count()
    assert files.write_files(masked(spark, ROWS[:20]), str(tmp_path / "out")) == 20
    assert files.write_files(masked(spark, ROWS[:20]), str(tmp_path / "out")) == 20
    assert held(tmp_path / "out") == dict(ROWS[:20])


def test_equal_names(spark, tmp_path):
    rows = [("a.txt", b"1"), ("a.txt", b"2"), ("b", b"3"), ("b", b"3"), ("dir/a.txt", b"4")]
    with pytest.raises(files.SameName, match="a.txt, b"):
        files.write_files(masked(spark, rows), str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()
    assert files.write_files(masked(spark, rows[:4]), str(tmp_path / "out"), numbered=True) == 4
    assert sorted(held(tmp_path / "out").values()) == [b"1", b"2", b"3", b"3"]


def test_bare_paths_are_for_one_machine(spark):
    class Cluster:
        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="each executor"):
        stitch.reachable(Cluster, "/tmp/out")
    assert stitch.file_system("file:/shared/out")[1] == stitch.file_system("file:///shared/out")[1] == "/shared/out"
    assert stitch.reachable(Cluster, "file:///shared/out") and stitch.reachable(Cluster, "file:/shared/out") and stitch.reachable(spark, "/tmp/out")


@pytest.mark.parametrize("limits", [None, (5000, 10)])
def test_archive(spark, tmp_path, monkeypatch, limits):
    if limits:  # as for an archive of over 4 GB and 65,535 files
        monkeypatch.setattr(files, "_LIMIT", limits[0])
        monkeypatch.setattr(files, "_MANY", limits[1])
    rows = [*ROWS, ("f1.txt", b"another"), ("내 파일.txt", b"x")]
    assert files.write_archive(masked(spark, rows), str(tmp_path / "all.zip")) == 304
    if limits:
        data = (tmp_path / "all.zip").read_bytes()
        assert b"PK\x06\x06" in data and b"PK\x06\x07" in data
        return
    with zipfile.ZipFile(tmp_path / "all.zip") as out:
        assert out.testzip() is None and len(out.namelist()) == 304
        assert all(out.read(n) == b for n, b in rows[:303] if b is not None and n != "f1.txt") and out.read("내 파일.txt") == b"x"
        assert sorted(out.read(n) for n in ("f1.txt", "f1 (2).txt")) == sorted([dict(ROWS)["f1.txt"], b"another"])
    assert [p.name for p in tmp_path.iterdir()] == ["all.zip"]
    assert files.write_archive(masked(spark, rows).limit(0), str(tmp_path / "none.zip")) == 0
    assert zipfile.ZipFile(tmp_path / "none.zip").namelist() == []


def test_records_of_sixty_four_bits():
    """A directory with them, as Python reads it: members beyond 4 GB are placed by the 64-bit field."""
    entry = files._directory_entry(b"a", 1, 2, 3, 5 << 32)
    assert entry[42:46] == b"\xff\xff\xff\xff" and int.from_bytes(entry[-8:], "little") == 5 << 32
    head = files._local_header(b"a", 0, 0, 0)
    whole = io.BytesIO(head + (d := files._directory_entry(b"a", 0, 0, 0, 0)) + files._directory_end(1, len(d), len(head)))
    assert zipfile.ZipFile(whole).namelist() == ["a"]
    end = files._directory_end(70_000, 10, 20)
    assert end.startswith(b"PK\x06\x06") and end[-22:].startswith(b"PK\x05\x06") and int.from_bytes(end[32:40], "little") == 70_000


def test_reports_as_one_file(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60)
    done = stitch.written(process(text_files(docs, "doc_id"), Config(mode="full", text_only=True)))
    for write, text in ((reports.write_csv_report, reports.csv_report), (reports.write_html_report, reports.html_report)):
        size = write(done, str(tmp_path / "one"))
        assert (tmp_path / "one").read_text() == text(done) and size == (tmp_path / "one").stat().st_size
    reports.write_json_report(done, str(tmp_path / "json"))
    assert json.loads((tmp_path / "json").read_text()) == json.loads(reports.json_report(done))
    for write in (reports.write_csv_report, reports.write_json_report, reports.write_html_report):
        write(done.limit(0), str(tmp_path / "empty"))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["empty", "json", "one"]


def test_a_store_without_places(spark, tmp_path, monkeypatch):
    """Where a file can only be written from begin to end, one task sends the blobs behind each other."""
    import pyarrow.fs

    class Only:
        def __init__(self):
            self.inner = pyarrow.fs.LocalFileSystem()

        def __getattr__(self, name):
            return getattr(self.inner, name)

    monkeypatch.setattr(pyarrow.fs, "LocalFileSystem", type("Other", (), {}))
    real = pyarrow.fs.FileSystem.from_uri
    monkeypatch.setattr(stitch, "file_system", lambda path: real(path if "://" in path else f"file://{path}"))
    rows = spark.range(1000).select(F.format_string("%04d", "id").alias("line")).orderBy("line")
    stitch.write_text(rows, "line", str(tmp_path / "out"), "head\n", "\n", "\ntail")
    assert (tmp_path / "out").read_text() == "head\n" + "\n".join(f"{i:04d}" for i in range(1000)) + "\ntail"


def test_written_files_are_read_by_name(spark, tmp_path):
    """Nobody lists the folder, and files don't make tasks: as many as there were to write."""
    folder = str(tmp_path / "out")
    names = files.write_named(masked(spark, ROWS), folder)
    back = read_named(names, folder)
    assert back.rdd.getNumPartitions() <= 4
    assert {r["filename"]: (r["path"], bytes(r["content"]), r["length"]) for r in back.collect()} == {n: (f"{folder}/{n}", b, len(b)) for n, b in ROWS if b is not None}
    assert queries.written_files(spark, "/root/testdata/sf0.01").rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("mounted", [False, True])
def test_files_are_written_wherever_checkpoints_are(spark, tmp_path, monkeypatch, mounted):
    """A bare ``spark.checkpoint.dir`` is in the default file system, on a cluster too, and Arrow doesn't know viewfs: before, both were an error."""
    there = tmp_path / "shared of all"
    there.mkdir()
    spark.sparkContext._jsc.hadoopConfiguration().set(f"fs.viewfs.mounttable.{tmp_path.name.replace('_', '-')}.link./shared", f"file://{tmp_path}/shared%20of%20all")
    monkeypatch.setattr(shared, "shared_folder", lambda spark: f"viewfs://{tmp_path.name.replace('_', '-')}/shared" if mounted else str(there))
    monkeypatch.setattr(spark.sparkContext, "master", "spark://elsewhere:7077")
    made = queries.written_files(spark, "/root/testdata/sf0.001")
    assert made.count() == 200 == len(list(there.glob("masked-documents-*/*.txt")))
    assert queries.split_csv_records(spark, "/root/testdata/sf0.001").count() == 87
