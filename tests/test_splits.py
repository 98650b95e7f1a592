"""Files in splits: lines and records as from the whole text, wherever splits begin."""

import random

import pytest
from pyspark.sql import functions as F

from haetae import plain
from haetae.sources import splits, text


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "64", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in keys}
    set_to = lambda size: [spark.conf.set(k, v if k != "spark.sql.files.maxPartitionBytes" else str(size)) for k, v in keys.items()]
    yield set_to
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def texts():
    rng = random.Random(3)
    made = {
        "a": "one\ntwo\r\n\nlast", "b": "ends with feed\n", "c": "", "d": "\n", "e": "\n\n\n", "f": 'x,"q\nq",y\n"open\nnever closed\nagain\n',
        "g": 'a,"' + "long quoted 가나\n" * 60 + '",z\nnext\n', "h": '"' * 7 + "\n" + 'b"c\n"d\ne', "i": "no feed " * 40, "j": "\r\n\r\r\n가\r",
    }
    for i in range(12):
        made[f"r{i}"] = "".join(rng.choice(['"', "\n", "\n", "a", "가", "\r\n", ",", '""', " user@example.com "]) for _ in range(rng.randint(0, 300)))
    return made


@pytest.mark.parametrize("size", [16, 64, 1000])
@pytest.mark.parametrize("csv", [False, True])
def test_as_from_the_whole_text(spark, tmp_path, small_splits, size, csv):
    all_of = texts()
    for name, t in all_of.items():
        (tmp_path / name).write_bytes(t.encode())
    (tmp_path / "marked").write_bytes(b"\xef\xbb\xbf" + 'x,"1\n2"\ny\n'.encode())
    all_of["marked"] = 'x,"1\n2"\ny\n'
    small_splits(size)
    found: dict = {}
    for r in splits.read_records(spark, str(tmp_path), csv).collect():
        found.setdefault(r.path.rpartition("/")[2], []).append((r.nth, r.at, r.text))
    for name, t in all_of.items():
        want = text.csv_records(t) if csv else text.lines(t)
        want = want if t else []
        assert sorted(found.get(name, [])) == [(i, at, x) for i, (at, x) in enumerate(want)], (name, t)


def test_many_splits_are_dealt_out(spark, tmp_path, small_splits, monkeypatch):
    body = 'a,"b\n' + "".join(f'{i},"x\n{i}",y\n' for i in range(300)) + '"'
    (tmp_path / "f").write_text(body)
    small_splits(64)
    monkeypatch.setattr(splits, "BROADCAST", 3)
    rows = sorted((r.nth, r.at, r.text) for r in splits.read_records(spark, str(tmp_path), True).collect())
    assert rows == [(i, at, x) for i, (at, x) in enumerate(text.csv_records(body))]


def test_one_file_in_many_tasks(spark, tmp_path, small_splits):
    """One file of conversations, in splits of 64 KB: as from expressions over the column, with places in the whole file."""
    conv = spark.read.parquet("/root/testdata/sf0.1/conversations.parquet")
    cells = conv.select(F.concat(F.col("conv_id").cast("string"), F.lit(',"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit("\n"), F.col("role"), F.lit('",u@example.com')).alias("line"))
    cells.coalesce(1).write.text(str(tmp_path / "one"))
    small_splits(64 << 10)
    records = splits.read_records(spark, str(tmp_path / "one"), True)
    assert splits._lines(spark, str(tmp_path / "one")).rdd.getNumPartitions() > 10
    body = next((tmp_path / "one").glob("part-*")).read_text()
    rows = records.orderBy("nth").collect()
    assert [(r.at, r.text) for r in rows] == text.csv_records(body)
    found = splits.record_findings(records)
    some = sorted((r["at"], r["raw"]) for r in found.select("at", "raw").collect())
    assert len(some) >= conv.count() and all(body[at : at + len(raw)] == raw for at, raw in some)
    assert sum(len(plain.find(t)) for _, t in text.csv_records(body)) == len(some)
