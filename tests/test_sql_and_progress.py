"""SQL functions inlined into plans, and counts of runs in progress."""

import time

from pyspark.sql import functions as F

from haetae import plain
from haetae import rules as catalog
from haetae.functions.checks import VALIDATORS
from haetae.functions.register import register
from haetae.operators.detect import detect
from haetae.plans.process import Config, process, text_files
from haetae.plans.progress import Watch, observed, observed_stream
from haetae.streaming.scan import detect_stream, run_available

TEXTS = ["메일 user@example.com\r\n900101-1234568, it's \"4111-1111-1111-1111\"", "", None, "M12345678 u***@x.org\n\n10.0.0.1 `back` 'tick'"]


def test_functions_as_plain(spark):
    register(spark)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    df.createOrReplaceTempView("notes_sql")
    for mode in ("full", "부분", " Replace ", "delete", "?"):
        rows = spark.sql(f"SELECT id, mask_identifiers(text, '{mode}') AS m FROM notes_sql")
        assert "Python" not in rows._jdf.queryExecution().executedPlan().toString()
        from haetae.functions.masks import parse_mode

        want = [None if t is None else "\n".join(plain.mask_line(x.rstrip("\r"), parse_mode(mode)) + x[len(x.rstrip("\r")) :] for x in t.split("\n")) for t in TEXTS]
        assert [r.m for r in rows.orderBy("id").collect()] == want
    found = spark.sql("SELECT id, f.* FROM notes_sql, LATERAL find_identifiers(text) f")
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.id, r.paragraph_index, r.rule_id, r.raw, r.masked_preview, r.char_start) for r in found.collect()) == sorted((i, n, f.rule_id, f.raw, f.masked_preview, f.char_start) for i, t in enumerate(TEXTS) for n, x in enumerate((t or "").split("\n")) for f in plain.find(x.rstrip("\r")))
    raws = ["4111-1111-1111-1111", "4111-1111-1111-1112", "900101-1234568", "220-81-62517", "010-1234-5678", "x", "10.0.0.*", "u@x.org", "M12345678", "123456-12345"]
    for v in (*VALIDATORS, "none", "other"):
        made = spark.createDataFrame([(r,) for r in [*raws, None]], "raw string").selectExpr("raw", f"check_identifier(raw, '{v}') AS c").collect()
        assert [(r.raw, r.c) for r in made] == [(r, plain.judge(r, v)) for r in raws] + [(None, None)]


def test_functions_with_own_rules_and_pushdown(spark, tmp_path):
    rules = catalog.overlay(catalog.builtin(), "[[rules]]\nid = 'no'\nlabel = \"it's\"\npattern = 'No\\\\.\\d+\\b'\nreplace_token = \"[it's]\"\npriority = 200\n".replace("\\\\", "\\"))
    register(spark, rules)
    spark.createDataFrame([(i, f"see No.{i} and a@b.com", "x") for i in range(50)], "id int, text string, other string").write.parquet(str(tmp_path / "t"))
    spark.read.parquet(str(tmp_path / "t")).createOrReplaceTempView("notes_own")
    rows = spark.sql("SELECT mask_identifiers(text, 'replace') AS m FROM notes_own WHERE id = 7")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert [r.m for r in rows.collect()] == ["see [it's] and [이메일]"] and "EqualTo(id,7)" in plan and "other" not in plan.split("ReadSchema")[1][:80]
    register(spark)


def test_counts_of_a_batch(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    results, counts = observed(process(text_files(docs, "doc_id"), Config(text_only=True)), "batch-run")
    rows = results.select("error", "findings").collect()
    assert counts.get == {"files": len(rows), "findings": sum(len(r.findings) for r in rows), "errors": 0} and counts.get["findings"] > 0
    found, counts = observed(detect(docs, ["doc_id"]), "batch-findings")
    rows = found.collect()
    assert counts.get["findings"] == len(rows) and counts.get["confirmed"] == sum(r.confidence == "confirmed" for r in rows)


def test_counts_of_a_stream_batch_by_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", F.concat(F.lit("ip 10.0.0."), (F.col("event_id") % 256).cast("string"), F.lit(" "), "props").alias("text"))
    for i in range(3):
        events.filter(F.hash("ts") % 3 == (i if i < 2 else -1) if i < 2 else F.lit(True)).limit(300 * (i + 1)).write.parquet(str(tmp_path / "in" / f"{i}"))
    watch = Watch("events").attach(spark)
    try:
        source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        run_available(observed_stream(detect_stream(source, ["ts"]), "events"), lambda df, i: df.write.mode("append").parquet(str(tmp_path / "out")), str(tmp_path / "state"))
        for _ in range(100):
            if watch.total().get("findings") == spark.read.parquet(str(tmp_path / "out")).count():
                break
            time.sleep(0.2)
    finally:
        watch.detach(spark)
    batch = detect(spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "in")), ["ts"])
    assert watch.total()["findings"] == batch.count() and watch.total()["confirmed"] == batch.filter("confidence = 'confirmed'").count()
    assert len({b for _, b, counts in watch.batches if counts["findings"]}) >= 3
