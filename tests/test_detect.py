"""Detection and masking: fixed vectors, and the plans against the plain statement of the rules."""

import random

import pytest
from pyspark.sql import functions as F

from haetae import plain
from haetae import rules as catalog
from haetae.functions import masks
from haetae.operators.detect import detect
from haetae.operators.mask import changed, mask_text, masked_lines
from haetae.operators.summary import residual, summaries, totals

#: (text, [(rule, confidence, begin, end), ...])
VECTORS = [
    ("계약자 900101-1234568 입니다", [("resident_id", "confirmed", 4, 18)]),
    ("900101-1234560", [("resident_id", "suspicious", 0, 14)]),
    ("900101-1******", [("resident_id", "already_masked", 0, 14)]),
    ("900101-*******", [("resident_id", "already_masked", 0, 14)]),
    ("900101-5******", [("foreign_id", "already_masked", 0, 14)]),
    ("900101-5234564", [("foreign_id", "suspicious", 0, 14)]),
    ("900231-1234567", [("corp_id", "suspicious", 0, 14)]),
    ("1700000000000", [("corp_id", "suspicious", 0, 13)]),
    ("4111-1111-1111-1111", [("credit_card", "confirmed", 0, 19)]),
    ("4111-1111-1111-1112", [("credit_card", "suspicious", 0, 19)]),
    ("4111 1111 1111 1111 2024", []),
    ("4111 1111 1111 1111, 2024", [("credit_card", "confirmed", 0, 19)]),
    ("4111-****-****-1111", [("credit_card", "already_masked", 0, 19)]),
    ("*" * 13, [("credit_card", "already_masked", 0, 13)]),
    ("220-81-62517", [("business_id", "confirmed", 0, 12)]),
    ("2208162517", [("business_id", "confirmed", 0, 10)]),
    ("220-81-62510", [("business_id", "suspicious", 0, 12)]),
    ("2208162510", []),
    ("220\t81\t62510", []),
    ("010-1234-5678", [("mobile_phone", "confirmed", 0, 13)]),
    ("user@example.com", [("email", "confirmed", 0, 16)]),
    ("192.168.0.1", [("ip_address", "confirmed", 0, 11)]),
    ("u***@example.com", [("email", "already_masked", 0, 16)]),
    ("192.168.0.*", [("ip_address", "already_masked", 0, 11)]),
    ("M*******", [("passport", "already_masked", 0, 8)]),
    ("AB******", [("passport", "already_masked", 0, 8)]),
    ("서울-12-******-**", [("driver_license", "already_masked", 0, 15)]),
    ("110-***-******", [("bank_account", "already_masked", 0, 14)]),
    ("서울-01-123456-90", [("driver_license", "confirmed", 0, 15)]),
    ("M12345678", [("passport", "confirmed", 0, 9)]),
    ("110-123-456789", [("bank_account", "confirmed", 0, 14)]),
    ("123456-12345", [("health_insurance", "confirmed", 0, 12)]),
    ("M123456", []),
    ("12345612345", []),
    ("fe80::1", []),
    ("300.1.1.1", []),
    ("x900101-1234568", []),
    ("1.2.3.4.5", [("ip_address", "confirmed", 0, 7)]),
    ("10:15:30", [("ip_address", "confirmed", 0, 8)]),
    ("2001:db8:0:0:0:0:0:*", [("ip_address", "confirmed", 0, 18)]),
    ("900101–1234568", [("resident_id", "confirmed", 0, 14)]),
    ("１２３４５６-1234567", []),
    ("", []),
    (None, []),
]


def shape(rows):
    return [(f.rule_id, f.confidence, f.char_start, f.char_end) for f in rows]


def test_vectors(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(VECTORS)], "k int, text string")
    got = {}
    for r in detect(df, ["k"]).collect():
        got.setdefault(r.k, []).append((r.rule_id, r.confidence, r.char_start, r.char_end))
    for i, (text, expected) in enumerate(VECTORS):
        assert sorted(got.get(i, [])) == sorted(expected), text
        assert shape(plain.find(text)) == expected, text


def random_lines(n):
    random.seed(7)
    bits = ["900101-1234568", "4111-1111-1111-1111", "220-81-62517", "010-1234-5678", "a.b_c@ex.co.kr", "서울-01-123456-90", "M12345678", "110-123-456789", "123456-12345", "10.0.0.1", "*", "-", " ", "가", "x", "7", "12", "😀", ":", "1:2:3", "000000", "–", "\t", "AB******", "9001011234568"]
    return ["".join(random.choice(bits) for _ in range(random.randint(1, 9))) for _ in range(n)]


@pytest.mark.parametrize("mode", ["full", "partial", "replace", "delete"])
def test_same_as_plain(spark, mode):
    lines = random_lines(400)
    df = spark.createDataFrame(list(enumerate(lines)), "k int, text string")
    rows = {r.k: r for r in masked_lines(df, ["k"], mode=mode).collect()}
    for i, line in enumerate(lines):
        expected = plain.find(line)
        assert shape(rows[i].findings) == shape(expected), line
        assert [f.masked_preview for f in rows[i].findings] == [f.masked_preview for f in expected], line
        assert rows[i].after == plain.mask_line(line, mode), line
        for f in rows[i].findings:
            assert line.encode()[f.byte_start : f.byte_end].decode() == f.raw == line[f.char_start : f.char_end]
            assert f.context_before == line[max(0, f.char_start - 20) : f.char_start] and f.context_after == line[f.char_end : f.char_end + 20]


def test_mask_text_keeps_line_ends(spark):
    df = spark.createDataFrame([(1, "a 010-1234-5678\r\n\r\n b@c.de\r"), (2, None), (3, "")], "k int, text string")
    rows = {r.k: r.masked for r in mask_text(df, mode="delete").collect()}
    assert rows == {1: "a \r\n\r\n \r", 2: None, 3: ""}


def test_summaries_and_totals(spark):
    df = spark.createDataFrame([(1, "b@c.de\n010-1234-5678 x@y.zz"), (2, "nothing"), (3, "900101-1234560\n900101-1******")], "k int, text string")
    found = detect(df, ["k"])
    s = sorted((r.k, r.first_seen, r.rule_id, r["count"], r.preview) for r in summaries(found, ["k"]).collect())
    assert s == [(1, 1, "email", 2, "*@*.**"), (1, 2, "mobile_phone", 1, "***-****-**** x@y.zz"), (3, 1, "resident_id", 2, "******-*******")]
    t = {r.k: (r.confirmed, r.suspicious, r.already_masked) for r in totals(df, found, ["k"]).collect()}
    assert t == {1: (3, 0, 0), 2: (0, 0, 0), 3: (0, 1, 1)}
    assert changed(masked_lines(df, ["k"])).count() == 3


def test_residual(spark):
    df = spark.createDataFrame([(1, "2001:db8:0:0:0:0:0:1 900101-1234568")], "k int, text string")
    count = lambda mode: residual(df, ["k"], mode=mode).filter("confidence = 'confirmed'").count()
    assert count("full") == 0 and count("partial") == 1


def test_overlay_and_rule_errors(spark):
    rules = catalog.overlay(catalog.builtin(), '[[rules]]\nid = "employee_no"\nlabel = "사번"\npattern = \'EMP-\\d{6}\'\n')
    assert len(rules) == 13 and rules.get("employee_no").replace_token == "[사번]" and rules.rules[-1].id == "employee_no"
    df = spark.createDataFrame([("x EMP-123456",)], "text string")
    assert masked_lines(df, [], mode="replace", rules=rules).first().after == "x [사번]"
    assert catalog.overlay(rules, "  \n") is rules
    own = catalog.overlay(catalog.builtin(), '[[rules]]\nid = "email"\nlabel = "m"\npattern = "zz"\npriority = 200\n')
    assert own.rules[0].id == "email" and len(own) == 12
    for bad in ('[[rules]]\nid = "a"\nlabel = "b"\n', "[[rules]", '[[rules]]\nid = "a"\nlabel = "b"\npattern = "("\n', "[[rules]]\nid = 'a'\nlabel = 'b'\npattern = '(?<=a)b'\n"):
        with pytest.raises(catalog.RuleError):
            catalog.load(bad)


def test_modes():
    assert [masks.parse_mode(x) for x in (" Partial", "부분", "치환", "삭제", "FULL", "?")] == ["partial", "partial", "replace", "delete", "full", "full"]


def test_plan_is_narrow_and_prunes(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = detect(df, ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_sql_functions(spark):
    from haetae.functions.register import register

    register(spark)
    assert spark.sql("SELECT rule_id, paragraph_index FROM find_identifiers('x\na@b.co')").collect() == [("email", 1)]
    assert spark.sql("SELECT mask_identifiers('a@b.co 010-1234-5678', '부분') AS m").first().m == "a@b.co 010-****-5678"
    assert spark.sql("SELECT check_identifier('4111111111111112', 'luhn') AS c").first().c == "suspicious"


def test_sql_views(spark):
    from haetae.functions.register import register_views

    spark.createDataFrame([(1, "a user@example.com b\n900101-1234568"), (2, None)], "id long, text string").createOrReplaceTempView("notes")
    assert register_views(spark, "notes", ["id"], mode="partial") == ("notes_findings", "notes_masked")
    found = spark.sql("select id, rule_id from notes_findings where confidence = 'confirmed' order by rule_id")
    assert [tuple(r) for r in found.collect()] == [(1, "email"), (1, "resident_id")]
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    assert [r.masked for r in spark.sql("select masked from notes_masked order by id").collect()] == ["a u***@example.com b\n900101-1******", None]


def test_luhn_check_digit(spark):
    from haetae.functions import checks

    rows = spark.createDataFrame([("411111111111111", 1), ("4111-1111-1111-111", 1), ("7992739871", 3), ("0", 0), ("", None)], "t string, want int")
    made = rows.select("t", "want", checks.luhn_check_digit(F.col("t")).alias("got")).collect()
    assert all(r.got == r.want for r in made)
    assert all(plain.checksum("luhn", r.t.replace("-", "") + str(r.got)) for r in made if r.t)


def test_stream_equals_batch(spark, tmp_path):
    from haetae.streaming.scan import detect_stream, run_available

    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    source.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sink = lambda batch, _: batch.write.mode("append").parquet(str(tmp_path / "out"))
    run_available(detect_stream(stream, ["doc_id"]), sink, str(tmp_path / "cp"))
    run_available(detect_stream(stream, ["doc_id"]), sink, str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, detect(source, ["doc_id"]).collect()))


def test_windowed_counts_on_stream(spark, tmp_path):
    from haetae.streaming.scan import detect_stream, windowed_counts

    rows = [("2024-01-01 00:10:00", "a@b.co"), ("2024-01-01 00:50:00", "c@d.ef 10.0.0.1"), ("2024-01-01 02:00:00", "x")]
    batch = spark.createDataFrame(rows, "ts string, text string").withColumn("ts", F.to_timestamp("ts"))
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    counts = windowed_counts(detect_stream(stream, ["ts"]), "ts")
    query = counts.writeStream.format("memory").queryName("windowed").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r.rule_id, r.n) for r in spark.table("windowed").collect()) == [("email", 2), ("ip_address", 1)]


def test_leading_runs_match_as_they_stand(spark):
    """A pattern whose leading run is tried from its begin only has the matches that it has as written."""
    import re

    email = next(r for r in catalog.builtin() if r.id == "email").patterns[0]
    assert r"\G" in catalog.java_pattern(email)
    for p in (r"[a-z]+@?x", r"[a-z@]+@x", r"[a-z]+@x|b", r"[^a]+@", r"[a-z]+.x", r"[a-z]*@", r"[a-z]+?@", "@[a-z]+", r"[a-z]+\b@"):
        assert r"\G" not in catalog.java_pattern(p)
    random.seed(5)
    texts = ["".join(random.choice("ab.@-_*% 가") for _ in range(random.randint(1, 30))) for _ in range(2000)]
    texts += ["a@b.com@c.org", "a@b.com_x@c.org", "a@b.c0m x@y.zz.", "@@a@b.co", "a@.co", "a@b..co.u"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").select("id", F.regexp_extract_all("t", F.lit(catalog.java_pattern(email)), F.lit(0)).alias("m"), F.rlike("t", F.lit(catalog.java_pattern(email))).alias("any"))
    for r in rows.collect():
        assert r.m == re.findall(email, texts[r.id], re.ASCII) and r.any == bool(r.m), texts[r.id]


def test_long_lines_take_seconds(spark):
    """A line of a million letters, one of thousands of findings, one of overlapping candidates, and long records."""
    import time

    from haetae.sources.text import full_text, text_csv_records, text_lines

    began = time.time()
    many = " ".join(f"user{i}@example{i % 7}.com" for i in range(8_000))
    chained = " ".join(["900101-1234568", "220-81-62517", "110-123-456789"] * 40) + " " + "*" * 500
    docs = spark.createDataFrame([(1, "a" * 1_000_000 + "@"), (2, many), (3, chained)], "id long, text string")
    found = {i: [] for i in (1, 2, 3)}
    for r in detect(docs, ["id"]).collect():
        found[r.id].append(r)
    assert not found[1] and len(found[2]) == 8_000
    assert all(many[r.char_start : r.char_end] == r.raw and r.byte_start == r.char_start and r.context_after == many[r.char_end : r.char_end + 20] for r in found[2])
    assert [(r.char_start, r.rule_id) for r in found[3]] == [(f.char_start, f.rule_id) for f in plain.find(chained)]
    masked = {r.id: r.masked for r in mask_text(docs).collect()}
    assert masked[1] == docs.first().text and masked[2].count("*") > 8_000 and masked[3] == plain.mask_line(chained)
    lines = "\n".join(f'{i},"a {i}\nb",x' for i in range(50_000))
    row = spark.createDataFrame([("\n\n" + lines,)], "t string").select(F.size(text_csv_records(F.col("t"))).alias("n"), full_text(text_lines(F.col("t"))).alias("whole")).first()
    assert row.n == 50_002 and row.whole == lines
    assert time.time() - began < 240


def test_offsets_beyond_the_first_block(spark):
    """Places and contexts of findings far into a line with characters of several bytes."""
    for pad in (490, 500, 511, 512, 513, 1023, 1024, 1500):
        text = "가" * (pad - 1) + " user@example.com," + "나" * 700 + " 192.168.0.1"
        rows = detect(spark.createDataFrame([(1, text)], "id long, text string"), ["id"]).collect()
        assert [(r.raw, r.char_start, r.char_end) for r in rows] == [(f.raw, f.char_start, f.char_end) for f in plain.find(text)]
        for r in rows:
            assert r.byte_start == len(text[: r.char_start].encode()) and r.byte_end == len(text[: r.char_end].encode())
            assert r.context_before == text[max(0, r.char_start - 20) : r.char_start] and r.context_after == text[r.char_end : r.char_end + 20]
        assert mask_text(spark.createDataFrame([(text,)], "text string")).first().masked == plain.mask_line(text)


def test_the_digits_of_a_match_are_taken_once_for_its_check(spark):
    """Inside lambdas no expression is shared: a check that asked for them digit by digit replaced a dozen times."""
    from haetae.functions.checks import VALIDATORS, verdict
    from haetae.functions.register import sql_text

    assert [sql_text(verdict(F.col("raw"), v)).count("regexp_replace") for v in VALIDATORS if v != "phone"] == [v not in ("email", "passport", "ip") for v in VALIDATORS if v != "phone"]


def test_a_single_match_begins_where_its_text_first_stands(spark):
    from haetae import patterns, rules
    from haetae.operators.detect import candidates

    own = rules.load('[[rules]]\nid="a"\nlabel="a"\npattern=\'\\b\\d{2}\\b\'\n[[rules]]\nid="b"\nlabel="b"\npattern=\'[a-z]++\\d\'\n')
    assert [patterns.free(patterns.parse(r.patterns[0]).tree) for r in own] == [False, True]
    rows = spark.createDataFrame([("😀x12 12",), ("😀12 ab1",), ("ab1ab1 한ab1",)], "text string").select(candidates(F.col("text"), own).alias("c")).collect()
    assert [[(c["start"], c["rule"], c["raw"]) for c in r["c"]] for r in rows] == [[(1, 1, "x1"), (5, 0, "12")], [(1, 0, "12"), (4, 1, "ab1")], [(0, 1, "ab1"), (3, 1, "ab1"), (8, 1, "ab1")]]


def test_counts_of_rules_build_no_previews(spark):
    """Queries that only count findings by rule work out neither their masked text nor their context."""
    from haetae.plans.queries import QUERIES

    for name in ("residual_identifiers_partial", "residual_documents", "many_rules_documents"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "context_before" not in plan and "masked_preview" not in plan, name


def test_some_fields_are_those_of_all(spark):
    from haetae.operators.many import detect_many

    docs = spark.createDataFrame([(1, "a 900101-1234568\nx u@example.com 010-1234-5678"), (2, None), (3, "4111-1111-1111-1111 10.0.0.1 " * 40)], "doc_id long, text string")
    own = catalog.load('[[rules]]\nid="a"\nlabel="a"\npattern=\'\\d{4}\'\n')
    some = ("rule_id", "confidence", "byte_start")
    as_rows = lambda df: sorted(map(tuple, df.select("doc_id", *some).collect()))
    for mode in ("full", "partial", "replace", "delete"):
        assert as_rows(residual(docs, ["doc_id"], mode=mode, fields=some)) == as_rows(residual(docs, ["doc_id"], mode=mode))
    assert as_rows(detect_many(docs, ["doc_id"], "text", own, some)) == as_rows(detect_many(docs, ["doc_id"], "text", own)) != []
