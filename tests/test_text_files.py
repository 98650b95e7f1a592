"""Text, CSV and JSON files without Python nodes, and what is looked through again after masking."""

import json
import random
import time

from pyspark.sql import functions as F

from haetae import rules as catalog
from haetae.functions.escapes import in_json_strings
from haetae.operators.detect import detect
from haetae.operators.mask import changed, mask_text, masked_lines
from haetae.operators.summary import residual, residual_lines
from haetae.plans.process import Config, process
from haetae.sources import files


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def inputs(spark):
    rows = [
        (1, "a.txt", "메일 user@example.com\r\n\n끝 900101-1234568"), (2, "b.csv", 'x,"user@example.com\n4111-1111-1111-1111",y\n"10.0.0.1'), (3, "c.json", '{"a": "user@example.com", "b\\"": 4111111111111111, "c": ["10.0.0.1", "\\\\"], "d": 010-1234-5678}'),
        (4, "d.md", ""), (5, "e.json", '"x\\u0022 user@example.com'), (6, "f.json", "﻿[900101-1234568,\n \"a\n900101-1234568\"]"), (7, "g", "plain 10.0.0.1"), (8, "h.txt", None),
    ]
    return spark.createDataFrame([(i, n, None if t is None else t.encode()) for i, n, t in rows], "id int, filename string, content binary").repartition(3)


FIELDS = ["id", "format", "warnings", "paragraph_count", "findings", "summaries", "diffs", "confirmed", "residual_confirmed", "residual_suspicious", "masked", "output_name"]


def test_expressions_do_what_python_does(spark, monkeypatch):
    for mode in ("full", "replace"):
        native = process(inputs(spark), Config(mode=mode, text_only=True), ("id",))
        assert "Python" not in plan(native)
        mixed = process(inputs(spark), Config(mode=mode), ("id",))
        monkeypatch.setattr(files, "text_kind", lambda name, content: F.lit(None).cast("string"))
        monkeypatch.setattr(files, "TEXTS", ("txt", "csv", "json"))
        slow = process(inputs(spark), Config(mode=mode), ("id",))
        rows = [sorted(map(tuple, made.select(*FIELDS).collect())) for made in (native, mixed, slow)]
        monkeypatch.undo()
        assert rows[0] == rows[1] and [r[:-2] for r in rows[0]] == [r[:-2] for r in rows[2]] and rows[0] == rows[2]


def test_json_stays_json(spark):
    row = {r.id: r.masked for r in process(inputs(spark), Config(mode="full", text_only=True), ("id",)).collect()}
    assert row[3].decode() == '{"a": "****@*******.***", "b\\"": "****************", "c": ["**.*.*.*", "\\\\"], "d": "***-****-****"}'
    assert json.loads(row[3])["c"] == ["**.*.*.*", "\\"]


def reader(text):
    """States of a reader, character by character."""
    inside, skip, out = False, False, []
    for c in text:
        out.append(inside)
        if inside and skip:
            skip = False
        elif inside and c == "\\":
            skip = True
        elif c == '"':
            inside = not inside
    return out


def test_string_states_by_hand(spark):
    rng = random.Random(4)
    texts = ["", '"', '\\"a"', '"\\\\"b', '"\\'] + ["".join(rng.choice('""\\\\ab\n가') for _ in range(rng.randint(1, 40))) for _ in range(400)] + ["".join(rng.choice('"\\abc') for _ in range(3000))]
    df = spark.createDataFrame([(i, t, list(range(len(t)))) for i, t in enumerate(texts)], "i int, t string, at array<int>").repartition(4)
    for r in df.select("i", in_json_strings(F.col("t"), F.col("at")).alias("m")).collect():
        assert r.m == reader(texts[r.i]), texts[r.i]


def test_a_megabyte_of_json_on_one_line(spark):
    body = json.dumps([{"id": i, "mail": f"user{i}@example.com", "note": 'a "quoted" \\ ' + "x" * 60} for i in range(10_000)])
    assert len(body) > 1_000_000 and "\n" not in body
    began = time.time()
    row = process(spark.createDataFrame([("big.json", body.encode())], "filename string, content binary"), Config(mode="full", text_only=True)).select("confirmed", "residual_confirmed", "masked").first()
    assert time.time() - began < 120 and row.confirmed == 10_000 and row.residual_confirmed == 0
    assert [(x["id"], "user" in x["mail"]) for x in json.loads(row.masked)] == [(i, False) for i in range(10_000)]


def test_only_changed_lines_are_looked_through_again(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(-1, "u***@example.com 10.0.0.1\n2001:db8:0:0:0:0:0:1\r\n10.0.0.*\nnothing"), (-2, None)], "doc_id long, text string")
    both = docs.unionByName(more)
    rules = catalog.builtin()
    for mode in ("full", "partial", "replace", "delete"):
        again = detect(mask_text(both, mode=mode), ["doc_id"], "masked", rules)
        assert sorted(map(tuple, residual(both, ["doc_id"], mode=mode).collect())) == sorted(map(tuple, again.collect()))
        assert residual_lines(both, ["doc_id"], "text", mode, rules).filter("changed").count() == changed(masked_lines(both, ["doc_id"], mode=mode)).count()


def test_tokens_with_line_feeds(spark):
    rules = catalog.load("[[rules]]\nid = 'a'\nlabel = 'b'\npattern = 'X\\d'\nreplace_token = \"1\\nX2\"\n")
    df = spark.createDataFrame([(1, "see X1")], "id int, text string")
    assert [(r.paragraph_index, r.raw) for r in residual(df, ["id"], mode="replace", rules=rules).collect()] == [(1, "X2")]


def test_full_texts_of_line_ends_alone(spark, tmp_path):
    """Texts that are empty or all line ends end in a line feed as others do; before, they were nothing, as a missing text is."""
    import duckdb

    from haetae.plans.oracles import ORACLES
    from haetae.plans.queries import QUERIES

    draw = random.Random(5)
    texts = [None, "", "\n", "\r", "\r\n", "\n\n\n", "a", "\na\r\n", "a\r\r", *("".join(draw.choices("\n\r a", k=draw.randint(0, 6))) for _ in range(500))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    made = {r["doc_id"]: r["text_md5"] for r in QUERIES["full_texts"](spark, str(tmp_path)).collect()}
    assert made == dict(con.execute(ORACLES["full_texts"]).fetchall()) and len(made) == len(texts)
    assert len({made[0], made[1], made[6]}) == 3 and made[1] == made[5]
