"""Rules as data: the same findings as by expressions, for any number of rules."""

import time

from pyspark.sql import functions as F

from haetae import plain
from haetae import rules as catalog
from haetae.operators.detect import detect
from haetae.operators.many import Matcher, detect_many, masked_lines_many, rules_from
from haetae.operators.mask import masked_lines

TEXT = "계약 900101-1234568, user@example.com\n4111-1111-1111-1111 M12345678 u***@x.org\r\n\n10.0.0.1 2001:db8:0:0:0:0:0:1 010-1234-5678"


def docs(spark):
    made = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    return made.unionByName(spark.createDataFrame([(-1, TEXT), (-2, None), (-3, "")], "doc_id long, text string")).repartition(4)


def test_same_as_by_expressions(spark):
    rules = catalog.builtin()
    few = sorted(map(tuple, detect(docs(spark), ["doc_id"]).collect()))
    assert sorted(map(tuple, detect_many(docs(spark), ["doc_id"], "text", rules).collect())) == few and len(few) > 8
    for mode in ("full", "partial", "replace", "delete"):
        one, other = (sorted((r.doc_id, r.paragraph_index, r.after) for r in made.collect()) for made in (masked_lines(docs(spark), ["doc_id"], mode=mode), masked_lines_many(docs(spark), ["doc_id"], "text", rules, mode)))
        assert one == other


def table(spark, n):
    numbers = spark.range(n)
    return numbers.select(F.format_string("r%05d", "id").alias("id"), F.lit("l").alias("label"), (F.col("id") % 5).cast("int").alias("priority"), F.when(F.col("id") % 3 == 0, "luhn").otherwise("none").alias("validator"), F.lit("").alias("replace_token"), F.lit("phone").alias("partial"), F.array(F.format_string("K%05d-\\d+", "id"), F.format_string("(?:x%d|y%d):[a-z]+", "id", "id")).alias("patterns"))


def test_thousands_of_rules(spark):
    rules = rules_from(table(spark, 3000))
    lines = [(i, f"see K{i % 4000:05d}-{i * 7919} and x{i}:abc, y{i + 1}:de; K{i:05d}-4111111111111111") for i in range(500)]
    df = spark.createDataFrame(lines, "id int, text string")
    began = time.time()
    rows = detect_many(df, ["id"], "text", rules).collect()
    assert time.time() - began < 90
    found: dict = {}
    for r in rows:
        found.setdefault(r.id, []).append((r.rule_id, r.raw, r.confidence, r.char_start, r.masked_preview))
    for i, t in lines[::25]:
        assert sorted(found.get(i, [])) == sorted((f.rule_id, f.raw, f.confidence, f.char_start, f.masked_preview) for f in plain.find(t, rules)), t


def test_plan_does_not_grow_with_the_rules(spark):
    df = docs(spark)
    size = lambda n: len(detect_many(df, ["doc_id"], "text", rules_from(table(spark, n)))._jdf.queryExecution().optimizedPlan().toString())
    assert abs(size(2) - size(2000)) < 200


def test_only_patterns_whose_literals_are_there_run():
    made = Matcher(catalog.load("".join(f"[[rules]]\nid = 'r{i}'\nlabel = 'l'\npattern = 'w{i}\\d+'\n" for i in range(50)) + "[[rules]]\nid = 'any'\nlabel = 'l'\npattern = '\\d{3}'\n").rules)
    assert len(made.always) == 1
    assert [(c["id"], c["raw"]) for c in made.candidates("w7123 w499")] == [("r7", "w7123"), ("any", "712"), ("r4", "w499"), ("r49", "w499"), ("any", "499")]
    assert Matcher(()).candidates("x") == []
