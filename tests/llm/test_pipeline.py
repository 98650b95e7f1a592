"""The corpus pipeline: each stage against a plain statement of what it keeps, and the whole run."""

import hashlib
import sys
from pathlib import Path

import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).parent))

import corpus_pipeline  # noqa: E402
from haetae.llm import decontaminate, language_id, quality  # noqa: E402
from haetae.llm.common import read_table, shared_dir  # noqa: E402
from test_search import close, groups, plain_fingerprint, plain_scan  # noqa: E402


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows before and after each stage."""
    sf = "/root/testdata/sf0.001"
    docs, out, base = read_table(spark, sf, "documents"), [], tmp_path_factory.mktemp("stages")
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, sf)
        made.write.parquet(str(base / name))
        after = spark.read.parquet(str(base / name))
        out.append((name, docs.collect(), after.collect(), docs.columns, after.columns))
        docs = after
    return sf, out


def key(rows):
    return sorted((r.doc_id, r.text) for r in rows)


def test_order_and_columns(stages):
    assert [n for n, *_ in stages[1]] == ["language_id", "quality", "near_duplicates", "decontamination", "byte_bpe"]
    for name, _, _, before, after in stages[1][:-1]:
        assert before == after, name
    assert all(len(a) <= len(b) for _, b, a, _, _ in stages[1])


def test_language_and_quality(spark, stages):
    sf, out = stages
    docs = read_table(spark, sf, "documents")
    profiles, model = language_id.fit(docs), quality.fit(docs, read_table(spark, sf, "labels"))
    arrow = lambda rows: pa.array([(r.text or "").encode() for r in rows], pa.large_binary())
    lang, score = profiles.predict(arrow(out[0][1]))
    assert key(out[0][2]) == key([r for r, x, s in zip(out[0][1], lang, score) if x != "und" and s >= 0.15])
    good = model.scorer()(arrow(out[1][1]))
    assert key(out[1][2]) == key([r for r, s in zip(out[1][1], good) if s >= 0.3])
    marks = {r.doc_id: r.quality for r in read_table(spark, sf, "labels").collect()}
    kept = {r.doc_id for r in out[1][2]}
    clean = [r.doc_id for r in out[1][1] if marks.get(r.doc_id) == 1]
    assert sum(i in kept for i in clean) >= 0.97 * len(clean)


def test_near_duplicates(stages):
    _, before, after, _, _ = stages[1][2]
    before = sorted(before, key=lambda r: r.doc_id)
    root = groups([plain_fingerprint(r.text) for r in before], close)
    assert key(after) == key([r for i, r in enumerate(before) if root[i] == i])


def test_decontamination(spark, stages):
    sf, out = stages
    items = [(r.item_id, r.text) for r in read_table(spark, sf, "benchmark").collect()]
    _, before, after, _, _ = out[3]
    assert key(after) == key([r for r in before if not plain_scan([(r.doc_id, r.text)], items)[0][5]])
    assert decontaminate.WINDOW == 10


def test_tokens_and_run(spark, stages):
    sf, out = stages
    _, before, after, _, columns = out[4]
    assert columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {r.doc_id: r.decoded_sha256 for r in after} == {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in before}
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, after))
    assert corpus_pipeline.ORACLE_SQL is None and shared_dir(spark)


def test_edges(spark, edge):
    """Every stage takes nulls, empty texts, repeated rows, clashing columns and no rows at all."""
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, edge, "/root/testdata/sf0.001")
        assert made.count() <= edge.count(), name
        assert stage(spark, edge.limit(0), "/root/testdata/sf0.001").count() == 0, name
        if name != "byte_bpe":
            assert made.schema == edge.schema
