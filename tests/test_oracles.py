"""Every query against its DuckDB statement on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from haetae.plans.oracles import ORACLES
from haetae.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    made = duckdb.connect()
    for t in TABLES:
        made.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return made


def test_each_query_has_a_statement():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_as_duckdb(spark, con, name):
    made = QUERIES[name](spark, SF)
    cursor = con.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(made.columns)
    assert sorted(map(str, cursor.fetchall())) == sorted(map(str, (tuple(r[c] for c in columns) for r in made.collect())))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_optional_parts_may_be_gone(tmp_path):
    """Without the optional folder, with the pipeline's file or without, the entry point still imports; an error inside them is not hidden."""
    import os
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__spark_entry__.__file__).resolve().parent
    shutil.copytree(root / "haetae", tmp_path / "haetae", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    env = {**os.environ, "PYTHONPATH": os.pathsep.join(p for p in sys.path if p and Path(p).resolve() != root), "PYTHONSAFEPATH": ""}
    run = lambda code: subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    count = "import __spark_entry__ as e; print(e.__file__, len(e.queries()), len(e.oracle_sql()))"
    mine = [str(tmp_path / "__spark_entry__.py"), str(len(QUERIES)), str(len(ORACLES))]
    (tmp_path / "corpus_pipeline.py").write_text("from haetae.llm import bpe")
    for gone in (None, tmp_path / "haetae" / "llm", tmp_path / "corpus_pipeline.py"):
        if gone and gone.suffix:
            gone.unlink()
        elif gone:
            (gone / "__pycache__").mkdir(parents=True)  # what a deletion may leave
        done = run(count)
        assert done.stdout.split() == mine, done.stderr
    (tmp_path / "haetae" / "llm" / "__init__.py").write_text("")
    (tmp_path / "haetae" / "llm" / "queries.py").write_text("import nothing_of_this_name")
    assert "nothing_of_this_name" in run("import __spark_entry__ as e; e.queries()").stderr
