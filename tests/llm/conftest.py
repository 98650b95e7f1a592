import zlib

import pytest
from pyspark.sql import functions as F

#: Text columns as they come: nulls, empty and very long texts, ties, repeated rows.
TEXTS = [(1, "The quick brown fox jumps over the lazy dog and runs away from it."), (2, None), (3, ""), (None, "no id here at all"), (4, "word " * 30_000), (5, "12 34 ¿? 🎉"), (5, "12 34 ¿? 🎉"), (6, "tie"), (7, "tie"), (8, "Ünïcode ▁ text\x00 with \r\n odd\t bytes 가나다")]


@pytest.fixture(scope="session")
def edge(spark):
    """Documents with every edge case, and extra columns whose names clash with results."""
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    return df.withColumns({c: F.lit("x") for c in ("score", "fp", "n_tokens", "label", "spans", "root", "digest", "held_out")})


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


def held(doc_id, mod, rest):
    return zlib.crc32(str(doc_id).encode()) % mod == rest
