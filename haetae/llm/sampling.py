"""Bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haetae.llm.common import crc_bucket


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_class: int) -> tuple[list[str], list[int], dict[int, int]]:
    """Whole texts and labels of at most ``per_class`` ids each of label 0 and 1, and how many ids have each label in all.

    Only ids whose crc32 as text mod 5 isn't 0 are taken, the first by a hash of the id. The ids are chosen from
    the labels alone, so that just the chosen few meet the documents: 2 * ``per_class`` ids are broadcast. Rows
    with a null id, label or text are left out, a repeated label counts once. Of several texts under one id the
    least counts, so the driver gets one text for each chosen id and the same ones in each run.
    """
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("mark")).filter(F.col("id").isNotNull() & F.col("mark").isin(0, 1) & (crc_bucket("id", 5) != 0))
    marks = marks.groupBy("id", "mark").count()
    order = [F.xxhash64("id", F.lit(5)), "id"]
    chosen = [r for mark in (0, 1) for r in marks.filter(F.col("mark") == mark).orderBy(*order).limit(per_class).select("id", "mark").collect()]
    if not chosen:
        return [], [], {}
    totals = {r["mark"]: r["n"] for r in marks.groupBy("mark").agg(F.count("*").alias("n")).collect()}
    ids = docs.sparkSession.createDataFrame(chosen, marks.select("id", "mark").schema)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    found = texts.join(F.broadcast(ids), "id").groupBy("id", "mark").agg(F.min("text").alias("text"))
    rows = sorted(found.collect(), key=lambda r: (r["id"], r["mark"]))
    return [r["text"] for r in rows], [r["mark"] for r in rows], totals
