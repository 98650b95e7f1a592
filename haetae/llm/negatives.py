"""Hard negatives: each anchor's positives cut the scores into disjoint slots, and what is best in each slot answers all windows."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haetae.llm.common import cut_lineage

#: Anchors that are broadcast at once, and scores that a task holds at once.
AT_ONCE, SCORES = 16384, 1 << 21
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def limits(positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of a negative: half and 95 % of the positive's, in whole numbers."""
    return -((-positive) // 2), positive - -((-positive) // 20)


class Best:
    """The ``k`` best (score, id) of each of ``groups``: higher scores first, ties by smaller id."""

    def __init__(self, groups: int, k: int) -> None:
        self.k = k
        self.group, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.kth = np.full(groups, _LEAST, np.int64)  # what a newcomer must reach

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(group):
            return
        group, score, ids = np.concatenate([self.group, group]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, ~score, group))  # ~ turns the order round without leaving a long
        group = group[order]
        first = np.searchsorted(group, group, "left")
        kept = np.arange(len(group)) - first < self.k
        self.group, self.score, self.id = group[kept], score[order][kept], ids[order][kept]
        last = np.flatnonzero(np.arange(len(group)) - first == self.k - 1)
        self.kth[group[last]] = score[order][last]


def _scores(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``x`` with those of ``y``, exact; beyond a long the nearest long."""
    if x.shape[1] * np.abs(x).max(initial=0) * np.abs(y).max(initial=0) < 2**53:
        return (x @ y.T).astype(np.int64)
    whole = [[int(v) for v in row] for row in y]
    return np.array([[max(_LEAST, min(_MOST, sum(a * b for a, b in zip(mine, row)))) for row in whole] for mine in ([int(v) for v in r] for r in x)], np.int64).reshape(len(x), len(y))


Pick = Callable[[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray], None]


def _search(held: Any, groups: int, k: int, pick: Callable[[dict, Best], Pick]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The ``k`` best of a task's rows in each of ``groups`` groups of each anchor; ``pick`` chooses what is offered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = held.value
        best = Best(len(anchors["id"]) * groups, k)
        offer = pick(anchors, best)
        for batch in batches:
            ids, labels, column = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            sizes = np.array(column.value_lengths())
            for size in np.unique(sizes):
                if int(size) not in anchors["of"]:
                    continue
                mine, theirs = np.flatnonzero(sizes == size), anchors["of"][int(size)]
                x = column.take(pa.array(mine)).flatten().to_numpy(zero_copy_only=False).reshape(len(mine), int(size))
                for a in range(0, len(theirs[0]), AT_ONCE):
                    y, at = theirs[1][a : a + AT_ONCE], theirs[0][a : a + AT_ONCE]
                    step = max(1, SCORES // len(at))
                    for b in range(0, len(mine), step):
                        rows = mine[b : b + step]
                        offer(int(size), _scores(x[b : b + step], y), at, ids[rows], labels[rows])
        yield pa.RecordBatch.from_arrays([pa.array(anchors["id"][best.group // groups], pa.int64()), pa.array(best.group % groups, pa.int32()), pa.array(best.id, pa.int64()), pa.array(best.score, pa.int64())], names=["anchor_id", "slot", "other_id", "score"])

    return run


def _pick_positives(anchors: dict, best: Best) -> Pick:
    """Rows of the anchor's label, but its own."""

    def offer(size: int, scores: np.ndarray, at: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        near = (labels[:, None] == anchors["label"][at]) & (ids[:, None] != anchors["id"][at]) & (scores >= best.kth[at])
        if np.count_nonzero(near) > 4 * best.k * len(at):  # the rest of these rows can't be among the best
            near &= scores >= np.partition(np.where(near, scores, _LEAST), len(ids) - best.k, 0)[len(ids) - best.k]
        row, column = np.nonzero(near)
        best.add(at[column], scores[row, column], ids[row])

    return offer


def _pick_negatives(anchors: dict, best: Best) -> Pick:
    """Rows of other labels, each in the slot of the least upper limit that it does not pass.

    Slot j holds the scores above limit j + 1 and up to limit j. Windows that reach into slot j are those of positives
    1 to j, the jth of which has the least lower limit.
    """
    low, high = anchors["low"], anchors["high"]
    slots = high.shape[1]

    def offer(size: int, scores: np.ndarray, at: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        least = np.maximum(low, best.kth.reshape(-1, slots)).min(1)
        row, column = np.nonzero((labels[:, None] != anchors["label"][at]) & (scores >= least[at]) & (scores <= high[at, 0]))
        score, anchor = scores[row, column], at[column]
        slot = (score[:, None] <= high[anchor]).sum(1) - 1
        group = anchor * slots + slot
        kept = (score >= low[anchor, slot]) & (score >= best.kth[group])
        best.add(group[kept], score[kept], ids[row[kept]])

    return offer


def _anchors(ids: np.ndarray, labels: np.ndarray, vectors: pa.Array) -> dict:
    """Anchors for a broadcast; ``of`` has their positions and vectors by number of components."""
    sizes = np.array(vectors.value_lengths())
    of = {int(s): (at := np.flatnonzero(sizes == s), vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), int(s))) for s in np.unique(sizes)}
    return {"id": ids, "label": labels, "of": of}


def mine(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: float = 256.0, at_once: int = AT_ONCE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    A score is the integer inner product of two vectors of floor(``scale`` * x); higher ones come first, ties by smaller
    id. An anchor's positives are its first ``positives`` other rows of the same label. For each the first ``negatives``
    rows of other labels are returned whose score is from 50 to 95 % of the positive's.

    Rows with a null id, label or vector, or with a null or non-finite component, take no part; vectors meet only those of
    as many components. Rows of the anchor's own id are no partners of it. An anchor that is there several times counts
    once (the least label and vector), repeated other rows count each. Scores beyond a long count as the nearest long.
    Anchors without positives, or whose positives have no such negatives, have no rows; empty tables give none. Other
    columns are not read.

    Anchors are broadcast in blocks of about ``at_once``, each done with and checkpointed before the next one. A block
    takes two narrow passes over the rows, wherever they are and however a label is spread: the first keeps the best
    positives of each anchor in a task, the second what is best in each slot. Only these few are shuffled. The slots of
    an anchor are disjoint and in order, so a positive's negatives are the first of the suffix that begins at its slot.
    """
    spark = vectors.sparkSession
    cols = F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v")
    finite = lambda df: df.select(*cols).filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    fine = lambda df: finite(df).select("id", "label", F.transform("v", lambda x: _floor(x * F.lit(scale))).alias("v"))
    rows = fine(vectors)
    asked = cut_lineage(fine(anchors).groupBy("id").agg(F.min(F.struct("label", "v")).alias("least")).select("id", "least.label", "least.v"))
    blocks = max(1, math.ceil(asked.count() / at_once))
    first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "other_id"))
    kinds, parts = "anchor_id long, slot int, other_id long, score long", []
    for i in range(blocks):
        chosen = (asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i)).orderBy("id").toArrow().combine_chunks()
        ids, labels, lists = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in chosen.columns)
        if not len(ids):
            continue
        block = _anchors(ids.to_numpy(), labels.to_numpy(), lists)
        held = spark.sparkContext.broadcast(block)
        found = rows.mapInArrow(_search(held, 1, positives, _pick_positives), kinds)
        found = cut_lineage(found.withColumn("nth", first("anchor_id")).filter(F.col("nth") <= positives).select("anchor_id", (F.col("nth") - 1).alias("nth"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")))
        table = found.select("anchor_id", "nth", "positive_score").toArrow()
        low, high = (np.full((len(ids), positives), fill, np.int64) for fill in (_MOST, _LEAST))
        at = np.searchsorted(block["id"], table["anchor_id"].to_numpy()), table["nth"].to_numpy()
        low[at], high[at] = limits(table["positive_score"].to_numpy())
        held_too = spark.sparkContext.broadcast(block | {"low": low, "high": high})
        best = rows.mapInArrow(_search(held_too, positives, negatives, _pick_negatives), kinds)
        best = best.withColumn("nth", first("anchor_id", "slot")).filter(F.col("nth") <= negatives)
        suffix = best.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("slot", "nth", "other_id", "score"))).alias("best"))
        made = found.join(suffix, "anchor_id").select("anchor_id", "positive_id", "positive_score", F.posexplode(F.slice(F.filter("best", lambda b: b["slot"] >= F.col("nth")), 1, negatives)).alias("at", "b"))
        made = made.filter(F.col("b.score") >= F.shiftright("positive_score", 1) + F.col("positive_score").bitwiseAND(1))  # half of it, rounded up
        made = made.select("anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.other_id").alias("negative_id"), "positive_score", F.col("b.score").alias("negative_score"))
        if blocks > 1:
            made = cut_lineage(made)
            held.destroy()
            held_too.destroy()
        parts.append(made)
    if not parts:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    made = parts[0]
    for part in parts[1:]:
        made = made.unionAll(part)
    return made


def _floor(x: Any) -> Any:
    """The floor of a double as a double: beyond 2**53 every double is whole already."""
    return F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)

