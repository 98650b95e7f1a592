"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haetae.llm.common import cut_lineage

#: Queries that are broadcast at once; dimensions that a candidate is looked at in before its first test, and more before each next.
AT_ONCE, FIRST, MORE = 16384, 24, 8
_LONG = 1 << 63


class Reads:
    """What a search has looked at: candidates met, values read of them, and candidates scored in full."""

    def __init__(self) -> None:
        self.met = self.values = self.full = 0


class Lists:
    """A block of candidate vectors of one dimension, with a sorted list of them for each component."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.vectors = ids, vectors
        self.order = np.argsort(vectors, axis=0, kind="stable")
        self.sorted = np.take_along_axis(vectors, self.order, 0)
        self.peak = np.abs(vectors).max() if vectors.size else 0.0
        self.by_dimension = np.ascontiguousarray(vectors.T)
        self.norms = (vectors * vectors).sum(1)
        self.spread = vectors.std(0) if vectors.size else np.zeros(vectors.shape[1])
        self.reads = Reads()

    def hopeful(self, new: np.ndarray, query: np.ndarray, weight: np.ndarray, kth: float) -> np.ndarray:
        """Those of ``new`` that may score ``kth`` or more.

        Dimensions are read by falling ``weight``. What the others can still add is at most the product of the
        lengths of both rests (Cauchy-Schwarz), so a candidate goes as soon as its sum so far and that fall short.
        """
        self.reads.met += len(new)
        if kth == -np.inf or len(query) <= FIRST:
            self.reads.values += len(new) * len(query)
            return new
        so_far, left, at = np.zeros(len(new)), self.norms[new], 0
        rest = float(query @ query)
        while at < len(query) and len(new):
            dims = weight[at : at + (MORE if at else FIRST)]
            q = query[dims]
            read = self.by_dimension[dims[:, None], new]
            so_far += q @ read
            left -= np.einsum("ij,ij->j", read, read)
            self.reads.values += len(dims) * len(new)
            rest, at = rest - float(q @ q), at + len(dims)
            most = so_far + np.sqrt(max(rest, 0.0) * np.maximum(left, 0)) * (1 + 1e-9) + 1e-3
            alive = most >= kth
            new, so_far, left = new[alive], so_far[alive], left[alive]
        return new

    def top(self, own: int, query: np.ndarray, k: int, first: int = 2, kth: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """Positions and scores of the ``k`` best candidates but those with id ``own``; ties go to the smaller id.

        Lists are read in step, from the end that the sign of the query's component favours; what turns up new and
        is ``hopeful`` is scored in full. A candidate not seen yet scores at most the inner product of the query with the last
        values read, and at most the product of both lengths. Reading stops when the kth score is above that bound; at an equal score an unseen
        candidate might have the smaller id. Candidates under ``kth``, which others have reached, may be left out.
        """
        n = len(self.ids)
        if query.size and query.size * self.peak * np.abs(query).max() >= 2**53:
            return self.top_of_large(own, query, k)
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        weight = np.argsort(-np.abs(query) * self.spread, kind="stable")
        longest = np.sqrt(float(query @ query) * self.norms.max()) * (1 + 1e-9) + 1e-3 if n else 0.0
        seen = self.ids == own
        best, scores, at, step = np.zeros(0, np.int64), np.zeros(0), 0, first
        while at < n and longest >= kth:
            to = min(n, at + step)
            fresh = np.zeros(n, bool)
            if to * (len(up) + len(down)) >= 4 * n or not len(up) + len(down):  # hardly one is left that no list has shown
                fresh[:] = True
                to = n
            else:
                fresh[self.order[n - to : n - at, up]] = True
                fresh[self.order[at:to, down]] = True
            fresh &= ~seen
            seen |= fresh
            new = self.hopeful(np.flatnonzero(fresh), query, weight, kth)
            self.reads.full += len(new)
            best, scores = np.concatenate([best, new]), np.concatenate([scores, self.vectors[new] @ query])
            if len(best) > k:
                least = np.partition(scores, len(scores) - k)[len(scores) - k]
                best, scores = best[scores >= least], scores[scores >= least]
                order = np.lexsort((self.ids[best], -scores))[:k]
                best, scores = best[order], scores[order]
            if len(best) >= k:
                kth = max(kth, scores.min())
            if to < n and kth > min(longest, self.sorted[n - to, up] @ query[up] + self.sorted[to - 1, down] @ query[down]):
                break
            at, step = to, 4 * step
        return best, scores

    def top_of_large(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, list[int]]:
        """The same where doubles could round: every candidate in Python's integers."""
        q = [int(x) for x in query]
        scores = {i: max(-_LONG, min(_LONG - 1, sum(int(x) * y for x, y in zip(row, q)))) for i, row in enumerate(self.vectors) if self.ids[i] != own}
        best = sorted(scores, key=lambda i: (-scores[i], self.ids[i]))[:k]
        return np.array(best, np.int64), [scores[i] for i in best]


def _whole(vectors: list[list[float]] | pa.Array, n: int, dim: int) -> np.ndarray:
    """floor(1024 x) of ``n`` vectors of ``dim`` components, as doubles."""
    values = vectors.flatten().to_numpy(zero_copy_only=False) if isinstance(vectors, pa.Array) else np.array(vectors, np.float64)
    return np.floor(1024 * values.astype(np.float64)).reshape(n, dim)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", at_once: int = AT_ONCE) -> DataFrame:
    """query_id, rank, vec_id and score: for each query the ``k`` best rows of ``vectors`` by integer inner product.

    Both tables have ``id_col`` and ``vector_col``; components are floor(1024 x). Rows of the query's own id are
    no candidates of it. Null vectors, those with a null or non-finite component, and rows without an id take no
    part. Vectors meet only those of as many components. A query row that is there several times counts once
    (of several vectors under one id the least counts), repeated candidates count each. Scores beyond a long
    count as the nearest long. Empty tables give no rows.

    Queries are dealt to blocks of about ``at_once``, each broadcast by itself and done with before the next one;
    each Arrow batch of candidates is a block of sorted lists. A task carries the ``k`` best of each query, and so the score to be
    reached, from batch to batch, and returns them at its end: only these are shuffled.
    """
    spark = vectors.sparkSession
    fine = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    asked = cut_lineage(fine(queries).groupBy("id").agg(F.min("v").alias("v")))
    blocks = max(1, math.ceil(asked.count() / at_once))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    parts = []
    for i in range(blocks):
        chosen = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i)
        held = spark.sparkContext.broadcast(sorted((r["id"], r["v"]) for r in chosen.collect()))
        found = fine(vectors).mapInArrow(_search(held, k), "query_id long, vec_id long, score long")
        found = found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if blocks > 1:
            found = cut_lineage(found)
            held.destroy()
        parts.append(found)
    found = parts[0]
    for part in parts[1:]:
        found = found.unionAll(part)
    return found


def _search(held: Any, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The ``k`` best of a task's rows for each of the queries (id, vector) that ``held`` broadcasts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[int, list[int]] = {}
        whole = [(own, _whole([v], 1, len(v))[0]) for own, v in held.value]
        for i, (_, v) in enumerate(whole):
            asked.setdefault(len(v), []).append(i)
        ids: list[np.ndarray] = [np.zeros(0, np.int64)] * len(whole)
        scores: list[list[int]] = [[]] * len(whole)
        for batch in batches:
            column, given = batch.column(1), batch.column(0).to_numpy()
            dims = np.array(column.value_lengths())
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                lists = Lists(given[rows], _whole(column.take(pa.array(rows)), len(rows), int(dim))) if dim in asked else None
                for i in asked.get(dim, ()):
                    own, v = whole[i]
                    best, more = lists.top(own, v, k, kth=scores[i][-1] if len(scores[i]) == k else -np.inf)
                    if len(best):
                        both, all_ids = [*scores[i], *(int(s) for s in more)], np.concatenate([ids[i], lists.ids[best]])
                        order = sorted(range(len(both)), key=lambda j: (-both[j], all_ids[j]))[:k]
                        ids[i], scores[i] = all_ids[order], [both[j] for j in order]
        for a in range(0, len(whole), 4096):
            n = [len(x) for x in scores[a : a + 4096]]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat([own for own, _ in whole[a : a + 4096]], n), pa.int64()), pa.array(np.concatenate(ids[a : a + 4096]), pa.int64()), pa.array([s for part in scores[a : a + 4096] for s in part], pa.int64())], names=["query_id", "vec_id", "score"])

    return run
