"""Toxicity by a factorization machine over hashed terms: weights of terms and of pairs of terms."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haetae.llm.common import Hasher, add_columns, arrow_texts, crc_bucket, flat, slices, word_spans
from haetae.llm.sampling import labelled_sample

#: Labelled documents of each class that are learnt from: the bound of the sample.
PER_CLASS = 3000
#: Buckets of hashed terms, latent factors of each, and the value of a term that a text has.
BITS, FACTORS, VALUE = 18, 8, 0.5
#: Pull to zero of the weight and of the factors of a term that alone does not tell the classes apart. Fixed values.
PULL_WEIGHT, PULL_FACTORS = 0.01, 0.003
#: A word is a term, and so are its first 4, 5 and 6 bytes if it is longer.
PREFIXES = (4, 5, 6)


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of the distinct terms of each text, sorted."""
    data, starts = flat(texts)
    low, begin, end, owner = word_spans(data, starts)
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hasher, found = Hasher(low), []
    for n in (0, *PREFIXES):
        long = end - begin > n if n else np.ones(len(begin), bool)
        h = hasher(begin[long], begin[long] + n if n else end[long], n + 1)
        found.append((owner[long].astype(np.uint64) << np.uint64(BITS)) | (h >> np.uint64(64 - BITS)))
    keys = np.concatenate(found)
    keys.sort()
    keys = keys[np.r_[True, keys[1:] != keys[:-1]]]
    return (keys >> np.uint64(BITS)).astype(np.int64), (keys & np.uint64((1 << BITS) - 1)).astype(np.int64)


@dataclasses.dataclass
class Model:
    """``slot[bucket]``: row of ``weights`` and ``factors``, 0 (all zero) for terms that were too rare to learn or tell nothing."""

    slot: np.ndarray
    weights: np.ndarray
    factors: np.ndarray
    bias: float

    def margin(self, owner: np.ndarray, slot: np.ndarray, n: int) -> np.ndarray:
        """bias + sum of w_i x_i + half the sum over factors of (sum of v_i x_i)**2 - sum of (v_i x_i)**2."""
        v = self.factors[slot] * VALUE
        linear = np.bincount(owner, self.weights[slot] * VALUE, n)
        pairs = sum(np.bincount(owner, v[:, f], n) ** 2 for f in range(v.shape[1])) - np.bincount(owner, (v * v).sum(1), n)
        return self.bias + linear + pairs / 2

    def score(self, texts: pa.Array) -> np.ndarray:
        owner, bucket = terms(texts)
        slot = self.slot[bucket]
        known = slot > 0
        return 1 / (1 + np.exp(-np.clip(self.margin(owner[known], slot[known], len(texts)), -30, 30)))


class _Batch:
    """Texts of one step and their terms, with where each text's and each term's entries begin, so that sums need no sorting."""

    def __init__(self, texts: np.ndarray, starts: np.ndarray, slots: np.ndarray) -> None:
        lengths = starts[texts + 1] - starts[texts]
        take = np.repeat(starts[texts] - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(lengths.sum())
        self.texts, self.slots, self.owner = texts, slots[take], np.repeat(np.arange(len(texts)), lengths)
        self.some = lengths > 0
        self.begins = (np.cumsum(lengths) - lengths)[self.some]
        self.order = np.argsort(self.slots, kind="stable")
        self.used, self.firsts = np.unique(self.slots[self.order], return_index=True)

    def by_text(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.texts), *values.shape[1:]))
        if len(self.begins):
            out[self.some] = np.add.reduceat(values, self.begins, axis=0)
        return out

    def by_term(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values[self.order], self.firsts, axis=0) if len(self.firsts) else values[:0]


def train(texts: list[str], labels: list[int], rounds: int = 12, rate: float = 0.15, l2: float = 1e-4, least: int = 5, sure: float = 3.5, seed: int = 1) -> Model:
    """Adagrad on the log loss in mini-batches, the same ones in another order each round; both classes weigh the same.

    All terms take part that ``least`` texts have. Those whose shares in the two classes differ by less than ``sure``
    standard errors may still tell in pairs, but most are made-up or rare words that would be learnt by heart: each
    step pulls their weight (lasso) and their factors (group lasso) towards zero, where they stay unless the loss
    keeps pulling the other way.
    """
    y = np.array(labels, float)
    owner, bucket, at = [], [], 0
    arr = arrow_texts(pa.array(texts, pa.large_string()))
    for a, b in slices(arr):
        o, k = terms(arr.slice(a, b - a))
        owner.append(o + at)
        bucket.append(k)
        at += b - a
    owner, bucket = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (owner, bucket))
    have = np.stack([np.bincount(bucket[y[owner] == k], minlength=1 << BITS) for k in (0, 1)]) if len(y) else np.zeros((2, 1 << BITS))
    size, both = np.maximum([(y == 0).sum(), (y == 1).sum()], 1), have.sum(0)
    spread = np.sqrt(np.maximum(both / size.sum() * (1 - both / size.sum()), 1e-12) * (1 / size).sum())
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(1 << BITS, np.int32), np.zeros(1), np.zeros((1, FACTORS)), 0.0 if not len(y) else (3.0 if y[0] else -3.0))
    seen = both >= least
    weak = np.r_[False, np.abs(have[1] / size[1] - have[0] / size[0])[seen] < (sure * spread)[seen]]
    slot = np.where(seen, np.cumsum(seen), 0).astype(np.int32)
    n, random = int(seen.sum()) + 1, np.random.default_rng(seed)
    model = Model(slot, np.zeros(n), random.normal(0, 0.1, (n, FACTORS)), 0.0)
    model.factors[0] = 0
    owner, slots = owner[seen[bucket]], slot[bucket[seen[bucket]]]
    starts = np.searchsorted(owner, np.arange(len(y) + 1))
    share = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    gw, gv, gb = np.full(n, 1e-6), np.full((n, FACTORS), 1e-6), 1e-6
    batches = [_Batch(chunk, starts, slots) for chunk in np.array_split(random.permutation(len(y)), max(1, len(y) // 64))]
    for _ in range(rounds):
        for i in random.permutation(len(batches)):
            batch = batches[i]
            v = model.factors[batch.slots]
            linear, sums = batch.by_text(model.weights[batch.slots]) * VALUE, batch.by_text(v) * VALUE
            margin = model.bias + linear + ((sums * sums).sum(1) - batch.by_text((v * v).sum(1)) * VALUE**2) / 2
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[batch.texts]) * share[batch.texts] / len(batch.texts)
            used, e = batch.used, (error * VALUE)[batch.owner]
            dw = batch.by_term(e) + l2 * model.weights[used]
            dv = batch.by_term(e[:, None] * (sums[batch.owner] - v * VALUE)) + l2 * model.factors[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            gb += error.sum() ** 2
            model.weights[used] -= rate * dw / np.sqrt(gw[used])
            model.factors[used] -= rate / 4 * dv / np.sqrt(gv[used])
            model.bias -= rate * error.sum() / np.sqrt(gb)
            used = used[weak[used]]
            w, v = model.weights[used], model.factors[used]
            model.weights[used] = np.sign(w) * np.maximum(np.abs(w) - rate * PULL_WEIGHT / np.sqrt(gw[used]), 0)
            step = rate / 4 * PULL_FACTORS / np.sqrt(gv[used].mean(1))
            model.factors[used] = v * np.maximum(1 - step / np.maximum(np.sqrt((v * v).sum(1)), 1e-12), 0)[:, None]
    left = (model.weights != 0) | model.factors.any(1)
    left[0] = True  # the row of unknown terms; other rows of zeros change no score
    return Model((np.cumsum(left) - 1)[np.where(left[slot], slot, 0)].astype(np.int32), model.weights[left], model.factors[left], model.bias)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS) -> Model:
    """Learn from at most ``per_class`` labelled rows of each class whose crc32(id as text) mod 5 isn't 0."""
    texts, marks, _ = labelled_sample(docs, labels, id_col, text_col, label_col, per_class)
    return train(texts, marks)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", at: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; null counts as an empty text, which has a score as well.

    A null id isn't held out. Repeated rows score alike, other columns are not read, an empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by 2**BITS buckets

    def make() -> Callable[[pa.Array], dict[str, Any]]:
        own = held.value
        return lambda texts: {"score": own.score(texts)}

    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(crc_bucket(id_col, 5) == 0, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return add_columns(base, "text", "score double", make, ["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= at).cast("int"))
