"""Quality by compression: zstandard dictionaries of good and of bad text, and a calibrated score of the size difference."""

from __future__ import annotations

import dataclasses
from collections import Counter
from collections.abc import Callable
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haetae.llm.common import add_columns, add_private, crc_bucket
from haetae.llm.sampling import labelled_sample

#: Labelled documents of each class that are learnt from: the bound of the sample.
PER_CLASS = 1500
DICTIONARY_BYTES, LEVEL, SLICE = 110_000, 3, 250
KEEP = 0.3
#: Features of a text, all of them differences of its sizes under the two dictionaries.
FEATURES = 13


@dataclasses.dataclass
class Model:
    """Two dictionaries, weights of what they differ by on a text, and the curve (slope, offset) that calibrates their sum."""

    good: bytes
    bad: bytes
    weights: np.ndarray
    center: np.ndarray
    scale: np.ndarray
    curve: np.ndarray

    def compressors(self) -> tuple[Any, Any]:
        import zstandard

        options = {"write_checksum": False, "write_content_size": False, "write_dict_id": False}
        made = []
        for content in (self.good, self.bad):
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_AUTO)
            held.precompute_compress(level=LEVEL)
            made.append(zstandard.ZstdCompressor(dict_data=held, **options))
        return made[0], made[1]

    def margin(self, x: np.ndarray) -> np.ndarray:
        return (x - self.center) / self.scale @ self.weights[:-1] + self.weights[-1]

    def scorer(self) -> Callable[[pa.Array], np.ndarray]:
        tools = self.compressors()
        return lambda texts: curve(self.margin(features([t.as_py() for t in texts], tools)), self.curve)


def curve(margin: np.ndarray, at: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(at[0] * margin + at[1], -30, 30)))


def features(texts: list[bytes], tools: tuple[Any, Any]) -> np.ndarray:
    """Per text: the difference of the sizes under the bad and the good dictionary, normalised by their sum and by the text.

    A text is compressed in slices of ``SLICE`` bytes, so that each meets the dictionaries and not the rest of the
    text. The differences of all slices together count, and the least, the greatest and quartiles of the slices'.
    """
    out = np.zeros((len(texts), FEATURES))
    for i, text in enumerate(texts):
        cut = [text[a : a + SLICE] for a in range(0, len(text), SLICE)] or [b""]
        sizes = np.array([[len(tool.compress(x)) for tool in tools] for x in cut], float)
        gap, both, n = sizes[:, 1] - sizes[:, 0], sizes.sum(1), np.array([len(x) + 20.0 for x in cut])
        whole, per_byte = gap.sum() / both.sum(), gap.sum() / n.sum()
        a, b, k = np.sort(gap / both), np.sort(gap / n), len(cut)
        out[i] = (whole, whole * abs(whole), a[0], a[-1], a[k // 2], per_byte, per_byte * abs(per_byte), b[0], b[-1], b[k // 4], b[k // 2], b[3 * k // 4], np.minimum(b, 0.03).mean())
    return out


def train(texts: list[bytes], labels: list[int], totals: dict[int, int] | None = None) -> Model:
    """Dictionaries from three tenths of the texts, weights from half of them, and the calibrating curve from the last fifth.

    Weights are learnt with both classes alike; the curve with each class as heavy as it is among all labels
    (``totals``), so that a score is the share of label 1 to be expected.
    """
    y = np.array(labels, float)
    turn = np.zeros(len(y), int)
    for k in (0, 1):
        turn[y == k] = np.arange(int((y == k).sum())) % 10
    first = turn < 3
    model = Model(dictionary([t for t, a, k in zip(texts, y, first) if a == 1 and k]), dictionary([t for t, a, k in zip(texts, y, first) if a == 0 and k]), np.zeros(FEATURES + 1), np.zeros(FEATURES), np.ones(FEATURES), np.array([1.0, 0.0]))
    second, third = (turn >= 3) & (turn < 8), turn >= 8
    if len(y) and all(0 < y[part].mean() < 1 for part in (second, third) if part.any()) and second.any() and third.any():
        x = features([t for t, k in zip(texts, first) if not k], model.compressors())
        of = lambda part: x[part[~first]]
        model.center, model.scale = of(second).mean(0), of(second).std(0) + 1e-9
        model.weights = logistic((of(second) - model.center) / model.scale, y[second], 0.5)
        share = totals[1] / (totals[0] + totals[1]) if totals and totals.get(0) and totals.get(1) else y.mean()
        model.curve = logistic(model.margin(of(third))[:, None], y[third], share)
    return model


def dictionary(texts: list[bytes]) -> bytes:
    """A zstandard dictionary of ``texts``; too few or too small ones are taken as they are.

    Lines that several texts share are left out: a passage that is passed on says nothing about quality, but a
    text that has it would compress as if it repeated itself.
    """
    import zstandard

    shared = Counter(line for t in texts for line in set(t.split(b"\n")) if len(line) > 20)
    texts = [b"\n".join(line for line in t.split(b"\n") if shared[line] < 2) for t in texts] if shared else texts
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [t[i : i + 4000] for t in texts for i in range(0, len(t), 4000)]).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[-DICTIONARY_BYTES:] or b"\n" * 16


def logistic(x: np.ndarray, y: np.ndarray, share: float, l2: float = 0.03, rounds: int = 60) -> np.ndarray:
    """Newton's method with step halving; label 1 weighs ``share`` of all. The last weight is the bias."""
    x = np.c_[x, np.ones(len(x))]
    heavy = np.where(y == 1, share / max(y.sum(), 1), (1 - share) / max((1 - y).sum(), 1)) * len(y)
    loss = lambda w: float((heavy * np.logaddexp(0, np.where(y == 1, -1, 1) * (x @ w))).sum() + l2 / 2 * w @ w)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (heavy * p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w)), x.T @ (heavy * (p - y)) + l2 * w)
        now = loss(w)
        while loss(w - step) > now and np.abs(step).max() > 1e-9:
            step /= 2
        w = w - step
        if np.abs(step).max() < 1e-7:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = PER_CLASS) -> Model:
    """Learn from at most ``per_class`` labelled rows of each class whose crc32(id as text) mod 5 isn't 0."""
    texts, marks, totals = labelled_sample(docs, labels, id_col, text_col, label_col, per_class)
    return train([t.encode() for t in texts], marks, totals)


def _kernel(docs: DataFrame, model: Model) -> Callable[[], Callable[[pa.Array], dict[str, Any]]]:
    held = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of DICTIONARY_BYTES

    def make() -> Callable[[pa.Array], dict[str, Any]]:
        score = held.value.scorer()
        return lambda texts: {"quality_score": score(texts)}

    return make


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; null counts as an empty text, which has a score as well.

    A null id isn't held out. Repeated rows score alike, other columns are not read, an empty table gives no rows.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(crc_bucket(id_col, 5) == 0, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    made = add_columns(base, "text", "quality_score double", _kernel(docs, model), ["doc_id", "held_out"])
    return made.select("doc_id", "held_out", F.col("quality_score").alias("score"), (F.col("quality_score") >= keep).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """The rows of ``docs``, all columns, that score ``keep`` or more; a null text scores as an empty one, ids don't matter."""
    made = add_private(docs, text_col, "quality_score double", _kernel(docs, model))
    return made.filter(made.private("quality_score") >= keep).done()
