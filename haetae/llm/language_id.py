"""Language identification by rank-order profiles: out-of-place distance between a text's most frequent n-grams and each language's."""

from __future__ import annotations

import dataclasses
import functools
from collections.abc import Callable
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haetae.llm.common import add_columns, add_private, arrow_texts, crc_bucket, slices

#: N-grams of one to three characters; the most frequent of a text and of a language that are compared.
ORDERS, TOP = (1, 2, 3), 300
#: Labelled documents that a language's profile is learnt from, about: the bound of the sample.
SAMPLE = 1000
UNKNOWN = "und"
#: Values that an id's hash is drawn from, far more than a language has ids.
_DRAWS = 1 << 50
_ROW, _GRAM = np.uint64(44), np.uint64((1 << 44) - 1)


@functools.lru_cache
def _letters() -> np.ndarray:
    """For each code point its lower case if it is a letter, else 0."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if (s := chr(c)).isalpha():
            low = s.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, n-gram and count of the distinct n-grams of each text, sorted by row and n-gram, and the letters of each text.

    Runs of other characters count as one space, also before and after a text.
    """
    rows = texts.cast(pa.large_string()).to_pylist()
    points = np.frombuffer("".join(f"\n{t}\n" for t in rows).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(rows), dtype=np.uint64), np.array([len(t) + 2 for t in rows], np.int64))
    low = _letters()[points]
    letters = np.bincount(row.astype(np.int64), low != 0, len(rows)).astype(np.int64)
    kept = low != 0
    kept[1:] |= low[:-1] != 0  # one space after each word
    kept[1:] |= row[1:] != row[:-1]  # and one before the first
    kept[:1] = True
    low, row = low[kept].astype(np.uint64), row[kept]
    low[low == 0] = 1
    grams = []
    packed = np.zeros(len(low), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        head = len(low) - n + 1
        if head <= 0:
            break
        packed = (packed[:head] << np.uint64(21)) | low[n - 1 :]
        if n in ORDERS:
            same = row[:head] == row[n - 1 :]
            if n == 1:
                same &= low[:head] != 1
            h = packed[same] * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
            h *= np.uint64(0xD6E8FEB86659FD93)
            grams.append((row[:head][same] << _ROW) | (h >> np.uint64(20)))
    keys = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
    keys.sort()
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    count = np.diff(np.r_[first, len(keys)])
    keys = keys[first]
    return (keys >> _ROW).astype(np.int64), keys & _GRAM, count, letters


def _frequent(texts: pa.Array, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, n-gram and rank of the ``top`` most frequent n-grams of each text, and the letters of each text; ties rank by the n-gram's hash."""
    owner, gram, count, letters = _grams(texts)
    order = np.argsort((owner.astype(np.uint64) << _ROW) | (_GRAM - np.minimum(count.astype(np.uint64), _GRAM)), kind="stable")
    begins = np.searchsorted(owner, np.arange(len(texts) + 1))
    rank = np.arange(len(owner)) - begins[owner]
    best = order[rank < top]
    return owner[best], gram[best], rank[rank < top], letters


@dataclasses.dataclass
class Profiles:
    """``ranks[i, j]``: rank of n-gram ``grams[i]`` in the profile of ``languages[j]``, or ``top`` if it isn't there."""

    languages: list[str]
    grams: np.ndarray
    ranks: np.ndarray
    top: int = TOP

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """The nearest language (the first by name on ties) and 1 - its distance as a share of the greatest possible."""
        owner, gram, rank, letters = _frequent(texts, self.top)
        n = np.bincount(owner, minlength=len(texts))
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        at = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
        known = self.grams[at] == gram
        away = np.full((len(gram), len(self.languages)), self.top, np.int32)
        theirs = self.ranks[at[known]]
        away[known] = np.where(theirs < self.top, np.abs(theirs - rank[known, None]), self.top)
        total = np.stack([np.bincount(owner, away[:, j], len(texts)) for j in range(len(self.languages))], 1)
        best = total.argmin(1)
        score = 1 - total[np.arange(len(texts)), best] / np.maximum(n * self.top, 1)
        none = letters == 0
        return [UNKNOWN if z else self.languages[b] for b, z in zip(best, none)], np.where(none, 0.0, np.clip(score, 0, 1))


def learn(texts: list[str], languages: list[str], top: int = TOP) -> Profiles:
    """Profiles from labelled texts: the n-grams that are frequent in a language's texts together."""
    names, lists = sorted(set(languages)), []
    for name in names:
        gram, count = np.zeros(0, np.uint64), np.zeros(0)
        mine = arrow_texts(pa.array([t for t, x in zip(texts, languages) if x == name], pa.large_string()))
        for a, b in slices(mine):
            _, more, n, _ = _grams(mine.slice(a, b - a))
            gram, at = np.unique(np.concatenate([gram, more]), return_inverse=True)
            count = np.bincount(at, np.concatenate([count, n]), len(gram))
        lists.append(gram[np.lexsort((gram, -count))[:top]])
    grams = np.unique(np.concatenate(lists)) if lists else np.zeros(0, np.uint64)
    ranks = np.full((len(grams), len(names)), top, np.int32)
    for j, gram in enumerate(lists):
        ranks[np.searchsorted(grams, gram), j] = np.arange(len(gram))
    return Profiles(names, grams, ranks, top)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, salt: int = 9) -> Profiles:
    """Learn from rows with a text, a language and crc32(id as text) mod 4 other than 2.

    Of a language with more than ``sample`` ids, a share of them is taken by a hash of the id that gives about
    ``sample``; ids are counted by a sketch, however often each is repeated. Of several texts under one id the least
    counts. The driver gets the languages' counts and one whole text for each id of the sample, whatever the size of
    ``docs``; languages are taken to be some hundreds at most.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & (crc_bucket("id", 4) != 2))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("id", 0.02).alias("n")).collect()}
    if not counts:
        return learn([], [])
    draw = F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(_DRAWS))
    chosen = F.lit(False)
    for lang, n in counts.items():
        chosen |= (F.col("lang") == lang) & (draw < (_DRAWS if n <= sample else _DRAWS * sample // n + 1))
    found = sorted(tuple(r) for r in rows.filter(chosen).groupBy("lang", "id").agg(F.min("text").alias("text")).collect())
    return learn([text for _, _, text in found], [lang for lang, _, _ in found])


def _kernel(profiles: Profiles) -> Callable[[], Callable[[pa.Array], dict[str, Any]]]:
    def make() -> Callable[[pa.Array], dict[str, Any]]:
        def kernel(texts: pa.Array) -> dict[str, Any]:
            lang, score = profiles.predict(texts)
            return {"lang_pred": lang, "lang_score": score}

        return kernel

    return make


def identify(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row.

    A text that is null or without a letter is ``und`` with score 0. A null id isn't held out. Repeated rows,
    other columns (not read) and empty tables need no care; without any labelled row all are ``und``.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(crc_bucket(id_col, 4) == 2, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return add_columns(base, "text", "lang_pred string, lang_score double", _kernel(profiles), ["doc_id", "held_out"]).withColumnRenamed("lang_score", "score")


def keep_identified(docs: DataFrame, profiles: Profiles, text_col: str = "text", least: float = 0.15) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is in a known language: not ``und`` and a score of ``least`` or more.

    Null and empty texts and those without a letter go; ids don't matter, repeated rows stay as they are.
    """
    made = add_private(docs, text_col, "lang_pred string, lang_score double", _kernel(profiles))
    return made.filter((made.private("lang_pred") != UNKNOWN) & (made.private("lang_score") >= least)).done()
