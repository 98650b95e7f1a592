"""Benchmark decontamination by Wu-Manber multi-pattern search over words."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haetae.llm.common import WORD, add_columns, add_private

#: Words of a window, words of a block of the shift table, and bytes of benchmark texts that are searched for at once.
WINDOW, BLOCK, AT_ONCE = 10, 3, 1 << 20
_TABLE = bytes(b or 32 for b in WORD.tolist())


def words_of(text: bytes) -> list[bytes]:
    """Words of digits, letters and characters beyond ASCII, A-Z in lower case."""
    return text.translate(_TABLE).split()


class Search:
    """Patterns of one length: the shift table, buckets by the last block, and in these by the first block.

    A pattern is (item, offset): the words of ``items[item]`` from ``offset`` on.
    """

    def __init__(self, items: list[list[bytes]], patterns: list[tuple[int, int]], length: int, block: int = BLOCK) -> None:
        self.items, self.length, self.block = items, length, min(block, length)
        self.far = length - self.block + 1  # how far the end moves when the block is in no pattern
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict[tuple[bytes, ...], list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for item, offset in patterns:
            words, b = items[item], self.block
            for end in range(b, length + 1):
                key = tuple(words[offset + end - b : offset + end])
                self.shift[key] = min(self.shift.get(key, self.far), length - end)
            self.buckets[tuple(words[offset + length - b : offset + length])][tuple(words[offset : offset + b])].append((item, offset))

    def find(self, words: list[bytes]) -> list[tuple[int, int]]:
        """(begin, item) of every occurrence."""
        found, shift, far, m, b, n = [], self.shift.get, self.far, self.length, self.block, len(words)
        end = m
        while end <= n:
            key = tuple(words[end - b : end])
            step = shift(key, far)
            if step:
                end += step
                continue
            candidates = self.buckets[key].get(tuple(words[end - m : end - m + b]))
            if candidates:
                window = words[end - m : end]
                found += [(end - m, item) for item, offset in candidates if self.items[item][offset : offset + m] == window]
            end += 1
        return found


def searches(items: list[list[bytes]], window: int) -> list[Search]:
    """One search for each length of pattern: ``window``, and that of each shorter item."""
    by_length: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for i, words in enumerate(items):
        length = min(window, len(words))
        if length:
            by_length[length] += [(i, offset) for offset in range(len(words) - length + 1)]
    return [Search(items, patterns, length) for length, patterns in sorted(by_length.items())]


def _kernels(docs: DataFrame, benchmark: DataFrame, item_col: str, text_col: str, window: int, at_once: int) -> list[Callable[[], Callable[[pa.Array], dict[str, Any]]]]:
    """A kernel for each block of the benchmark of about ``at_once`` bytes; only one block is collected at a time."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("id"), F.col(text_col).alias("text")).filter("id is not null and text is not null").distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, made = max(1, math.ceil(size / at_once)), []
    for i in range(blocks):
        part = rows if blocks == 1 else rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == i)
        held = docs.sparkSession.sparkContext.broadcast(sorted((r["id"], words_of(r["text"].encode())) for r in part.collect()))

        def make(held: Any = held) -> Callable[[pa.Array], dict[str, Any]]:
            ids, tools = [i for i, _ in held.value], searches([w for _, w in held.value], window)

            def kernel(texts: pa.Array) -> dict[str, Any]:
                counts, spans, items = [], [], []
                for text in texts:
                    words = words_of(text.as_py())
                    hits = [(a, a + tool.length, item) for tool in tools for a, item in tool.find(words)]
                    counts.append(len(words))
                    merged: list[list[int]] = []
                    for a, b in sorted({(a, b) for a, b, _ in hits}):
                        if merged and a <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], b)
                        else:
                            merged.append([a, b])
                    spans.append(merged)
                    items.append(sorted({ids[i] for _, _, i in hits}))
                return {"n_words": counts, "spans": spans, "items": items}

            return kernel

        made.append(make)
    return made


FIELDS = "n_words long, spans array<array<int>>, items array<string>"


def hit_words(spans: Column) -> Column:
    """Words inside the union of sorted spans [begin, end)."""
    start = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("total"))
    step = lambda acc, x: F.struct(F.greatest(acc["upto"], x[1]).alias("upto"), (acc["total"] + F.greatest(F.lit(0), x[1] - F.greatest(x[0], acc["upto"]))).alias("total"))
    return F.aggregate(spans, start, step, lambda acc: acc["total"])


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, at_once: int = AT_ONCE) -> DataFrame:
    """doc_id, n_words, n_hit, spans (of words, [begin, end)) and items (ids as sorted strings) of every row of ``docs``.

    Null and empty texts have no words; items without an id, a text or a word are no patterns. Repeated rows
    and items make no difference, other columns are not read; empty tables give no rows, or no hits. A benchmark
    of over ``at_once`` bytes is searched for in blocks, one after the other on the same rows, without a shuffle.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kernels = _kernels(docs, benchmark, item_col, item_text_col, window, at_once)
    for i, make in enumerate(kernels):
        rows = add_columns(rows, "text", FIELDS, make, [c for c in rows.columns if c != "text" or len(kernels) > 1])
        if len(kernels) > 1:
            rows = rows.withColumnsRenamed({"n_words": f"n_words{i}", "spans": f"spans{i}", "items": f"items{i}"})
    if len(kernels) > 1:
        every = lambda name: F.concat(*[f"{name}{i}" for i in range(len(kernels))])
        rows = rows.select("doc_id", F.col("n_words0").alias("n_words"), F.array_sort(every("spans")).alias("spans"), F.array_sort(F.array_distinct(every("items"))).alias("items"))
    return rows.select("doc_id", "n_words", hit_words(F.col("spans")).alias("n_hit"), "spans", "items")


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, at_once: int = AT_ONCE) -> DataFrame:
    """The rows of ``docs``, all columns, in which no window of a benchmark item occurs; null and empty texts stay, ids don't matter."""
    for make in _kernels(docs, benchmark, item_col, item_text_col, window, at_once):
        made = add_private(docs, text_col, FIELDS, make)
        docs = made.filter(F.size(made.private("items")) == 0).done()
    return docs
