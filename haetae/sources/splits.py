"""Lines and CSV records of text files of any size, read in splits by many tasks.

Spark's text source deals a file out by byte ranges and gives each task whole lines. What a split means depends on
what stands before it: how many lines and characters, and whether a quote is open. So each split is first summed up as
a function of the quote state at its begin; the functions, composed in order, give each split's own state, and then
each cuts its own records. Only records that go over a split's end are put together from their pieces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haetae import rules as catalog
from haetae.operators.detect import line_findings
from haetae.shared import written

#: Splits whose states are broadcast (some 60 bytes each); with more the lines are dealt by split and sorted instead.
BROADCAST = 500_000
_SUMMARY = "path string, block long, size long, n_lines long, n_chars long, n_bytes long, quotes long, begins_even long, begins_odd long"
_CUT = "path string, nth long, at long, block long, whole boolean, text string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    read = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(path)
    return read.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"), "value")


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """Parts of a batch that are of one split."""
    paths, blocks = batch.column(0).dictionary_encode(), batch.column(1).to_numpy()
    which = paths.indices.to_numpy()
    edges = np.flatnonzero(np.r_[True, (blocks[1:] != blocks[:-1]) | (which[1:] != which[:-1]), True]) if len(blocks) else []
    for a, b in zip(edges[:-1], edges[1:]):
        yield paths.dictionary[int(which[a])].as_py(), int(blocks[a]), batch.slice(int(a), int(b - a))


def _measures(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Characters of each line with its line feed, and its quotes."""
    return pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1, pc.count_substring(texts, '"').to_numpy(zero_copy_only=False).astype(np.int64)


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each split of a task: its size, its quotes, and how many records begin in it for either state at its begin."""
    names = [f.split()[0] for f in _SUMMARY.split(", ")]
    now: list[Any] | None = None
    for batch in batches:
        for path, block, part in _runs(batch):
            if now is None or now[:2] != [path, block]:
                if now is not None:
                    yield pa.RecordBatch.from_pydict({n: [v] for n, v in zip(names, now)})
                now = [path, block, part.column(2)[0].as_py(), 0, 0, 0, 0, 0, 0]
            chars, quotes = _measures(part.column(3))
            even = int(np.count_nonzero((now[6] + np.cumsum(quotes) - quotes) % 2 == 0))
            for i, more in ((3, len(chars)), (4, chars.sum()), (5, pc.sum(pc.binary_length(part.column(3))).as_py() + len(chars)), (6, quotes.sum()), (7, even), (8, len(chars) - even)):
                now[i] += int(more)
    if now is not None:
        yield pa.RecordBatch.from_pydict({n: [v] for n, v in zip(names, now)})


def _states(summary: DataFrame, csv: bool) -> DataFrame:
    """path, block and what holds at the split's begin: an open quote, lines or records and characters before; and whether a last empty line follows it."""
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("path")
    total = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    open_at = total("quotes") % 2 if csv else F.lit(0).cast("long")
    made = summary.withColumns({"open": open_at, "chars": total("n_chars"), "last": F.col("block") == F.max("block").over(whole), "bytes": F.sum("n_bytes").over(whole)})
    begins = F.when(F.col("open") == 0, F.col("begins_even")).otherwise(F.col("begins_odd")) if csv else F.col("n_lines")
    made = made.withColumn("begins", begins).withColumn("before", total("begins"))
    # Lines take a byte more than they have, but for the last one of a file without a line feed at its end; a byte order mark is three.
    return made.select("path", "block", "open", "before", "chars", (F.col("last") & F.col("bytes").isin(F.col("size"), F.col("size") - 3)).alias("feed"))


class _Cutter:
    """Records of one split, from the state at its begin."""

    def __init__(self, path: str, block: int, opened: int, before: int, chars: int, feed: bool, csv: bool) -> None:
        self.path, self.block, self.quotes, self.nth, self.at, self.feed, self.csv = path, block, opened, before, chars, feed, csv
        self.held: list[str] = []
        self.start: int | None = None  # where the held record begins, if it does so in this split

    def add(self, texts: pa.Array, out: list[tuple]) -> None:
        chars, quotes = _measures(texts)
        ats = self.at + np.cumsum(chars) - chars
        before = self.quotes + np.cumsum(quotes) - quotes
        begins = np.flatnonzero(before % 2 == 0) if self.csv else np.arange(len(chars))
        values = texts.to_pylist()
        self.held += values[: begins[0]] if len(begins) else values
        for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(values)]):
            self.close(out, True)
            self.start, self.held = int(ats[a]), values[a:b]
        self.at += int(chars.sum())
        self.quotes += int(quotes.sum())

    def close(self, out: list[tuple], ended: bool) -> None:
        """Hand over what is held: a whole record, or a piece of one that began before or goes on."""
        if self.start is None:
            if self.held:
                out.append((self.path, self.nth - 1, None, self.block, False, "\n".join(self.held)))
        else:
            text = "\n".join(self.held)
            out.append((self.path, self.nth, self.start, self.block, ended, text.rstrip("\r") if ended else text))
            self.nth += 1
        self.held = []

    def end(self, out: list[tuple]) -> None:
        if self.feed:
            self.add(pa.array([""]), out)
        self.close(out, not self.csv or self.quotes % 2 == 0)


def _cut(csv: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Cutter | None = None
        names = [f.split()[0] for f in _CUT.split(", ")]
        table = lambda out: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()))], names=names)
        for batch in batches:
            out: list[tuple] = []
            for path, block, part in _runs(batch):
                if now is None or (now.path, now.block) != (path, block):
                    if now is not None:
                        now.end(out)
                    now = _Cutter(path, block, *(part.column(c)[0].as_py() for c in ("open", "before", "chars", "feed")), csv)
                now.add(part.column("value"), out)
            if out:
                yield table(out)
        if now is not None:
            out = []
            now.end(out)
            if out:
                yield table(out)

    return run


def read_records(spark: SparkSession, path: str, csv: bool = False) -> DataFrame:
    """path, nth (from 0), at and text of every line, or CSV record, of the UTF-8 text files under ``path``.

    ``at`` is where it begins in its file, in characters. Lines are as in ``text_lines``, records as in ``text_csv_records``: a line feed
    within quotes belongs to the record, and a quote that is never closed takes in the rest of its file. Files of no bytes are not read, and have no line here.

    Splits are the session's ``spark.sql.files.maxPartitionBytes``. Lines stay in their tasks; what is shuffled are a summary
    for each split and the pieces of records that go over a split's end. The files are read twice for lines and three times for records.
    """
    lines = _lines(spark, path)
    states = written(_states(lines.mapInArrow(_summarise, _SUMMARY), csv))
    if states.count() <= BROADCAST:
        ready = lines.join(F.broadcast(states), ["path", "block"])
    else:
        ready = _dealt(lines, states)
    cut = ready.select("path", "block", "value", "open", "before", "chars", "feed").mapInArrow(_cut(csv), _CUT)
    made = cut.filter("whole").select("path", "nth", "at", "text")
    if csv:
        pieces = cut.filter("not whole").groupBy("path", "nth").agg(F.min("at").alias("at"), F.sort_array(F.collect_list(F.struct("block", "text"))).alias("p"))
        made = made.unionByName(pieces.select("path", "nth", "at", F.rtrim(F.array_join("p.text", "\n"), F.lit("\r")).alias("text")))
    return made


def _dealt(lines: DataFrame, states: DataFrame) -> DataFrame:
    """The same for more splits than are broadcast: lines numbered within their split, joined by split and put in order again."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n = None, 0
        for batch in batches:
            for path, block, part in _runs(batch):
                now, n = ((path, block), n) if now == (path, block) else ((path, block), 0)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.arange(n, n + part.num_rows))], names=[*part.schema.names, "line"])
                n += part.num_rows

    numbered = lines.mapInArrow(number, "path string, block long, size long, value string, line long")
    return numbered.join(states, ["path", "block"]).repartition("path", "block").sortWithinPartitions("path", "block", "line")


def record_findings(records: DataFrame, rules: catalog.RuleSet | None = None) -> DataFrame:
    """path, at (of the finding, in characters of its file) and the fields of a finding, for each finding in the records; paragraph_index is nth."""
    rules = rules or catalog.builtin()
    likely = records.filter(F.rlike("text", F.lit(rules.guard))) if rules.guard else records
    found = likely.withColumn("paragraph_index", F.col("nth").cast("int")).select("path", "at", line_findings(rules).alias("found"))
    found = found.select("path", "at", F.explode_outer("found").alias("f")).filter("f is not null")
    return found.select("path", (F.col("at") + F.col("f.char_start")).alias("at"), "f.*")
