"""Arrays and long texts within one row: values bound once, running totals, and pieces of a text without walking all of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements that a running total goes over at once, and characters of a block of text (a power of two).
CHUNK, SHIFT = 128, 9
WIDTH = 1 << SHIFT
_END = 1 << 30


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once: inside lambdas nothing else shares an expression.

    A fold over nothing, whose last step is ``body``: a ``transform`` would copy what ``body`` makes, at every level once more.
    """
    return F.aggregate(F.array(), value, lambda bound, unused: bound, body)


def pinned(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that the optimizer neither works out twice nor writes into what uses it.

    A step of its own in the plan, still in place and row by row: large expressions over large expressions would
    be multiplied out otherwise.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def pinned_fields(df: DataFrame, made: Column) -> DataFrame:
    """The same for a struct, whose fields become columns: no later step then reaches into it."""
    return df.select("*", F.inline(F.array(made)))


def chunks(items: Column) -> Column:
    """``items`` in arrays of ``CHUNK``; an empty array for none."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / CHUNK).cast("int")), lambda i: F.slice(items, i * CHUNK + 1, F.lit(CHUNK)))


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each integer the ``op`` of all integers before it, from 0 on.

    An array grows by copies, so ``n`` steps in one go would cost the square of ``n``. Chunks are gone over one by
    one, each from the total of those before it.
    """
    step = lambda acc, v: F.struct(op(acc["at"], v).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))
    scan = lambda items, start: F.aggregate(items, F.struct(start.alias("at"), F.array().cast("array<int>").alias("out")), step, lambda acc: acc["out"])
    total = lambda items: F.aggregate(items, F.lit(0), op)

    def over(v: Column) -> Column:
        long = let(chunks(v), lambda c: F.flatten(F.zip_with(c, scan(F.transform(c, total), F.lit(0)), scan)))
        return F.when(F.size(v) <= CHUNK, scan(v, F.lit(0))).otherwise(long)

    return let(values, over)


def running_sum(values: Column) -> Column:
    return running(values, lambda a, b: a + b)


def runs(items: Column, begins: Column) -> Column:
    """``items`` cut at the positions ``begins`` (from 0, rising) into arrays; what stands before the first is left out."""
    cut = lambda x, b: F.transform(b, lambda at, i: F.slice(x, at + 1, F.coalesce(F.get(b, i + 1), F.size(x)) - at))
    return let(items, lambda x: let(begins, lambda b: cut(x, b)))


def blocks(text: Column) -> Column:
    """A text as blocks of ``WIDTH`` characters, so that ``part`` reads a few of them and not all that stands before."""
    return F.when(F.length(text) <= WIDTH, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{WIDTH}}}"), F.lit(0)))


def part(held: Column, start: Column, n: Column) -> Column:
    """``n`` characters from ``start`` (from 0) of a text's ``blocks``; fewer at its end."""
    first = F.shiftright(start, SHIFT)
    some = F.substr(F.array_join(F.slice(held, first + 1, F.shiftright(start + n, SHIFT) - first + 1), ""), start.bitwiseAND(WIDTH - 1) + 1, n)
    return F.when(F.size(held) == 1, F.substr(F.get(held, F.lit(0)), start + 1, n)).otherwise(some)


def replaced(text: Column, spans: Column) -> Column:
    """``text`` with ``spans`` (array<struct<begin, stop, new>>, apart and in order) replaced by their new text."""

    def join(held: Column, s: Column) -> Column:
        before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(s, i - 1)["stop"])
        pieces = F.transform(s, lambda x, i: F.concat(part(held, before(i), x["begin"] - before(i)), x["new"]))
        return F.array_join(F.concat(pieces, F.array(part(held, before(F.size(s)), F.lit(_END)))), "")

    return let(spans, lambda s: F.when(F.size(s) == 0, text).otherwise(let(blocks(text), lambda held: join(held, s))))
