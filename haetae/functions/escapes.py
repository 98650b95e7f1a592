"""Escaping of text for JSON, XML, HTML and CSV as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from haetae.operators.pieces import let, running, running_sum


def _chain(text: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def xml_escape(text: Column) -> Column:
    return _chain(text, (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")))


def xml_unescape(text: Column) -> Column:
    """The five named entities, ``&amp;`` first; numeric ones stay."""
    return _chain(text, (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")))


def html_escape(text: Column) -> Column:
    return _chain(text, (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")))


def json_escape(text: Column) -> Column:
    """What goes between the quotes of a JSON string."""
    return _chain(text, (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")))


def csv_escape(text: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[",\n\r]'), quoted).otherwise(text)


#: A string of JSON with its quotes; one that isn't closed goes to the end.
_STRING = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+(?:"|\\?\z)'


def in_json_strings(text: Column, begins: Column) -> Column:
    """For each of ``begins`` (rising, from 0) whether the character there is inside a JSON string, as an array.

    Leftmost matches of a whole string follow the three states of a reader (outside, inside, behind a backslash), so one
    extraction and one split give where strings are; a merge of their begins with ``begins`` answers all at once.
    """
    strings, gaps = F.regexp_extract_all(text, F.lit(_STRING), F.lit(0)), F.split(text, _STRING, -1)
    sizes = lambda raws, between: F.zip_with(raws, F.slice(between, 1, F.size(raws)), lambda raw, gap: F.struct(F.length(gap).alias("gap"), F.length(raw).alias("n")))

    def merged(pairs: Column) -> Column:
        at = running_sum(F.transform(pairs, lambda x: x["gap"] + x["n"]))
        theirs = F.zip_with(pairs, at, lambda x, before: F.struct((before + x["gap"]).alias("at"), F.lit(1).alias("kind"), (before + x["gap"] + x["n"]).alias("stop"), F.lit(0).alias("i")))
        mine = F.transform(begins, lambda b, i: F.struct(b.alias("at"), F.lit(0).alias("kind"), F.lit(0).alias("stop"), i.alias("i")))
        return let(F.array_sort(F.concat(theirs, mine)), answers)

    def answers(events: Column) -> Column:
        reach = running(F.transform(events, lambda e: e["stop"]), lambda a, b: F.greatest(a, b))
        marked = F.zip_with(events, reach, lambda e, stop: F.when(e["kind"] == 0, F.struct(e["i"].alias("i"), (stop > e["at"]).alias("inside"))))
        return F.transform(F.array_sort(F.array_compact(marked)), lambda m: m["inside"])

    return let(strings, lambda raws: let(sizes(raws, gaps), merged))


def in_json_string(text: Column, start: Column) -> Column:
    """Whether the character at ``start`` (from 0) is inside a JSON string."""
    return F.get(in_json_strings(text, F.array(start)), F.lit(0))


def json_spans(text: Column, spans: Column) -> Column:
    """``spans`` (array<struct<begin, stop, new>>, in order) with their new text as JSON: escaped within a string, else a string of its own."""

    def made(s: Column) -> Column:
        inside = in_json_strings(text, F.transform(s, lambda x: x["begin"]))
        quoted = lambda new: F.concat(F.lit('"'), new, F.lit('"'))
        return F.zip_with(s, inside, lambda x, within: let(json_escape(x["new"]), lambda new: F.struct(x["begin"].alias("begin"), x["stop"].alias("stop"), F.when(within, new).otherwise(quoted(new)).alias("new"))))

    return let(spans, lambda s: F.when(F.size(s) == 0, s).otherwise(made(s)))
