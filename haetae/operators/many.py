"""Detection with thousands of rules: the rules are data in a broadcast, not nodes of the plan.

Every match of a pattern holds one of the pattern's ``literals``. One automaton (Aho-Corasick) over the literals of all
rules goes over a line once; only the patterns whose literals the line holds are run on it. What comes after,
boundaries, checks, claims and findings, are the same expressions as for few rules; they go by a candidate's own fields,
so the plan has the same size for any number of rules.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from haetae import plain
from haetae import rules as catalog
from haetae.functions.checks import MASKED, VALIDATORS, verdict
from haetae.functions.masks import DELETE, FULL, KINDS, PARTIAL, REPLACE, mask_full, mask_partial, parse_mode
from haetae.operators.detect import FINDING, bounded, by_value, found_in, paragraphs, resolved, some_of
from haetae.operators.pieces import blocks, let, replaced
from haetae.patterns import literals, parse

#: Bytes of rules that are broadcast at most.
MOST_BYTES = 256 << 20
_CANDIDATE = "array<struct<start:int,rule:int,ord:int,raw:string,validator:string,id:string,label:string,partial:string,token:string>>"
_JUDGED = "array<struct<start:int,rule:int,ord:int,raw:string,confidence:string,id:string,label:string,partial:string,token:string>>"
#: A finding with the token of its rule.
TOKENED = FINDING.replace(">", ",token:string>")


class Matcher:
    """The rules of a worker: an automaton over literals, and the patterns behind each."""

    def __init__(self, rules: tuple[catalog.Rule, ...]) -> None:
        import ahocorasick

        self.rules = rules
        self.always: list[tuple[int, int]] = []
        keyed: dict[str, list[tuple[int, int]]] = {}
        for i, rule in enumerate(rules):
            for j, p in enumerate(rule.patterns):
                for key in literals(parse(p).tree) or ():
                    keyed.setdefault(key, []).append((i, j))
                if not literals(parse(p).tree):
                    self.always.append((i, j))
        self.automaton = ahocorasick.Automaton() if keyed else None
        for key, who in keyed.items():
            self.automaton.add_word(key, who)
        if keyed:
            self.automaton.make_automaton()

    def candidates(self, text: str) -> list[dict[str, Any]]:
        """Matches of all patterns by start, rule and pattern."""
        who = dict.fromkeys(self.always)
        if self.automaton is not None:
            for _, some in self.automaton.iter(text):
                who.update(dict.fromkeys(some))
        out = []
        for i, j in who:
            rule = self.rules[i]
            for a, b in plain.spans(plain.compiled(rule.patterns[j]), text):
                out.append({"start": a, "rule": i, "ord": j, "raw": text[a:b], "validator": rule.validator, "id": rule.id, "label": rule.label, "partial": rule.partial, "token": rule.replace_token})
        return sorted(out, key=lambda c: (c["start"], c["rule"], c["ord"]))


@functools.lru_cache(maxsize=4)
def _matcher(rules: tuple[catalog.Rule, ...]) -> Matcher:
    return Matcher(rules)


def rules_from(table: DataFrame) -> catalog.RuleSet:
    """A rule set out of a table with the columns of ``RuleSet.dataframe``; the table comes to the driver, up to MOST_BYTES."""
    rows, size = [], 0
    for r in table.select("id", "label", "priority", "validator", "replace_token", "partial", "patterns").toLocalIterator():
        size += sum(len(p) for p in r["patterns"]) + len(r["id"]) + len(r["label"])
        if size > MOST_BYTES:
            raise catalog.RuleError(f"rules of over {MOST_BYTES} bytes are too many for a broadcast")
        rows.append(catalog.checked(r["id"], r["label"], tuple(r["patterns"]), r["priority"] or 0, r["validator"] or "none", r["replace_token"] or "", r["partial"] or ""))
    return catalog.RuleSet(tuple(sorted(rows, key=lambda r: (-r.priority, r.id))))


def candidates(df: DataFrame, text: Column, rules: catalog.RuleSet) -> Column:
    """All matches of all rules in ``text`` as an array, by one Arrow function; null for null text."""
    if sum(len(p) for r in rules for p in r.patterns) > MOST_BYTES:
        raise catalog.RuleError(f"rules of over {MOST_BYTES} bytes are too many for a broadcast")
    held = df.sparkSession.sparkContext.broadcast(rules.rules)
    kind = T._parse_datatype_string(_CANDIDATE)
    arrow = to_arrow_type(kind)

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matcher = _matcher(held.value)
        for texts in batches:
            yield pa.array([None if t is None else matcher.candidates(t) for t in texts.to_pylist()], arrow)

    return run(text)


def _found(text: Column, candidates_of: Column, index: Column, fields: tuple[str, ...] | None = None) -> Column:
    """Findings with tokens of one paragraph out of its candidates."""
    def claims(held: Column) -> Column:
        whole = F.filter(candidates_of, lambda c: bounded(held, c["start"], c["start"] + F.length(c["raw"])))
        judged = F.transform(whole, lambda c: F.struct(c["start"].alias("start"), c["rule"].alias("rule"), c["ord"].alias("ord"), c["raw"].alias("raw"), by_value(c["validator"], VALIDATORS, lambda v: verdict(c["raw"], v), verdict(c["raw"], "none")).alias("confidence"), *[c[x].alias(x) for x in ("id", "label", "partial", "token")]))
        return resolved(judged, _JUDGED)

    preview = lambda c: F.when(c["confidence"] == MASKED, c["raw"]).otherwise(by_value(c["partial"], KINDS, lambda k: mask_partial(c["raw"], k), mask_full(c["raw"])))
    return let(blocks(text), lambda held: found_in(held, claims(held), index, lambda c: c["id"], lambda c: c["label"], preview, TOKENED, lambda c: c["token"], fields=fields))


def line_findings(df: DataFrame, keys: list[str], text_col: str, rules: catalog.RuleSet, fields: tuple[str, ...] | None = None) -> DataFrame:
    """``keys``, paragraph_index, text and found (array of ``TOKENED``, or of ``fields`` of it and the token) of every line."""
    lines = paragraphs(df, keys, text_col).withColumn("__candidates__", candidates(df, F.col("text"), rules))
    none = F.array().cast(f"array<{some_of(TOKENED, fields)}>")
    return lines.select(*keys, "paragraph_index", "text", F.when(F.size("__candidates__") > 0, _found(F.col("text"), F.col("__candidates__"), F.col("paragraph_index"), fields)).otherwise(none).alias("found"))


def detect_many(df: DataFrame, keys: list[str], text_col: str, rules: catalog.RuleSet, fields: tuple[str, ...] | None = None) -> DataFrame:
    """As ``detect``: ``keys`` and all or only some ``fields`` of a finding, for any number of rules. Narrow: no shuffle."""
    found = line_findings(df, keys, text_col, rules, fields).select(*keys, F.explode_outer("found").alias("f")).filter("f is not null")
    return found.select(*keys, "f.*").drop("token")


def masked_lines_many(df: DataFrame, keys: list[str], text_col: str, rules: catalog.RuleSet, mode: str = "full") -> DataFrame:
    """As ``masked_lines``: ``keys``, paragraph_index, before, after and findings of every line, for any number of rules."""
    mode = parse_mode(mode)
    new = {FULL: lambda f: mask_full(f["raw"]), PARTIAL: lambda f: f["masked_preview"], REPLACE: lambda f: f["token"], DELETE: lambda f: F.lit("")}[mode]
    lines = line_findings(df, keys, text_col, rules)
    todo = F.filter("found", lambda f: f["confidence"] != MASKED)
    after = replaced(F.col("text"), F.transform(todo, lambda f: F.struct(f["char_start"].alias("begin"), f["char_end"].alias("stop"), new(f).alias("new"))))
    return lines.select(*keys, "paragraph_index", F.col("text").alias("before"), after.alias("after"), F.col("found").alias("findings"))
