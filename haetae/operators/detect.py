"""Detection: candidates of every pattern, boundaries, checks, and the claims that keep findings apart."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haetae import rules as catalog
from haetae.functions.checks import MASKED, SKIP, verdict
from haetae.functions.masks import mask_full, mask_partial
from haetae.operators.once import once
from haetae.operators.pieces import SHIFT, WIDTH, blocks, chunks, let, part, running, running_sum, runs
from haetae.patterns import free, nullable, parse

FINDING = "struct<rule_id:string,label:string,raw:string,masked_preview:string,confidence:string,paragraph_index:int,byte_start:int,byte_end:int,char_start:int,char_end:int,context_before:string,context_after:string>"
_CANDIDATE = "array<struct<start:int,rule:int,ord:int,raw:string>>"
_MATCHES = "array<struct<who:array<struct<rule:int,ord:int>>,raws:array<string>,gaps:array<string>>>"
_JUDGED = "array<struct<start:int,rule:int,ord:int,raw:string,confidence:string>>"
CONTEXT = 20
Of = Callable[[Column], Column]
NAMES = tuple(field.partition(":")[0] for field in FINDING[len("struct<") : -1].split(","))


def some_of(kind: str, fields: Sequence[str] | None) -> str:
    """The type of a finding with no others of its ``NAMES`` than ``fields``; with all for None."""
    kept = [f for f in kind[len("struct<") : -1].split(",") if fields is None or (n := f.partition(":")[0]) in fields or n not in NAMES]
    return f"struct<{','.join(kept)}>"


def candidates(text: Column, rules: catalog.RuleSet, keep: Callable[[Column, Column], Column] | None = None) -> Column:
    """All matches by start, then priority of the rule, then pattern: array<struct<start, rule, ord, raw>>, start in characters.

    A pattern's non-overlapping leftmost matches come from one extraction. A single match of a pattern that looks at nothing around it begins
    where its text first stands, as the pattern would match there too; else the pieces between matches, from one split,
    give where each begins. Empty matches are left out. Rules with the same pattern share its matches; built-in patterns that can't match are
    skipped by one test for many of them, others cost one test each. The walk over matches and pieces is one expression for all patterns.
    Matches that ``keep``, a test of their start and text, doesn't hold for are left out before rules multiply them.
    """
    uses: dict[str, list[tuple[int, int]]] = {}
    for i, rule in enumerate(rules):
        for j, p in enumerate(rule.patterns):
            uses.setdefault(p, []).append((i, j))
    none = F.array().cast(_CANDIDATE)
    if not uses:
        return none
    guards, found, empty = catalog.pattern_guards(), {}, False
    nothing = F.array().cast(_MATCHES)
    for p, who in uses.items():
        java, tree = catalog.java_pattern(p), parse(p).tree
        for_rules = F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(j).alias("ord")) for i, j in who])
        raws, gaps = F.regexp_extract_all(text, F.lit(java), F.lit(0)), F.split(text, java, -1)
        if maybe_empty := nullable(tree):
            # An empty match at the very begin cuts nothing off: put back the empty piece before it.
            gaps = let(gaps, lambda g: F.when(F.size(g) == F.size(raws), F.concat(F.array(F.lit("")), g)).otherwise(g))
            empty |= maybe_empty
        alone = F.lit(free(tree) and not maybe_empty)
        made = let(raws, lambda r: F.array(F.struct(for_rules.alias("who"), r.alias("raws"), F.when(~alone | (F.size(r) > 1), gaps).alias("gaps"))))  # noqa: B023
        found.setdefault(guards.get(p), []).append(F.when(F.rlike(text, F.lit(java)), made.cast(_MATCHES)).otherwise(nothing))

    def walk(m: Column) -> Column:
        pairs = F.zip_with(m["raws"], F.slice(m["gaps"], 1, F.size(m["raws"])), lambda raw, gap: F.struct(raw.alias("raw"), F.length(gap).alias("gap"), (F.length(gap) + F.length(raw)).alias("both")))
        spans = let(pairs, lambda ps: F.zip_with(ps, running_sum(F.transform(ps, lambda x: x["both"])), lambda x, at: F.struct((at + x["gap"]).alias("start"), x["raw"].alias("raw"))))
        first = F.get(m["raws"], F.lit(0))
        spans = F.when(m["gaps"].isNull(), F.array(F.struct((F.instr(text, first) - 1).alias("start"), first.alias("raw")))).otherwise(spans)
        spans = F.filter(spans, lambda s: F.length(s["raw"]) > 0) if empty else spans
        spans = F.filter(spans, lambda s: keep(s["start"], s["raw"])) if keep else spans
        return let(spans, lambda ss: F.when(F.size(ss) == 0, none).otherwise(F.flatten(F.transform(m["who"], lambda w: F.transform(ss, lambda s: F.struct(s["start"].alias("start"), w["rule"].alias("rule"), w["ord"].alias("ord"), s["raw"].alias("raw")))))))

    def all_of(made: list[Column]) -> Column:
        return F.flatten(F.array(*made)) if len(made) > 1 else made[0]

    guarded: dict[str | None, list[Column]] = {}
    for tests, made in found.items():
        outer, *inner = tests or (None,)
        guarded.setdefault(outer, []).append(F.when(F.rlike(text, F.lit(inner[0])), all_of(made)).otherwise(nothing) if inner else all_of(made))
    groups = [all_of(made) if test is None else F.when(F.rlike(text, F.lit(test)), all_of(made)).otherwise(nothing) for test, made in guarded.items()]
    return F.sort_array(F.flatten(F.transform(F.flatten(F.array(*groups)), walk)))


def bounded(held: Column, start: Column, end: Column) -> Column:
    """Neither neighbour is an ASCII letter, a digit or a star; tested after matching, never as part of it."""
    word = "[0-9A-Za-z*]"
    return ~((start > 0) & part(held, F.greatest(start - 1, F.lit(0)), F.lit(1)).rlike(word)) & ~part(held, end, F.lit(1)).rlike(word)


def by_kind(rule: Column, rules: catalog.RuleSet, kind, of, otherwise: Column) -> Column:
    """``of(kind)`` of the rule with that index; rules of one kind share an expression."""
    kinds: dict[str, list[int]] = {}
    for i, r in enumerate(rules):
        kinds.setdefault(kind(r), []).append(i)
    chain = None
    for k, which in kinds.items():
        chain = F.when(rule.isin(which), of(k)) if chain is None else chain.when(rule.isin(which), of(k))
    return otherwise if chain is None else chain.otherwise(otherwise)


def by_value(value: Column, values: Sequence[str], of: Callable[[str], Column], otherwise: Column) -> Column:
    """``of`` the one of ``values`` that ``value`` is."""
    chain = F.when(F.lit(False), otherwise)
    for v in values:
        chain = chain.when(value == v, of(v))
    return chain.otherwise(otherwise)


def name_of(rule: Column, names: list[str]) -> Column:
    return F.get(F.array(*[F.lit(n) for n in names]).cast("array<string>"), rule)


def claims(text: Column, rules: catalog.RuleSet, held: Column | None = None) -> Column:
    """Candidates that hold, as array<struct<start, rule, ord, raw, confidence>>; ``held`` are the text's ``blocks``.

    A candidate takes its characters only if its check doesn't skip it and none of a higher priority, an earlier
    start or pattern has taken any of them. Only candidates that overlap, also by way of others, decide about each
    other, so each such cluster is gone through by itself, rule by rule: a rule's candidates and what is
    taken already are merged in order of place. A line costs no square of its findings, nor of a cluster's candidates.
    """
    held = blocks(text) if held is None else held
    whole = candidates(text, rules, lambda start, raw: (F.length(raw) > 0) & bounded(held, start, start + F.length(raw)))
    judged = F.transform(whole, lambda c: F.struct(c["start"].alias("start"), c["rule"].alias("rule"), c["ord"].alias("ord"), c["raw"].alias("raw"), by_kind(c["rule"], rules, lambda r: r.validator, lambda v: verdict(c["raw"], v), F.lit(SKIP)).alias("confidence")))
    return resolved(judged, _JUDGED)


def resolved(judged: Column, kind: str) -> Column:
    """The claims among ``judged``, an array of type ``kind`` that begins with start, rule, ord, raw and confidence, by start."""
    end = lambda c: c["start"] + F.length(c["raw"])

    def resolve(cluster: Column) -> Column:
        ids = F.sort_array(F.array_distinct(F.transform(cluster, lambda c: c["rule"])))
        one_by_one = F.aggregate(ids, F.array().cast(kind), lambda taken, rule: claimed(taken, cluster, rule))
        # The first of the first rule takes its characters whatever comes after; where all others share some of them, it is the only one.
        first = F.get(cluster, F.array_min(F.transform(cluster, lambda c, i: F.struct(c["rule"].alias("rule"), i.alias("i"))))["i"])
        alone = lambda f: F.forall(cluster, lambda c: (c["start"] < end(f)) & (end(c) > f["start"]))
        return F.when(F.size(cluster) == 1, cluster).otherwise(let(first, lambda f: F.when(alone(f), F.array(f)).otherwise(one_by_one)))

    def claimed(taken: Column, cluster: Column, rule: Column) -> Column:
        """``taken`` (apart, by start) and what one rule's candidates take besides, from left to right.

        Ends of what is taken and begins of candidates are gone over in order: the first taken one that does not end
        before a candidate begins must begin after its end, and the rule's last one must have ended. In chunks, as arrays grow by copies.
        """
        mine = F.filter(F.transform(cluster, lambda c, i: F.struct(c["start"].alias("at"), F.lit(1).alias("kind"), i.alias("i"), c["rule"].alias("rule"))), lambda e: e["rule"] == rule)
        theirs = F.transform(taken, lambda t, i: F.struct(end(t).alias("at"), F.lit(0).alias("kind"), i.alias("i"), F.lit(0).alias("rule")))
        state = lambda ahead, stop, out: F.struct(ahead.alias("ahead"), stop.alias("stop"), out.alias("out"))

        def step(acc: Column, e: Column) -> Column:
            c, next_taken = F.get(cluster, e["i"]), F.get(taken, acc["ahead"])
            free = (c["start"] >= acc["stop"]) & (next_taken.isNull() | (next_taken["start"] >= end(c)))
            return F.when(e["kind"] == 0, state(e["i"] + 1, acc["stop"], acc["out"])).when(free, state(acc["ahead"], end(c), F.array_append(acc["out"], c))).otherwise(acc)

        nothing = F.array().cast(kind)
        some = lambda acc, events: F.aggregate(events, state(acc["ahead"], acc["stop"], nothing), step)
        more = lambda acc, events: let(some(acc, events), lambda m: state(m["ahead"], m["stop"], F.array_append(acc["out"], m["out"])))
        taken_now = lambda events: F.aggregate(chunks(events), state(F.lit(0), F.lit(0), F.array().cast(f"array<{kind}>")), more, lambda acc: F.flatten(acc["out"]))
        return F.sort_array(F.concat(taken, let(F.sort_array(F.concat(theirs, mine)), taken_now)))

    def clusters(c: Column) -> Column:
        reach = running(F.transform(c, end), lambda a, b: F.greatest(a, b))
        begins = let(reach, lambda r: F.filter(F.sequence(F.lit(0), F.size(c) - 1), lambda i: F.get(c, i)["start"] >= F.get(r, i)))
        return F.when(F.size(c) < 2, c).otherwise(F.flatten(F.transform(runs(c, begins), resolve)))

    return let(F.filter(judged, lambda c: c["confidence"] != SKIP), clusters)


def found_in(held: Column, claimed: Column, index: Column, id_of: Of, label_of: Of, preview_of: Of, kind: str = FINDING, *more: Of, fields: Sequence[str] | None = None) -> Column:
    """Findings (an array of ``kind``, or of those of its ``fields`` that are named) in reading order out of a paragraph's claims; ``held`` are its blocks."""
    kind = some_of(kind, fields)

    def full(sizes: Column, c: Column) -> Column:
        raw, start = c["raw"], c["start"]
        end = start + F.length(raw)
        before = F.greatest(start - CONTEXT, F.lit(0))
        block = F.shiftright(start, SHIFT)
        inside = F.octet_length(F.left(F.get(held, block), start.bitwiseAND(WIDTH - 1)))
        made = lambda begin: [
            id_of(c).alias("rule_id"),
            label_of(c).alias("label"),
            raw.alias("raw"),
            preview_of(c).alias("masked_preview"),
            c["confidence"].alias("confidence"),
            index.alias("paragraph_index"),
            begin.alias("byte_start"),
            (begin + F.octet_length(raw)).alias("byte_end"),
            start.alias("char_start"),
            end.alias("char_end"),
            part(held, before, start - before).alias("context_before"),
            part(held, end, F.lit(CONTEXT)).alias("context_after"),
        ]
        those = lambda columns: [x for n, x in zip(NAMES, columns, strict=True) if fields is None or n in fields]
        finding = lambda begin: F.struct(*those(made(begin)), *[of(c).alias(f"more_{i}") for i, of in enumerate(more)]).cast(kind)
        if fields is not None and not {"byte_start", "byte_end"} & set(fields):
            return finding(F.lit(0))
        return let(F.when(block == 0, inside).otherwise(F.get(sizes, block) + inside), finding)

    sizes = F.when(F.size(held) > 1, running_sum(F.transform(held, F.octet_length)))
    none = F.array().cast(f"array<{kind}>")
    # Claims are apart and by start already: their place in the text is their order.
    return let(claimed, lambda o: F.when(F.size(o) == 0, none).otherwise(let(sizes, lambda n: F.transform(o, lambda c: full(n, c)))))


def findings(text: Column, rules: catalog.RuleSet, paragraph_index: Column | None = None, fields: Sequence[str] | None = None) -> Column:
    """Findings of one paragraph in reading order, as an array of ``FINDING`` or of ``fields`` of it alone, which spares what others cost. Null text has none."""
    index = F.lit(0) if paragraph_index is None else paragraph_index.cast("int")
    preview = lambda c: F.when(c["confidence"] == MASKED, c["raw"]).otherwise(by_kind(c["rule"], rules, lambda r: r.partial, lambda k: mask_partial(c["raw"], k), mask_full(c["raw"])))
    id_of, label_of = (lambda c: name_of(c["rule"], [r.id for r in rules])), (lambda c: name_of(c["rule"], [r.label for r in rules]))
    made = lambda held: found_in(held, claims(text, rules, held), index, id_of, label_of, preview, fields=fields)
    likely = text.isNotNull() & (F.rlike(text, F.lit(rules.guard)) if rules.guard else F.lit(True))
    return F.when(likely, let(blocks(text), made)).otherwise(F.array().cast(f"array<{some_of(FINDING, fields)}>"))


def line_findings(rules: catalog.RuleSet, fields: tuple[str, ...] | None = None) -> Column:
    """``findings`` of the columns text and paragraph_index."""
    return once(lambda: findings(F.col("text"), rules, F.col("paragraph_index"), fields), "line_findings", rules, fields)


def paragraphs(df: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """``keys``, paragraph_index and text of every line; an empty or null text is one empty line. Carriage returns before a line feed go."""
    lines = F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1), lambda x: F.rtrim(x, F.lit("\r")))
    # The outer form: from the plain one the optimizer infers a filter on the size, and splits each text twice.
    return df.select(*keys, F.posexplode_outer(lines).alias("paragraph_index", "text"))


def detect(df: DataFrame, keys: list[str], text_col: str = "text", rules: catalog.RuleSet | None = None) -> DataFrame:
    """One row for each finding in the lines of ``text_col``: ``keys`` and the fields of a finding. Narrow: no shuffle."""
    rules = rules or catalog.builtin()
    lines = paragraphs(df, keys, text_col)
    if rules.guard:
        lines = lines.filter(F.rlike(F.col("text"), F.lit(rules.guard)))
    found = lines.select(*keys, line_findings(rules).alias("found"))
    # The outer form here as well: an inferred filter on the size would detect everything once more.
    return found.select(*keys, F.explode_outer("found").alias("f")).filter("f is not null").select(*keys, "f.*")
