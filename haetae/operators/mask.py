"""Masking: replacements spliced into paragraphs from left to right."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haetae import rules as catalog
from haetae.functions.checks import MASKED
from haetae.functions.masks import PARTIAL, REPLACE, apply_mode, mask_full, mask_partial
from haetae.operators.detect import findings, line_findings, paragraphs
from haetae.operators.once import once
from haetae.operators.pieces import let, replaced

#: What masking a text asks of its findings.
TO_MASK = ("rule_id", "raw", "confidence", "char_start", "char_end")


def replacement(finding: Column, mode: str, rules: catalog.RuleSet) -> Column:
    """What stands in for a finding: by its rule's partial kind and token; a rule that isn't there masks in full or as [PII]."""
    if mode == PARTIAL:
        kinds: dict[str, list[str]] = {}
        for r in rules:
            kinds.setdefault(r.partial, []).append(r.id)
        chain = F.when(F.lit(False), "")
        for kind, ids in kinds.items():
            chain = chain.when(finding["rule_id"].isin(ids), mask_partial(finding["raw"], kind))
        return chain.otherwise(mask_full(finding["raw"]))
    if mode == REPLACE:
        tokens = F.create_map(*[F.lit(x) for r in rules for x in (r.id, r.replace_token)]) if len(rules) else F.create_map().cast("map<string,string>")
        return F.coalesce(F.element_at(tokens, finding["rule_id"]), F.lit("[PII]"))
    return apply_mode(finding["raw"], mode)


def splice(text: Column, found: Column, mode: str, rules: catalog.RuleSet) -> Column:
    """``text`` with its findings (in reading order) replaced; what is masked already stays."""
    todo = F.filter(found, lambda f: f["confidence"] != MASKED)
    return replaced(text, F.transform(todo, lambda f: F.struct(f["char_start"].alias("begin"), f["char_end"].alias("stop"), replacement(f, mode, rules).alias("new"))))


def preview_line(finding: Column) -> Column:
    """Context, the value in full mask (as it is, if masked already), context."""
    shown = F.when(finding["confidence"] == MASKED, finding["raw"]).otherwise(mask_full(finding["raw"]))
    return F.concat(finding["context_before"], shown, finding["context_after"])


def masked_lines(df: DataFrame, keys: list[str], text_col: str = "text", mode: str = "full", rules: catalog.RuleSet | None = None) -> DataFrame:
    """``keys``, paragraph_index, before, after and the findings of every line."""
    rules = rules or catalog.builtin()
    lines = paragraphs(df, keys, text_col).withColumn("found", line_findings(rules))
    return lines.select(*keys, "paragraph_index", F.col("text").alias("before"), once(lambda: splice(F.col("text"), F.col("found"), mode, rules), "splice", mode, rules).alias("after"), F.col("found").alias("findings"))


def changed(lines: DataFrame) -> DataFrame:
    """The lines that masking changed."""
    return lines.filter("before <> after")


def mask_text(df: DataFrame, text_col: str = "text", out_col: str = "masked", mode: str = "full", rules: catalog.RuleSet | None = None) -> DataFrame:
    """All columns of ``df`` and the masked text; line feeds stay where they are, carriage returns too. Narrow: no shuffle."""
    rules = rules or catalog.builtin()
    return df.withColumn(out_col, once(lambda: masked_text(F.col(text_col), mode, rules), "mask_text", text_col, mode, rules))


def masked_text(text: Column, mode: str, rules: catalog.RuleSet) -> Column:
    """A text with its lines' findings masked; null for null."""
    def line(x: Column) -> Column:
        return let(F.rtrim(x, F.lit("\r")), lambda core: F.concat(splice(core, findings(core, rules), mode, rules), F.substr(x, F.length(core) + 1)))

    masked = F.array_join(F.transform(F.split(text, "\n", -1), line), "\n")
    return F.when(F.rlike(text, F.lit(rules.guard)), masked).otherwise(text) if rules.guard else masked
