"""Summaries of findings by file and rule, totals by file, and what is left after masking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haetae import rules as catalog
from haetae.functions.checks import CONFIRMED, MASKED, SUSPICIOUS
from haetae.functions.masks import REPLACE
from haetae.operators.detect import NAMES, detect, findings, line_findings, paragraphs
from haetae.operators.mask import TO_MASK, mask_text, preview_line, splice
from haetae.operators.once import once
from haetae.operators.pieces import pinned


def _counts(prefix: str = "") -> list:
    count = lambda value: F.count_if(F.col("confidence") == value)
    return [count(CONFIRMED).alias(f"{prefix}confirmed"), count(SUSPICIOUS).alias(f"{prefix}suspicious"), count(MASKED).alias(f"{prefix}already_masked")]


def summaries(found: DataFrame, keys: list[str]) -> DataFrame:
    """For each file and rule: label, count, counts by confidence, preview of the first finding, first_seen (order of rules in the file, from 1).

    Counts and the first finding combine before the shuffle; ranking the few rules of a file takes no further one.
    """
    place = F.struct("paragraph_index", "byte_start", "byte_end")
    line = preview_line(F.struct("confidence", "raw", "context_before", "context_after"))
    made = found.groupBy(*keys, "rule_id").agg(F.min_by("label", place).alias("label"), F.count("*").alias("count"), *_counts(), F.min_by(line, place).alias("preview"), F.min(place).alias("place"))
    ranked = made.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", "rule_id", "label", "count", "confirmed", "suspicious", "already_masked", "preview"))).alias("s"))
    flat = ranked.select(*keys, F.posexplode("s").alias("at", "x"))
    return flat.select(*keys, "x.rule_id", "x.label", "x.count", "x.confirmed", "x.suspicious", "x.already_masked", "x.preview", (F.col("at") + 1).alias("first_seen"))


def totals(files: DataFrame, found: DataFrame, keys: list[str], prefix: str = "") -> DataFrame:
    """``keys`` and counts by confidence of every file, zero where nothing was found."""
    counted = found.groupBy(*keys).agg(*_counts(prefix))
    names = [f"{prefix}{n}" for n in ("confirmed", "suspicious", "already_masked")]
    return files.select(*keys).distinct().join(counted, keys, "left").select(*keys, *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


def residual(df: DataFrame, keys: list[str], text_col: str = "text", mode: str = "full", rules: catalog.RuleSet | None = None, fields: tuple[str, ...] | None = None) -> DataFrame:
    """Findings in the masked text, with all or only some ``fields``. Those of a line that masking left as it was are carried over; only changed lines are looked through again."""
    rules = rules or catalog.builtin()
    if mode == REPLACE and any("\n" in r.replace_token for r in rules):  # lines don't stay lines
        return detect(mask_text(df.select(*keys, text_col), text_col, "__masked__", mode, rules), keys, "__masked__", rules).select(*keys, *(fields or NAMES))
    left = residual_lines(df, keys, text_col, mode, rules, fields).select(*keys, F.explode_outer("left").alias("f"))
    return left.filter("f is not null").select(*keys, *[f"f.{n}" for n in fields or NAMES])


def residual_lines(df: DataFrame, keys: list[str], text_col: str, mode: str, rules: catalog.RuleSet, fields: tuple[str, ...] | None = None) -> DataFrame:
    """``keys``, paragraph_index, whether masking changed it and the findings left, with all or only some ``fields``, of every line that may have any."""
    fields = None if fields is None else tuple(n for n in NAMES if n in fields)
    needed = None if fields is None else tuple(n for n in NAMES if n in fields or n in TO_MASK)
    lines = paragraphs(df, keys, text_col)
    if rules.guard:
        lines = lines.filter(F.rlike(F.col("text"), F.lit(rules.guard)))
    lines = pinned(lines, "found", line_findings(rules, needed))
    lines = pinned(lines, "after", once(lambda: splice(F.col("text"), F.col("found"), mode, rules), "splice", mode, rules))
    again = once(lambda: findings(F.col("after"), rules, F.col("paragraph_index"), fields), "again", rules, fields)
    changed = F.col("text") != F.col("after")
    return lines.select(*keys, "paragraph_index", changed.alias("changed"), F.when(changed, again).otherwise(F.col("found") if needed == fields else F.transform("found", lambda f: F.struct(*[f[n].alias(n) for n in fields]))).alias("left"))
