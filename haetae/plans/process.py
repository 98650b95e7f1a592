"""The whole run over files: read, detect, mask, write back, scan the output again, report. Narrow from end to end."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haetae import rules as catalog
from haetae.functions.checks import CONFIRMED, MASKED, SUSPICIOUS
from haetae.functions.masks import parse_mode
from haetae.operators.detect import NAMES, findings
from haetae.operators.mask import TO_MASK, preview_line, replacement, splice
from haetae.operators.once import once
from haetae.operators.pieces import pinned
from haetae.sources.files import with_extracted, with_rewritten

#: What summaries ask of findings, besides ``TO_MASK``.
SUMMED = ("label", "context_before", "context_after")


@dataclass(frozen=True)
class Config:
    """Rules, mask mode by any of its names, whether to mask, whether an unreadable file ends the run, and whether all files are UTF-8 text (no Python then)."""

    rules: catalog.RuleSet = field(default_factory=catalog.builtin)
    mode: str = "partial"
    mask: bool = True
    fail: bool = False
    text_only: bool = False


def _count(found: Column, confidence: str) -> Column:
    return F.size(F.filter(found, lambda f: f["confidence"] == confidence))


def _per_paragraph(column: str, rules: catalog.RuleSet, fields: tuple[str, ...] | None) -> Column:
    return once(lambda: F.transform(column, lambda p, i: findings(p, rules, i, fields)), "per_paragraph", column, rules, fields)


def _left(rules: catalog.RuleSet) -> Column:
    """Confidences in the paragraphs as read again, which is all that is counted: those of a paragraph that is as it was are carried over, others are looked through."""
    same = lambda p, i: p == F.get(F.col("x_paragraphs"), i)
    known = lambda i: F.transform(F.get(F.col("each"), i), lambda f: F.struct(f["confidence"].alias("confidence")))
    return once(lambda: F.transform("again_paragraphs", lambda p, i: F.when(same(p, i), known(i)).otherwise(findings(p, rules, i, ("confidence",)))), "left", rules)


def summaries_of(found: Column) -> Column:
    """Findings of a file by rule, in the order in which rules first come up."""
    ids = F.array_distinct(F.transform(found, lambda f: f["rule_id"]))

    def one(rule_id: Column) -> Column:
        group = F.filter(found, lambda f: f["rule_id"] == rule_id)
        first = F.element_at(group, 1)
        return F.struct(rule_id.alias("rule_id"), first["label"].alias("label"), F.size(group).alias("count"), _count(group, CONFIRMED).alias("confirmed"), _count(group, SUSPICIOUS).alias("suspicious"), _count(group, MASKED).alias("already_masked"), preview_line(first).alias("preview"))

    return F.transform(ids, one)


def process(files: DataFrame, config: Config = Config(), keys: tuple[str, ...] = (), name_col: str = "filename", content_col: str = "content", again: bool = False, fields: tuple[str, ...] | None = None) -> DataFrame:
    """A row for each file: ``keys``, filename, format, warnings, error, paragraph_count, findings, summaries, diffs, counts, residual counts, masked, output_name, fallback_note.

    A file stays in one row throughout, so nothing is shuffled and the work splits by file. Without masking the
    later columns are null or empty. With ``again`` a last column ``again_paragraphs`` has the paragraphs of the written file, which is read
    once for the residual counts anyway. With ``fields`` findings have these and what masking asks for alone, which spares what others
    cost; there are summaries only if those of ``SUMMED`` are among them.
    """
    fields = None if fields is None else tuple(n for n in NAMES if n in fields or n in TO_MASK or n == "paragraph_index")
    rules, mode = config.rules, parse_mode(config.mode)
    df = files.select(*keys, F.col(name_col).alias("filename"), F.col(content_col).alias("content"))
    df = with_extracted(df, "x", "filename", "content", config.fail, config.text_only)
    df = pinned(df, "each", _per_paragraph("x_paragraphs", rules, fields)).withColumn("findings", F.flatten("each"))
    report = [*keys, "filename", "format", "warnings", "error", "paragraph_count", "findings", "summaries", "diffs", "confirmed", "suspicious", "already_masked", "residual_confirmed", "residual_suspicious", "masked", "output_name", "fallback_note"]
    if fields is None or set(SUMMED) <= set(fields):
        df = df.withColumn("summaries", once(lambda: summaries_of(F.col("findings")), "summaries"))
    else:
        report.remove("summaries")
    df = df.withColumns({
        "format": F.col("x_format"), "error": F.col("x_error"), "paragraph_count": F.size("x_paragraphs"),
        "confirmed": _count(F.col("findings"), CONFIRMED), "suspicious": _count(F.col("findings"), SUSPICIOUS), "already_masked": _count(F.col("findings"), MASKED),
    })
    if not config.mask:
        empty = F.array().cast("array<struct<paragraph_index:int,before:string,after:string>>")
        return df.withColumns({"warnings": F.col("x_warnings"), "diffs": empty, "residual_confirmed": F.lit(0), "residual_suspicious": F.lit(0), "masked": F.lit(None).cast("binary"), "output_name": F.lit(None).cast("string"), "fallback_note": F.lit(None).cast("string"), "again_paragraphs": F.lit(None).cast("array<string>")}).select(*report, *(["again_paragraphs"] if again else []))
    after = once(lambda: F.zip_with("x_paragraphs", "each", lambda p, found: splice(p, found, mode, rules)), "after", mode, rules)
    todo = F.filter("findings", lambda f: f["confidence"] != MASKED)
    changes = once(lambda: F.transform(todo, lambda f: F.struct(f["paragraph_index"].alias("paragraph_index"), f["char_start"].alias("char_start"), f["char_end"].alias("char_end"), replacement(f, mode, rules).alias("replacement"))), "changes", mode, rules)
    df = pinned(pinned(df, "after", after), "changes", changes)
    pairs = F.zip_with("x_paragraphs", "after", lambda before, new: F.struct(before.alias("before"), new.alias("after")))
    diffs = F.filter(F.transform(pairs, lambda d, i: F.struct(i.alias("paragraph_index"), d["before"].alias("before"), d["after"].alias("after"))), lambda d: d["before"] != d["after"])
    df = df.withColumns({"diffs": diffs, "encoding": F.col("x_encoding"), "offsets": F.col("x_offsets"), "first_warnings": F.col("x_warnings")}).drop("x_places", "x_format", "x_error")
    df = with_rewritten(df, "out", ["filename", "content", "format", "encoding", "after", "changes", "offsets"], config.text_only).withColumnsRenamed({"out_content": "masked", "out_name": "output_name", "out_note": "fallback_note"}).drop("content", "after", "changes", "offsets")
    df = pinned(with_extracted(df, "again", "output_name", "masked", text_only=config.text_only), "left", F.flatten(_left(rules)))
    df = df.withColumns({"residual_confirmed": _count(F.col("left"), CONFIRMED), "residual_suspicious": _count(F.col("left"), SUSPICIOUS)})
    left = F.when(F.col("residual_confirmed") > 0, F.concat(F.lit("마스킹 후에도 확정 개인정보 "), F.col("residual_confirmed").cast("string"), F.lit("건이 남아 있습니다.")))
    warnings = F.array_compact(F.concat("first_warnings", F.array("fallback_note"), F.array(left)))
    return df.withColumn("warnings", warnings).select(*report, *(["again_paragraphs"] if again else []))


def text_files(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """A text column as files <id>.txt."""
    return df.select(id_col, F.concat(F.col(id_col).cast("string"), F.lit(".txt")).alias("filename"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("content"))
