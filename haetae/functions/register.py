"""For SQL: views of a table's findings and masked texts, and functions over single values."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from haetae import rules as catalog
from haetae.functions.checks import VALIDATORS, verdict
from haetae.functions.masks import ALIASES, DELETE, FULL, PARTIAL, REPLACE, parse_mode
from haetae.operators.detect import by_value, detect, findings
from haetae.operators.mask import mask_text, masked_text
from haetae.sources.text import text_lines


def register_views(spark: SparkSession, table: str, keys: list[str], text_col: str = "text", mode: str = "full", rules: catalog.RuleSet | None = None) -> tuple[str, str]:
    """Views ``{table}_findings`` (``keys`` and the fields of a finding) and ``{table}_masked`` (the table and a column ``masked``).

    They are the expressions of ``operators`` over the table, so a query of them runs inside the JVM, with filters and
    columns pushed down to the table's scan. This is the form for tables of any size.
    """
    name = table.rpartition(".")[2]
    detect(spark.table(table), keys, text_col, rules).createOrReplaceTempView(f"{name}_findings")
    mask_text(spark.table(table), text_col, "masked", parse_mode(mode), rules).createOrReplaceTempView(f"{name}_masked")
    return f"{name}_findings", f"{name}_masked"


#: String literals, which stay, and operators in the form of a function call, which SQL wants quoted.
_CALLS = re.compile(r"('(?:[^'\\]|\\.)*')|(?<![\w`])(<=>|<=|>=|=|<|>|\+|-|\*|/|%|!|&|\||and|or|in|not)\(", re.S)


def sql_text(column: Column) -> str:
    """An expression as SQL that the parser reads again. Sessions of the classic kind alone can tell it."""
    node = getattr(column, "_jc", None)
    if node is None:
        raise RuntimeError("SQL functions need a classic session; elsewhere take the views, or the expressions in haetae.operators")
    return _CALLS.sub(lambda m: m[1] or f"`{m[2]}`(", node.node().sql())


def register(spark: SparkSession, rules: catalog.RuleSet | None = None) -> None:
    """``find_identifiers(text)`` gives a row for each finding of every line, ``mask_identifiers(text, mode)`` the masked text, ``check_identifier(raw, validator)`` a verdict.

    Their bodies are the expressions of ``operators`` as SQL, which the optimizer puts in place of the call: no Python runs, filters and
    columns reach the scan, and a mode or validator that is a literal leaves its own branch alone.
    """
    rules = rules or catalog.builtin()
    text, raw = F.col("text"), F.col("raw")
    fields = {"paragraph_index": "int", "rule_id": "string", "label": "string", "raw": "string", "masked_preview": "string", "confidence": "string", "char_start": "int", "char_end": "int"}
    each = F.flatten(F.transform(text_lines(text), lambda line, i: findings(line, rules, i)))
    rows = F.transform(each, lambda f: F.struct(*[f[c].alias(c) for c in fields]))
    mode = F.lower(F.trim("mode"))
    names = [(m, [n for n, of in ALIASES.items() if of == m]) for m in (PARTIAL, REPLACE, DELETE)]
    masked = F.when(text.isNull(), F.lit(None).cast("string"))
    for m, called in names:
        masked = masked.when(mode.isin(called), masked_text(text, m, rules))
    masked = masked.otherwise(masked_text(text, FULL, rules))
    judged = F.when(raw.isNull(), F.lit(None).cast("string")).otherwise(by_value(F.col("validator"), VALIDATORS, lambda v: verdict(raw, v), verdict(raw, "none")))
    create = "CREATE OR REPLACE TEMPORARY FUNCTION"
    spark.sql(f"{create} find_identifiers(text STRING) RETURNS TABLE({', '.join(f'{n} {t}' for n, t in fields.items())}) RETURN SELECT inline({sql_text(rows)})")
    spark.sql(f"{create} mask_identifiers(text STRING, mode STRING) RETURNS STRING RETURN {sql_text(masked)}")
    spark.sql(f"{create} check_identifier(raw STRING, validator STRING) RETURNS STRING RETURN {sql_text(judged)}")
