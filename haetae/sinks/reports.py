"""Reports of processed files: CSV rows, JSON and HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haetae.functions.escapes import csv_escape, html_escape
from haetae.operators.detect import FINDING
from haetae.sinks.stitch import write_text

COLUMNS = ("filename", "type", "label", "count", "confirmed", "suspicious", "already_masked", "residual_confirmed", "residual_suspicious", "preview")


def csv_rows(reports: DataFrame) -> DataFrame:
    """A row for each file and rule; a file without findings has one with zeros. Ready for any tabular sink."""
    s = reports.select("filename", "residual_confirmed", "residual_suspicious", F.posexplode_outer("summaries").alias("at", "s"))
    zero = lambda name: F.coalesce(F.col(f"s.{name}"), F.lit(0))
    text = lambda name: F.coalesce(F.col(f"s.{name}"), F.lit(""))
    return s.select("filename", text("rule_id").alias("type"), text("label").alias("label"), *[zero(n).alias(n) for n in COLUMNS[3:7]], "residual_confirmed", "residual_suspicious", text("preview").alias("preview"), F.coalesce("at", F.lit(0)).alias("at"))


def csv_lines(reports: DataFrame) -> DataFrame:
    """filename, at and line: each row of ``csv_rows`` as text."""
    cell = lambda c: csv_escape(F.col(c)) if c in ("filename", "type", "label", "preview") else F.col(c).cast("string")
    return csv_rows(reports).select("filename", "at", F.concat_ws(",", *[cell(c) for c in COLUMNS]).alias("line"))


def csv_report(reports: DataFrame) -> str:
    """One CSV text with a header. It is a single text, so the reports must fit on the driver; else write ``csv_rows``."""
    return "".join(f"{line}\n" for line in [",".join(COLUMNS), *(r["line"] for r in csv_lines(reports).orderBy("filename", "at").toLocalIterator())])


def write_csv_report(reports: DataFrame, path: str) -> int:
    """The same text as ``csv_report`` as one file, written by the executors; its size in bytes."""
    return write_text(csv_lines(reports).orderBy("filename", "at"), "line", path, f"{','.join(COLUMNS)}\n", "\n", "\n")


def json_lines(reports: DataFrame) -> DataFrame:
    """filename and json: the report of each file without its bytes. It holds what was found in clear."""
    kept = [c for c in reports.columns if c not in ("masked",)]
    return reports.select("filename", F.to_json(F.struct(*kept), {"ignoreNullFields": "false"}).alias("json"))


SUMMARY = "array<struct<rule_id:string,label:string,count:int,confirmed:int,suspicious:int,already_masked:int,preview:string>>"
SCHEMA = f"filename string, format string, warnings array<string>, error string, paragraph_count int, findings array<{FINDING}>, summaries {SUMMARY}, diffs array<struct<paragraph_index:int,before:string,after:string>>, confirmed int, suspicious int, already_masked int, residual_confirmed int, residual_suspicious int, output_name string, fallback_note string"


def from_json_lines(lines: DataFrame, json_col: str = "json") -> DataFrame:
    """Reports out of ``json_lines``: CSV and HTML can be made of them again."""
    return lines.select(F.from_json(json_col, SCHEMA).alias("r")).select("r.*")


def from_json_report(spark: SparkSession, report: str) -> DataFrame:
    """Reports out of one JSON document."""
    import json

    files = [(json.dumps(f, ensure_ascii=False),) for f in json.loads(report)["files"]]
    return from_json_lines(spark.createDataFrame(files, "json string"))


def json_report(reports: DataFrame) -> str:
    """One JSON document of all reports, for the driver."""
    import json

    files = [json.loads(r["json"]) for r in json_lines(reports).orderBy("filename").toLocalIterator()]
    return json.dumps({"generated_by": "haetae", "files": files}, ensure_ascii=False, indent=2)


def write_json_report(reports: DataFrame, path: str) -> int:
    """One JSON document of all reports as one file, written by the executors; its size in bytes."""
    return write_text(json_lines(reports).orderBy("filename"), "json", path, '{"generated_by": "haetae", "files": [\n', ",\n", "\n]}\n")


#: Words of the page. Fixed values.
WORDS = {"title": "개인정보 탐지 리포트", "kind": "항목 유형", "count": "건수", "confirmed": "확정", "suspicious": "의심", "already_masked": "마스킹됨", "preview": "미리보기", "left": "잔여", "none": "탐지 없음", "changed": "마스킹 전/후"}


def _tag(name: str, *inner: Column, kind: str = "") -> Column:
    return F.concat(F.lit(f'<{name} class="{kind}">' if kind else f"<{name}>"), *inner, F.lit(f"</{name}>"))


def _each(items: Column, of) -> Column:
    return F.array_join(F.transform(items, of), "")


def html_fragments(reports: DataFrame) -> DataFrame:
    """filename and html: an article for each file, with its counts, its rules as cards, its notes and its changed lines."""
    number = lambda c: c.cast("string")
    pair = lambda label, value: F.concat(_tag("dt", F.lit(label)), _tag("dd", value))
    counts = ("confirmed", "suspicious", "already_masked")
    card = lambda s: _tag("li", _tag("b", html_escape(s["label"])), _tag("dl", pair(WORDS["count"], number(s["count"])), *[pair(WORDS[c], number(s[c])) for c in counts], pair(WORDS["preview"], _tag("code", html_escape(s["preview"])))))
    change = lambda d: _tag("p", _tag("del", html_escape(d["before"])), F.lit("<br>"), _tag("ins", html_escape(d["after"])))
    some = lambda items, of: F.when(F.size(items) > 0, of).otherwise("")
    left = [pair(f"{WORDS['left']} {WORDS[c]}", number(F.col(f"residual_{c}"))) for c in counts[:2]]
    found = F.when(F.size("summaries") > 0, _tag("ul", _each(F.col("summaries"), card), kind="rules")).otherwise(_tag("p", F.lit(WORDS["none"])))
    notes = some("warnings", _tag("aside", _each(F.col("warnings"), lambda w: _tag("p", html_escape(w)))))
    changes = some("diffs", F.concat(_tag("h2", F.lit(WORDS["changed"])), _each(F.col("diffs"), change)))
    article = _tag("article", _tag("header", _tag("h1", html_escape(F.col("filename"))), _tag("dl", pair("", F.col("format")), *left)), found, notes, changes)
    return reports.select("filename", article.alias("html"))


STYLE = "article{max-width:60em;margin:2em auto;font:1em sans-serif}dl,.rules{display:flex;flex-wrap:wrap;gap:.5em;list-style:none;padding:0}dd{margin:0 1em 0 0;font-weight:bold}li{padding:.5em;background:#eef}del{background:#fdd}ins{background:#dfd}"
HEAD = f'<!DOCTYPE html>\n<html lang="ko"><meta charset="utf-8"><title>{WORDS["title"]}</title><style>{STYLE}</style>\n<main>\n'
TAIL = "\n</main></html>"


def html_report(reports: DataFrame) -> str:
    """One page of all articles, for the driver."""
    return HEAD + "\n".join(r["html"] for r in html_fragments(reports).orderBy("filename").toLocalIterator()) + TAIL


def write_html_report(reports: DataFrame, path: str) -> int:
    """The same page as one file, written by the executors; its size in bytes."""
    return write_text(html_fragments(reports).orderBy("filename"), "html", path, HEAD, "\n", TAIL)
