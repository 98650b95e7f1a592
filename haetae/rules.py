"""Rule catalog: TOML rules of what to find, how to check it and how to mask it."""

from __future__ import annotations

import functools
import tomllib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from haetae import patterns

#: Identifiers, labels, priorities and patterns of the built-in rules.
BUILTIN_TOML = r"""
[[rules]]
id = "resident_id"
label = "주민등록번호"
priority = 100
validator = "rrn"
replace_token = "[주민번호]"
partial = "rrn"
pattern = '\d{6}[\s\-–][0-9*]{7}|\d{13}'

[[rules]]
id = "foreign_id"
label = "외국인등록번호"
priority = 95
validator = "frn"
replace_token = "[외국인등록번호]"
partial = "rrn"
pattern = '\d{6}[\s\-–][0-9*]{7}|\d{13}'

[[rules]]
id = "corp_id"
label = "법인등록번호"
priority = 90
validator = "corp"
replace_token = "[법인등록번호]"
partial = "corp"
pattern = '\d{6}[\s\-–][0-9*]{7}|\d{13}'

[[rules]]
id = "credit_card"
label = "신용카드번호"
priority = 85
validator = "luhn"
replace_token = "[신용카드]"
partial = "card"
pattern = '[3-6*](?:[\s\-*]?[0-9*]){12,18}'

[[rules]]
id = "business_id"
label = "사업자등록번호"
priority = 80
validator = "biz"
replace_token = "[사업자번호]"
partial = "biz"
pattern = '\d{3}[\s\-–]?\d{2}[\s\-–]?[0-9*]{5}'

[[rules]]
id = "mobile_phone"
label = "휴대전화"
priority = 75
validator = "phone"
replace_token = "[휴대전화]"
partial = "phone"
pattern = '01[016789][\s\-–]?[0-9*]{3,4}[\s\-–]?[0-9*]{4}'

[[rules]]
id = "email"
label = "이메일"
priority = 70
validator = "email"
replace_token = "[이메일]"
partial = "email"
pattern = '[A-Za-z0-9._%+\-*]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}'

[[rules]]
id = "driver_license"
label = "운전면허번호"
priority = 65
validator = "driver_license"
replace_token = "[운전면허]"
partial = "driver"
pattern = '(?:서울|부산|대구|인천|광주|대전|울산|세종|경기|강원|충북|충남|전북|전남|경북|경남|제주|[0-9*]{2})[\s\-–][0-9*]{2}[\s\-–][0-9*]{6}[\s\-–][0-9*]{2}'

[[rules]]
id = "passport"
label = "여권번호"
priority = 60
validator = "passport"
replace_token = "[여권번호]"
partial = "passport"
pattern = '[A-Z]{1,2}[0-9*]{6,8}'

[[rules]]
id = "bank_account"
label = "계좌번호"
priority = 55
validator = "bank"
replace_token = "[계좌번호]"
partial = "account"
patterns = [
  '[0-9*]{3}[\s\-][0-9*]{2}[\s\-][0-9*]{6}[\s\-][0-9*]{3}',
  '[0-9*]{3}[\s\-][0-9*]{3}[\s\-][0-9*]{6}',
  '[0-9*]{4}[\s\-][0-9*]{3}[\s\-][0-9*]{6}',
  '[0-9*]{3}[\s\-][0-9*]{6}[\s\-][0-9*]{5}',
  '[0-9*]{3}[\s\-][0-9*]{4}[\s\-][0-9*]{4}[\s\-][0-9*]{2}',
  '[0-9*]{6}[\s\-][0-9*]{2}[\s\-][0-9*]{6}',
  '[0-9*]{3}[\s\-][0-9*]{6}[\s\-][0-9*]{2}[\s\-][0-9*]{3}',
  '[0-9*]{4}[\s\-][0-9*]{2}[\s\-][0-9*]{7}',
  '[0-9*]{3}[\s\-][0-9*]{2}[\s\-][0-9*]{7}',
]

[[rules]]
id = "health_insurance"
label = "건강보험증번호"
priority = 50
validator = "health"
replace_token = "[건강보험증]"
partial = "health"
pattern = '\d{6}[\s\-–][0-9*]{5}|\d{11}'

[[rules]]
id = "ip_address"
label = "IP 주소"
priority = 40
validator = "ip"
replace_token = "[IP주소]"
partial = "ip"
patterns = [
  '(?:(?:25[0-5]|2[0-4]\d|1?\d{1,2})\.){3}(?:25[0-5]|2[0-4]\d|1?\d{1,2}|\*)',
  '(?:[0-9A-Fa-f]{1,4}:){2,7}[0-9A-Fa-f]{1,4}',
]
"""

#: Each match of a built-in pattern has one of these characters, so that other paragraphs need no search.
GUARD = r"(?U)[\d*@:]"


#: Further tests, each passed by every match of a pattern: six digits or stars with at most one separator between
#: neighbours for numbers, and what an address can't be without. A property of the pattern, whatever rule has it.
DENSE = r"(?U)[\d*](?:[\s\-–]?[\d*]){5}"
#: Three parts of an account number: all of its patterns have them.
PARTED = r"(?U)[0-9*]{3}[\s\-][0-9*]{2,6}[\s\-][0-9*]{2}"
#: A licence number without its region.
LICENCE = r"(?U)[\s\-–][0-9*]{2}[\s\-–][0-9*]{6}[\s\-–][0-9*]{2}"
_INNER = {"driver_license": LICENCE, "bank_account": PARTED}
_MARKS = {"email": (r"@",), "ip_address": (r"(?U)\d\.\d", r":")}


class RuleError(ValueError):
    """A rule file that can't be used."""


@dataclass(frozen=True)
class Rule:
    id: str
    label: str
    patterns: tuple[str, ...]
    priority: int = 0
    validator: str = "none"
    replace_token: str = ""
    partial: str = ""


@dataclass(frozen=True)
class RuleSet:
    """Rules by falling priority; equal ones in the order of declaration. ``guard`` holds for built-in patterns only."""

    rules: tuple[Rule, ...]
    guard: str | None = None

    def __iter__(self):
        return iter(self.rules)

    def __len__(self) -> int:
        return len(self.rules)

    def get(self, rule_id: str) -> Rule | None:
        return next((r for r in self.rules if r.id == rule_id), None)

    def slow(self) -> list[tuple[str, str]]:
        """(rule, pattern) of patterns whose time may grow with a power of a line's length."""
        return [(r.id, p) for r in self.rules for p in r.patterns if patterns.ambiguity(patterns.parse(p).tree) in ("polynomial", "unknown")]

    def dataframe(self, spark: SparkSession) -> DataFrame:
        rows = [(r.id, r.label, r.priority, r.validator, r.replace_token, r.partial, list(r.patterns), i) for i, r in enumerate(self.rules)]
        return spark.createDataFrame(rows, "id string, label string, priority int, validator string, replace_token string, partial string, patterns array<string>, ord int")

#: The card pattern, and 13 of its digits or stars. A star may be a separator or stand for a digit, so the pattern tries every way to pair stars before
#: it takes 13 one by one, or finds too few. Read with other separators alone there is one way: fewer than 13 hold no match, 13 with none behind
#: them only this one.
CARD, THIRTEEN = r"[3-6*](?:[\s\-*]?[0-9*]){12,18}", r"[3-6*](?:[\s\-]?+[0-9*]){12}+"


def java_pattern(pattern: str) -> str:
    """The pattern for Java's engine: Unicode classes, line ends and text ends as in linear-time engines.

    A leading run of a class is not tried from each of its characters: before a character that isn't in the class, it
    either leads to a match from its first character on or from none. So a match starts where the last one ended or
    behind a character outside the class, and never gives characters of the run back. Else a long line of letters costs
    the square of its length.
    """
    parsed = patterns.parse(pattern)
    made = parsed.java
    if run := patterns.leading_run(parsed):
        leaf = run[0].render(patterns.JAVA)
        made = rf"(?:\G|(?<!{leaf})){leaf}++{run[1]}"
    if pattern == CARD:
        made = rf"(?={THIRTEEN})(?:{THIRTEEN}(?![\s\-]?[0-9*])|{made})"
    return f"(?U)(?d){made}"


def _check(pattern: str, rule_id: str) -> str:
    """The pattern, if it can be run in time: one with exponentially many ways through a text would never end in a backtracking engine."""
    try:
        parsed = patterns.parse(pattern)
    except patterns.PatternError as error:
        raise RuleError(f"rule {rule_id!r}: {error}") from error
    if patterns.ambiguity(parsed.tree) == "exponential":
        raise RuleError(f"rule {rule_id!r}: there are exponentially many ways to match the pattern, write it without loops that read the same text: {pattern}")
    return pattern


def checked(rule_id: str, label: str, sources: tuple[str, ...], priority: int = 0, validator: str = "none", token: str | None = None, partial: str = "") -> Rule:
    """A rule whose patterns can be run; an empty token becomes [label]."""
    return Rule(rule_id, label, tuple(_check(p, rule_id) for p in sources), priority, validator, token or f"[{label}]", partial)


def _ordered(rules: Sequence[Rule], guard: str | None) -> RuleSet:
    return RuleSet(tuple(sorted(rules, key=lambda r: -r.priority)), guard)


def load(toml_text: str, guard: str | None = None) -> RuleSet:
    """Rules of a TOML text. Unknown keys are ignored; a rule without a pattern is an error; an empty token becomes [label]."""
    try:
        parsed = tomllib.loads(toml_text)
    except tomllib.TOMLDecodeError as error:
        raise RuleError(str(error)) from error
    rules = []
    for raw in parsed.get("rules", []):
        if "id" not in raw or "label" not in raw:
            raise RuleError("a rule needs id and label")
        sources = ([raw["pattern"]] if raw.get("pattern") is not None else []) + list(raw.get("patterns") or [])
        if not sources:
            raise RuleError(f"규칙 '{raw['id']}' 에 pattern 이 없습니다")
        rules.append(checked(raw["id"], raw["label"], tuple(sources), int(raw.get("priority", 0)), raw.get("validator", "none"), raw.get("replace_token"), raw.get("partial", "")))
    return _ordered(rules, guard)


def builtin() -> RuleSet:
    return load(BUILTIN_TOML, GUARD)


@functools.lru_cache
def pattern_guards() -> dict[str, tuple[str, ...]]:
    """For each built-in pattern cheap tests that every match passes, the one that more patterns share first."""
    return {p: (_MARKS[r.id][i],) if r.id in _MARKS else (DENSE, _INNER[r.id]) if r.id in _INNER else (DENSE,) for r in builtin() for i, p in enumerate(r.patterns)}


def overlay(base: RuleSet, toml_text: str) -> RuleSet:
    """``base`` with further rules: one with a known id takes the other's place, others are added; blank text changes nothing."""
    if not toml_text.strip():
        return base
    extra = {r.id: r for r in load(toml_text)}
    merged = [extra.pop(r.id, r) for r in base]
    return _ordered([*merged, *extra.values()], None)
