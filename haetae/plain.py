"""Detection and masking of single Python strings: for SQL functions and as a second statement to test the plans against."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from haetae import rules as catalog
from haetae.patterns import parse

CONFIRMED, SUSPICIOUS, MASKED, SKIP = "confirmed", "suspicious", "already_masked", "skip"


@dataclass(frozen=True)
class Found:
    rule_id: str
    label: str
    raw: str
    masked_preview: str
    confidence: str
    char_start: int
    char_end: int


def _sum(tokens: str, weights: str) -> int:
    return sum(int(d) * int(w) for d, w in zip(tokens, weights))


def checksum(kind: str, t: str) -> bool:
    if kind == "rrn":
        return (11 - _sum(t[:12], "234567892345") % 11) % 10 == int(t[12])
    if kind == "corp":
        return -_sum(t[:12], "121212121212") % 10 == int(t[12])
    if kind == "biz":
        return -(_sum(t[:9], "137137135") + int(t[8]) * 5 // 10) % 10 == int(t[9])
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(t))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def birth_ok(t: str) -> bool:
    import datetime

    century = 1900 if t[6] in "1256" else 2000 if t[6] in "3478" else None
    try:
        return century is not None and bool(datetime.date(century + int(t[:2]), int(t[2:4]), int(t[4:6])))
    except ValueError:
        return False


def judge(raw: str, validator: str) -> str:
    t, star, sep = re.sub("[^0-9*]", "", raw), "*" in raw, any(c in raw for c in "- –")
    plain = MASKED if star else CONFIRMED
    graded = lambda ok: CONFIRMED if ok else SUSPICIOUS
    match validator:
        case "rrn" | "frn":
            mine = "1234" if validator == "rrn" else "5678"
            if len(t) != 13:
                return SKIP
            if star:
                return MASKED if t[6] in mine + "*" else SKIP
            return graded(checksum("rrn", t)) if t[6] in mine and birth_ok(t) else SKIP
        case "corp":
            return SKIP if len(t) != 13 else MASKED if star else graded(checksum("corp", t))
        case "luhn":
            return SKIP if not 13 <= len(t) <= 19 else MASKED if star else graded(checksum("luhn", t)) if t[0] in "3456" else SKIP
        case "phone":
            return plain if t[:1] == "0" and raw.startswith("01") and (star or 10 <= len(t) <= 11) else SKIP
        case "email":
            return plain if "@" in raw and "." in raw else SKIP
        case "passport":
            whole = re.fullmatch(r"[A-Za-z]{1,2}([0-9*]+)", raw)
            n = len(whole[1]) if whole else 0
            return SKIP if not whole or n > 8 or n < (6 if star else 7) else plain
        case "biz":
            if len(t) != 10:
                return SKIP
            return MASKED if star else CONFIRMED if checksum("biz", t) else SUSPICIOUS if sep else SKIP
        case "health":
            return SKIP if len(t) != 11 else MASKED if star else CONFIRMED if sep else SKIP
        case "bank":
            return plain if 10 <= len(t) <= 14 else SKIP
        case "ip":
            if "." not in raw:
                return plain if ":" in raw else SKIP
            parts = raw.split(".")
            numbers = parts[:3] if parts[-1] == "*" else parts
            return SKIP if len(parts) != 4 or not all(re.fullmatch("[0-9]+", p) and int(p) <= 255 for p in numbers) else MASKED if parts[-1] == "*" else CONFIRMED
    return plain


def _stars(text: str, which: str = "[0-9A-Za-z]") -> str:
    return re.sub(which, "*", text)


def mask(raw: str, mode: str, partial: str = "", token: str = "[PII]") -> str:
    if mode == "replace":
        return token
    if mode == "delete":
        return ""
    keep = {"rrn": (7, 0), "corp": (7, 0), "biz": (3, 0), "health": (6, 0), "account": (0, 4), "card": (4, 4), "phone": (3, 4)}
    if mode == "partial" and partial in keep:
        first, last = keep[partial]
        n, seen, out = len(re.sub("[^0-9]", "", raw)), 0, []
        for c in raw:
            if c in "0123456789":
                out.append(c if seen < first or seen >= n - last else "*")
                seen += 1
            else:
                out.append("*" if partial not in ("card", "phone") and c.isascii() and c.isalpha() else c)
        return "".join(out)
    if mode == "partial" and partial == "email" and "@" in raw:
        local, _, domain = raw.partition("@")
        return f"{local[:1]}{_stars(local[1:], '[^._-]')}@{domain}"
    if mode == "partial" and partial == "driver":
        head = re.match("[^0-9]*", raw)[0]
        return head + "".join("*" if c.isalpha() or c in "0123456789" else c for c in raw[len(head) :])
    if mode == "partial" and partial == "passport":
        return _stars(raw, "[0-9]")
    if mode == "partial" and partial == "ip" and ("." in raw or ":" in raw):
        mark = "." if "." in raw else ":"
        return raw.rpartition(mark)[0] + mark + "*"
    return _stars(raw)


@functools.lru_cache(maxsize=20_000)
def compiled(pattern: str) -> Any:
    import regex

    return regex.compile(parse(pattern).python, regex.V1)


def spans(pattern: Any, text: str) -> Iterator[tuple[int, int]]:
    """Matches that are not empty, as linear-time engines and Java find them: behind an empty one the search goes on one character further."""
    at = 0
    while found := pattern.search(text, at):
        a, b = found.span()
        if b > a:
            yield a, b
        at = b if b > a else b + 1
        if at > len(text):
            break


def find(text: str | None, rules: catalog.RuleSet | None = None) -> list[Found]:
    """Findings of one paragraph in reading order."""
    out: list[Found] = []
    for rule in rules or catalog.builtin():
        for a, _, b in sorted((a, i, b) for i, p in enumerate(rule.patterns) for a, b in spans(compiled(p), text or "")):
            beside = text[a - 1 : a] * (a > 0) + text[b : b + 1]
            if a == b or re.search("[0-9A-Za-z*]", beside) or any(f.char_start < b and a < f.char_end for f in out):
                continue
            if (verdict := judge(text[a:b], rule.validator)) != SKIP:
                raw = text[a:b]
                out.append(Found(rule.id, rule.label, raw, raw if verdict == MASKED else mask(raw, "partial", rule.partial), verdict, a, b))
    return sorted(out, key=lambda f: (f.char_start, f.char_end))


def mask_line(text: str, mode: str = "full", rules: catalog.RuleSet | None = None) -> str:
    """One paragraph with its findings masked."""
    rules = rules or catalog.builtin()
    for f in reversed(find(text, rules)):
        if f.confidence != MASKED:
            rule = rules.get(f.rule_id)
            text = text[: f.char_start] + mask(f.raw, mode, rule.partial, rule.replace_token) + text[f.char_end :]
    return text
