"""Mask modes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FULL, PARTIAL, REPLACE, DELETE = "full", "partial", "replace", "delete"
#: Kinds of partial masks.
KINDS = ("rrn", "corp", "biz", "health", "account", "card", "phone", "email", "driver", "passport", "ip")
#: Other names of the modes.
ALIASES = {"full": FULL, "partial": PARTIAL, "부분": PARTIAL, "replace": REPLACE, "치환": REPLACE, "delete": DELETE, "삭제": DELETE}


def parse_mode(name: str) -> str:
    """A mode by its English or Korean name, trimmed, in any case; anything else is ``full``."""
    return ALIASES.get(name.strip().lower(), FULL)


def stars(raw: Column, letters: str = "[0-9A-Za-z]") -> Column:
    return F.regexp_replace(raw, letters, "*")


def mask_full(raw: Column) -> Column:
    """ASCII letters and digits become stars; separators and other letters stay."""
    return stars(raw)


def _after(raw: Column, head: Column) -> Column:
    return F.substr(raw, F.length(head) + 1)


def _before(raw: Column, tail: Column) -> Column:
    return F.left(raw, F.length(raw) - F.length(tail))


def keep_first(raw: Column, keep: int) -> Column:
    """The first ``keep`` digits stay, other digits and ASCII letters become stars."""
    head = F.regexp_extract(raw, rf"^(?:[^0-9]*[0-9]){{0,{keep}}}[^0-9]*", 0)
    return F.concat(stars(head, "[A-Za-z]"), stars(_after(raw, head)))


def _last(raw: Column, keep: int) -> Column:
    return F.regexp_extract(raw, rf"(?:[0-9][^0-9]*){{0,{keep}}}\z", 0)


def keep_last(raw: Column, keep: int) -> Column:
    """The last ``keep`` digits stay, other digits and ASCII letters become stars."""
    tail = _last(raw, keep)
    return F.concat(stars(_before(raw, tail)), stars(tail, "[A-Za-z]"))


def keep_both(raw: Column, first: int, last: int) -> Column:
    """The first and the last digits stay, those between become stars, all else stays."""
    head = F.regexp_extract(raw, rf"^(?:[^0-9]*[0-9]){{0,{first}}}", 0)
    rest = _after(raw, head)
    tail = _last(rest, last)
    return F.concat(head, stars(_before(rest, tail), "[0-9]"), tail)


def mask_partial(raw: Column, kind: str) -> Column:
    """The partial mask of a kind; an unknown kind masks in full."""
    if kind in ("rrn", "corp"):
        return keep_first(raw, 7)
    if kind == "biz":
        return keep_first(raw, 3)
    if kind == "health":
        return keep_first(raw, 6)
    if kind == "account":
        return keep_last(raw, 4)
    if kind == "card":
        return keep_both(raw, 4, 4)
    if kind == "phone":
        return keep_both(raw, 3, 4)
    if kind == "email":
        local = F.substring_index(raw, "@", 1)
        masked = F.concat(F.left(local, F.lit(1)), stars(F.substr(local, F.lit(2)), "[^._-]"), _after(raw, local))
        return F.when(F.contains(raw, F.lit("@")), masked).otherwise(mask_full(raw))
    if kind == "driver":
        head = F.regexp_extract(raw, "^[^0-9]*", 0)
        return F.concat(head, stars(_after(raw, head), r"[0-9\p{IsAlphabetic}]"))
    if kind == "passport":
        return stars(raw, "[0-9]")
    if kind == "ip":
        cut = lambda mark: F.regexp_replace(raw, rf"\{mark}[^{mark}]*\z", f"{mark}*")
        return F.when(F.contains(raw, F.lit(".")), cut(".")).when(F.contains(raw, F.lit(":")), cut(":")).otherwise(mask_full(raw))
    return mask_full(raw)


def apply_mode(raw: Column, mode: str, partial: str = "", token: str = "[PII]") -> Column:
    return {FULL: lambda: mask_full(raw), PARTIAL: lambda: mask_partial(raw, partial), REPLACE: lambda: F.lit(token), DELETE: lambda: F.lit("")}[mode]()
