"""Check digits and format checks as Column expressions; no Python runs per row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from haetae.operators.pieces import let

CONFIRMED, SUSPICIOUS, MASKED, SKIP = "confirmed", "suspicious", "already_masked", "skip"


#: Korean names of the verdicts. Fixed values.
LABELS = {CONFIRMED: "확정", SUSPICIOUS: "의심", MASKED: "이미 마스킹됨"}


def verdict_label(confidence: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair]), confidence)


def digit_stars(raw: Column) -> Column:
    """ASCII digits and stars."""
    return F.regexp_replace(raw, "[^0-9*]", "")


def digits(raw: Column) -> Column:
    return F.regexp_replace(raw, "[^0-9]", "")


def has_star(raw: Column) -> Column:
    return F.contains(raw, F.lit("*"))


def digit(tokens: Column, i: int) -> Column:
    """The ``i``-th digit from 0; other characters give numbers outside 0 to 9."""
    return F.ascii(F.substring(tokens, i + 1, 1)) - F.lit(48)


def _weighted(tokens: Column, weights: Sequence[int]) -> Column:
    total = F.lit(0)
    for i, w in enumerate(weights):
        total = total + digit(tokens, i) * w
    return total


def rrn_ok(tokens: Column) -> Column:
    """Check digit of a resident or foreigner number: weights 2 to 9 and 2 to 5, then 11 minus the remainder by 11."""
    return (F.lit(11) - _weighted(tokens, (2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5)) % 11) % 10 == digit(tokens, 12)


def corp_ok(tokens: Column) -> Column:
    """Check digit of a corporate number: weights 1 and 2 in turn."""
    return (F.lit(10) - _weighted(tokens, (1, 2) * 6) % 10) % 10 == digit(tokens, 12)


def biz_ok(tokens: Column) -> Column:
    """Check digit of a business number: weights 1, 3, 7, ..., 5, and the tens of five times the ninth digit."""
    return (F.lit(10) - (_weighted(tokens, (1, 3, 7, 1, 3, 7, 1, 3, 5)) + F.floor(digit(tokens, 8) * 5 / 10)) % 10) % 10 == digit(tokens, 9)


def luhn_ok(tokens: Column) -> Column:
    """Luhn check of 13 to 19 digits."""
    return F.length(tokens).between(13, 19) & F.coalesce(F.call_function("luhn_check", tokens), F.lit(False))


def luhn_check_digit(tokens: Column) -> Column:
    """The digit that makes ``tokens`` a number with a valid Luhn check when put behind it; null without digits."""
    whole = digits(tokens)
    doubled = F.transform(F.reverse(F.split(whole, "")), lambda d, i: F.when(i % 2 == 0, F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)).otherwise(d.cast("int")))
    return F.when(F.length(whole) > 0, (F.lit(10) - F.aggregate(doubled, F.lit(0), lambda acc, d: acc + d) % 10) % 10)


def rrn_date_ok(tokens: Column) -> Column:
    """yymmdd and the century that the seventh digit stands for."""
    number = lambda i: digit(tokens, i) * 10 + digit(tokens, i + 1)
    gender = digit(tokens, 6)
    year = F.when(gender.isin(1, 2, 5, 6), F.lit(1900)).when(gender.isin(3, 4, 7, 8), F.lit(2000)) + number(0)
    month, day = number(2), number(4)
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    days = F.when(month.isin(1, 3, 5, 7, 8, 10, 12), 31).when(month.isin(4, 6, 9, 11), 30).when(month == 2, F.when(leap, 29).otherwise(28)).otherwise(0)
    return F.coalesce(year.isNotNull() & (day >= 1) & (day <= days), F.lit(False))


def _masked_or(raw: Column, verdict: Column | str) -> Column:
    return F.when(has_star(raw), MASKED).otherwise(verdict)


def _separated(raw: Column) -> Column:
    return raw.rlike("[- –]")


#: Checks that rules may name; any other name only asks for stars.
VALIDATORS = ("rrn", "frn", "corp", "luhn", "phone", "email", "passport", "biz", "health", "bank", "ip")
#: Those that read the digits and stars.
_BY_TOKENS = ("rrn", "frn", "corp", "luhn", "phone", "biz", "health", "bank")


def verdict(raw: Column, validator: str) -> Column:
    """confirmed, suspicious, already_masked or skip. An unknown validator confirms what holds no star."""
    return let(digit_stars(raw), lambda tokens: _verdict(raw, tokens, validator)) if validator in _BY_TOKENS else _verdict(raw, digit_stars(raw), validator)


def _verdict(raw: Column, tokens: Column, validator: str) -> Column:
    n, star = F.length(tokens), has_star(raw)
    if validator in ("rrn", "frn"):
        low, high = (1, 4) if validator == "rrn" else (5, 8)
        gender = digit(tokens, 6)
        mine = gender.between(low, high)
        checked = F.when(mine & rrn_date_ok(tokens), F.when(rrn_ok(tokens), CONFIRMED).otherwise(SUSPICIOUS)).otherwise(SKIP)
        return F.when(n != 13, SKIP).when(star, F.when(mine | (F.substring(tokens, 7, 1) == "*"), MASKED).otherwise(SKIP)).otherwise(checked)
    if validator == "corp":
        return F.when(n != 13, SKIP).otherwise(_masked_or(raw, F.when(corp_ok(tokens), CONFIRMED).otherwise(SUSPICIOUS)))
    if validator == "luhn":
        checked = F.when(digit(tokens, 0).between(3, 6), F.when(luhn_ok(tokens), CONFIRMED).otherwise(SUSPICIOUS)).otherwise(SKIP)
        return F.when(~n.between(13, 19), SKIP).otherwise(_masked_or(raw, checked))
    if validator == "phone":
        fine = (digit(tokens, 0) == 0) & raw.startswith("01") & (F.length(digits(raw)).between(10, 11) | star)
        return F.when(fine, _masked_or(raw, F.lit(CONFIRMED))).otherwise(SKIP)
    if validator == "email":
        return F.when(F.contains(raw, F.lit("@")) & F.contains(raw, F.lit(".")), _masked_or(raw, F.lit(CONFIRMED))).otherwise(SKIP)
    if validator == "passport":
        return F.when(raw.rlike(r"^[A-Za-z]{1,2}[0-9]{7,8}\z"), CONFIRMED).when(star & raw.rlike(r"^[A-Za-z]{1,2}[0-9*]{6,8}\z"), MASKED).otherwise(SKIP)
    if validator == "biz":
        checked = F.when(biz_ok(tokens), CONFIRMED).when(_separated(raw), SUSPICIOUS).otherwise(SKIP)
        return F.when(n != 10, SKIP).otherwise(_masked_or(raw, checked))
    if validator == "health":
        return F.when(n != 11, SKIP).otherwise(_masked_or(raw, F.when(_separated(raw), CONFIRMED).otherwise(SKIP)))
    if validator == "bank":
        return F.when(n.between(10, 14), _masked_or(raw, F.lit(CONFIRMED))).otherwise(SKIP)
    if validator == "ip":
        octet = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
        dotted = F.when(raw.rlike(rf"^(?:{octet}\.){{3}}{octet}\z"), CONFIRMED).when(raw.rlike(rf"^(?:{octet}\.){{3}}\*\z"), MASKED).otherwise(SKIP)
        return F.when(F.contains(raw, F.lit(".")), dotted).when(F.contains(raw, F.lit(":")), _masked_or(raw, F.lit(CONFIRMED))).otherwise(SKIP)
    return _masked_or(raw, F.lit(CONFIRMED))
