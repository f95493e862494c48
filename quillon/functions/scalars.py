"""Scalar expressions: rounding, ratios, flags, names, redaction, trading cost."""

from __future__ import annotations

import re
from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

REDACTED = "<redacted>"
#: A key's name with what stands between it and its value (``=`` or ``:``, quotes, spaces), then the value, to the next
#: character that cannot be part of one. Covers query strings, reprs of dicts and dataclasses, headers and JSON.
SECRET = r"(?i)\b(api_?key[\"']?\s*[=:]\s*[\"']?)[^\s\"'&<>(),;{}\[\]]+"

BILL_ACTION_WEIGHTS = {
    "introduced": 0.25, "referred_to_committee": 0.5, "committee_hearing": 1.0, "markup": 1.5,
    "reported_out_of_committee": 2.0, "passed_house": 3.0, "passed_senate": 3.0, "signed_into_law": 5.0,
}
ROLE_WEIGHTS = {"chair": 3.0, "ranking_member": 2.5, "subcommittee_chair": 2.0, "member": 1.0}
SECTOR_KEYWORDS = {
    "semiconductors": ["semiconductor", "chip", "fab", "foundry", "AI accelerator"],
    "defense": ["defense", "missile", "munitions", "aerospace", "drone", "DoD"],
    "telecom_broadband": ["broadband", "fiber", "BEAD", "rural internet", "spectrum"],
}


def rounded(value: Column, digits: int = 6) -> Column:
    """Half-up rounding with a nudge below the last digit, so that engines that add up in another order agree on ties."""
    return F.round(value + F.lit(10.0 ** -(digits + 2)), digits)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, b)


def redact(value: object) -> str:
    """Text of ``value`` with every API key replaced."""
    return re.sub(SECRET, rf"\g<1>{REDACTED}", str(value))


def redact_column(text: Column) -> Column:
    return F.regexp_replace(text, SECRET, f"$1{REDACTED}")


def as_date(value: object) -> date | None:
    """A date of a datetime, a date, or a string that begins with one."""
    if value is None:
        return None
    if isinstance(value, datetime):
        return value.date()
    return value if isinstance(value, date) else datetime.strptime(str(value)[:10], "%Y-%m-%d").date()


def as_date_column(text: Column) -> Column:
    return F.substring(text.cast("string"), 1, 10).try_cast("date")


def weight_of(key: Column, weights: dict[str, float]) -> Column:
    """The weight of a key, 0 for an unknown one: a literal map, looked up without a join."""
    flat = [F.lit(x) for pair in weights.items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*flat), key), F.lit(0.0))


def keyword_hits(text: Column, words: list[str]) -> Column:
    """How many of ``words`` occur in the text, in any case."""
    low = F.lower(text)
    hits = [F.when(low.contains(w.lower()), 1).otherwise(0) for w in words]
    out = hits[0]
    for h in hits[1:]:
        out = out + h
    return out.cast("long")


#: Legal forms that do not tell companies apart.
LEGAL_FORMS = "INC|CORP|CORPORATION|CO|COMPANY|LTD|LLC|PLC|GROUP|HOLDINGS"


def normal_name(name: Column) -> Column:
    """Upper case, punctuation to spaces, legal forms dropped, single spaces."""
    clean = F.regexp_replace(F.upper(name), "[^A-Z0-9]+", " ")
    clean = F.regexp_replace(clean, rf"\b({LEGAL_FORMS})\b", " ")
    return F.trim(F.regexp_replace(clean, " +", " "))


def name_score(a: Column, b: Column) -> Column:
    """1 for equal names, less by the share of letters to change."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def impact_bps(order: Column, adv: Column, volatility: Column, coefficient: float = 0.75) -> Column:
    """Square-root market impact in basis points; infinite without trading volume."""
    return F.when(adv <= 0, F.lit(float("inf"))).otherwise(F.lit(coefficient) * volatility * F.sqrt(order / adv) * 10_000)


def trade_allowed(expected: Column, cost: Column, margin: Column | float, turnover: Column, sector: Column, liquid: Column, max_turnover: float = 0.5, max_sector: float = 0.25) -> Column:
    """The expected excess pays for cost and margin, and turnover, sector weight and liquidity are within bounds."""
    return F.coalesce((expected > cost + margin) & (turnover <= max_turnover) & (sector <= max_sector) & liquid, F.lit(False))
