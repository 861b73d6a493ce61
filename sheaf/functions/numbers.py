"""Exact decimal text handling: no floating point."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from sheaf.functions.text import WHITESPACE, WS, col

# Fixed pattern: headings whose columns hold identifiers, never quantities.
IDENTIFIER_HEADING = (
    r"(?i)\b(?:account|acct|a/c|ecr|employee\s*(?:id|no|number|code)"
    r"|reference|ref|code|serial|sr\.?\s*no)\b"
)
# Fixed pattern: a complete, unambiguous quantity, plain, negative or in accounting brackets.
_QUANTITY = r"(?:0|[1-9]\d*|[1-9]\d{0,2}(?:,\d{3})+)(?:\.\d+)?"
LITERAL = rf"^{WS}*(?:-?{_QUANTITY}|\({_QUANTITY}\)){WS}*\z"


@dataclass(frozen=True)
class NumberRule:
    """Explicit number format of one compared field."""

    decimal: str = "."
    grouping: str = ","
    currency: str = ""
    max_fraction_digits: int = 2

    def problem(self) -> str | None:
        import unicodedata

        if not 0 <= self.max_fraction_digits <= 12:
            return "fraction digits"
        if self.decimal not in (".", ",") or self.grouping not in (".", ",", "") or self.grouping == self.decimal:
            return "separators"
        if self.currency and not (len(self.currency) <= 3 and all("A" <= c <= "Z" or unicodedata.category(c) == "Sc" for c in self.currency)):
            return "currency"
        return None


def decimal_key(text: Column | str, rule: NumberRule) -> Column:
    """Canonical scaled-integer string of normalised ``text`` under ``rule``, NULL when it does not parse.

    Equality of two keys is exact equality of the amounts at any width up to 50 digits.
    """
    if rule.problem():
        raise ValueError("invalid numeric rule: " + rule.problem())
    v = col(text)
    grouped = rf"|[1-9]\d{{0,2}}(?:\{rule.grouping}\d{{3}})+" if rule.grouping else ""
    frac = rf"(?:\{rule.decimal}\d{{1,{rule.max_fraction_digits}}})?" if rule.max_fraction_digits else ""
    currency = rf"(?:\Q{rule.currency}\E{WS}*)?" if rule.currency else ""
    pattern = rf"^{currency}-?(?:0|[1-9]\d*{grouped}){frac}$"
    # A text that fits the pattern is one number once its decoration is dropped.
    bare = F.translate(v, rule.grouping + rule.currency + WHITESPACE + "-", "")
    whole = F.substring_index(bare, rule.decimal, 1)
    fraction = F.when(bare.contains(rule.decimal), F.substring_index(bare, rule.decimal, -1)).otherwise("")
    digits = F.ltrim(F.concat(whole, F.rpad(fraction, rule.max_fraction_digits, "0")), F.lit("0"))
    value = F.when(digits == "", "0").when(v.contains("-"), F.concat(F.lit("-"), digits)).otherwise(digits)
    return F.when(v.rlike(pattern) & (F.length(whole) <= 50), value)


def identifier_heading(heading: Column | str) -> Column:
    return col(heading).rlike(IDENTIFIER_HEADING)


def numeric_literal(text: Column | str) -> Column:
    """DECIMAL(38,15) of a conservative literal: thousands groups, accounting negatives,
    at most 15 digits, no leading zeros; otherwise NULL."""
    v = col(text)
    # A text that fits the pattern is one number once its decoration is dropped; others are never trimmed.
    bare = F.translate(v, "(),-" + WHITESPACE, "")
    signed = F.when(v.contains("(") | v.contains("-"), F.concat(F.lit("-"), bare)).otherwise(bare)
    digits = F.length(F.replace(bare, F.lit("."), F.lit("")))
    return F.when(v.rlike(LITERAL) & (digits <= 15), signed.try_cast("decimal(38,15)"))


def plain_number(c: Column | str) -> Column:
    """Shortest plain text of a decimal: no trailing zeros, no negative zero."""
    t = col(c).cast("string")
    t = F.when(t.contains("."), F.regexp_replace(F.regexp_replace(t, "0+$", ""), r"\.$", "")).otherwise(t)
    return F.when(t.isin("-0", "0E-12", "0E-15"), F.lit("0")).otherwise(t)
