"""Money and whole numbers in statement texts. Amounts are decimal(18,2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reconcilia.functions.text import word_text

MONEY = "decimal(18,2)"
# What each layout takes for an amount.
BANAMEX = r"^[+-]?\(?\$?\d{1,3}(?:,\d{3})*(?:\.\d{2})?\)?$"
BANORTE = r"^[+-]?\(?\$?\d{1,3}(?:,\d{3})*(?:\.\d{1,2})?\)?$"
BANORTE_SUMMARY = r"^(?:\$?\d{1,3}(?:,\d{3})*(?:\.\d{2})?-?|-\$?\d{1,3}(?:,\d{3})*(?:\.\d{2})?)$"
BANAMEX_SUMMARY = r"^[-+]?\$?\d{1,3}(?:,\d{3})*(?:\.\d{2})?$"
SHORT_INTEGER = r"^\d{1,3}$"
BBVA_GLOBAL = r"^[+-]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d{2,})?$"
PERCENT = r"^(\d+(?:\.\d+)?)%$"


def zero() -> Column:
    return F.lit(0).cast(MONEY)


def is_amount(text: Column, pattern: str) -> Column:
    return word_text(text).rlike(pattern)


def number(text: Column) -> Column:
    """A decimal, or null."""
    return text.try_cast(MONEY)


def plain(text: Column) -> Column:
    """Commas removed; anything else is 0."""
    return F.coalesce(number(F.trim(F.replace(text, F.lit(","), F.lit("")))), zero())


def spaced_or_null(text: Column) -> Column:
    """Commas and spaces removed; null if that is no number."""
    return number(F.translate(text, ", ", ""))


def spaced(text: Column) -> Column:
    return F.coalesce(spaced_or_null(text), zero())


def whole(text: Column) -> Column:
    """As above, cut to an integer; 0 if that is no number."""
    return F.coalesce(F.translate(text, ", ", "").try_cast("double").cast("int"), F.lit(0))


def rate(text: Column) -> Column:
    """Commas and spaces removed, all decimals kept; 0 if that is no number."""
    return F.coalesce(F.translate(text, ", ", "").try_cast("double"), F.lit(0.0))


def bare(text: Column) -> Column:
    """``$`` and commas removed."""
    return F.trim(F.replace(F.replace(word_text(text), F.lit("$"), F.lit("")), F.lit(","), F.lit("")))


def in_parentheses(text: Column, trailing_minus: bool = False) -> Column:
    """``$`` and commas removed; parentheses (or a minus behind, if so asked) make it negative; else 0."""
    return bare_in_parentheses(bare(text), trailing_minus)


def bare_in_parentheses(bare: Column, trailing_minus: bool = False) -> Column:
    """The same from ``bare`` text, best a column of its own, as it is read several times."""
    minus = bare.endswith("-") if trailing_minus else F.lit(False)
    bare = F.when(minus, F.trim(F.regexp_replace(bare, "-$", ""))).otherwise(bare)
    wrapped = bare.startswith("(") & bare.endswith(")")
    inner = F.when(wrapped, F.trim(F.regexp_replace(bare, r"^\(|\)$", ""))).otherwise(bare)
    value = F.coalesce(number(inner), zero())
    return F.when(wrapped | minus, -value).otherwise(value).cast(MONEY)


def optional(text: Column) -> Column:
    """``$`` and commas removed; N/A and other texts are null."""
    return F.when(text != "N/A", number(F.trim(F.translate(text, "$,", ""))))


def optional_whole(text: Column) -> Column:
    return F.when(text != "N/A", F.trim(text).try_cast("double").cast("int"))


def percent(text: Column) -> Column:
    return F.regexp_extract(word_text(text), PERCENT, 1).try_cast("double")


def signed(sign: Column, amount: Column) -> tuple[Column, Column]:
    """(credit, debit) of an amount with sign 1, -1 or 0."""
    known = F.coalesce(amount, zero())
    return F.when(sign > 0, known).otherwise(zero()), F.when(sign < 0, known).otherwise(zero())
