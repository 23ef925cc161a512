"""Dates in statement texts; they stay texts, as two banks write no year."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reconcilia.functions.text import found, word_text, word_upper

# Date forms of the layouts.
LETTER = "[A-ZÁÉÍÓÚÑ]"
MONTHS = "ENE|FEB|MAR|ABR|MAY|JUN|JUL|AGO|SEP|OCT|NOV|DIC"
DAY_MONTH = rf"(?iU)^(?:\d{{1,2}}[ /-]{LETTER}{{3,9}}|\d{{1,2}} {LETTER}{{3,9}} \d{{4}}|\d{{1,2}}/{LETTER}{{3,9}}/\d{{4}})$"
DAY_ABBREVIATION = rf"^(0*(?:[1-9]|[12]\d|3[01])) (?:{MONTHS})\S*$"
PREFIX = rf"(?iU)^(\d{{1,2}}-{LETTER}{{3}}-(?:\d{{4}}(?!\d)|\d{{2}}))"
LOOSE_PREFIX = rf"(?iU)^(\d{{1,2}}-{LETTER}{{3}}-\d{{2,4}})"
SLASHED = r"(?U)\d{1,2}/[A-Za-zÁÉÍÓÚáéíóúÑñ]+/\d{4}\b"


def is_day_month(text: Column) -> Column:
    """``05 ENE``, ``05/ENE``, ``05-ENE``, the first two with a year, or a day and a month abbreviation."""
    upper = word_upper(text)
    return upper.rlike(DAY_MONTH) | upper.rlike(DAY_ABBREVIATION)


def date_prefix(text: Column, pattern: str = PREFIX) -> Column:
    """``dd-MMM-yyyy`` or ``dd-MMM-yy`` at the start, upper case, else null."""
    return F.upper(found(word_text(text), pattern))


def without_date_prefix(text: Column) -> Column:
    return F.trim(F.regexp_replace(word_text(text), PREFIX, ""))


def slashed_date(text: Column) -> Column:
    return found(text, SLASHED, 0)
