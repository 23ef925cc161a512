"""The account number (CLABE) in a document's head, and its bank."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reconcilia.functions.text import clabe_or_null, found

# Labelled forms, in order of priority. In Unicode mode as texts may hold no-break spaces.
RUN = r"((?:\d[\s-]*){18})"
LABELLED = [
    r"(?iU)CLABE\s+(\d{3}\s+\d{3}\s+\d{11}\s+\d)",
    rf"(?iU)CLABE\s+Personalizada\s+{RUN}",
    rf"(?iU)CLABE\s+INTERBANCARIA\s+{RUN}",
    rf"(?iU)CLABE\):\s*{RUN}",
    rf"(?iU)CLABE(?:\s+Interbancaria|:)?\s*{RUN}",
    rf"(?iU)CLABE(?:.|\n){{0,80}}?{RUN}",
]
# Forms in a table below the label, in order.
TABULAR = [r"(?U)\b\d{18}\b", r"(?U)\b\d{3}\s+\d{3}\s+\d{11}\s+\d\b", r"(?U)\b(?:\d[\s-]*){18}\b"]
WINDOW = 500


def tabular_clabe(text: Column) -> Column:
    """If text, not a digit, follows the first word CLABE: the number within the next 500 characters."""
    after = F.regexp_extract(text, r"(?isU)^.*?\bCLABE\b(.*)$", 1)
    labelled = text.rlike(r"(?iU)\bCLABE\b")
    numeric = F.regexp_replace(after, r"(?U)^\s+", "").rlike(r"(?U)^\d")
    window = F.substring(after, 1, WINDOW)
    return F.when(labelled & ~numeric, F.coalesce(*(clabe_or_null(found(window, p, 0)) for p in TABULAR)))


def labelled_clabe(text: Column) -> Column:
    return F.coalesce(*(clabe_or_null(found(text, p)) for p in LABELLED))


def clabe(text: Column) -> Column:
    """One number a document: the tabular form before the labelled ones."""
    return F.coalesce(tabular_clabe(text), labelled_clabe(text))
