"""Text: canonical forms, digits and labels. Every function takes and returns a Column."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

def runs(codes: list[int]) -> list[tuple[str, str]]:
    """First and last characters of the runs in sorted code points."""
    out: list[list[int]] = []
    for c in codes:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return [(chr(a), chr(b)) for a, b in out]


#: White space as Unicode has it, no-break space included.
SPACE = r"(?U)\s+"
#: The same, but for a single space, which stays as it is: most texts have nothing to replace.
ODD_SPACE = r"(?U) \s+|[\s&&[^ ]]\s*"


def stripped(char: str) -> str:
    """A character's canonical decomposition without its marks."""
    return "".join(x for x in unicodedata.normalize("NFD", char) if unicodedata.category(x) != "Mn")


#: Characters of the basic plane (but small letters) that lose marks in that way, and what is left of them. Hangul syllables become several letters and stay.
MARKED = [c for c in map(chr, range(0xC0, 0x10000)) if not c.islower() and unicodedata.decomposition(c) and len(stripped(c)) == 1 and stripped(c) != c]
PLAIN = [stripped(c) for c in MARKED]
#: Characters that compatibility composition changes or joins with others, and all beyond the basic plane: a text without any of them stays as it is.
_CHANGES = [c for c in range(0x80, 0x10000) if not 0xD800 <= c < 0xE000 and (unicodedata.category(chr(c)) in ("Mn", "Mc") or 0x1161 <= c <= 0x11C2 or not unicodedata.is_normalized("NFKC", chr(c)))]
#: Characters that need no look at the list: it has hundreds of ranges, and a class tries one after the other.
STABLE = r"\x{0}-\x{9f}\x{c0}-\x{ff}"
UNSTABLE = f"[^{STABLE}]&&[" + "".join(f"\\x{{{ord(a):x}}}-\\x{{{ord(b):x}}}" for a, b in runs(_CHANGES)) + "\\x{10000}-\\x{10ffff}]"


def collapsed(text: Column) -> Column:
    """White-space runs to one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, ODD_SPACE, " "))


def canonical(text: Column) -> Column:
    """Upper case without marks, white space collapsed: what bank identification works on."""
    upper = F.translate(F.upper(text), "".join(MARKED), "".join(PLAIN))
    return collapsed(F.regexp_replace(upper, r"\p{Mn}", ""))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def word_text(text: Column) -> Column:
    """No-break space to space, en and em dash to hyphen, collapsed; null is empty."""
    # no translate, which makes every character anew
    return collapsed(F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("–"), F.lit("-")), F.lit("—"), F.lit("-")))


def word_upper(text: Column) -> Column:
    return F.upper(word_text(text))


def header_text(text: Column) -> Column:
    """Trimmed, upper, Ó and É without accent."""
    return F.replace(F.replace(F.upper(F.trim(text)), F.lit("Ó"), F.lit("O")), F.lit("É"), F.lit("E"))


def collapsed_or_null(text: Column) -> Column:
    return F.nullif(collapsed(text), F.lit(""))


def filled(text: Column) -> Column:
    """``text``, null if it is empty. Inside a branch ``nullif`` makes what it is given twice, and what that is made of four times; an array holds it once."""
    return F.get(F.array_remove(F.array(text), ""), 0)


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null without one or if empty."""
    return filled(F.regexp_extract(text, pattern, group))


def rfc_compact(text: Column) -> Column:
    """A tax id without its spaces."""
    return F.nullif(F.replace(text, F.lit(" "), F.lit("")), F.lit(""))


def rfc_labelled(text: Column) -> Column:
    """A tax id without RFC labels and spaces, upper case."""
    return F.nullif(F.regexp_replace(F.upper(F.regexp_replace(text, r"(?i)(?:RFC\s*:?\s*)+", "")), SPACE, ""), F.lit(""))


def digits_or_null(text: Column) -> Column:
    return F.nullif(digits(text), F.lit(""))


def clabe_or_null(text: Column) -> Column:
    """Exactly 18 digits, else null. There is no check-digit test."""
    return F.when(F.length(digits(text)) == 18, digits(text))


@F.arrow_udf(StringType())
def _nfkc(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in text.to_pylist()], pa.string())


def nfkc(text: Column) -> Column:
    """Compatibility composition. Only texts that hold a character which it can change go to Python; plain texts never do."""
    return F.when(text.rlike(f"[{UNSTABLE}]"), _nfkc(F.when(text.rlike(f"[{UNSTABLE}]"), text))).otherwise(text)
