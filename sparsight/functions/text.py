"""Text rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters that Unicode-aware stripping removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as a class that both Java and RE2 read alike.
_SPACE = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"
SPACE_RUN = _SPACE + "+"
NUMERIC = rf"^{_SPACE}*\p{{N}}+{_SPACE}*$"
TWO_LETTERS = r"\p{L}\P{L}*\p{L}"

MIN_CHARS = 20
MAX_CHARS = 30_000


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def is_nonblank(text: Column) -> Column:
    return strip(text) != ""


def long_enough(text: Column) -> Column:
    return F.length(strip(text)) > MIN_CHARS


def short_enough(text: Column) -> Column:
    """Text that is short as it stands need not be stripped to know."""
    return (F.length(text) < MAX_CHARS) | (F.length(strip(text)) < MAX_CHARS)


def not_all_upper(text: Column) -> Column:
    """Caseless scripts count as upper case, so they are rejected as well.

    White space has no case, so the text need not be stripped for this. One
    ASCII letter in lower case settles it without building the upper-case copy.
    """
    return text.rlike("[a-z]") | (F.upper(text) != text)


def not_numeric(text: Column) -> Column:
    return ~text.rlike(NUMERIC)


def has_two_letters(text: Column) -> Column:
    return text.rlike(TWO_LETTERS)


def is_good(text: Column) -> Column:
    return long_enough(text) & short_enough(text) & not_all_upper(text) & not_numeric(text)


def is_strict(text: Column) -> Column:
    """No upper length bound, but at least two letters."""
    return long_enough(text) & has_two_letters(text) & not_all_upper(text) & not_numeric(text)


def words(text: Column) -> Column:
    """Whitespace-separated words; an empty array for blank text."""
    stripped = strip(text)
    return F.when(stripped == "", F.array().cast("array<string>")).otherwise(
        F.split(stripped, SPACE_RUN)
    )
