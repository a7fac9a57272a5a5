"""Text cleaning and tokenising."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white-space code points on which a text is split, and the characters kept
# besides white space (letters, numbers, underscore).
WHITESPACE_CLASS = (
    r"\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
KEPT_CLASS = r"\p{L}\p{N}_"

DROPPED_PATTERN = f"[^{KEPT_CLASS}{WHITESPACE_CLASS}]"
SPLIT_PATTERN = f"[{WHITESPACE_CLASS}]+"
WHITESPACE = "".join(
    chr(code)
    for first, last in (
        (0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680),
        (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
    )
    for code in range(first, last + 1)
)

# The same two classes behind cheap range tests, in Java syntax: nearly every character of a text is
# a plain letter or a space and gets decided by the ranges alone.
_FAST_DROPPED = (
    r"[\x{00}-\x{1f}\x{21}-\x{2f}\x{3a}-\x{5e}\x{60}\x{7b}-\x{10ffff}&&" + DROPPED_PATTERN + "]"
)
_FAST_ODD_SPACE = (
    r"[\x{09}-\x{1f}\x{85}-\x{a0}\x{1680}-\x{3000}&&[" + WHITESPACE_CLASS + "]]"
)


def clean_text(text: Column) -> Column:
    """Lower-case and delete everything but letters, numbers, underscore and white space."""
    return F.regexp_replace(F.lower(text), _FAST_DROPPED, "")


def tokens(text: Column) -> Column:
    """White-space tokens of the cleaned text; a text without any gives an empty array."""
    # Splitting at a literal blank needs no pattern matching.
    spaced = F.regexp_replace(clean_text(text), _FAST_ODD_SPACE, " ")
    return F.array_remove(F.split(spaced, " "), "")


def strip(text: Column) -> Column:
    """Remove white space at both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def unquote(text: Column) -> Column:
    """Remove white space and then double quotes at both ends."""
    return F.btrim(strip(text), F.lit('"'))


def preview(text: Column, length: int = 100) -> Column:
    """The first ``length`` characters, with ``...`` when something was cut off."""
    return F.when(
        F.char_length(text) > length, F.concat(F.substring(text, 1, length), F.lit("..."))
    ).otherwise(text)
