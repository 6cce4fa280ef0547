"""General text and number helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character a Unicode-aware strip removes; SQL trim() removes blanks only.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as a regular-expression class (accepted by Java and RE2 alike).
SPACE = (
    r"[\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
LATIN_SPACE = r"[\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x{85}\x{a0}]"
# The class without the blank: these are replaced by blanks before splitting.
OTHER_SPACE = SPACE.replace("\\x1f ", "\\x1f")
# The first two bytes of white space beyond Latin-1.
_WIDE_STARTS = [bytearray(b) for b in sorted({c.encode()[:2] for c in WHITESPACE if ord(c) > 0xFF})]


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def strip_or_empty(text: Column) -> Column:
    """Strip, reading a missing value as the empty string."""
    return strip(F.coalesce(text, F.lit("")))


def single_blanks(text: Column) -> Column:
    """Every white-space character as a blank.

    One pattern for the Latin-1 range (a bit set in the matcher) and plain substring
    replacement for the rest, which hardly ever occurs: their UTF-8 bytes have four beginnings.
    """

    def wide(text: Column) -> Column:
        raw = text.cast("binary")
        begins = [F.contains(raw, F.lit(start)) for start in _WIDE_STARTS]
        blanks = text
        for char in WHITESPACE:
            if ord(char) > 0xFF:
                blanks = F.replace(blanks, F.lit(char), F.lit(" "))
        return F.when(reduce(lambda a, b: a | b, begins), blanks).otherwise(text)

    narrow = F.regexp_replace(text, LATIN_SPACE, " ")
    return F.get(F.transform(F.array(narrow), wide), 0)


def is_blank(text: Column) -> Column:
    return strip_or_empty(text) == ""


def non_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def group(text: Column, pattern: str, index: int = 1) -> Column:
    """A capture group, NULL when the pattern does not match."""
    return non_empty(F.regexp_extract(text, pattern, index))


def preview(text: Column, length: int, always: bool = False) -> Column:
    """The first ``length`` characters, marked with dots when cut (or always)."""
    cut = F.concat(F.substring(text, 1, length), F.lit("..."))
    return cut if always else F.when(F.length(text) > length, cut).otherwise(text)


def round_n(value: Column, digits: int) -> Column:
    """Round through DECIMAL, so that a value next to a tie rounds the same everywhere."""
    return F.round(value.cast("decimal(28,9)"), digits).cast("double")


def clamp(value: Column, low: float, high: float) -> Column:
    """Clamp that keeps NULL (greatest/least would turn it into a bound)."""
    return F.when(
        value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high))
    )


def percentage(part: Column, whole: Column) -> Column:
    """100 * part / whole, and 0 for an empty whole."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double") * 100).otherwise(
        F.lit(0.0)
    )


def iso_format(moment: Column) -> Column:
    """ISO text; the fraction is left out when it is zero."""
    whole = F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(moment, "SSSSSS")
    return F.when(fraction == "000000", whole).otherwise(F.concat(whole, F.lit("."), fraction))
