"""64-bit perceptual hashes held as signed BIGINT, and their distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_HEX = r"^\s*(?:0x)?0*([0-9a-f]{1,16})\s*$"


def parse_hash64(col: Column | str) -> Column:
    """Hexadecimal text -> signed BIGINT; NULL where the text holds no 64-bit number.

    Case, outer blanks, a 0x prefix and missing or surplus leading zeros do not matter.
    """
    col = F.col(col) if isinstance(col, str) else col
    digits = F.regexp_extract(F.lower(col), _HEX, 1)
    number = lambda x: F.conv(x, 16, -10).cast("bigint")
    # sixteen digits as they should be are told by a table of bytes; all else goes through the pattern
    plain = (F.length(col) == 16) & F.unhex(col).isNotNull()
    return F.when(plain, number(col)).when(digits != "", number(digits))


def hamming(a: Column, b: Column) -> Column:
    """Number of differing bits of two BIGINT hashes."""
    return F.bit_count(a.bitwiseXOR(b))


def norm_digest(col: Column | str) -> Column:
    """A content digest without case and outer blanks; empty text is NULL."""
    text = F.lower(F.trim(F.col(col) if isinstance(col, str) else col))
    return F.when(text != "", text)


def compact_digest(col: Column | str) -> Column:
    """The digest as bytes: half the width of its hexadecimal text, the text itself where it is none."""
    text = norm_digest(col)
    return F.coalesce(F.when(F.length(text) % 2 == 0, F.unhex(text)), F.encode(text, "UTF-8"))
