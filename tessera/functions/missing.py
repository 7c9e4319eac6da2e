"""Sentinel texts that stand for no value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that name nothing, compared in lower case without outer blanks.
NO_VALUE = ("", "-", "--", "n/a", "na", "nan", "nil", "none", "null", "unknown", "?", "#n/a", "<na>", "missing")


def usable(col: Column | str, lower: bool = True) -> Column:
    """The text without outer blanks, in lower case unless told otherwise; NULL where it names nothing."""
    text = F.btrim(F.col(col) if isinstance(col, str) else col, F.lit(" \t\n\x0b\f\r"))
    return F.when(~F.lower(text).isin(*NO_VALUE), F.lower(text) if lower else text)
