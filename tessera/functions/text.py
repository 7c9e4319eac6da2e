"""Numbers in prose: normalising, finding and rendering them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A sign, a digit and what may go on in a number.
_RUN = r"(?<![\d.,])[+-]?\d[\d.,]*"


def normalise(text: Column) -> Column:
    """Unicode minus and dashes to '-', hard blanks to blanks, runs of blanks to one."""
    plain = F.translate(text, "−–—‑   ", "----   ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def number_tokens(text: Column) -> Column:
    """All readings of the numbers of a text as distinct tokens, so that looking a number up is an equality.

    A run of digits, points and commas may be read up to any of its digits that is followed by no other: "3,064.5"
    holds 3, 3,064 and 3,064.5, but neither 64 nor 3,06. A sign before the run gives each reading a signed form too.
    """

    def readings(run: Column) -> Column:
        body = F.regexp_replace(run, r"^[+-]", "")
        parts = F.split(body, r"(?=[.,])")
        ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), ""))
        whole = F.filter(ends, lambda e: e.rlike(r"\d$"))
        signed = F.transform(whole, lambda e: F.concat(F.substring(run, 1, 1), e))
        return F.when(run.rlike(r"^[+-]"), F.concat(whole, signed)).otherwise(whole)

    return F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(text, F.lit(_RUN), F.lit(0)), readings)))


def numbers(text: Column) -> Column:
    """Numbers that stand alone: words of digits with digit grouping and decimals, without points or commas around."""
    words = F.split(text, r"[^\p{L}\p{N}_.,]+")
    bare = F.transform(words, lambda w: F.regexp_replace(w, r"^[.,]+|[.,]+$", ""))
    return F.filter(bare, lambda w: w.rlike(r"^\d[\d,]*(\.\d+)?$"))


def variants(rendered: Column) -> Column:
    """The forms in which a rendered number counts as quoted: as it is, and without a leading plus."""
    return F.array_distinct(F.array(rendered, F.regexp_replace(rendered, r"^\+", "")))


#: Forms of rendered numbers.
FORMS = ("f4", "f3", "f2", "f1", "thousands", "int", "pp", "pct")


def rendered(value: Column, form: str) -> Column:
    """A number as text: f1..f4 decimals, thousands, int, signed points, or percent."""
    v = value.cast("double")
    if form.startswith("f"):
        return F.format_string(f"%.{form[1:]}f", F.round(v, int(form[1:])))
    whole = F.round(v, 0).cast("bigint")
    return {"thousands": F.format_string("%,d", whole), "int": whole.cast("string"), "pp": F.format_string("%+.2f", F.round(v, 2)), "pct": F.format_string("%.1f", F.round(v, 1))}[form]


def rendered_as(value: Column, form: Column) -> Column:
    """A number in the form another column names; NULL for an unknown form."""
    out = F.lit(None).cast("string")
    for f in FORMS:
        out = F.when(form == f, rendered(value, f)).otherwise(out)
    return out
