"""Checking numbers stated in documents against the values they should have."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalise, number_tokens, numbers, rendered_as, variants


def quoted(docs: DataFrame) -> DataFrame:
    """(scope, token): every reading of every number in the documents of a scope, once."""
    return docs.select("scope", F.explode(number_tokens(normalise(F.col("text")))).alias("token")).distinct()


def verdicts(claims: DataFrame, tokens: DataFrame, scopes: Sequence[str], lenient: Sequence[str] = ()) -> DataFrame:
    """(claim_id, rendered, verdict): the cascade over claims (claim_id, value, form, must_appear, zero_ok).

    A value that is NULL, NaN, or a zero that is not expected is skipped, as is a rendering of one digit, which would
    match by chance; a form nobody knows is an ERROR; a value that need not be quoted is a note. Otherwise it must
    stand in the documents of all scopes: ok, ok* if only lenient scopes lack it, FAIL if another does. Texts are
    read once into tokens and claims are looked up by equality.
    """
    c = claims.withColumn("rendered", rendered_as(F.col("value"), F.col("form")))
    skip = F.when(F.col("value").isNull() | F.isnan("value"), "SKIP").when((F.col("value") == 0) & ~F.col("zero_ok"), "SKIP")
    state = skip.when(F.col("rendered").isNull(), "ERROR").when(F.length(F.regexp_replace("rendered", r"^[+-]+|[+-]+$", "")) < 2, "SKIP").when(~F.col("must_appear"), "note")
    c = c.withColumn("state", state)
    open_ = c.where("state is null").select("claim_id", F.explode(variants(F.col("rendered"))).alias("token"))
    found = open_.join(tokens, "token").groupBy("claim_id").agg(F.collect_set("scope").alias("scopes"))  # as many as there are scopes
    j = c.join(found, "claim_id", "left")
    lacking = F.array_except(F.array(*map(F.lit, scopes)), F.coalesce("scopes", F.array().cast("array<string>")))
    hard = F.array_except(lacking, F.array(*map(F.lit, lenient)).cast("array<string>"))
    verdict = F.coalesce("state", F.when(F.size(lacking) == 0, "ok").when(F.size(hard) == 0, "ok*").otherwise("FAIL"))
    return j.select("claim_id", "rendered", verdict.alias("verdict"))


def uncovered(docs: DataFrame, claims: DataFrame) -> DataFrame:
    """(number, n): standing numbers of three characters and more that no claim renders."""
    seen = docs.select(F.explode(numbers(normalise(F.col("text")))).alias("number")).groupBy("number").agg(F.count(F.lit(1)).alias("n"))
    telling = F.col("number").contains(".") | F.col("number").contains(",") | (F.length("number") >= 3)
    known = claims.select(F.explode(variants(rendered_as(F.col("value"), F.col("form")))).alias("number")).distinct()
    # claims grow with the runs; both sides lie by number already, so a merge moves nothing more
    return seen.where(telling).join(known.hint("merge"), "number", "left_anti")
