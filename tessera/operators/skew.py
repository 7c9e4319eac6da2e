"""Joins in which no key, however many rows hold it, ends up in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more rows than this is cut into blocks of that size.
HOT_ROWS = 200_000
#: Keys that can be hot at most: the limit rises with the table, which bounds what is broadcast.
HOT_KEYS = 10_000


def hot_keys(sizes: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """(keys, _blocks) of the keys whose ``n`` in the stored table ``sizes`` is above the limit; None if there are none."""
    top = sizes.agg(F.max("n").alias("top"), F.sum("n").alias("total")).first()
    limit = max(hot_rows, (top["total"] or 0) // HOT_KEYS)
    if (top["top"] or 0) <= limit:
        return None
    return sizes.where(F.col("n") > limit).select(*keys, F.ceil(F.col("n") / limit).cast("int").alias("_blocks"))


def spread_join(rows: DataFrame, other: DataFrame, keys: Sequence[str], sizes: DataFrame, by: Sequence[str], how: str = "inner", hot_rows: int = HOT_ROWS) -> DataFrame:
    """``rows`` joined with ``other`` on ``keys``, of which ``sizes`` (keys, n) says how many rows hold each.

    The rows of a hot key are dealt into blocks by a hash of the columns ``by``, and the other side's rows of that
    key go to each of them; the list of hot keys has HOT_KEYS rows at most and is broadcast. ``how`` is inner, left
    or right; for right, ``sizes`` must name all keys of ``rows``.
    """
    hot = hot_keys(sizes, keys, hot_rows)
    if hot is None:
        return rows.join(other, list(keys), how)
    hot = F.broadcast(hot)
    block = F.when(F.col("_blocks").isNotNull(), F.pmod(F.xxhash64(*by), F.col("_blocks"))).otherwise(0).cast("int")
    dealt = rows.join(hot, list(keys), "left").withColumn("_block", block).drop("_blocks")
    copied = other.join(hot, list(keys), "left").withColumn("_block", F.explode(F.sequence(F.lit(0), F.coalesce("_blocks", F.lit(1)) - 1))).drop("_blocks")
    if how == "right":  # an empty block is no missing key
        met = dealt.join(copied, [*keys, "_block"]).drop("_block")
        return met.unionByName(other.join(sizes.select(*keys), list(keys), "left_anti"), allowMissingColumns=True)
    return dealt.join(copied, [*keys, "_block"], how).drop("_block")


def pairs_within(rows: DataFrame, key: str, item: str, block: int = 2048) -> DataFrame:
    """(key, a, b), a < b: all pairs of items of one key; ``rows`` holds (key, item, n) with the key's number of rows.

    Items of a key of more than ``block`` rows are dealt into blocks, and each pair of blocks is joined on its own.
    """
    n_blocks = F.ceil(F.col("n") / block).cast("int")
    dealt = rows.select(key, item, n_blocks.alias("_n"), F.pmod(F.xxhash64(item), n_blocks).cast("int").alias("_i"))
    left = dealt.select(key, F.col(item).alias("a"), F.col("_i").alias("_x"), F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_y"))
    right = dealt.select(key, F.col(item).alias("b"), F.col("_i").alias("_y"), F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_x"))
    return left.join(right, [key, "_x", "_y"]).where("a < b").select(key, "a", "b")
