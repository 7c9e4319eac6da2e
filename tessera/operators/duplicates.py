"""Exact duplicates and what they say about sources and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def joined_set(col: Column | str, sep: str = " + ") -> Column:
    """Sorted distinct values of a group as one text."""
    return F.array_join(F.sort_array(F.collect_set(col)), sep)


def exact_groups(df: DataFrame, key: str, source: str, label: str) -> DataFrame:
    """One row per key held more than once: n_files, sources, n_sources, classes, class_conflict."""
    g = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n_files"), joined_set(source).alias("sources"), F.countDistinct(source).alias("n_sources"), joined_set(label).alias("classes"), (F.countDistinct(label) > 1).alias("class_conflict"))
    return g.where("n_files > 1")


def redundancy(df: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    """n, distinct contents and the redundant share per group; rows without a key count as unique."""
    g = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), (F.countDistinct(key) + F.count_if(F.col(key).isNull())).alias("n_unique"))
    return g.withColumn("redundant_share", F.round(1 - F.col("n_unique") / F.col("n"), 6))


def shared_between(df: DataFrame, key: str, source: str) -> DataFrame:
    """Contents shared by each pair of sources, from one distinct (key, source) table."""
    ks = df.where(F.col(key).isNotNull() & F.col(source).isNotNull()).select(key, source).distinct()
    per = ks.groupBy(key).agg(F.sort_array(F.collect_set(source)).alias("ss")).where(F.size("ss") > 1)  # as many as there are sources
    pairs = per.select(F.explode(F.expr("flatten(transform(ss, (a, i) -> transform(slice(ss, i + 2, size(ss)), b -> struct(a as source_a, b as source_b))))")).alias("x"))
    return pairs.groupBy("x.source_a", "x.source_b").agg(F.count(F.lit(1)).alias("n_shared"))


def flag_repeats(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``is_repeated`` for rows whose keys occur more than once; counts are joined, so no group is gathered."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return df.join(n, list(keys), "left").withColumn("is_repeated", F.coalesce(F.col("_n") > 1, F.lit(False))).drop("_n")


def top_sizes(df: DataFrame, by: str, k: int = 4) -> DataFrame:
    """The k most frequent WxH of each group; ties by text."""
    from pyspark.sql import Window

    dims = df.where("width is not null and height is not null").groupBy(by, F.concat_ws("x", "width", "height").alias("dims")).agg(F.count(F.lit(1)).alias("n"))
    return dims.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "dims"))).where(F.col("rank") <= k)


def crosstab(df: DataFrame, row: str, col: str, values: Sequence[str]) -> DataFrame:
    """Counts of ``values`` of col per row, 0 where none."""
    return df.groupBy(row).pivot(col, list(values)).agg(F.count(F.lit(1))).na.fill(0)


def crosstab_margins(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts for every (a, b), each a, each b and all; margins are marked by the level."""
    g = df.cube(a, b).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))
    return g.select(a, b, F.col("level").cast("int").alias("level"), "n")
