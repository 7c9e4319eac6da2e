"""Inclusion rules, representatives and identifier propagation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def apply_rules(files: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """``included`` for (source, class) pairs that a rule names; the rules are a literal of the caller."""
    pair = F.struct(F.col("source").alias("a"), F.col("class").alias("b"))
    known = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in rules])
    return files.withColumn("included", F.coalesce(F.array_contains(known, pair), F.lit(False)))


def _priority(priority: Mapping[str, int]) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in priority.items() for x in kv])[F.col("source")], F.lit(9))


def representatives(df: DataFrame, cluster: str, priority: Mapping[str, int]) -> DataFrame:
    """One row per cluster: best source priority, then a mask, then most bytes, then smallest path.

    An aggregation over a composite struct, so a cluster of any size is reduced before it is moved.
    """
    rank = F.struct(_priority(priority).alias("a"), F.col("mask").isNull().alias("b"), (-F.coalesce("bytes", F.lit(0))).alias("c"), "path", *[c for c in df.columns if c not in ("path", cluster)])
    return df.where(F.col(cluster).isNotNull()).groupBy(cluster).agg(F.min(rank).alias("r")).select(cluster, *[F.col(f"r.{c}") for c in df.columns if c != cluster])


def propagate(df: DataFrame, cluster: str) -> DataFrame:
    """Missing patients take the smallest of their cluster; clusters with several are marked."""
    per = df.groupBy(cluster).agg(F.min("patient").alias("_p"), (F.countDistinct("patient") > 1).alias("conflict"))
    return df.join(per, cluster).withColumn("patient_id", F.coalesce("patient", "_p")).drop("_p")


def dedup_effect(df: DataFrame, cluster: str, priority: Mapping[str, int]) -> DataFrame:
    """Rows per label before and after representatives are taken."""
    clustered = df.where(F.col(cluster).isNotNull())
    before = clustered.groupBy("label").agg(F.count(F.lit(1)).alias("before"))
    after = representatives(clustered, cluster, priority).groupBy("label").agg(F.count(F.lit(1)).alias("after")).withColumnRenamed("label", "l2")
    j = before.join(after, F.col("label").eqNullSafe(F.col("l2")), "left").select("label", "before", F.coalesce("after", F.lit(0)).alias("after"))
    return j.withColumn("removed_pct", F.round(100.0 * (1 - F.col("after") / F.col("before")), 4))
