"""Stratified and grouped folds, and the checks that find what leaks between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Staging
from .statistics import draw


def stratified_folds(df: DataFrame, item: str, label: str, k: int, seed: int) -> DataFrame:
    """fold: items of a label dealt in turn in a seeded order. Partitioned by label and a hash cell, the deal

    starts where the cells before it ended, so a label of any size is spread over many tasks.
    """
    h = draw(F.lit(seed), item)
    cells = df.select(item, label, h.alias("h"), (h / F.lit(1 << 20)).cast("int").alias("cell"))  # 4096 cells
    sizes = cells.groupBy(label, "cell").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(label).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col(label).alias("_l"), F.col("cell").alias("_c"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy(label, "cell").orderBy("h", item)
    pos = F.row_number().over(inside) - 1
    out = cells.withColumn("pos", pos).join(starts, F.col(label).eqNullSafe(F.col("_l")) & (F.col("cell") == F.col("_c")))
    return out.select(item, label, ((F.col("start") + F.col("pos")) % k).cast("int").alias("fold"))


def grouped_folds(df: DataFrame, unit: str, k: int, seed: int) -> DataFrame:
    """fold from the hash of the unit: groups stay whole without a shuffle."""
    return df.withColumn("fold", (draw(F.lit(seed), unit) % k).cast("int"))


#: Units dealt together by :func:`stratified_group_folds`.
CELL_UNITS = 5000


def stratified_group_folds(df: DataFrame, unit: str, label: str, k: int, seed: int, cell_units: int = CELL_UNITS) -> DataFrame:
    """(unit, fold): whole units dealt so that labels spread evenly over folds.

    Within a hash cell of units, units are placed one by one, those with the most uneven labels first, each where
    the spread of label shares over folds then is least. Cells are independent and hold about ``cell_units`` units
    each, so there are more of them the more units there are, and evenness of every cell makes the whole even.
    """
    per = df.where(F.col(unit).isNotNull() & F.col(label).isNotNull()).groupBy(unit, label).agg(F.count(F.lit(1)).alias("n"))
    counts = Staging(df.sparkSession, "deal").keep(per.groupBy(unit).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(label, "n")))).alias("c")))  # one entry per label
    cells = max(1, -(-counts.count() // cell_units))
    placed = counts.withColumn("cell", (draw(F.lit(seed), unit) % cells).cast("int"))

    def deal(pdf):
        import numpy as np
        import pandas as pd

        maps = [dict(c) for c in pdf["c"]]
        labels = sorted({x for m in maps for x in m})
        m = np.array([[c.get(x, 0) for x in labels] for c in maps], float)
        total = m.sum(0)
        order = sorted(range(len(m)), key=lambda i: (-m[i].std(), str(pdf[unit].iloc[i])))
        held, fold = np.zeros((k, len(labels))), np.zeros(len(m), int)
        for i in order:
            # adding the unit to fold f changes the share of that fold alone: all k outcomes at once
            tried = np.repeat(held[None], k, 0)
            tried[np.arange(k), np.arange(k)] += m[i]
            spread = (tried / total).std(1).mean(1)
            best = np.lexsort((np.arange(k), held.sum(1), spread))[0]
            held[best] += m[i]
            fold[i] = best
        return pd.DataFrame({unit: pdf[unit], "fold": fold.astype("int32")})

    return placed.groupBy("cell").applyInPandas(deal, f"{unit} {df.schema[unit].dataType.simpleString()}, fold int")


def siblings(df: DataFrame, unit: str, fold: str) -> DataFrame:
    """Per fold: items, and those whose unit also occurs in another fold."""
    spans = df.where(F.col(unit).isNotNull()).groupBy(unit).agg((F.min(fold) != F.max(fold)).alias("spans"))
    j = df.join(spans.hint("merge"), unit, "left")  # a row per unit is not sent through the driver
    return j.groupBy(fold).agg(F.count(F.lit(1)).alias("n"), F.count_if("spans").alias("n_sibling")).withColumn("sibling_pct", F.round(100.0 * F.col("n_sibling") / F.col("n"), 4))


def spanning(df: DataFrame, unit: str, fold: str) -> DataFrame:
    """Units found in more than one fold, with how many folds and items."""
    g = df.where(F.col(unit).isNotNull()).groupBy(unit).agg(F.countDistinct(fold).alias("n_folds"), F.count(F.lit(1)).alias("n"))
    return g.where("n_folds > 1")


def verify(df: DataFrame, unit: str, entity: str, label: str, fold: str) -> DataFrame:
    """(check_name, n, status): invariants of a split, each counted; anything above 0 fails."""
    n = F.count(F.lit(1)).alias("n")
    grid = df.select(fold).distinct().join(df.select(label).distinct().where(F.col(label).isNotNull()))
    rows = [
        spanning(df, unit, fold).agg(n).withColumn("check_name", F.lit("units_spanning_folds")),
        spanning(df, entity, fold).agg(n).withColumn("check_name", F.lit("entities_spanning_folds")),
        df.where(F.col(fold).isNull()).agg(n).withColumn("check_name", F.lit("rows_without_fold")),
        grid.join(df.groupBy(fold, label).count(), [fold, label], "left_anti").agg(n).withColumn("check_name", F.lit("labels_absent_from_fold")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.select("check_name", "n", F.when(F.col("n") == 0, "ok").otherwise("FAIL").alias("status"))


def require(checks: DataFrame, strict: bool = True) -> DataFrame:
    """The checks; in strict mode a failed one raises."""
    if strict:
        failed = [r["check_name"] for r in checks.where("status = 'FAIL'").collect()]  # one row per check
        if failed:
            raise ValueError(f"split fails: {', '.join(failed)}")
    return checks
