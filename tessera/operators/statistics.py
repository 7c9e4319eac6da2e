"""Paired tests, multiplicity adjustment and resampling with a portable random number."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(*parts: Column | str) -> Column:
    """A reproducible 32-bit number from the md5 of the parts joined by ':'."""
    text = F.concat_ws(":", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def mcnemar(pairs: DataFrame, *by: str) -> DataFrame:
    """Exact two-sided McNemar test from columns a_ok, b_ok: a_only, b_only, p.

    The binomial tail is summed in log space over the smaller discordant count.
    """
    g = pairs.groupBy(*by).agg(F.count_if((F.col("a_ok") == 1) & (F.col("b_ok") == 0)).alias("a_only"), F.count_if((F.col("a_ok") == 0) & (F.col("b_ok") == 1)).alias("b_only"))
    return g.withColumn("p", F.round(binomial_p(F.col("a_only"), F.col("b_only")), 6))


def binomial_p(a: Column, b: Column) -> Column:
    """min(1, 2 P(X <= min(a, b))) for X ~ Bin(a + b, 1/2)."""
    n, k = a + b, F.least(a, b)
    # log C(n, i) grows by log((n - i + 1) / i); the state carries (log C, running sum)
    step = lambda s, i: F.struct((s["c"] + F.log((n - i + 1) / i)).alias("c"), (s["t"] + F.exp(s["c"] + F.log((n - i + 1) / i) - n * F.log(F.lit(2.0)))).alias("t"))
    start = F.struct(F.lit(0.0).alias("c"), F.exp(-n * F.log(F.lit(2.0))).alias("t"))
    tail = F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("bigint"), k)).otherwise(F.array().cast("array<bigint>")), start, step, lambda s: s["t"])
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail))


def holm(df: DataFrame, p: str, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``p_holm``: step-down adjusted p within each family ``by``; ties in the order given."""
    w = Window.partitionBy(*by).orderBy(p, *order)
    n = F.count(p).over(Window.partitionBy(*by))
    raw = F.least(F.lit(1.0), F.col(p) * (n - F.row_number().over(w) + 1))
    ranked = df.where(F.col(p).isNotNull()).withColumn("_raw", raw)
    return ranked.withColumn("p_holm", F.max("_raw").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_raw")


def group_sums(df: DataFrame, unit: str, sums: dict[str, Column], *by: str) -> DataFrame:
    """Sufficient statistics per resampling unit: what a draw adds when it picks the unit."""
    return df.groupBy(*by, unit).agg(*[F.sum(c).alias(k) for k, c in sums.items()])


def poisson_cdf(top: int = 12) -> list[float]:
    """P(X <= k) of a Poisson variable with mean 1, for k below ``top``; what lies above is less likely than 1e-10."""
    return [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(top)]


def mix32(x: np.ndarray) -> np.ndarray:
    """A 32-bit integer hash in 64-bit arithmetic, so that SQL can compute it too."""
    low = np.uint64(0xFFFFFFFF)
    for _ in range(2):
        x = ((x >> np.uint64(16)) ^ x) * np.uint64(0x45D9F3B) & low
    return (x >> np.uint64(16)) ^ x


def bootstrap_sums(stats: DataFrame, unit: str, sums: Sequence[str], draws: int, seed: int, *by: str) -> DataFrame:
    """(by, draw, sums): the sums of each draw of a Poisson(1) bootstrap over units.

    A unit's weight in a draw depends on the two alone, so no draw needs to see all units. Weights are made for whole
    batches as matrices of units and draws and multiplied with the units' sums, so a task gives one row per draw,
    whatever the number of units.
    """
    cdf = np.array(poisson_cdf())
    key = draw(F.lit(seed), unit, *by)
    second = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in (unit, *by)])), 9, 8), 16, 10).cast("bigint")
    rows = stats.select(*by, key.alias("_a"), second.alias("_b"), *[F.col(c).cast("double").alias(c) for c in sums])
    schema = ", ".join([*(f"{c} {stats.schema[c].dataType.simpleString()}" for c in by), "draw int", *(f"{c} double" for c in sums)])
    steps = np.arange(1, draws + 1, dtype=np.uint64) * np.uint64(0x9E3779B1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            groups = batch.groupby(list(by), dropna=False, sort=False) if by else [((), batch)]
            for name, part in groups:
                name = name if isinstance(name, tuple) else (name,)
                total = held.setdefault(name, np.zeros((draws, len(sums))))
                for at in range(0, len(part), 2048):
                    block = part.iloc[at : at + 2048]
                    a, b = (block[c].to_numpy().astype(np.uint64)[:, None] for c in ("_a", "_b"))
                    u = mix32(mix32((a + steps) & np.uint64(0xFFFFFFFF)) ^ b) / 4294967296.0
                    w = np.searchsorted(cdf, u.ravel(), side="right").reshape(u.shape)
                    total += w.T.astype(float) @ block[list(sums)].to_numpy(float)
        for name, total in held.items():
            made = pd.DataFrame(total, columns=list(sums))
            made.insert(0, "draw", np.arange(1, draws + 1, dtype=np.int32))
            for i, c in enumerate(by):
                made.insert(i, c, pd.Series([name[i]] * draws, dtype=object))
            yield made

    # units are few bytes and each costs as many steps as there are draws: the table is spread over all cores first
    spread = rows.repartition(stats.sparkSession.sparkContext.defaultParallelism)
    return spread.mapInPandas(run, schema).groupBy(*by, "draw").agg(*[F.sum(c).alias(c) for c in sums])


def interval(draws: DataFrame, value: str, *by: str, **more: Column) -> DataFrame:
    """Mean and 2.5 / 97.5 percentiles (linear interpolation) of a statistic over draws; ``more`` are further aggregates."""
    q = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    g = draws.groupBy(*by) if by else draws
    return g.agg(F.round(F.avg(value), 6).alias("mean"), F.round(q[0], 6).alias("lo"), F.round(q[1], 6).alias("hi"), F.count(value).alias("n_draws"), *[F.round(c, 6).alias(k) for k, c in more.items()])


def two_sided_p(value: Column) -> Column:
    """2 min(P(d <= 0), P(d >= 0)), at most 1."""
    return F.least(F.lit(1.0), 2 * F.least(F.avg((value <= 0).cast("double")), F.avg((value >= 0).cast("double"))))


def two_sided_p_plus(value: Column) -> Column:
    """2 (tail + 1) / (n + 1), at most 1."""
    tail = F.least(F.count_if(value <= 0), F.count_if(value >= 0))
    return F.least(F.lit(1.0), 2 * (tail + 1) / (F.count(value) + 1))


def format_p(p: Column, draws: int, plus_one: bool = False) -> Column:
    """Text of a p value, floored at what the number of draws can resolve."""
    floor = 2 / (draws + 1) if plus_one else 1 / draws
    return F.when(p < floor, F.lit(f"<{floor:.4f}")).otherwise(F.format_string("%.4f", p))
