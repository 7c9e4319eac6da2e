"""The current row of each key in a table that lists keys more than once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Staging


def latest_rows(df: DataFrame, key: str, order: Sequence[str], cols: Mapping[str, Column], staging: Staging | None = None) -> DataFrame:
    """(key, cols): the row of each key that is greatest by ``order``, and by the columns where these are equal.

    With a staging folder the keys held by several rows are counted and written first; all other rows are then
    current as they are and pass without a shuffle, and only rows of repeated keys are aggregated. The planner
    broadcasts the written keys while their size on disk is below its threshold and joins by a shuffle beyond it.
    Without one it is a single aggregation over rows cut down to ``cols``. Either way rows are combined before they
    are moved, so a key of very many rows is no burden. Rows with a NULL key are left out; an order column the table
    lacks counts as NULL.
    """
    rows = df.where(F.col(key).isNotNull())
    ranks = [F.col(o).alias(f"_o{i}") for i, o in enumerate(order) if o in df.columns]
    picked = F.struct(*ranks, F.struct(*[c.alias(n) for n, c in cols.items()]).alias("v")).alias("r")
    newest = lambda part: part.select(key, picked).groupBy(key).agg(F.max("r").alias("r")).select(key, "r.v.*")
    if staging is None:
        return newest(rows)
    repeated = staging.keep(rows.groupBy(key).count().where("count > 1").select(key))
    once = rows.join(repeated, key, "left_anti").select(key, *[c.alias(n) for n, c in cols.items()])
    return once.unionByName(newest(rows.join(repeated, key, "left_semi")))
