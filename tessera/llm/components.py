"""Connected components by alternating star contraction, for link sets that fit no single machine.

Every link is kept as (a, b) with a > b. The *small-star* step re-hangs the smaller neighbours of a node
under the smallest of them; the *large-star* step re-hangs a node under the smallest neighbour of its own
smaller end. Both are an aggregation to one minimum per node and an equi-join with it; the steps alternate
until the link set no longer changes, which leaves a star per component with its minimum in the centre.

Defined results: NULL ends and self-links are left out, repeated links count once, an empty link set gives
an empty table, ids may be of any orderable type (the minimum is the type's own).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import HOT_KEYS, HOT_ROWS
from ..session import Staging

#: A key with more rows than this is joined apart from the rest, against a broadcast of its own minimum. The limit
#: rises with the table, so that no more than HOT_KEYS keys can be hot, which bounds that broadcast.


def join_by_key(rows: DataFrame, key: str, mins: DataFrame, how: str, n_rows: int, hot_rows: int) -> DataFrame:
    """rows joined with ``mins``, one row per key; keys held by more than ``hot_rows`` rows do not pass through a shuffle."""
    hot_rows = max(hot_rows, n_rows // HOT_KEYS)
    if n_rows <= hot_rows:  # no key can be hot
        return rows.join(mins, key, how)
    hot = F.broadcast(rows.groupBy(key).count().where(F.col("count") > hot_rows).select(key))
    hot_mins = F.broadcast(mins.join(hot, key, "left_semi"))
    return rows.join(hot, key, "left_anti").join(mins, key, how).unionByName(rows.join(hot, key, "left_semi").join(hot_mins, key, how))


def star_links(rows: DataFrame, keys: Sequence[str], node: str, staging: Staging, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Links (a, b) from each row's node to the smallest node that shares all ``keys``: n - 1 for n rows, not n².

    Rows with a NULL key link to nothing.
    """
    rows = rows.select(*keys, F.col(node).alias("a")).dropna()
    groups = staging.keep(rows.groupBy(*keys).agg(F.min("a").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    return links_to_root(rows, groups, keys, hot_rows)


def with_group(rows: DataFrame, groups: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """rows joined with a stored table of groups (keys, n, ...); n is the number of rows of a group.

    Groups of more than ``hot_rows`` rows are broadcast, of which there are HOT_KEYS at most as the limit rises with
    the rows, and their rows stay where they are; the others are joined by a shuffle that no group can unbalance.
    """
    top = groups.agg(F.max("n").alias("top"), F.sum("n").alias("total")).first()
    hot_rows = max(hot_rows, (top["total"] or 0) // HOT_KEYS)
    what = groups.drop("n")
    if (top["top"] or 0) <= hot_rows:
        return rows.join(what, list(keys))
    hot = F.broadcast(groups.where(F.col("n") > hot_rows).drop("n"))
    cold = groups.where(F.col("n") <= hot_rows).drop("n")
    names = F.broadcast(groups.where(F.col("n") > hot_rows).select(*keys))
    return rows.join(hot, list(keys)).unionByName(rows.join(names, list(keys), "left_anti").join(cold, list(keys)))


def links_to_root(rows: DataFrame, groups: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """rows (keys, a) joined with a stored table groups (keys, b, n); links (a, b) with a > b."""
    return with_group(rows, groups.select(*keys, "b", "n"), keys, hot_rows).where("a <> b").select("a", "b")


def connected_components(links: DataFrame, staging: Staging, hot_rows: int = HOT_ROWS, max_rounds: int = 100) -> DataFrame:
    """(node, component) of every node that has a link; component is the smallest node it can reach."""
    cur = staging.keep(
        links.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    state = _fingerprint(cur)
    for _ in range(max_rounds):
        n = state[0]
        if n == 0:
            break
        mins = cur.groupBy("a").agg(F.min("b").alias("m"))
        hung = join_by_key(cur, "a", mins, "inner", n, hot_rows)
        small = mins.select("a", F.col("m").alias("b")).unionByName(hung.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        small = staging.keep(small)
        up = small.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("b"), "m")
        large = join_by_key(small, "b", up, "left", n, hot_rows).select("a", F.coalesce("m", "b").alias("b")).distinct()
        nxt = staging.keep(large)
        new_state = _fingerprint(nxt)
        staging.drop(cur, small)
        cur, done = nxt, new_state == state
        state = new_state
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _fingerprint(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.bit_xor(F.hash("b", "a")).alias("y")).first()
    return row["n"], row["x"], row["y"]
