"""Groups as connected components, with and without a veto on merging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Staging
from .skew import HOT_ROWS, spread_join


def components(edges: DataFrame, staging: Staging | None = None, max_rounds: int = 64, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(node, component): the smallest node reachable over edges (a, b), by contraction.

    Each node points to the smallest of itself and its neighbours; pointers are followed to their ends, which leaves
    the local minima, and edges between these go into the next round. At least half of the nodes that have edges
    vanish in each, so the state shrinks to nothing in a logarithm of rounds. A node of very many edges is dealt over
    tasks. NULL ends and loops are left out; the tables of a round are written to the shared folder.
    """
    staging = staging or Staging(edges.sparkSession, "components")
    cur = edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    cur, levels = staging.keep(cur), []
    for _ in range(max_rounds):
        if cur.limit(1).count() == 0:
            break
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooked = staging.keep(both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select(F.col("a").alias("node"), F.least("a", "m").alias("l"), "n"))
        ends = hooked.select("node", "l")
        while True:  # paths to the local minima are halved each time
            up = ends.select(F.col("node").alias("l"), F.col("l").alias("ll"))
            nxt = staging.keep(ends.join(up, "l").select("node", F.col("ll").alias("l"), (F.col("ll") != F.col("l")).alias("moved")))
            ends = nxt.select("node", "l")
            if nxt.where("moved").limit(1).count() == 0:
                break
        levels.append(ends)
        of = lambda c: ends.select(F.col("node").alias(c), F.col("l").alias(f"l{c}"))
        size = lambda c: hooked.select(F.col("node").alias(c), "n")
        half = spread_join(cur, of("a"), ["a"], size("a"), ["b"], hot_rows=hot_rows).select("b", "la")
        whole = spread_join(half, of("b"), ["b"], size("b"), ["la"], hot_rows=hot_rows)
        cur = staging.keep(whole.where("la <> lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct())
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    if not levels:
        return cur.select(F.col("a").alias("node"), F.col("a").alias("component"))
    out = levels[-1]
    for level in reversed(levels[:-1]):
        out = level.join(out.select(F.col("node").alias("l"), F.col("l").alias("ll")), "l", "left").select("node", F.coalesce("ll", "l").alias("l"))
    return out.select("node", F.col("l").alias("component"))


def constrained_groups(items: DataFrame, edges: DataFrame, item: str, entity: str) -> DataFrame:
    """(item, grp): items merged along edges in (a, b) order, entities first, refusing to join two known entities.

    Items of one entity are merged unconditionally, an item with several rows carries the entities of all. After that
    an edge between two groups with entities is always refused, so only edges of items without entity matter: such an
    item joins the first group with entities that an accepted edge leads to. Items without entity that hang together
    are settled on their own; where they touch no such group or a single one, all their edges are accepted and
    nothing has to be ordered, and only the others are walked edge by edge. The group is named by its smallest item;
    items without edges are groups of their own.

    The tables of a step can have a row per item, whatever their written size, by which the planner would send them
    through the driver; so their joins ask for a merge.
    """
    staging = Staging(items.sparkSession, "constrained")
    kind = items.schema[item].dataType.simpleString()
    nodes = items.where(F.col(item).isNotNull()).select(F.col(item).alias("node"), F.col(entity).alias("entity"))
    named = staging.keep(nodes.where("entity is not null").distinct())
    root = named.groupBy("entity").agg(F.min("node").alias("b"))
    ties = components(named.join(root.hint("merge"), "entity").where("node <> b").select(F.col("node").alias("a"), "b"), staging)
    known = staging.keep(named.select("node").distinct().join(ties.hint("merge"), "node", "left").select("node", F.coalesce("component", "node").alias("k")))
    ends = edges.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()
    of = lambda n: known.select(F.col("node").alias(n), F.col("k").alias(f"k_{n}")).hint("merge")
    ends = staging.keep(ends.join(of("lo"), "lo", "left").join(of("hi"), "hi", "left").where("k_lo is null or k_hi is null"))
    free = ends.where("k_lo is null and k_hi is null")
    comp = components(free.select(F.col("hi").alias("a"), F.col("lo").alias("b")), staging)
    loose = staging.keep(nodes.select("node").distinct().join(known.hint("merge"), "node", "left_anti").join(comp.hint("merge"), "node", "left").select("node", F.coalesce("component", "node").alias("c")))
    touching = ends.where("k_lo is not null or k_hi is not null").select(F.when(F.col("k_lo").isNull(), F.col("lo")).otherwise(F.col("hi")).alias("node"), F.coalesce("k_lo", "k_hi").alias("k"), "lo", "hi")
    touching = staging.keep(touching.join(loose.hint("merge"), "node"))
    reach = staging.keep(touching.groupBy("c").agg(F.min("k").alias("k"), (F.min("k") != F.max("k")).alias("several")))
    easy = loose.join(reach.hint("merge"), "c", "left").where("several is null or not several").select("node", "k", F.when(F.col("k").isNull(), F.col("c")).alias("u"))
    hard = reach.where("several").select("c").hint("merge")
    rows = touching.join(hard, "c", "left_semi").select("c", "lo", "hi", "node", "k")
    inner = free.join(loose.select(F.col("node").alias("lo"), "c").hint("merge"), "lo").join(hard, "c", "left_semi").select("c", "lo", "hi", F.col("lo").alias("node"), F.lit(None).cast(kind).alias("k"))

    def settle(pdf):
        import pandas as pd

        parent: dict = {}
        held: dict = {}

        def find(x):
            parent.setdefault(x, x)
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for r in pdf.sort_values(["lo", "hi"]).itertuples():
            if pd.notna(r.k):
                held.setdefault(find(r.node), r.k)  # a group that has an entity keeps it
                continue
            x, y = find(r.lo), find(r.hi)
            if x != y and (x not in held or y not in held or held[x] == held[y]):
                lo, hi = min(x, y), max(x, y)
                parent[hi] = lo
                if hi in held:
                    held[lo] = held.pop(hi)
        found = [(x, held.get(find(x)), find(x)) for x in parent]
        return pd.DataFrame({"node": [x for x, _, _ in found], "k": pd.Series([k for _, k, _ in found], dtype=object), "u": pd.Series([None if k is not None else u for _, k, u in found], dtype=object)})

    walked = rows.unionByName(inner).groupBy("c").applyInPandas(settle, f"node {kind}, k {kind}, u {kind}")
    every = staging.keep(known.select("node", "k", F.lit(None).cast(kind).alias("u")).unionByName(easy).unionByName(walked))
    name = every.groupBy("k", "u").agg(F.min("node").alias("grp"))
    met = (every["k"].eqNullSafe(name["k"])) & (every["u"].eqNullSafe(name["u"]))
    return every.join(name.hint("merge"), met).select(every["node"].alias(item), name["grp"].alias("grp"))
