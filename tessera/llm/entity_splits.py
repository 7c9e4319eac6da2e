"""Problem 6: splits in which records that share an entity stay together.

Groups and patients are the nodes of a graph, a record that names both is a link, and a path listed with several
entities links all of them. Components come from star contraction over these entity names, so a block of any size
costs one link per distinct (group, patient) pair. A record that names neither is a block of its own, under its path.

Defined results: NULL, blank and placeholder names link nothing; case and outer blanks do not matter; equal rows
count once; rows without a path are left out; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.missing import usable
from ..operators.skew import HOT_ROWS
from ..operators.statistics import draw
from ..session import Staging
from .components import connected_components, join_by_key, star_links

#: Cells the hash range is cut into when the shares are fitted; bounds what is sorted on one machine.
CELLS = 4096


def record_blocks(dataset: DataFrame, staging: Staging, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(path, block) of every distinct path of ``dataset``."""
    group = F.regexp_replace(F.lower("group_id"), r"^\s+|\s+$", "")
    rows = dataset.where("path is not null").select("path", F.when(group != "", F.concat(F.lit("g:"), group)).alias("g"), F.concat(F.lit("p:"), usable("patient_id")).alias("p"))
    rows = staging.keep(rows.distinct())
    several = staging.keep(rows.groupBy("path").count().where("count > 1").select("path"))
    ties = rows.where("g is not null and p is not null").select(F.col("g").alias("a"), F.col("p").alias("b")).distinct()
    # rows of one path may name any number of entities: each is tied to the smallest of them
    again = rows.join(several, "path", "left_semi")
    named = again.select("path", F.explode(F.array("g", "p")).alias("entity")).distinct()
    blocks = staging.keep(connected_components(ties.unionByName(star_links(named, ["path"], "entity", staging, hot_rows)), staging, hot_rows))
    node = F.coalesce("g", "p").alias("node")
    held = staging.keep(rows.join(several, "path", "left_anti").select("path", node).unionByName(again.groupBy("path").agg(F.min(node).alias("node"))))
    # a block may hold a third of all records: its records are joined apart
    joined = join_by_key(held.where("node is not null"), "node", blocks, "left", held.count(), hot_rows).select("path", F.coalesce("component", "node").alias("block"))
    return joined.unionByName(held.where("node is null").select("path", F.concat(F.lit("f:"), "path").alias("block")))


def split_breaches(dataset: DataFrame, splits: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(path): paths with a fold whose block has more than one fold."""
    staging = Staging(dataset.sparkSession, "breaches")
    folds = splits.where("path is not null and outer_fold is not null").groupBy("path").agg(F.min("outer_fold").alias("lo"), F.max("outer_fold").alias("hi"))
    held = staging.keep(folds.join(record_blocks(dataset, staging, hot_rows), "path", "left").select("path", F.coalesce("block", F.concat(F.lit("f:"), "path")).alias("block"), "lo", "hi"))
    torn = held.groupBy("block").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select("block")
    return join_by_key(held, "block", staging.keep(torn), "inner", held.count(), hot_rows).select("path")


def assign_splits(dataset: DataFrame, targets: DataFrame, seed: int = 42, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(path, block, split_name): the block's hash falls into a range per split, in target proportion.

    Blocks differ in size, so the ranges are fitted to rows rather than to blocks: the hash space is cut into
    ``CELLS`` cells, the rows of each cell are counted, and a cell goes to the split in whose share of the
    running total its middle falls. A block never straddles cells. Targets are ordered by name; shares that do
    not sum to 1 are scaled; without targets the result is empty; more than ``CELLS`` targets are an error.
    """
    staging = Staging(dataset.sparkSession, "assign")
    wanted = targets.where("split_name is not null and target_share > 0").groupBy("split_name").agg(F.sum("target_share").alias("share"))
    if wanted.count() > CELLS:
        raise ValueError(f"more than {CELLS} splits")
    shares = sorted((r["split_name"], float(r["share"])) for r in wanted.collect())
    blocks = staging.keep(record_blocks(dataset, staging, hot_rows).withColumn("cell", (draw(F.lit(seed), "block") % CELLS).cast("int")))
    cells = sorted((r["cell"], r["n"]) for r in blocks.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect())  # CELLS rows at most
    total, whole = sum(n for _, n in cells), sum(s for _, s in shares)
    out, before = [], 0
    for cell, n in cells if shares else []:
        at, edge = (before + n / 2) / total, 0.0
        for name, share in shares:
            edge += share
            if at <= edge / whole or name == shares[-1][0]:
                out.append((int(cell), name))
                break
        before += n
    table = F.broadcast(dataset.sparkSession.createDataFrame(out, "cell int, split_name string"))  # CELLS rows at most
    return blocks.join(table, "cell").select("path", "block", "split_name")
