"""Exact join of close hash pairs: positions cut into shares, of which two close records must agree in one.

Two records at most ``k`` bits apart in a hash disagree in at most ``k`` of ``k + 1`` shares of its positions, so an
equi-join on (share, bits) finds every pair. Groups of records that agree in a share are counted; large ones are cut
by shares of the other hash, then by the rest of the first, and what is still large is joined block by block. A pair
that agrees in several shares is reported by the first of them alone, which follows from the two records, so no
distinct over pairs is needed. Used for links, of which none may be lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hamming
from ..session import Staging

#: Records that may be compared with each other in one group.
LEAF = 512


def position_shares(k: int, positions: Sequence[int], seed: str) -> list[int]:
    """k + 1 bit masks (signed 64-bit) over ``positions`` in a seeded order."""
    order = sorted(positions, key=lambda i: hashlib.md5(f"{seed}:{i}".encode()).digest())
    masks = []
    for j in range(k + 1):
        mask = sum(1 << i for i in order[j * len(order) // (k + 1) : (j + 1) * len(order) // (k + 1)])
        masks.append(mask - (1 << 64) if mask >= 1 << 63 else mask)
    return masks


def _positions(mask: int) -> list[int]:
    return [i for i in range(64) if (mask >> i) & 1]


def _first_common(branch: Column, differing: Column, masks: Sequence[int]) -> Column:
    """True where ``branch`` is the first of the masks in which nothing differs."""
    at = [differing.bitwiseAND(F.lit(m).cast("bigint")) == 0 for m in masks]
    first = F.when(at[0], F.lit(0))
    for i in range(1, len(masks)):
        first = first.when(at[i], F.lit(i))
    return first == branch


def _cut(rows: DataFrame, value: str, masks: Sequence[int], name: str, parent: str | None) -> DataFrame:
    """One row per share, with node = hash(parent, share, bits)."""
    made = [
        F.struct(
            F.xxhash64(*([F.col(parent)] if parent else []), F.lit(i), F.col(value).bitwiseAND(F.lit(m).cast("bigint"))).alias("node"),
            F.lit(i).cast("tinyint").alias(name),
        )
        for i, m in enumerate(masks)
    ]
    keep = [c for c in rows.columns if c != "node"]
    return rows.select(*keep, F.inline(F.array(*made))).select("node", *keep, name)


def _compare(rows: DataFrame, k: int, levels: Sequence[tuple[str, str, Sequence[int]]], blocks: bool = False) -> DataFrame:
    """Pairs within the nodes of ``rows``; levels: (share column, hash, masks) of the way so far."""
    more = ["i", "j"] if blocks else []
    left = rows.select("node", F.col("rep").alias("a"), F.col("p").alias("pa"), F.col("d").alias("da"), *[F.col(n) for n, _, _ in levels], *[F.col(c).alias(f"{c}a") for c in more])
    right = rows.select("node", F.col("rep").alias("b"), F.col("p").alias("pb"), F.col("d").alias("db"), *[F.col(c).alias(f"{c}b") for c in more])
    near = (F.col("a") < F.col("b")) & (hamming(F.col("pa"), F.col("pb")) <= k) & (hamming(F.col("da"), F.col("db")) <= k)
    for name, value, masks in levels:
        near = near & _first_common(F.col(name), F.col(f"{value}a").bitwiseXOR(F.col(f"{value}b")), masks)
    if blocks:  # records of one block meet where the block is paired with itself
        near = near & ((F.col("ia") != F.col("ib")) | ((F.col("ja") == F.col("ia")) & (F.col("jb") == F.col("ib"))))
    met = left.join(right, left["node"] == right["node"]).where(near)
    return met.select("a", "b", hamming(F.col("pa"), F.col("pb")).cast("int").alias("dist_p"), hamming(F.col("da"), F.col("db")).cast("int").alias("dist_d"))


def close_pairs(classes: DataFrame, k: int, staging: Staging, leaf: int = LEAF, seed: str = "cp") -> DataFrame:
    """(a, b, dist_p, dist_d) of all classes (rep, p, d) with p and d each at most ``k`` bits apart, a < b.

    ``classes`` holds distinct (p, d) with a unique rep and should be a stored table, as it is read by each
    level. Rows with a NULL hash link to nothing; an empty table gives an empty one.
    """
    classes = classes.select("rep", "p", "d").dropna()
    first = position_shares(k, range(64), f"{seed}-d")
    second = position_shares(k, range(64), f"{seed}-p")
    top = [("b1", "d", first)]
    frontier = _cut(classes, "d", first, "b1", None)
    counts = staging.keep(frontier.groupBy("b1", "node").count().where(F.col("count") > leaf).select("b1", "node"))
    if counts.limit(1).count() == 0:
        return _compare(frontier, k, top)
    out = []
    for share, mask in enumerate(first):  # one at a time, so that the disk holds the shuffle of one share
        rows = frontier.where(F.col("b1") == share)
        large = counts.where(F.col("b1") == share).select("node")
        if large.limit(1).count() == 0:
            out.append(staging.keep(_compare(rows, k, top)))
            continue
        out.append(staging.keep(_compare(rows.join(large, "node", "left_anti"), k, top)))
        levels = [*top, ("b2", "p", second)]
        rows = _cut(rows.join(large, "node", "left_semi"), "p", second, "b2", "node")
        large = staging.keep(rows.groupBy("node").count().where(F.col("count") > leaf).select("node"))
        out.append(staging.keep(_compare(rows.join(large, "node", "left_anti"), k, levels)))
        if large.limit(1).count() == 0:
            continue
        rest = position_shares(k, [i for i in range(64) if i not in set(_positions(mask))], f"{seed}-d{share}")
        levels = [*levels, ("b3", "d", rest)]
        rows = _cut(rows.join(large, "node", "left_semi"), "d", rest, "b3", "node")
        sizes = staging.keep(rows.groupBy("node").count().where(F.col("count") > leaf).select("node", F.ceil(F.col("count") * 2 / leaf).alias("n")))
        out.append(staging.keep(_compare(rows.join(sizes, "node", "left_anti"), k, levels)))
        if sizes.limit(1).count():
            dealt = rows.join(sizes, "node").withColumn("i", F.pmod(F.xxhash64("rep"), "n")).withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
            out.append(staging.keep(_compare(dealt.withColumn("node", F.xxhash64("node", F.least("i", "j"), F.greatest("i", "j"))), k, levels, True)))
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole
