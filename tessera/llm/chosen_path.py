"""Chosen-path set similarity join over pairs of 64-bit hashes.

A record is the set of its 128 (hash, position, bit) tokens. A tree is walked from its root: each node orders the
positions by its own seeded hash, selects the first of them, and sends a record to the child named by the token it
holds there. As the order depends on the node alone, two records together at a node go on together exactly where they
hold the same token at the selected position, so two records that differ in ``2 k`` of 128 positions stay together
through ``m`` levels with probability ``(1 - 2 k / 128) ** m``. (A position selected again further down separates
nothing and costs nothing.)

The depth is the logarithm of the number of records, so a node holds about ``leaf / 64`` unrelated ones at any scale,
and as many independent trees are grown as it takes to lose a pair at the very limit with a probability of ``miss``
at most; closer pairs are lost more rarely still. Nodes of up to ``leaf`` records are compared exhaustively. The
records of larger ones are branched again, into ``BRANCHES`` subtrees each so that recall is kept; what is still
together after ``ROUNDS`` of that is alike for the most part and is compared exhaustively too, in blocks, so that no
task holds a whole node.

Paths need no communication: they are computed for whole Arrow batches. Records are then moved to their nodes, sorted
there, and compared run by run, so a task holds one node of ``leaf`` records at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Staging

#: Records a node may hold to be compared exhaustively.
LEAF = 4096
#: Probability of losing a pair that differs in as many bits as allowed.
MISS = 1e-5
#: Levels added, subtrees grown and rounds made where a node is too large.
LEVELS, BRANCHES, ROUNDS = 5, 3, 3
#: Trees grown at once; bounds the disk that moved records take.
GROUP = 3

_SCHEMA = "node bigint, a bigint, b bigint, p bigint, d bigint"
_ARROW = pa.schema([(n, pa.int64()) for n in ("node", "a", "b", "p", "d")])
_ROWS = 200_000  # rows looked at together
_SHORT = 128  # rows of a node compared step by step with those of other nodes; longer ones are compared as matrices
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def descend(node: np.ndarray, p: np.ndarray, d: np.ndarray, levels: int) -> np.ndarray:
    """The nodes reached from ``node`` by records (p, d) after some levels.

    A node ranks position j by (j XOR its hash), so the first position is its hash itself.
    """
    for _ in range(levels):
        at = mix(node + _U(0x9E3779B97F4A7C15)) & _U(127)
        bit = (np.where(at < 64, p, d) >> (at & _U(63))) & _U(1)
        node = mix(node ^ ((at << _U(1) | bit) + _U(1)) * _U(0xD1342543DE82EF95))
    return node


def plan(n: int, k: int, leaf: int, miss: float) -> tuple[int, int]:
    """(levels, trees) for ``n`` records and at most ``k`` differing bits in each hash."""
    levels = max(0, int(math.log2(max(n, 1) / max(1, leaf / 64))))
    if n <= leaf or levels == 0:
        return 0, 1
    stay = 1 - 2 * k / 128
    kept = (1 - (1 - stay**LEVELS) ** BRANCHES) ** ROUNDS
    return levels, math.ceil(math.log(miss) / math.log1p(-kept * stay**levels))


def _columns(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False).view(_U) for n in names]


def _table(node, a, b, p, d) -> pa.RecordBatch:
    n = len(a)
    cols = [pa.nulls(n, pa.int64()) if x is None else pa.array(x.view(np.int64)) for x in (node, a, b, p, d)]
    return pa.RecordBatch.from_arrays(cols, schema=_ARROW)


def _plant(trees: range, levels: int, seed: int):
    """Rows (node, a, NULL, p, d) of each record in each tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, p, d = _columns(batch, "rep", "p", "d")
            for t in trees:
                root = mix(np.full(1, (seed << 20) + t + 1, _U))[0]
                yield _table(descend(np.full(len(rep), root, _U), p, d, levels), rep, None, p, d)

    return run


def _regrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of large nodes, sent down the subtrees of these."""
    for batch in batches:
        node, rep, p, d = _columns(batch, "node", "a", "p", "d")
        for t in range(BRANCHES):
            yield _table(descend(mix(node + _U(t + 1)), p, d, LEVELS), rep, None, p, d)


def _close(rep, p, d, starts, sizes, k: int) -> Iterator[pa.RecordBatch]:
    """Close pairs of rows of one node; nodes are given by where they start and their sizes."""

    def pairs(i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
        dp = np.bitwise_count(p[i] ^ p[j])
        ok = dp <= k
        if ok.any():
            i, j, dp = i[ok], j[ok], dp[ok]
            x, y = rep[i].view(np.int64), rep[j].view(np.int64)
            yield _table(None, np.minimum(x, y), np.maximum(x, y), dp.astype(np.int64), np.bitwise_count(d[i] ^ d[j]).astype(np.int64))

    short = sizes <= _SHORT
    end = np.zeros(len(rep), np.int64)
    at = np.repeat(starts[short] - np.cumsum(sizes[short]) + sizes[short], sizes[short]) + np.arange(sizes[short].sum())
    end[at] = np.repeat((starts + sizes)[short], sizes[short])
    step = 1
    at = at[at + 1 < end[at]]
    while len(at):
        near = np.bitwise_count(d[at] ^ d[at + step]) <= k
        yield from pairs(at[near], at[near] + step)
        step += 1
        at = at[at + step < end[at]]
    for a, n in zip(starts[~short], sizes[~short], strict=True):
        for i in range(a, a + n, 256):
            rows = d[i : min(i + 256, a + n)]
            x, y = np.nonzero(np.bitwise_count(rows[:, None] ^ d[None, i : a + n]) <= k)
            after = x < y
            yield from pairs(x[after] + i, y[after] + i)


def _compare(k: int, leaf: int | None):
    """Close pairs within the nodes of sorted rows; records of nodes above ``leaf`` come out as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        n_held, large = 0, None

        def settle(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, n_held, large
            node, rep, p, d = (np.concatenate(c) for c in zip(*held, strict=True)) if held else (np.empty(0, _U),) * 4
            held, n_held = [], 0
            if not len(node):
                return
            starts = np.concatenate([[0], np.nonzero(node[1:] != node[:-1])[0] + 1])
            sizes = np.diff(np.concatenate([starts, [len(node)]]))
            big = sizes > leaf if leaf is not None else np.zeros(len(sizes), bool)
            big[0] |= large is not None and node[0] == large
            large = node[-1] if big[-1] else None
            if not last and not big[-1]:  # the last node may go on in the next batch
                held, n_held = [[c[starts[-1] :] for c in (node, rep, p, d)]], sizes[-1]
                starts, sizes, big = starts[:-1], sizes[:-1], big[:-1]
            for a, n in zip(starts[big], sizes[big], strict=True):
                yield _table(node[a : a + n], rep[a : a + n], None, p[a : a + n], d[a : a + n])
            yield from _close(rep, p, d, starts[~big], sizes[~big], k)

        for batch in batches:
            held.append(_columns(batch, "node", "a", "p", "d"))
            n_held += batch.num_rows
            if n_held >= _ROWS:
                yield from settle(False)
        yield from settle(True)

    return run


def _in_nodes(rows: DataFrame, k: int, leaf: int | None) -> DataFrame:
    return rows.repartition("node").sortWithinPartitions("node").mapInArrow(_compare(k, leaf), _SCHEMA)


def _in_blocks(rows: DataFrame, block: int, staging: Staging) -> DataFrame:
    """Rows of large nodes under a node per pair of blocks, in which all their pairs meet."""
    sizes = staging.keep(rows.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / block).alias("n_blocks")))
    dealt = rows.join(sizes, "node").withColumn("i", F.pmod(F.xxhash64("a"), "n_blocks"))
    met = dealt.withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_blocks") - 1)))
    return met.select(F.xxhash64("node", F.least("i", "j"), F.greatest("i", "j")).alias("node"), "a", "b", "p", "d")


def near_pairs(classes: DataFrame, k: int, staging: Staging, leaf: int = LEAF, miss: float = MISS, seed: int = 1) -> DataFrame:
    """(a, b, dist_p, dist_d) of classes (rep, p, d) with p and d each at most ``k`` bits apart, a < b, each pair once.

    A pair is lost with probability ``miss`` at most. ``classes`` holds distinct (p, d) with a unique rep and should
    be a stored table, as it is read once per group of trees. Rows with a NULL hash link to nothing; an empty table
    gives an empty one.
    """
    classes = classes.select("rep", "p", "d").dropna()
    levels, trees = plan(classes.count(), k, leaf, miss)
    made = []
    for at in range(0, trees, GROUP):
        planted = classes.mapInArrow(_plant(range(at, min(at + GROUP, trees)), levels, seed), _SCHEMA)
        found = staging.keep(_in_nodes(planted, k, leaf))
        for _ in range(ROUNDS):
            made.append(found.where("node is null"))
            large = found.where("node is not null")
            if large.limit(1).count() == 0:
                break
            found = staging.keep(_in_nodes(large.mapInArrow(_regrow, _SCHEMA), k, leaf))
        else:
            made.append(found.where("node is null"))
            large = found.where("node is not null")
            if large.limit(1).count():
                made.append(staging.keep(_in_nodes(_in_blocks(large, max(1, leaf // 4), staging), k, None)))
    whole = made[0]
    for part in made[1:]:
        whole = whole.unionByName(part)
    return whole.select("a", "b", F.col("p").cast("int").alias("dist_p"), F.col("d").cast("int").alias("dist_d")).distinct()
