"""Distance joins over pairs of 64-bit hashes, by banding.

Two hashes at most t bits apart agree in at least one of t + 1 bands, so an equi-join on (band of one hash,
band of the other) finds every pair; both distances are then counted. Copies share one class, so a hash that
very many files hold costs one row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hamming
from ..session import Staging


def hash_classes(files: DataFrame) -> DataFrame:
    """Distinct (p, d) with their smallest file_id as rep."""
    return files.where("p is not null and d is not null").groupBy("p", "d").agg(F.min("file_id").alias("rep"), F.count(F.lit(1)).alias("n"))


def _bands(t: int) -> list[int]:
    cuts = [i * 64 // (t + 1) for i in range(t + 2)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _keyed(df: DataFrame, t: int) -> DataFrame:
    """One row per combination of a band of p and a band of d.

    The planner takes the exploded rows for as small as the table they come from, so joins on the key ask for a merge:
    else one side, 25 rows a class, is sent through the driver.
    """
    m = _bands(t)
    keys = [F.xxhash64(F.lit(i), F.lit(j), F.col("p").bitwiseAND(F.lit(a).cast("bigint")), F.col("d").bitwiseAND(F.lit(b).cast("bigint"))) for i, a in enumerate(m) for j, b in enumerate(m)]
    return df.select("*", F.explode(F.array(*keys)).alias("key"))


def _dist(a: str, b: str) -> Column:
    return hamming(F.col(a), F.col(b)).cast("int")


def banded_pairs(classes: DataFrame, t: int) -> DataFrame:
    """(a, b, dist_p, dist_d) of classes with both distances at most t, a < b."""
    k = _keyed(classes.select("rep", "p", "d"), t)
    left = k.select("key", F.col("rep").alias("a"), F.col("p").alias("pa"), F.col("d").alias("da"))
    right = k.select("key", F.col("rep").alias("b"), F.col("p").alias("pb"), F.col("d").alias("db"))
    met = left.hint("merge").join(right, "key").where("a < b").select("a", "b", _dist("pa", "pb").alias("dist_p"), _dist("da", "db").alias("dist_d"))
    return met.where(f"dist_p <= {t} and dist_d <= {t}").distinct()


def within(queries: DataFrame, item: str, pool: DataFrame, t: int) -> DataFrame:
    """(item, match_id, distance) of all pool classes with both distances at most t; distance is the larger."""
    q = _keyed(queries.select(item, "p", "d"), t).select("key", item, F.col("p").alias("pa"), F.col("d").alias("da"))
    r = _keyed(pool.select("rep", "p", "d"), t).select("key", F.col("rep").alias("match_id"), F.col("p").alias("pb"), F.col("d").alias("db"))
    met = q.hint("merge").join(r, "key").select(item, "match_id", F.greatest(_dist("pa", "pb"), _dist("da", "db")).alias("distance"))
    return met.where(F.col("distance") <= t).distinct()


#: Queries sent to every task at once.
QUERY_BLOCK = 20_000


def scan_best(queries: DataFrame, item: str, pool: DataFrame, k: int, staging: Staging, both: bool = True) -> DataFrame:
    """(item, match_id, distance): the ``k`` nearest pool classes of each item at any distance, ties to smaller ids.

    The distance is the larger of both hashes', or that of p alone. Queries are a stated set: they are broadcast in
    blocks of QUERY_BLOCK, and each task keeps the ``k`` best per query over all of its pool rows.
    """
    stated = staging.keep(queries.select(F.col(item).cast("string").alias("_q"), "p", "d").withColumn("_b", F.pmod(F.xxhash64("_q"), F.lit(4096))))
    sizes = sorted((r["_b"], r["count"]) for r in stated.groupBy("_b").count().collect())  # 4096 rows at most
    blocks, held = [[]], 0
    for b, n in sizes:
        if held + n > QUERY_BLOCK and blocks[-1]:
            blocks.append([])
            held = 0
        blocks[-1].append(b)
        held += n
    pool = _spread(pool)
    out = None
    for cells in blocks:
        rows = stated.where(F.col("_b").isin(cells)).collect() if cells else []
        part = _scan_block(pool, [(r["_q"], r["p"], r["d"]) for r in rows], k, both)
        part = staging.keep(part) if len(blocks) > 1 else part
        out = part if out is None else out.unionByName(part)
    ranked = out.withColumn("_r", F.row_number().over(Window.partitionBy("_q").orderBy("distance", "match_id"))).where(F.col("_r") <= k)
    return ranked.select(F.col("_q").cast(queries.schema[item].dataType).alias(item), "match_id", "distance")


def _spread(pool: DataFrame, few: int = 5_000_000) -> DataFrame:
    """A pool of so few rows that it may lie in one file is dealt over all cores."""
    return pool.repartition(pool.sparkSession.sparkContext.defaultParallelism) if pool.count() <= few else pool


def _scan_block(pool: DataFrame, rows: list[tuple[str, int, int]], k: int, both: bool) -> DataFrame:
    sent = pool.sparkSession.sparkContext.broadcast((np.array([r[1] for r in rows], np.int64).view(np.uint64), np.array([r[2] for r in rows], np.int64).view(np.uint64)))
    names = pool.sparkSession.sparkContext.broadcast([r[0] for r in rows])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qp, qd = sent.value
        n = len(qp)
        best_d, best_i = np.full((n, k), 255, np.int64), np.full((n, k), np.iinfo(np.int64).max)
        for batch in batches:
            batch = batch.sort_values("rep")  # of equal distances the first is the smallest id
            p, d, rep = batch["p"].to_numpy().view(np.uint64), batch["d"].to_numpy().view(np.uint64), batch["rep"].to_numpy()
            for at in range(0, n, 256):
                dist = np.bitwise_count(qp[at : at + 256, None] ^ p[None])
                if both:
                    dist = np.maximum(dist, np.bitwise_count(qd[at : at + 256, None] ^ d[None]))
                for _ in range(min(k, len(rep))):
                    j = dist.argmin(1)
                    new = dist[np.arange(len(j)), j].astype(np.int64)
                    dist[np.arange(len(j)), j] = 254
                    cand_d, cand_i = np.column_stack([best_d[at : at + 256], new]), np.column_stack([best_i[at : at + 256], np.where(new < 254, rep[j], np.iinfo(np.int64).max)])
                    order = np.lexsort((cand_i, cand_d), axis=1)[:, :k]
                    best_d[at : at + 256], best_i[at : at + 256] = np.take_along_axis(cand_d, order, 1), np.take_along_axis(cand_i, order, 1)
        ok = best_d < 254
        q = np.repeat(np.arange(n), k).reshape(n, k)[ok]
        yield pd.DataFrame({"_q": pd.Series([names.value[i] for i in q], dtype=object), "match_id": best_i[ok], "distance": best_d[ok].astype(np.int32)})

    return pool.select("rep", "p", "d").mapInPandas(run, "_q string, match_id bigint, distance int")


def nearest(queries: DataFrame, item: str, pool: DataFrame, near: int = 4) -> DataFrame:
    """(item, match_id, distance): the nearest class of each item at any distance; ties go to the smallest id.

    Items with a class within ``near`` bits are answered by the banded join; only the others are compared with the
    whole pool. An empty pool gives an empty table.
    """
    staging = Staging(queries.sparkSession, "nearest")
    pool = staging.keep(pool.select("rep", "p", "d"))
    close = staging.keep(within(queries, item, pool, near).groupBy(item).agg(F.min(F.struct("distance", "match_id")).alias("m")).select(item, "m.match_id", "m.distance"))
    far = queries.select(item, "p", "d").join(close.select(item), item, "left_anti")
    return close.unionByName(scan_best(far, item, pool, 1, staging))


#: Distinct hash pairs asked for at once in ``nearest_by_set``, 16 bytes each, and pool rows compared at once.
SET_QUERIES, SET_ROWS = 1_000_000, 1_000_000
#: Comparisons from which pool rows are looked up by bands instead of one after the other, at any distance and where
#: only distances below a limit are told apart.
INDEX_FROM, INDEX_BELOW = 40_000_000_000, 4_000_000_000


def nearest_by_set(queries: DataFrame, item: str, pool: DataFrame, sets: Sequence[str], far: int | None = None) -> DataFrame:
    """(item, set, distance): the distance of each item to the nearest row of each set of pool rows, at any distance.

    ``pool`` is (p, d, held): a row belongs to ``sets[i]`` where bit i of held is set, so one pass serves all of them.
    Items of equal hashes are asked for once, in blocks that every task receives; the pool is dealt over all cores. A
    set without rows gives no row. With ``far`` distances from there on are given as ``far``: who asks no more of
    them spares comparing every item with every row.
    """
    spark, staging = queries.sparkSession, Staging(queries.sparkSession, "nearest_by_set")
    asked = staging.keep(queries.select("p", "d").distinct())
    pool = staging.keep(pool.select("p", "d", "held").repartition(spark.sparkContext.defaultParallelism))
    blocks = max(1, -(-asked.count() // SET_QUERIES))
    out = None
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("p", "d"), F.lit(blocks)) == b).toArrow()
        part = _scan_sets(pool, rows["p"].to_numpy(), rows["d"].to_numpy(), len(sets), far)
        part = staging.keep(part) if blocks > 1 else part
        out = part if out is None else out.unionByName(part)
    found = out.groupBy("p", "d", "held").agg(F.min("distance").alias("distance"))
    named = found.select("p", "d", F.element_at(F.array(*map(F.lit, sets)), F.col("held") + 1).alias("set"), "distance")
    if far is None:
        return queries.select(item, "p", "d").join(named, ["p", "d"]).select(item, "set", "distance")
    held = pool.agg(F.bit_or("held").alias("held")).first()["held"] or 0
    there = F.array(*[F.lit(s) for i, s in enumerate(sets) if held >> i & 1]).cast("array<string>")
    every = queries.select(item, "p", "d", F.explode(there).alias("set"))
    return every.join(named, ["p", "d", "set"], "left").select(item, "set", F.coalesce("distance", F.lit(far)).alias("distance"))


def _scan_sets(pool: DataFrame, p: np.ndarray, d: np.ndarray, n_sets: int, far: int | None) -> DataFrame:
    sent = pool.sparkSession.sparkContext.broadcast((p, d))
    index_from, set_rows, top = (INDEX_FROM if far is None else INDEX_BELOW), SET_ROWS, 255 if far is None else far

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qp, qd = (x.view(np.uint64) for x in sent.value)
        best = np.full((n_sets, len(qp)), top, np.uint8)

        def compare(held):
            rows = pd.concat(held)
            for mask, part in sorted(rows.groupby("held"), key=lambda x: -int(x[0]).bit_count()):
                of = [i for i in range(n_sets) if mask >> i & 1]
                if of:
                    limit = best[of].max(0)  # a row counts for all of its sets
                    _nearer(qp, qd, part["p"].to_numpy().view(np.uint64), part["d"].to_numpy().view(np.uint64), limit, best, of, index_from)

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= set_rows:
                compare(held)
                held, n = [], 0
        if held:
            compare(held)
        for i in range(n_sets):
            for at in range(0, len(qp), 100_000):
                ok = np.flatnonzero(best[i, at : at + 100_000] < top) + at
                yield pd.DataFrame({"p": qp[ok].view(np.int64), "d": qd[ok].view(np.int64), "held": np.full(len(ok), i, np.int32), "distance": best[i, ok].astype(np.int32)})

    return pool.mapInPandas(run, "p bigint, d bigint, held int, distance int")


def _nearer(qp: np.ndarray, qd: np.ndarray, p: np.ndarray, d: np.ndarray, limit: np.ndarray, best: np.ndarray, of: list[int], index_from: int) -> None:
    """Lowers ``best`` of the sets ``of`` where a pool row is nearer than the query's ``limit``.

    Where that is much to compare, p is cut into five bands, and the rows whose band differs from the query's by 0, 1,
    2 ... bits are compared first, band after band. By the pigeonhole principle a row not yet met after s such steps
    differs in s bits of p at least, so a query is settled as soon as its limit is s or less.
    """
    scratch = np.empty(131_072, np.uint64), np.empty(131_072, np.uint8), np.empty(131_072, bool)
    if len(qp) * len(p) < index_from:
        for part in (slice(64), slice(64, None)):  # the first rows alone bring limits down
            _compare(qp, qd, p[part], d[part], np.arange(len(qp)), limit, best, of, scratch)
        return
    cuts = [i * 64 // 5 for i in range(6)]
    bands = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        cell = lambda x, a=a, b=b: ((x >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)).astype(np.int64)
        order = np.argsort(cell(p), kind="stable")
        near = [np.array([m for m in range(1 << (b - a)) if m.bit_count() == t], np.int64) for t in range(b - a + 1)]
        starts = np.concatenate([[0], np.cumsum(np.bincount(cell(p), minlength=1 << (b - a)))])
        bands.append((cell(qp), p[order], d[order], starts, near))
    met = 0
    for t in range(14):
        for key, sp, sd, starts, near in bands:
            if t >= len(near):
                continue
            open_ = np.flatnonzero(limit > met)
            if not len(open_):
                return
            open_ = open_[np.argsort(key[open_], kind="stable")]
            for group in np.split(open_, np.flatnonzero(np.diff(key[open_])) + 1):
                cells = np.sort(key[group[0]] ^ near[t])
                size = starts[cells + 1] - starts[cells]
                rows = np.repeat(starts[cells] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                _compare(qp, qd, sp[rows], sd[rows], group, limit, best, of, scratch)
            met += 1


def _compare(qp: np.ndarray, qd: np.ndarray, p: np.ndarray, d: np.ndarray, who: np.ndarray, limit: np.ndarray, best: np.ndarray, of: list[int], scratch: tuple[np.ndarray, ...]) -> None:
    """Compares the queries ``who`` with all rows in tiles of the size of ``scratch``; d only where p is near enough."""
    xor, count, flag = scratch
    tile = len(xor)
    for s in range(0, len(p), 4096):
        tp, td = p[s : s + 4096], d[s : s + 4096]
        if len(tp) % 8:  # whole words of eight flags; a row met twice changes nothing
            tp, td = (np.concatenate([x, np.repeat(x[-1:], -len(x) % 8)]) for x in (tp, td))
        n = len(tp)
        for at in range(0, len(who), tile // n):
            w = who[at : at + tile // n]
            k = len(w) * n
            np.bitwise_xor(qp[w][:, None], tp, out=xor[:k].reshape(len(w), n))
            np.bitwise_count(xor[:k], out=count[:k])
            np.less(count[:k].reshape(len(w), n), limit[w][:, None], out=flag[:k].reshape(len(w), n))
            words = np.flatnonzero(flag[:k].view(np.uint64))
            if not len(words):
                continue
            x, y = np.nonzero(flag[:k].reshape(-1, 8)[words])
            cells = words[x] * 8 + y
            q, r = w[cells // n], cells % n
            near = np.maximum(count[cells], np.bitwise_count(qd[q] ^ td[r]))
            ok = np.flatnonzero(near < limit[q])
            if len(ok):
                for i in of:
                    np.minimum.at(best[i], q[ok], near[ok])
                limit[w] = best[of][:, w].max(0)


def best_two(queries: DataFrame, item: str, pool: DataFrame, both: bool = False) -> DataFrame:
    """(item, best_id, best_distance, runner_up_distance, margin) at any distance, by p alone unless ``both``.

    The runner-up is the next class in order of distance and id, also at the same distance.
    """
    staging = Staging(queries.sparkSession, "best_two")
    two = scan_best(queries, item, pool, 2, staging, both)
    g = two.groupBy(item).agg(F.min(F.struct("distance", "match_id")).alias("a"), F.max(F.struct("distance", "match_id")).alias("b"))
    other = F.when(F.col("a.match_id") != F.col("b.match_id"), F.col("b.distance"))
    return g.select(item, F.col("a.match_id").alias("best_id"), F.col("a.distance").alias("best_distance"), other.alias("runner_up_distance"), (other - F.col("a.distance")).alias("margin"))
