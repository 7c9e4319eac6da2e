"""Problem 9: a mix in which each source has its target share of all tokens.

Equal texts are one document, whose sources are all under which it was posted. Documents are aggregated by
membership pattern (the set of listed sources they belong to), so the flow network has one node per pattern
and one per source, however many documents there are. Tokens flow from a pattern to its sources; the k-th use
of a pattern's tokens costs k - 1, so repetition is bought last and spread evenly; a source takes at most
max_repeats times a pattern. The largest total at which every source can reach its share is found first, then
the cheapest flow of that total. Documents are picked in a seeded order: a pattern's documents lie on a line,
each source takes a stretch of it (a stretch longer than the line wraps round), and a document is used once for
each time its start is covered.

Defined results: texts that are NULL or empty, and documents of no listed source, are not used; a source whose
documents hold no tokens cannot be mixed: it is reported with share 0 and the others keep their proportions;
targets that are NULL or not above 0 are left out, and max_repeats below 1 counts as 1. A text posted more than
once is tokenized each time, which is cheaper than moving texts to find that out.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.missing import usable
from ..session import Staging

#: Rank file of a public tokenizer; a parameter wherever it is used.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public split pattern of that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Sources and membership patterns the network may have; more are an error.
MOST = 100_000
#: Cells of the seeded order; prefix sums over cells are the only sums made in one place per pattern.
CELLS = 4096

_encoders: dict = {}


def _encoder(path: str):
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}
        _encoders[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def n_tokens(path: str = TOKENIZER):
    """A column function: tokens of whole texts."""

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoder(path)
        for texts in batches:
            yield pd.Series([len(encoder.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return count


def min_cost_flow(n: int, arcs: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """Flow per arc (u, v, capacity, cost) of a cheapest maximum flow, by shortest augmenting paths."""
    graph: list[list[int]] = [[] for _ in range(n)]
    to, cap, cost = [], [], []
    for u, v, c, w in arcs:
        graph[u].append(len(to))
        to.append(v), cap.append(c), cost.append(w)
        graph[v].append(len(to))
        to.append(u), cap.append(0), cost.append(-w)
    potential = [0] * n
    while True:
        dist: list[float] = [float("inf")] * n
        back = [-1] * n
        dist[source] = 0
        queue = [(0, source)]
        while queue:
            d, u = heapq.heappop(queue)
            if d > dist[u]:
                continue
            for e in graph[u]:
                if cap[e] > 0:
                    nd = d + cost[e] + potential[u] - potential[to[e]]
                    if nd < dist[to[e]]:
                        dist[to[e]], back[to[e]] = nd, e
                        heapq.heappush(queue, (nd, to[e]))
        if back[sink] < 0:
            return [cap[2 * i + 1] for i in range(len(arcs))]
        for v in range(n):
            if dist[v] < float("inf"):
                potential[v] += dist[v]
        push, v = float("inf"), sink
        while v != source:
            push = min(push, cap[back[v]])
            v = to[back[v] ^ 1]
        v = sink
        while v != source:
            cap[back[v]] -= push
            cap[back[v] ^ 1] += push
            v = to[back[v] ^ 1]


def plan_flow(patterns: dict[tuple[str, ...], int], targets: dict[str, tuple[float, int]], total: int | None = None) -> dict[tuple[tuple[str, ...], str], int]:
    """Tokens from each pattern to each source. Without ``total``, the largest total that keeps all shares."""
    can = {s for p, t in patterns.items() if t > 0 for s in p}
    live = {s: v for s, v in sorted(targets.items()) if s in can}
    if not live:
        return {}
    whole = sum(share for share, _ in live.values())
    names = list(live)
    pats = [p for p in sorted(patterns) if patterns[p] > 0]

    def solve(amount: int, costs: bool) -> tuple[int, dict]:
        quota = {s: int(amount * live[s][0] / whole) for s in names}
        root, sink = 0, 1 + len(pats) + len(names)
        arcs, of = [], []
        for i, p in enumerate(pats):
            for k in range(max(live[s][1] for s in p)):
                arcs.append((root, 1 + i, patterns[p], k * costs))
            for s in p:
                of.append((len(arcs), p, s))
                arcs.append((1 + i, 1 + len(pats) + names.index(s), patterns[p] * live[s][1], 0))
        for j, s in enumerate(names):
            arcs.append((1 + len(pats) + j, sink, quota[s], 0))
        flow = min_cost_flow(sink + 1, arcs, root, sink)
        return sum(quota.values()) - sum(flow[-len(names) :]), {(p, s): flow[a] for a, p, s in of if flow[a]}

    if total is None:
        lo, hi = 0, sum(t * max(live[s][1] for s in p) for p, t in ((p, patterns[p]) for p in pats)) + 1
        while hi - lo > max(1, lo // 1_000_000):
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if solve(mid, False)[0] == 0 else (lo, mid)
        total = lo
    return solve(total, True)[1]


def _pooled(documents: DataFrame, targets: DataFrame, tokenizer: str, staging: Staging) -> tuple[DataFrame, dict]:
    """Stored (doc_id, pattern, tokens) of distinct texts with a listed source, and the targets."""
    rows = targets.select(usable("source").alias("source"), "target_share", "max_repeats").where("source is not null and target_share > 0").groupBy("source").agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("reps"))
    if rows.count() > MOST:
        raise ValueError(f"more than {MOST} sources")
    goal = {r["source"]: (float(r["share"]), max(1, int(r["reps"] or 1))) for r in rows.collect()}
    listed = F.broadcast(rows.select("source"))  # MOST rows at most
    # texts of other sources are left out before any is tokenized; a pattern holds no more names than there are targets
    used = documents.where("text is not null and text <> ''").select("doc_id", usable("source").alias("source"), "text").join(listed, "source")
    texts = used.select("doc_id", "source", F.sha2("text", 256).alias("key"), n_tokens(tokenizer)("text").alias("tokens"))
    pooled = texts.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.min("tokens").alias("tokens"), F.array_sort(F.collect_set("source")).alias("pattern"))
    return staging.keep(pooled.select("doc_id", "pattern", "tokens")), goal


def mix(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 42, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, copies, tokens): how often a document is used for a source, and its size."""
    spark = documents.sparkSession
    staging = Staging(spark, "mix")
    pooled, goal = _pooled(documents, targets, tokenizer, staging)
    cells = pooled.groupBy("pattern", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(CELLS)).alias("cell")).agg(F.sum("tokens").alias("t"))
    cells = staging.keep(cells)
    by_pattern = staging.keep(cells.groupBy("pattern").agg(F.sum("t").alias("t")))
    if by_pattern.count() > MOST:
        raise ValueError(f"more than {MOST} membership patterns")
    sizes = {tuple(r["pattern"]): int(r["t"]) for r in by_pattern.collect()}
    flow = plan_flow(sizes, goal, total)
    stretches, at = [], {}
    for (pattern, source), amount in sorted(flow.items()):
        start = at.get(pattern, 0)
        stretches.append((list(pattern), source, start, start + amount, sizes[pattern]))
        at[pattern] = start + amount
    # a cheapest flow uses a tree of arcs, so there are fewer stretches than patterns and sources together
    plan = F.broadcast(spark.createDataFrame(stretches, "pattern array<string>, source string, lo bigint, hi bigint, line bigint"))
    before = Window.partitionBy("pattern").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.withColumn("base", F.coalesce(F.sum("t").over(before), F.lit(0))).drop("t")
    inside = Window.partitionBy("pattern", "cell").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = pooled.withColumn("cell", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(CELLS)))
    placed = placed.withColumn("off", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(starts, ["pattern", "cell"])
    at_token = F.col("base") + F.col("off")
    # starts at_token + k * line that fall into [lo, hi)
    upto = lambda x: F.ceil((x - at_token) / F.col("line"))
    used = placed.where("tokens > 0").join(plan, "pattern").withColumn("copies", F.greatest(upto(F.col("hi")), F.lit(0)) - F.greatest(upto(F.col("lo")), F.lit(0)))
    return used.where("copies > 0").select("doc_id", "source", F.col("copies").cast("int").alias("copies"), "tokens")


def shares(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 42, tokenizer: str = TOKENIZER) -> DataFrame:
    """(source, target_share, max_repeats, n_docs, max_copies, mixed_tokens, actual_share) per target."""
    made = mix(documents, targets, total, seed, tokenizer)
    got = made.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.max("copies").alias("max_copies"), F.sum(F.col("copies") * F.col("tokens")).alias("mixed_tokens"))
    goal = targets.select(usable("source").alias("source"), "target_share", "max_repeats").where("source is not null")
    zero = F.lit(0)
    joined = goal.join(got, "source", "left").select("source", "target_share", "max_repeats", F.coalesce("n_docs", zero).alias("n_docs"), F.coalesce("max_copies", zero).alias("max_copies"), F.coalesce("mixed_tokens", zero).alias("mixed_tokens"))
    return joined.withColumn("actual_share", F.round(F.coalesce(F.try_divide("mixed_tokens", F.sum("mixed_tokens").over(Window.partitionBy())), F.lit(0.0)), 6))
