"""Problem 8: passages of held-out items inside corpus documents, by greedy string tiling.

Words are the longest runs of letters and digits, compared without case. Documents and items are joined on
shared seeds of ``seed`` words; for each candidate pair the longest matches not yet covered are marked again
and again, found by running Karp-Rabin over the words left, until none of ``min_tile`` words is left. An item
leaks where its longest tile, or the share of its words under tiles, reaches the threshold; the share catches
passages whose pieces were reordered.

The items' seeds travel to the documents, in blocks of ``BLOCK_SEEDS`` (a checked count): each document is read
once per block, whole, and no text is shuffled. Held-out sets are small beside the corpus, so reading it again for
each block costs far less than moving the seeds of every document.

Defined results: NULL or wordless texts leak nothing; repeated rows are reported once per id; ties between
equally long matches go to the earlier document position, then the earlier item position; an item shorter than
the seed leaks nothing; empty tables give an empty result.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Staging

WORD = re.compile(r"[^\W_]+")
#: Seeds of the items sent to every worker at once: 8 bytes each for the hash, 8 for the place.
BLOCK_SEEDS = 4_000_000
_BASE = np.uint64(1_000_003)
_SCHEMA = "doc_id bigint, item_id bigint, longest int, covered int, item_words int"


def words_of(text: str | None) -> list[str]:
    """Case-folded words; the dotless i counts as i, as upper case does not tell them apart."""
    if not text:
        return []
    folded = unicodedata.normalize("NFC", text).casefold().replace("i̇", "i").replace("ı", "i")
    return WORD.findall(folded)


def rolling(ids: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hash of every window of ``width`` ids, modulo 2^64."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = out * _BASE + ids[k : k + n]
    return out


def _free_windows(hashes: np.ndarray, taken: np.ndarray, width: int) -> np.ndarray:
    """Starts of the windows in which nothing is taken."""
    run = np.concatenate([[0], np.cumsum(taken)])
    return np.nonzero(run[width:] == run[: len(run) - width])[0][: len(hashes)]


def _run(doc: np.ndarray, item: np.ndarray, taken_d: np.ndarray, taken_i: np.ndarray, d: int, i: int) -> int:
    """Words from (d, i) on that are equal and free in both."""
    n, step = 0, 64
    while True:
        m = min(step, len(doc) - d - n, len(item) - i - n)
        x, y = d + n, i + n
        bad = (doc[x : x + m] != item[y : y + m]) | taken_d[x : x + m] | taken_i[y : y + m]
        stop = int(bad.argmax()) if m and bad.any() else m
        n += stop
        if stop < step:
            return n
        step *= 4


def relevant(doc: np.ndarray, item: np.ndarray, width: int) -> np.ndarray:
    """The runs of at least ``width`` words of the document that the item holds too, with a 0 between them.

    No tile can leave such a run, and their order is kept, so the tiles are those of the whole document.
    """
    held = np.isin(doc, item)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], held.view(np.int8), [0]])))
    parts = [np.append(doc[a:b], np.uint64(0)) for a, b in zip(edges[::2], edges[1::2], strict=True) if b - a >= width]
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def tiles(doc: np.ndarray, item: np.ndarray, min_tile: int) -> list[tuple[int, int, int]]:
    """Non-overlapping matches (doc start, item start, length), longest first."""
    out: list[tuple[int, int, int]] = []
    taken_d, taken_i = np.zeros(len(doc), bool), np.zeros(len(item), bool)
    width = max(min_tile, min(len(item), len(doc), 4 * min_tile))
    while len(doc) >= min_tile and len(item) >= min_tile:
        found: list[tuple[int, int, int]] = []
        hd, hi = rolling(doc, width), rolling(item, width)
        starts_i = _free_windows(hi, taken_i, width)
        places: dict[int, list[int]] = {}
        for i in starts_i:
            places.setdefault(int(hi[i]), []).append(int(i))
        starts_d = _free_windows(hd, taken_d, width)
        hits = starts_d[np.isin(hd[starts_d], hi[starts_i])] if len(starts_d) and len(starts_i) else []
        longest = 0
        covered: dict[int, int] = {}  # per diagonal, the document position a match already reaches
        for d in hits:
            d = int(d)
            for i in places.get(int(hd[d]), ()):
                if covered.get(d - i, -1) > d:
                    continue
                n = _run(doc, item, taken_d, taken_i, d, i)
                covered[d - i] = d + n
                if n >= width:
                    found.append((d, i, n))
                    longest = max(longest, n)
        if longest > 2 * width:
            width = longest  # start again from the longest match
            continue
        for d, i, n in sorted(found, key=lambda m: (-m[2], m[0], m[1])):
            if not taken_d[d : d + n].any() and not taken_i[i : i + n].any():
                taken_d[d : d + n] = True
                taken_i[i : i + n] = True
                out.append((d, i, n))
        if found and any(not taken_d[d : d + n].all() for d, _, n in found):
            # a match was cut by a longer one: what is left of it may still reach this width
            if _left_over(hd, hi, taken_d, taken_i, width):
                continue
        if width == min_tile:
            break
        width = max(min_tile, width // 2)
    return out


def _left_over(hd: np.ndarray, hi: np.ndarray, taken_d: np.ndarray, taken_i: np.ndarray, width: int) -> bool:
    d, i = _free_windows(hd, taken_d, width), _free_windows(hi, taken_i, width)
    return bool(len(d) and len(i) and np.isin(hd[d], hi[i]).any())


class _Items:
    """Items as word ids with the sorted hashes of their seeds."""

    def __init__(self, rows: Sequence[tuple[int, str]], seed: int):
        self.vocabulary: dict[str, int] = {}
        self.ids_of = [item for item, _ in rows]  # texts are told apart by their place: an id may have several
        self.words: list[np.ndarray] = []
        hashes, owners = [], []
        for place, (_, text) in enumerate(rows):
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)], np.uint64)
            self.words.append(ids)
            h = rolling(ids, seed)
            hashes.append(h)
            owners.append(np.full(len(h), place, np.int64))
        h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hashes, self.owners = h[order], (np.concatenate(owners)[order] if owners else np.empty(0, np.int64))

    def ids(self, text: str | None) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(w, 0) for w in words_of(text)], np.uint64)


_known: dict[str, _Items] = {}


def _items_of(token: str, rows: Sequence[tuple[int, str]], seed: int) -> _Items:
    """The items of a block, built once per Python worker; the last block alone is kept."""
    if token not in _known:
        _known.clear()
        _known[token] = _Items(rows, seed)
    return _known[token]


def _item_blocks(items: DataFrame, limit: int) -> Iterator[list[tuple[int, str]]]:
    """Items of about ``limit`` seeds at a time; one that is larger comes alone."""
    size = F.coalesce(F.sum(F.length("text")), F.lit(0))
    n_blocks = max(1, -(-items.agg(size).first()[0] // 2 // max(1, limit)))  # a seed needs two characters of text at least
    for b in range(n_blocks):
        rows, held = [], 0
        for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == b).orderBy("item_id").toLocalIterator():
            n = len(r["text"]) // 2
            if rows and held + n > 2 * limit:
                yield rows
                rows, held = [], 0
            rows.append((r["item_id"], r["text"]))
            held += n
        if rows:
            yield rows


def _tile_rows(doc_id: int, doc: np.ndarray, places: list[int], known: _Items, min_tile: int) -> Iterator[tuple]:
    for place in places:
        words = known.words[place]
        made = tiles(relevant(doc, words, min_tile), words, min_tile)
        if made:
            yield doc_id, known.ids_of[place], max(n for _, _, n in made), sum(n for _, _, n in made), len(words)


def _candidates(doc: np.ndarray, known: _Items, seed: int) -> list[int]:
    h = rolling(doc, seed)
    if not len(h) or not len(known.hashes):
        return []
    free = _free_windows(h, doc == 0, seed)  # a window with a word no item has can't match
    h = np.unique(h[free])
    lo, hi = np.searchsorted(known.hashes, h, "left"), np.searchsorted(known.hashes, h, "right")
    return sorted({int(x) for a, b in zip(lo, hi, strict=True) if b > a for x in known.owners[a:b]})


def leaks(documents: DataFrame, items: DataFrame, seed: int = 12, min_tile: int = 12, min_longest: int = 12, min_coverage: float | None = None, block_seeds: int = BLOCK_SEEDS) -> DataFrame:
    """(doc_id, item_id, longest, covered, item_words, coverage) of every leak.

    A pair is reported where the longest tile has ``min_longest`` words or, if given, tiles cover
    ``min_coverage`` of the item's words.
    """
    docs = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    its = items.where("item_id is not null and text is not null").select("item_id", "text")
    spark = documents.sparkSession

    def scanned(rows: list[tuple[int, str]]) -> DataFrame:
        sent, token = spark.sparkContext.broadcast(rows), uuid.uuid4().hex

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known = _items_of(token, sent.value, seed)
            for batch in batches:
                out = []
                for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                    ids = known.ids(text)
                    out += _tile_rows(doc_id, ids, _candidates(ids, known, seed), known, min_tile)
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "longest", "covered", "item_words"])

        return docs.mapInPandas(scan, _SCHEMA)

    found, staging = None, Staging(spark, "leaks")
    blocks = _item_blocks(its, block_seeds)
    rows = next(blocks, [])
    while rows:
        part, rows = scanned(rows), next(blocks, [])
        if rows or found is not None:  # of several blocks, only one is in the workers' memory at a time
            part = staging.keep(part)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], _SCHEMA)
    enough = F.col("longest") >= min_longest
    coverage = F.col("covered") / F.col("item_words")
    if min_coverage is not None:
        enough = enough | (coverage >= min_coverage)
    # an id listed more than once is reported once, with its best reading
    best = found.where(enough).groupBy("doc_id", "item_id").agg(F.max(F.struct("longest", "covered", "item_words")).alias("m")).select("doc_id", "item_id", "m.*")
    return best.withColumn("coverage", F.round(coverage, 6))
