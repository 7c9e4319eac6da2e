"""Problem 3: evaluation images that also stand among the training files, exactly or almost.

The two hashes of a file are read as strings of 64 binary characters. A string within edit distance k of an
evaluation string contains at least one of the k + 1 segments the evaluation string is cut into, at a position
shifted by no more than the edits left of it or right of it allow; so the evaluation side contributes its
segments, the training side its substrings at the allowed positions, and equal (segment number, text) of both
hashes make a candidate. Candidates are verified with a banded dynamic program over both strings, and then, as
the contract asks for substitutions only, by counting differing bits.

Defined results: NULL or unreadable hashes take no part in the near match, NULL paths in nothing; equal rows
count once; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import compact_digest, hamming, parse_hash64
from ..operators.skew import HOT_ROWS, spread_join
from ..session import Staging
from .tables import current_files, hash_cols

#: Folder names of evaluation parts, in lower case, and the split each stands for.
EVAL_FOLDERS = {"val": "validation", "valid": "validation", "validation": "validation", "test": "test", "testing": "test"}

BITS = 64


def eval_split(path: Column) -> Column:
    """The split of the first evaluation folder in a path, NULL if it has none; the file name is no folder."""
    parts = F.split(F.lower(path), "/")
    folders = F.filter(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x.isin(*EVAL_FOLDERS))
    return F.create_map(*[F.lit(x) for kv in EVAL_FOLDERS.items() for x in kv])[F.try_element_at(folders, F.lit(1))]


def segments(k: int, bits: int = BITS) -> list[tuple[int, int]]:
    """(start, length) of the k + 1 segments, lengths differing by one at most."""
    cuts = [i * bits // (k + 1) for i in range(k + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def positions(k: int, bits: int = BITS) -> list[tuple[int, int, int]]:
    """(segment, start, length) of every substring of an equally long string that may hold the segment.

    Segment i of k + 1 can be shifted by at most i edits to its left and k - i to its right.
    """
    out = []
    for i, (start, length) in enumerate(segments(k, bits)):
        reach = min(i, k - i)
        out += [(i, s, length) for s in range(max(0, start - reach), min(bits - length, start + reach) + 1)]
    return out


def _cut(col: str, start: int, length: int) -> Column:
    """``length`` binary characters of a hash from ``start``, as a number."""
    return F.shiftrightunsigned(F.col(col), BITS - start - length).bitwiseAND(F.lit((1 << length) - 1).cast("bigint"))


def _keys(rows: DataFrame, places: list[tuple[int, int, int]]) -> DataFrame:
    keys = [F.xxhash64(F.lit(i * 16 + j), _cut("p", s, n), _cut("d", u, m)) for i, s, n in places for j, u, m in places]
    return rows.select(F.explode(F.array_distinct(F.array(*keys))).alias("key"), *rows.columns)


def binary_text(col: Column) -> Column:
    return F.lpad(F.bin(col), BITS, "0")


#: Keys of the evaluation side a task may hold in memory.
HELD_KEYS = 1_000_000


def segment_join(evaluation: DataFrame, training: DataFrame, k: int) -> DataFrame:
    """Distinct (pe, de, pt, dt) of hash pairs within edit distance ``k`` in both hashes.

    Both inputs hold (p, d), distinct and without NULLs; the evaluation side is a stored table. While its keys, which
    are counted, fit the tasks' memory the join holds them there and leaves the training side unsorted.
    """
    ev = _keys(evaluation.select("p", "d"), [(i, s, n) for i, (s, n) in enumerate(segments(k))]).select("key", F.col("p").alias("pe"), F.col("d").alias("de"))
    tr = _keys(training.select("p", "d"), positions(k)).select("key", F.col("p").alias("pt"), F.col("d").alias("dt"))
    within = lambda a, b: F.levenshtein(binary_text(F.col(a)), binary_text(F.col(b)), k) >= 0
    tasks = int(evaluation.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if evaluation.count() * (k + 1) ** 2 <= HELD_KEYS * tasks:
        ev = ev.hint("shuffle_hash")
    return tr.join(ev, "key").select("pe", "de", "pt", "dt").where(within("pe", "pt") & within("de", "dt")).distinct()


def sides(manifest: DataFrame, files: DataFrame, staging: Staging) -> tuple[DataFrame, DataFrame]:
    """Stored (evaluation, training) files with path, p, d, s and their split or source."""
    split = eval_split(F.col("path"))
    ev = manifest.where("path is not null").select("path", split.alias("split"), parse_hash64("phash").alias("p"), parse_hash64("dhash").alias("d"), compact_digest("sha256").alias("s"))
    ev = staging.keep(ev.where("split is not null").distinct())
    in_train = F.lower(F.trim("orig_split")) == "train"
    tr = current_files(files, staging, path=F.col("path"), train=in_train, source=F.lower(F.trim("source")), **hash_cols())
    return ev, staging.keep(tr.where("train and path is not null").drop("train", "file_id"))


def overlaps(manifest: DataFrame, files: DataFrame, max_bits: int = 2, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(eval_path, train_path, split, source, exact): every overlap once; exact where the sha256 are equal.

    Hash pairs are matched once per distinct pair; the files that hold one are added afterwards, those of very common
    pairs or digests dealt over tasks.
    """
    staging = Staging(files.sparkSession, "overlap")
    ev, tr = sides(manifest, files, staging)
    pairs = lambda rows, a, b: rows.where("p is not null and d is not null").groupBy(F.col("p").alias(a), F.col("d").alias(b)).agg(F.count(F.lit(1)).alias("n"))
    ep, tp = staging.keep(pairs(ev, "pe", "de")), staging.keep(pairs(tr, "pt", "dt"))
    near = segment_join(ep.select(F.col("pe").alias("p"), F.col("de").alias("d")), tp.select(F.col("pt").alias("p"), F.col("dt").alias("d")), max_bits)
    near = staging.keep(near.where((hamming(F.col("pe"), F.col("pt")) <= max_bits) & (hamming(F.col("de"), F.col("dt")) <= max_bits)))
    e = ev.select(F.col("path").alias("eval_path"), "split", F.col("p").alias("pe"), F.col("d").alias("de"), F.col("s").alias("se"))
    t = tr.select(F.col("path").alias("train_path"), "source", F.col("p").alias("pt"), F.col("d").alias("dt"), F.col("s").alias("st"))
    of_eval = spread_join(e, near, ["pe", "de"], ep, ["eval_path"], hot_rows=hot_rows)
    by_hash = spread_join(t, of_eval, ["pt", "dt"], tp, ["train_path"], hot_rows=hot_rows)
    signed = t.where("st is not null")
    digests = staging.keep(signed.groupBy("st").agg(F.count(F.lit(1)).alias("n")))
    by_sha = spread_join(signed, e.where("se is not null").withColumn("st", F.col("se")), ["st"], digests, ["train_path"], hot_rows=hot_rows)
    cols = ["eval_path", "train_path", "split", "source", F.coalesce(F.col("se") == F.col("st"), F.lit(False)).alias("exact")]
    found = by_hash.select(*cols).unionByName(by_sha.select(*cols))
    return found.groupBy("eval_path", "train_path").agg(F.max("split").alias("split"), F.max("source").alias("source"), F.bool_or("exact").alias("exact"))


def overlap_counts(manifest: DataFrame, files: DataFrame, max_bits: int = 2) -> DataFrame:
    """(split, source, pairs, eval_files, train_files, exact_pairs) of the overlaps."""
    found = overlaps(manifest, files, max_bits)
    return found.groupBy("split", "source").agg(
        F.count(F.lit(1)).alias("pairs"), F.countDistinct("eval_path").alias("eval_files"), F.countDistinct("train_path").alias("train_files"), F.count_if("exact").alias("exact_pairs")
    )
