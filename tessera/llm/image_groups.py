"""Problems 1, 2 and 5: groups, pairs and survivors among image files known by their hashes.

Common rules: a file counts with its current row only (greatest indexed_at); rows without file_id are left
out; hashes are compared as 64-bit numbers whatever their spelling, and one that cannot be read is absent;
extra columns of any name are ignored; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hamming, parse_hash64
from ..functions.missing import usable
from ..operators.skew import HOT_ROWS, pairs_within, spread_join
from ..session import Staging
from .chosen_path import LEAF, MISS, near_pairs
from .components import connected_components, links_to_root, star_links, with_group
from .share_join import LEAF as SHARE_LEAF
from .share_join import close_pairs
from .tables import current_files, hash_cols


def hash_classes(files: DataFrame) -> DataFrame:
    """One row per distinct (p, d): its smallest file and how many files hold it."""
    return files.where("p is not null and d is not null").groupBy("p", "d").agg(F.min("file_id").alias("rep"), F.count(F.lit(1)).alias("n"))


def file_groups(files: DataFrame, dataset: DataFrame, max_bits: int = 2, leaf: int = SHARE_LEAF, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(file_id, group_id): files linked by close hashes or a shared patient, however many steps apart.

    Files that share both hashes hang on the smallest of them, close hash pairs link those smallest files, and
    the files of one patient hang on their smallest; star contraction makes groups of it. Groups of one file
    are left out.
    """
    spark = files.sparkSession
    staging = Staging(spark, "groups")
    cur = staging.keep(current_files(files, staging, p=parse_hash64("phash"), d=parse_hash64("dhash"), path=F.col("path")))
    classes = staging.keep(hash_classes(cur))
    copies = links_to_root(
        cur.where("p is not null and d is not null").select("p", "d", F.col("file_id").alias("a")),
        classes.where("n > 1").select("p", "d", F.col("rep").alias("b"), "n"),
        ["p", "d"],
        hot_rows,
    )
    close = close_pairs(classes, max_bits, staging, leaf).select("a", "b")
    patients = dataset.select("path", usable("patient_id").alias("patient")).where("path is not null and patient is not null").distinct()
    named = staging.keep(patients.join(cur.select("path", "file_id"), "path").select("patient", "file_id"))
    same_patient = star_links(named, ["patient"], "file_id", staging, hot_rows)
    links = copies.unionByName(close).unionByName(same_patient)
    return connected_components(links, staging, hot_rows).select(F.col("node").alias("file_id"), F.col("component").alias("group_id"))


def close_classes(files: DataFrame, max_bits: int = 4, leaf: int = LEAF, hot_rows: int = HOT_ROWS, miss: float = MISS) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Stored (files, classes, members of classes with copies, close class pairs) for problem 2."""
    staging = Staging(files.sparkSession, "pairs")
    cur = staging.keep(current_files(files, staging, **hash_cols()))
    classes = staging.keep(hash_classes(cur))
    shared = classes.where("n > 1")
    members = staging.keep(with_group(cur.where("p is not null and d is not null").select("p", "d", "file_id"), shared.select("p", "d", "rep", F.col("n").alias("size"), "n"), ["p", "d"], hot_rows).select("rep", "file_id", "size"))
    return cur, classes, members, staging.keep(near_pairs(classes, max_bits, staging, leaf, miss))


def class_pairs(files: DataFrame, max_bits: int = 4, leaf: int = LEAF, miss: float = MISS) -> DataFrame:
    """(class_a, class_b, dist_p, dist_d), a < b: close pairs of hash classes, each named by its smallest file.

    With the membership of :func:`class_links` they hold every link by hashes without expanding copies into pairs.
    """
    return close_classes(files, max_bits, leaf, miss=miss)[3].select(F.col("a").alias("class_a"), F.col("b").alias("class_b"), "dist_p", "dist_d")


def close_files(files: DataFrame, max_bits: int = 4, leaf: int = LEAF, hot_rows: int = HOT_ROWS, miss: float = MISS) -> DataFrame:
    """(file_id_a, file_id_b), a < b: sha256 present and equal, or phash and dhash each within ``max_bits``.

    The pairs of classes come from the chosen-path join and are expanded to files; copies of one image are
    pairs too. A pair with equal sha256 is added where the hashes do not already give it. Classes and digests of
    very many files are expanded block by block.
    """
    cur, _, members, pairs = close_classes(files, max_bits, leaf, hot_rows, miss)
    staging = Staging(files.sparkSession, "close_files")
    sizes = staging.keep(members.groupBy("rep").agg(F.first("size").alias("n")))
    of = lambda c, f: members.select(F.col("rep").alias(c), F.col("file_id").alias(f))
    named = lambda c: sizes.select(F.col("rep").alias(c), "n")
    # a class of many copies comes back once per close class: its copies are dealt over tasks
    half = spread_join(of("a", "fa"), pairs.select("a", "b"), ["a"], named("a"), ["fa"], "right", hot_rows).select(F.coalesce("fa", "a").alias("x"), "b")
    between = spread_join(of("b", "fb"), half, ["b"], named("b"), ["fb"], "right", hot_rows).select("x", F.coalesce("fb", "b").alias("y"))
    within = pairs_within(members.select("rep", "file_id", F.col("size").alias("n")), "rep", "file_id").select(F.col("a").alias("x"), F.col("b").alias("y"))
    signed = cur.where("s is not null")
    digests = staging.keep(signed.groupBy("s").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("s", F.col("n").alias("size"), "n"))
    held = staging.keep(with_group(signed, digests, ["s"], hot_rows))
    met = pairs_within(held.select("s", F.struct("file_id", "p", "d").alias("f"), F.col("size").alias("n")), "s", "f").select("a", "b")
    by_hash = (hamming(F.col("a.p"), F.col("b.p")) <= max_bits) & (hamming(F.col("a.d"), F.col("b.d")) <= max_bits)
    same = met.where(~F.coalesce(by_hash, F.lit(False))).select(F.col("a.file_id").alias("x"), F.col("b.file_id").alias("y"))
    ordered = between.unionByName(within).unionByName(same)
    return ordered.select(F.least("x", "y").alias("file_id_a"), F.greatest("x", "y").alias("file_id_b"))


def class_links(files: DataFrame, max_bits: int = 4, leaf: int = LEAF, hot_rows: int = HOT_ROWS, miss: float = MISS) -> DataFrame:
    """(file_id, class_id, class_size, n_close_classes, sha_id, sha_size, n_sha_classes): one row per file instead of all pairs.

    ``class_id`` is the smallest file with both hashes, NULL where one is absent; ``sha_id`` the smallest file with the
    sha256, NULL where it is absent. ``n_sha_classes`` counts the other classes with the same sha256 that the hashes
    do not link; for it a file without both hashes is a class of its own. The pairs counted are those of
    :func:`class_pairs`; files of one ``sha_id`` are all linked with each other.
    """
    cur, classes, _, pairs = close_classes(files, max_bits, leaf, hot_rows, miss)
    staging = Staging(files.sparkSession, "class_links")
    both = pairs.select(F.col("a").alias("rep"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("rep"), F.col("a").alias("other")))
    degree = both.groupBy("rep").agg(F.count(F.lit(1)).alias("deg"))
    sized = classes.join(degree, "rep", "left").select("p", "d", "rep", F.col("n").alias("class_size"), F.coalesce("deg", F.lit(0)).cast("bigint").alias("n_close_classes"))
    hashed = cur.where("p is not null and d is not null").join(sized, ["p", "d"]).select("file_id", "s", "rep", "class_size", "n_close_classes", F.col("rep").alias("unit"))
    loose = cur.where("p is null or d is null").select("file_id", "s", F.lit(None).cast("bigint").alias("rep"), F.lit(None).cast("bigint").alias("class_size"), F.lit(0).cast("bigint").alias("n_close_classes"), F.col("file_id").alias("unit"))
    every = staging.keep(hashed.unionByName(loose))
    units = staging.keep(every.where("s is not null").groupBy("s", "unit").agg(F.min("file_id").alias("first"), F.count(F.lit(1)).alias("n")))
    shas = staging.keep(units.groupBy("s").agg(F.min("first").alias("sha_id"), F.sum("n").alias("n"), F.sum("n").alias("sha_size"), F.count(F.lit(1)).alias("n_units")))
    # only close pairs are looked up in the units, so a sha256 of many units is never squared
    held = units.select("s", "unit")
    near = both.join(held, both["rep"] == held["unit"]).select("unit", "other", "s").join(held.select("s", F.col("unit").alias("other")), ["s", "other"], "left_semi")
    linked = near.groupBy("s", "unit").agg(F.count(F.lit(1)).alias("linked"))
    signed = with_group(every.where("s is not null"), shas, ["s"], hot_rows).join(linked, ["s", "unit"], "left")
    keys = ["file_id", F.col("rep").alias("class_id"), "class_size", "n_close_classes"]
    unsigned = every.where("s is null").select(*keys, F.lit(None).cast("bigint").alias("sha_id"), F.lit(None).cast("bigint").alias("sha_size"), F.lit(0).cast("bigint").alias("n_sha_classes"))
    return signed.select(*keys, "sha_id", "sha_size", (F.col("n_units") - 1 - F.coalesce("linked", F.lit(0))).alias("n_sha_classes")).unionByName(unsigned)


def survivors(files: DataFrame, dataset: DataFrame, trust: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(group_id, survivor_id, patient_id, mask_path): field-by-field survivorship over equal hash pairs.

    One aggregation over (phash, dhash): each field takes the maximum of a composite struct whose leading parts
    rank the file (trust of its source, a usable mask, bytes, indexed_at, smaller file_id) and whose last part
    is the value; a field ignores files that have no usable value for it. An unlisted or missing source ranks
    last, bytes of NULL or below 0 count as 0, a field nobody has is ''. The source table is fixed at a few dozen rows
    by contract and is broadcast only while its count stays under 10,000.
    """
    staging = Staging(files.sparkSession, "survivors")
    cur = staging.keep(
        current_files(files, staging, p=parse_hash64("phash"), d=parse_hash64("dhash"), path=F.col("path"), source=usable("source"), bytes=F.col("bytes"), at=F.col("indexed_at")).where("p is not null and d is not null")
    )
    several = staging.keep(hash_classes(cur).where("n > 1"))
    facts = (
        dataset.select("path", usable("patient_id").alias("patient"), usable("mask_path", lower=False).alias("mask"))
        .where("path is not null and (patient is not null or mask is not null)")
        .groupBy("path")
        .agg(F.min("patient").alias("patient"), F.min("mask").alias("mask"))
    )
    ranks = trust.select(usable("source").alias("source"), "trust_rank").where("source is not null").groupBy("source").agg(F.min("trust_rank").alias("trust_rank"))
    ranks = F.broadcast(ranks) if trust.count() < 10_000 else ranks
    # only files that have a twin take part in the joins with other tables
    in_group = with_group(cur, several, ["p", "d"], hot_rows)
    known = in_group.join(facts, "path", "left").join(ranks, "source", "left")
    rank = [
        (-F.coalesce(F.col("trust_rank"), F.lit(2_000_000_000)).cast("bigint")).alias("r1"),
        F.col("mask").isNotNull().alias("r2"),
        F.greatest(F.coalesce("bytes", F.lit(0)), F.lit(0)).alias("r3"),
        F.col("at").alias("r4"),
        (-F.col("file_id")).alias("r5"),
    ]
    best = known.groupBy("rep").agg(
        F.max(F.struct(*rank)).alias("file"),
        F.max(F.when(F.col("patient").isNotNull(), F.struct(*rank, F.col("patient").alias("v")))).alias("patient"),
        F.max(F.when(F.col("mask").isNotNull(), F.struct(*rank, F.col("mask").alias("v")))).alias("mask"),
    )
    return best.select(
        F.col("rep").alias("group_id"), (-F.col("file.r5")).alias("survivor_id"), F.coalesce("patient.v", F.lit("")).alias("patient_id"), F.coalesce("mask.v", F.lit("")).alias("mask_path")
    )
