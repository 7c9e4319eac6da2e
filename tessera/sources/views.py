"""Cleaned views of the project's tables, the starting point of most queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import norm_digest, parse_hash64
from ..functions.missing import usable
from .current import latest_rows
from .tables import table


def files(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    """The current row of each file with uniform spelling: file_id and of path, source, class, split, width, height,
    mode, bytes, sha, p, d those named (all by default), so that scan and shuffle hold nothing else."""
    known = {
        "path": F.col("path"), "source": F.lower(F.trim("source")), "class": F.col("class"), "split": F.lower(F.trim("orig_split")), "width": F.col("width"), "height": F.col("height"), "mode": F.col("mode"),
        "bytes": F.greatest(F.coalesce("bytes", F.lit(0)), F.lit(0)), "sha": norm_digest("sha256"), "p": parse_hash64("phash"), "d": parse_hash64("dhash"),
    }
    return latest_rows(table(spark, sf, "files_index"), "file_id", ("indexed_at", "loaded_at"), {c: known[c] for c in cols or known})


def external(spark: SparkSession, sf: str) -> DataFrame:
    """path, p, d of the external release's files that have both hashes; of differing rows of a path the smallest."""
    m = table(spark, sf, "bdneuro_v7_manifest").where("path is not null").select("path", parse_hash64("phash").alias("p"), parse_hash64("dhash").alias("d"))
    return m.where("p is not null and d is not null").groupBy("path").agg(F.min("p").alias("p"), F.min("d").alias("d"))


def curated(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct curated rows: path, source, label, width, height, bytes, p, d, patient, mask, dup_cluster, is_rep, grp."""
    return (
        table(spark, sf, "dataset")
        .select("path", F.lower(F.trim("source")).alias("source"), "label", "width", "height", "bytes", parse_hash64("phash").alias("p"), parse_hash64("dhash").alias("d"), usable("patient_id").alias("patient"), usable("mask_path", lower=False).alias("mask"), "dup_cluster", F.col("is_representative").alias("is_rep"), F.lower(F.trim("group_id")).alias("grp"))
        .withColumn("grp", F.when(F.col("grp") != "", F.col("grp")))
        .distinct()
    )


def folds(spark: SparkSession, sf: str) -> DataFrame:
    """path, fold of every split file; of several folds the smallest counts."""
    return table(spark, sf, "splits_outer").where("outer_fold is not null").groupBy("path").agg(F.min("outer_fold").alias("fold"))


def labelled_folds(spark: SparkSession, sf: str) -> DataFrame:
    """path, label, unit, fold: split files with the group of the curated table, or their path where it has none.

    Both sides have a row per file, whatever the written size of their tables, so they ask for a merge join: a
    broadcast of either goes through the driver, several at once where a query reads this view in several branches.
    """
    cur = curated(spark, sf).groupBy("path").agg(F.min("label").alias("label"), F.min("grp").alias("grp"), F.min("patient").alias("patient"), F.min("source").alias("source"))
    return folds(spark, sf).hint("merge").join(cur, "path").withColumn("unit", F.coalesce("grp", F.concat(F.lit("f:"), "path")))


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """The latest export of each run."""
    m = table(spark, sf, "metrics")
    row = F.struct("written_at", "loaded_at", "metrics_id")
    last = m.where("run_id is not null").groupBy("run_id").agg(F.max(row).alias("r")).select(F.col("r.metrics_id").alias("metrics_id"))
    return m.join(last, "metrics_id", "left_semi")


def _weights(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").where("l_returnflag is not null")
    named = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item"), F.col("l_orderkey").alias("grp"), F.col("l_returnflag").alias("y_true"), F.col("l_quantity").cast("bigint").alias("A"), (1 + F.round(F.col("l_discount") * 100).cast("bigint")).alias("N"), (1 + F.round(F.col("l_tax") * 100).cast("bigint")).alias("R"))
    return named.withColumn("total", F.col("A") + F.col("N") + F.col("R"))


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """item, grp, y_true, label, prob: three-class scores made of integer weights of lineitem, in long form."""
    cells = F.array(*[F.struct(F.lit(k).alias("label"), (F.col(k) / F.col("total")).alias("prob")) for k in ("A", "N", "R")])
    return _weights(spark, sf).select("item", "grp", "y_true", F.inline(cells))


def logits(spark: SparkSession, sf: str) -> DataFrame:
    """item, total, A, N, R: the weights of each row, a tenth of which serve as logits of a second model."""
    return _weights(spark, sf).select("item", "total", "A", "N", "R")


def wide_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """item, y_true, prob_A, prob_N, prob_R: the scores as columns."""
    return _weights(spark, sf).select("item", "y_true", *[(F.col(k) / F.col("total")).alias(f"prob_{k}") for k in ("A", "N", "R")])


def decisions(spark: SparkSession, sf: str) -> DataFrame:
    """item, grp, y_true, pred, conf, sq, correct of the same scores, one row per item; ties go to the first label.

    ``sq`` is the squared error summed over labels.
    """
    a, n, r = F.col("A"), F.col("N"), F.col("R")
    pred = F.when((a >= n) & (a >= r), "A").when(n >= r, "N").otherwise("R")
    sq = sum(F.pow(F.col(k) / F.col("total") - (F.col("y_true") == k).cast("double"), 2) for k in ("A", "N", "R"))
    w = _weights(spark, sf).select("item", "grp", "y_true", pred.alias("pred"), (F.greatest(a, n, r) / F.col("total")).alias("conf"), sq.alias("sq"))
    return w.withColumn("correct", (F.col("pred") == F.col("y_true")).cast("int"))
