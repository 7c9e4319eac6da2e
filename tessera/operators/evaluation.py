"""Classification metrics, calibration and selective prediction over long-form scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Staging


def label_grid(df: DataFrame, labels: Sequence[str], *by: str) -> DataFrame:
    """Counts for every (true, predicted) of the fixed labels, 0 where none; ``by`` adds groups."""
    cells = F.array(*[F.struct(F.lit(a).alias("y_true"), F.lit(b).alias("pred")) for a in labels for b in labels])
    base = (df.select(*by).distinct() if by else df.sparkSession.range(1).select()).select(*by, F.inline(cells))
    n = df.groupBy(*by, "y_true", "pred").agg(F.count(F.lit(1)).alias("n"))
    return base.join(n, [*by, "y_true", "pred"], "left").select(*by, "y_true", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def per_class(df: DataFrame, labels: Sequence[str], *by: str) -> DataFrame:
    """precision, recall, specificity, f1, support of each fixed label; empty denominators give 0."""
    g = label_grid(df, labels, *by)
    cell = F.explode(F.array(*map(F.lit, labels)))
    t = g.select(*by, "y_true", "pred", "n", cell.alias("label"))
    is_t, is_p = F.col("y_true") == F.col("label"), F.col("pred") == F.col("label")
    s = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    c = t.groupBy(*by, "label").agg(s(is_t & is_p).alias("tp"), s(~is_t & is_p).alias("fp"), s(is_t & ~is_p).alias("fn"), s(~is_t & ~is_p).alias("tn"))
    z = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    c = c.select(*by, "label", z(tp, tp + fp).alias("precision"), z(tp, tp + fn).alias("recall"), z(tn, tn + fp).alias("specificity"), z(2 * tp, 2 * tp + fp + fn).alias("f1"), (tp + fn).alias("support"))
    return c.select(*by, "label", *[F.round(x, 6).alias(x) for x in ("precision", "recall", "specificity", "f1")], "support")


def balanced_accuracy(df: DataFrame, labels: Sequence[str] | None = None, *by: str) -> DataFrame:
    """accuracy and mean recall: over the labels present in y_true, or over a fixed list where an absent one has 0."""
    r = df.groupBy(*by, "y_true").agg(F.sum("correct").alias("ok"), F.count(F.lit(1)).alias("n"))
    if labels is None:
        mean = F.avg(F.col("ok") / F.col("n"))
    else:
        mean = F.sum(F.when(F.col("y_true").isin(*labels), F.col("ok") / F.col("n")).otherwise(0.0)) / len(labels)
    return r.groupBy(*by).agg(F.round(F.sum("ok") / F.sum("n"), 6).alias("accuracy"), F.round(mean, 6).alias("balanced_accuracy"))


def brier(scores: DataFrame) -> DataFrame:
    """Multiclass Brier score: mean over items of the squared error summed over labels."""
    e = F.pow(F.col("prob") - F.when(F.col("y_true") == F.col("label"), 1.0).otherwise(0.0), 2)
    return scores.agg(F.round(F.sum(e) / F.count_if(F.col("y_true") == F.col("label")), 6).alias("brier"))


def softmax(logits: Column) -> Column:
    """Probabilities of an array of logits, shifted by the largest so that none overflows."""
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def reliability(df: DataFrame, bins: int = 15, *by: str) -> DataFrame:
    """Table over equal bins (lo, hi]: n, mean confidence, accuracy, gap; a confidence of 0 is in no bin."""
    b = F.ceil(F.round(F.col("conf") * bins, 9)).cast("int")
    g = df.withColumn("bin", b).where("bin >= 1").groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("conf").alias("mean_confidence"), F.avg("correct").alias("accuracy"))
    return g.withColumn("gap", F.abs(F.col("accuracy") - F.col("mean_confidence")))


def calibration(df: DataFrame, bins: int = 15, *by: str) -> DataFrame:
    """ece, mce, mean confidence, accuracy and their difference, from one binned aggregation."""
    r = reliability(df, bins, *by)
    n = F.sum("n")
    return r.groupBy(*by).agg(
        F.round(F.sum(F.col("n") * F.col("gap")) / n, 6).alias("ece"), F.round(F.max("gap"), 6).alias("mce"),
        F.round(F.sum(F.col("n") * F.col("mean_confidence")) / n, 6).alias("mean_confidence"), F.round(F.sum(F.col("n") * F.col("accuracy")) / n, 6).alias("accuracy"),
        F.round((F.sum(F.col("n") * F.col("accuracy")) - F.sum(F.col("n") * F.col("mean_confidence"))) / n, 6).alias("confidence_gap"),
    )


def pooled_units(scores: DataFrame) -> DataFrame:
    """One decision per group: mean score per label, ties to the first label; the group's smallest true label."""
    m = scores.groupBy("grp", "label").agg(F.avg("prob").alias("prob"), F.min("y_true").alias("y_true"), F.count(F.lit(1)).alias("size"))
    g = m.groupBy("grp").agg(F.max(F.struct(F.round("prob", 9).alias("prob"), (-F.ascii("label")).alias("o"))).alias("b"), F.min("y_true").alias("y_true"), F.max("size").alias("size"))
    return g.select("grp", F.char(-F.col("b.o")).alias("pred"), F.col("b.prob").alias("conf"), "y_true", "size").withColumn("correct", (F.col("pred") == F.col("y_true")).cast("int"))


def running(df: DataFrame, order: Sequence[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with ``pos`` (from 1) and running sums in a total order, without one task seeing all rows.

    Rows are range-partitioned by the order and written; totals per partition, one row each, give every partition
    its start, and the rest is a window inside it.
    """
    staging = Staging(df.sparkSession, "running")
    n = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    part = staging.keep(df.repartitionByRange(int(n), *order).withColumn("_part", F.spark_partition_id()))
    cols = {"pos": F.lit(1), **sums}
    totals = part.groupBy("_part").agg(*[F.sum(c).alias(f"_t_{k}") for k, c in cols.items()])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = totals.select("_part", *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_s_{k}") for k in cols])
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = part.join(F.broadcast(starts), "_part")
    return out.select(*df.columns, *[(F.sum(c).over(inside) + F.col(f"_s_{k}")).alias(k) for k, c in cols.items()])


def risk_coverage(df: DataFrame, unit: str) -> DataFrame:
    """(aurc, oracle_aurc, excess_aurc, n_units): area under the error-coverage curve, most confident first.

    The oracle puts all errors last, so its area follows from the counts of units and errors alone.
    """
    spark = df.sparkSession
    df = Staging(spark, "risk").keep(df)
    wrong = 1 - F.col("correct")
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(wrong).alias("e")).first()
    n, e = row["n"], row["e"] or 0
    tail = spark.range(n - e + 1, n + 1).agg(F.sum((F.col("id") - (n - e)) / F.col("id"))).first()[0] or 0.0
    r = running(df, [F.desc("conf"), F.col(unit)], {"errors": wrong}).agg(F.avg(F.col("errors") / F.col("pos")).alias("aurc"), F.count(F.lit(1)).alias("n_units"))
    oracle = F.lit(tail / n if n else None).cast("double")
    return r.select(F.round("aurc", 6).alias("aurc"), F.round(oracle, 6).alias("oracle_aurc"), F.round(F.col("aurc") - oracle, 6).alias("excess_aurc"), "n_units")


def deferral(units: DataFrame, fractions: Sequence[float]) -> DataFrame:
    """Accuracy of what is kept when the least confident share of whole units is withheld."""
    units = Staging(units.sparkSession, "deferral").keep(units)
    pos = running(units, [F.col("conf"), F.col("grp")], {})
    n = units.count()
    cuts = F.array(*[F.struct(F.lit(f).alias("defer_frac"), F.lit(_half_even(f * n)).alias("cut")) for f in fractions])
    kept = pos.select("*", F.inline(cuts)).where(F.col("pos") > F.col("cut"))
    return kept.groupBy("defer_frac").agg(F.count(F.lit(1)).alias("units_kept"), F.sum("size").alias("items_kept"), F.round(F.avg("correct"), 6).alias("unit_accuracy"))


def _half_even(x: float) -> int:
    return round(x)


def auc_ovr(scores: DataFrame) -> DataFrame:
    """One-vs-rest area under the ROC curve per label, from counts per distinct score.

    Scores are first reduced to (label, score) with their positives and negatives, so the running sum is over
    distinct scores, not items.
    """
    s = scores.withColumn("s", F.round("prob", 9)).groupBy("label", "s").agg(F.count_if(F.col("y_true") == F.col("label")).alias("pos"), F.count_if(F.col("y_true") != F.col("label")).alias("neg"))
    w = Window.partitionBy("label").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    c = s.withColumn("below", F.coalesce(F.sum("neg").over(w), F.lit(0)))
    g = c.groupBy("label").agg(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return g.where("p > 0 and n > 0").select("label", F.round(F.col("u") / F.col("p") / F.col("n"), 6).alias("auc"))
