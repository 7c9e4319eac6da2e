"""Models over feature vectors: nearest-neighbour votes and a linear probe, out of fold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Staging


#: Queries that vote at once.
QUERY_BLOCK = 20_000


def knn_vote(queries: DataFrame, pool: DataFrame, item: str, features: str, label: str, k: int) -> DataFrame:
    """(item, pred): majority label of the k nearest pool vectors by squared distance; ties to the smaller label.

    A stated query set against all rows: queries are broadcast in blocks of QUERY_BLOCK, the pool is scanned in Arrow
    batches, and a task keeps the k best per query over all its rows.
    """
    n_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    out = None
    for b in range(n_blocks):
        rows = queries.where(F.pmod(F.xxhash64(item), F.lit(n_blocks)) == b).select(item, features).orderBy(item).collect()
        part = _nearest_labels(pool, rows, item, features, label, k)
        out = part if out is None else out.unionByName(part)
    top = out.withColumn("r", F.row_number().over(Window.partitionBy(item).orderBy("dist", "other"))).where(F.col("r") <= k)
    votes = top.groupBy(item, "label").agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy(item).agg(F.max(F.struct("n", (-F.col("label")).alias("o"))).alias("b")).select(item, (-F.col("b.o")).cast("int").alias("pred"))


def _nearest_labels(pool: DataFrame, rows: list, item: str, features: str, label: str, k: int) -> DataFrame:
    ids = np.array([r[item] for r in rows], np.int64)
    sent = pool.sparkSession.sparkContext.broadcast((ids, np.array([r[features] for r in rows], np.float64)))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qi, qm = sent.value
        n = len(qi)
        dist, other, kind = np.full((n, k), np.inf), np.full((n, k), np.iinfo(np.int64).max), np.zeros((n, k), np.int64)
        for batch in batches:
            x, bi, bl = np.array(batch[features].tolist(), np.float64), batch[item].to_numpy(), batch[label].to_numpy()
            for at in range(0, n, 512):
                block = qm[at : at + 512]
                d = np.round((block**2).sum(1)[:, None] - 2 * block @ x.T + (x**2).sum(1)[None], 9)
                d[qi[at : at + 512][:, None] == bi[None]] = np.inf
                here = slice(at, at + len(block))
                all_d = np.hstack([dist[here], d])
                all_o = np.hstack([other[here], np.broadcast_to(bi, d.shape)])
                all_k = np.hstack([kind[here], np.broadcast_to(bl, d.shape)])
                best = np.lexsort((all_o, all_d), axis=1)[:, :k]
                dist[here], other[here], kind[here] = (np.take_along_axis(a, best, 1) for a in (all_d, all_o, all_k))
        ok = np.isfinite(dist)
        yield pd.DataFrame({item: np.repeat(qi, k).reshape(n, k)[ok], "other": other[ok], "label": kind[ok].astype(np.int32), "dist": dist[ok]})

    return pool.select(item, features, label).mapInPandas(scan, f"{item} bigint, other bigint, label int, dist double")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, weight): n / (k count), so that classes weigh the same."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy()  # one row per class
    return n.select(label, (F.sum("_n").over(w) / (F.count(F.lit(1)).over(w) * F.col("_n"))).alias("weight"))


def _standardised(train: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Features centred and divided by the population deviation of the training part."""
    from pyspark.ml.feature import ElementwiseProduct, StandardScaler
    from pyspark.ml.linalg import Vectors

    scaler = StandardScaler(inputCol="raw", outputCol="scaled", withMean=True).fit(train)  # sample deviation
    n = train.count()
    unbiased = ElementwiseProduct(inputCol="scaled", outputCol="features", scalingVec=Vectors.dense([(n / max(n - 1, 1)) ** 0.5] * len(scaler.mean)))
    return unbiased.transform(scaler.transform(train)), unbiased.transform(scaler.transform(test))


def out_of_fold(df: DataFrame, features: str, label: str, fold: str, item: str, k: int, fit, balanced: bool = True) -> DataFrame:
    """(item, label, pred): each fold predicted by a model fitted on the others.

    ``fit`` takes the standardised training rows (features, label, weight) and returns something with ``transform``.
    A training part with a single label predicts it. Rows without features or label are left out.
    """
    from pyspark.ml.functions import array_to_vector

    staging = Staging(df.sparkSession, "oof")
    data = df.where(F.col(features).isNotNull() & F.col(label).isNotNull() & F.col(fold).isNotNull())
    data = staging.keep(data.select(item, fold, F.col(label).cast("double").alias("label"), F.col(features).alias("_x"))).withColumn("raw", array_to_vector("_x")).drop("_x")
    out = None
    for f in range(k):
        train, test = data.where(F.col(fold) != f), data.where(F.col(fold) == f)
        kinds = [r[0] for r in train.select("label").distinct().limit(2).collect()]
        if len(kinds) < 2:
            part = test.select(item, "label", F.lit(kinds[0] if kinds else None).cast("double").alias("prediction"))
        else:
            train = train.join(F.broadcast(class_weights(train, "label")), "label") if balanced else train.withColumn("weight", F.lit(1.0))  # one row per class
            train, test = _standardised(train, test)
            part = fit(train).transform(test).select(item, "label", "prediction")
        out = part if out is None else out.unionByName(part)
    return out.select(item, F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("pred"))


def linear_probe(df: DataFrame, features: str, label: str, fold: str, item: str, k: int, c: float = 1.0) -> DataFrame:
    """(item, label, pred): out-of-fold predictions of a class-balanced multinomial logistic regression.

    The penalty is 1 / (C n), fits run until they converge.
    """
    from pyspark.ml.classification import LogisticRegression

    return out_of_fold(df, features, label, fold, item, k, lambda train: LogisticRegression(regParam=1 / (c * train.count()), maxIter=2000, tol=1e-6, weightCol="weight").fit(train))


def model_grid(n_features: int, n_labels: int, seed: int = 42) -> dict[str, list]:
    """Estimators by family, each with its settings to choose from.

    MLlib has no kernel machine: the support vectors are linear, one against the rest.
    """
    from pyspark.ml.classification import LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier

    return {
        "logreg": [LogisticRegression(regParam=r, maxIter=100, weightCol="weight") for r in (0.001, 0.1)],
        "rf": [RandomForestClassifier(numTrees=t, maxDepth=5, seed=seed, weightCol="weight") for t in (10, 20)],
        "svm": [OneVsRest(classifier=LinearSVC(regParam=r, maxIter=20), weightCol="weight") for r in (0.01, 0.1)],
        "mlp": [MultilayerPerceptronClassifier(layers=[n_features, h, n_labels], maxIter=30, seed=seed) for h in (16, 32)],
    }


def balanced_accuracy(predicted: DataFrame) -> float:
    """Mean recall over the labels present."""
    r = predicted.groupBy("label").agg(F.avg((F.col("label") == F.col("pred")).cast("double")).alias("r")).agg(F.avg("r")).first()[0]
    return float(r or 0.0)


def grid_search(df: DataFrame, features: str, label: str, inner: str, item: str, k: int, candidates: list) -> tuple[int, list[float]]:
    """(best, scores): the candidate with the best balanced accuracy over group-disjoint inner folds; ties to the first."""
    scores = [balanced_accuracy(out_of_fold(df, features, label, inner, item, k, est.fit)) for est in candidates]
    return max(range(len(scores)), key=lambda i: (round(scores[i], 12), -i)), scores


def sigmoid_calibration(scored: DataFrame, label: str, score: str, classes: list[int]) -> DataFrame:
    """``scored`` with ``prob``: one logistic curve per class over out-of-fold scores, normalised over classes.

    ``score`` is an array with a decision value per class.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    cols = []
    for i, c in enumerate(classes):
        one = scored.select((F.col(label) == c).cast("double").alias("y"), array_to_vector(F.array(F.get(score, F.lit(i)))).alias("x"))
        m = LogisticRegression(featuresCol="x", labelCol="y", maxIter=200).fit(one)
        cols.append(1 / (1 + F.exp(-(F.get(score, F.lit(i)) * float(m.coefficients[0]) + float(m.intercept)))))
    raw = F.array(*cols)
    total = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x)
    return scored.withColumn("prob", F.transform(raw, lambda x: F.coalesce(F.try_divide(x, total), F.lit(1.0 / len(classes)))))


#: Balanced accuracies above which a source can be told from the features for certain, or probably.
BANDS = ((0.97, "separable"), (0.85, "largely separable"))


def conclusions(per_class: DataFrame) -> DataFrame:
    """(label, recall, finding): what a probe's recall says; below 0.80 a class is flagged."""
    return per_class.withColumn("finding", F.when(F.col("recall") >= BANDS[0][0], BANDS[0][1]).when(F.col("recall") >= BANDS[1][0], BANDS[1][1]).when(F.col("recall") < 0.80, "flag: recall below 0.80").otherwise("partly separable"))


def save_model(model, path: str) -> None:
    """A fitted model as a checkpoint that replaces an older one."""
    model.write().overwrite().save(path)


def load_model(kind: type, path: str):
    """A stored model of the given class."""
    return kind.load(path)
