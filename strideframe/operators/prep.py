"""Preparation of feature vectors and feature selection.

Vectors are ``array<double>`` columns. Statistics over rows come from one
``Summarizer`` pass (partial sums on the map side, a vector per group); only
per-feature results reach the driver, never rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideframe.session import settle


def to_vector(df: DataFrame, features: str = "features", name: str = "vector") -> DataFrame:
    return df.withColumn(name, array_to_vector(F.col(features)))


def summarize(df: DataFrame, metrics: Sequence[str], features: str = "features", keys: Sequence[str] = ()) -> DataFrame:
    """Per group: arrays of the wanted statistics of every feature, and the row count."""
    stats = Summarizer.metrics(*metrics).summary(array_to_vector(F.col(features))).alias("s")
    out = df.groupBy(*keys).agg(stats, F.count(F.lit(1)).alias("n"))
    return out.select(*keys, "n", *[vector_to_array(F.col(f"s.{m}")).alias(m) for m in metrics])


def population_moments(df: DataFrame, features: str = "features") -> tuple[np.ndarray, np.ndarray, int]:
    """Mean and population deviation of every feature, and the rows."""
    row = summarize(df, ["mean", "std"], features).first()
    n = row["n"]
    return np.array(row["mean"]), np.array(row["std"]) * np.sqrt((n - 1) / n if n > 1 else 0.0), n


def literal(values: np.ndarray | Sequence[float]) -> Column:
    return F.lit([float(v) for v in values])


def standardise(df: DataFrame, mean: np.ndarray, deviation: np.ndarray, features: str = "features") -> DataFrame:
    """Centre and scale by training moments; a constant column is only centred."""
    scale = np.where(deviation > 0, deviation, 1.0)
    centred = F.zip_with(F.col(features), literal(mean), lambda x, m: x - m)
    return df.withColumn(features, F.zip_with(centred, literal(scale), lambda x, s: x / s))


def fit_standardise(train: DataFrame, *others: DataFrame, features: str = "features") -> tuple[list[DataFrame], int]:
    """Scale all tables by the moments of the first; also the number of constant columns."""
    mean, deviation, _ = population_moments(train, features)
    return [standardise(df, mean, deviation, features) for df in (train, *others)], int((deviation == 0).sum())


def unit_range(train: DataFrame, *others: DataFrame, features: str = "features") -> list[DataFrame]:
    """Scale to [0, 1] by the training extremes; a constant column becomes 0."""
    row = summarize(train, ["min", "max"], features).first()
    low, span = np.array(row["min"]), np.array(row["max"]) - np.array(row["min"])
    scale = np.where(span > 0, span, 1.0)
    shifted = F.zip_with(F.col(features), literal(low), lambda x, m: x - m)
    return [df.withColumn(features, F.zip_with(shifted, literal(scale), lambda x, s: x / s)) for df in (train, *others)]


def row_norm(features: Column) -> Column:
    return F.sqrt(F.aggregate(features, F.lit(0.0), lambda s, x: s + x * x))


def unit_norm(df: DataFrame, features: str = "features") -> DataFrame:
    """Divide every row by its Euclidean norm (rows of zeros stay)."""
    rows = df.withColumn("__n", row_norm(F.col(features)))
    safe = F.when(F.col("__n") > 0, F.col("__n")).otherwise(1.0)
    return rows.withColumn(features, F.transform(F.col(features), lambda x: x / safe)).drop("__n")


def binarise(df: DataFrame, threshold: float = 0.0, features: str = "features") -> DataFrame:
    return df.withColumn(features, F.transform(F.col(features), lambda x: (x > threshold).cast("double")))


def label_codes(df: DataFrame, label: str) -> DataFrame:
    """Codes 0.. of the classes in sorted order."""
    return df.select(label).distinct().withColumn("code", (F.row_number().over(Window.orderBy(label)) - 1).cast("long"))


def preparation_checks(df: DataFrame, features: str = "features") -> DataFrame:
    """Before/after table of scaling, normalisation, binarisation and standardisation."""
    (scaled,) = unit_range(df, features=features)
    (standard,), _ = fit_standardise(df, features=features)
    binary, normed = binarise(df, 0.0, features), unit_norm(df, features)

    def extremes(table: DataFrame, how: str) -> Column:
        inner = F.array_min if how == "min" else F.array_max
        return table.agg(getattr(F, how)(inner(F.col(features))).alias("v")).scalar()

    def norms(table: DataFrame, how: str) -> Column:
        return table.agg(getattr(F, how)(row_norm(F.col(features))).alias("v")).scalar()

    def above(table: DataFrame) -> Column:
        ones = F.aggregate(F.transform(F.col(features), lambda x: (x > 0).cast("double")), F.lit(0.0), lambda s, x: s + x)
        return table.agg((F.sum(ones) / F.sum(F.size(features))).alias("v")).scalar()

    def feature_stat(table: DataFrame, metric: str, pick: str) -> Column:
        stats = summarize(table, [metric], features)
        values = F.col(metric) if metric == "std" else F.transform(metric, F.abs)
        scaled_values = F.transform(values, lambda s: s * F.sqrt((F.col("n") - 1) / F.col("n"))) if metric == "std" else values
        return stats.select((F.array_min if pick == "min" else F.array_max)(scaled_values).alias("v")).scalar()

    checks = [
        ("scaling", "smallest value", extremes(df, "min"), extremes(scaled, "min")),
        ("scaling", "largest value", extremes(df, "max"), extremes(scaled, "max")),
        ("normalization", "smallest norm", norms(df, "min"), norms(normed, "min")),
        ("normalization", "largest norm", norms(df, "max"), norms(normed, "max")),
        ("binarization", "share above threshold", above(df), above(binary)),
        ("standardization", "largest absolute mean", feature_stat(df, "mean", "max"), feature_stat(standard, "mean", "max")),
        ("standardization", "smallest deviation", feature_stat(df, "std", "min"), feature_stat(standard, "std", "min")),
        ("standardization", "largest deviation", feature_stat(df, "std", "max"), feature_stat(standard, "std", "max")),
    ]
    rows = F.array(*[F.struct(F.lit(s).alias("step"), F.lit(c).alias("check"), b.alias("before"), a.alias("after")) for s, c, b, a in checks])
    return df.limit(1).select(F.inline(rows))


# ---- principal components -------------------------------------------------------------------------------

def components(train: DataFrame, k: int, *others: DataFrame, features: str = "features") -> tuple[list[DataFrame], np.ndarray]:
    """Scores on the first k principal components of standardised features, and their variance shares."""
    model = PCA(k=k, inputCol="vector", outputCol="scores").fit(to_vector(train, features))
    out = [model.transform(to_vector(df, features)).withColumn(features, vector_to_array("scores")).drop("vector", "scores") for df in (train, *others)]
    return out, np.array(model.explainedVariance.toArray())


def share_table(df: DataFrame, shares: np.ndarray) -> DataFrame:
    """Component shares with their running sum (one row per component)."""
    rows = df.limit(1).select(F.posexplode(literal(shares)).alias("component", "share"))
    return rows.withColumn("cumulative", F.sum("share").over(Window.orderBy("component")))


# ---- univariate scores -----------------------------------------------------------------------------------

def class_sums(df: DataFrame, label: str, metrics: Sequence[str], features: str = "features") -> DataFrame:
    """(label, n, feature, metrics...) - labels x features rows from one grouped pass."""
    stats = summarize(df, metrics, features, [label])
    return stats.select(label, "n", F.posexplode(F.arrays_zip(*metrics)).alias("feature", "z")).select(
        label, "n", "feature", *[F.col(f"z.{m}").alias(m) for m in metrics]
    )


def chi_squared(df: DataFrame, label: str, features: str = "features") -> DataFrame:
    """Chi-squared of the per-class sums of non-negative features against their expectation."""
    sums = class_sums(df, label, ["sum"], features)
    whole = Window.partitionBy("feature")
    expected = F.sum("sum").over(whole) * F.col("n") / F.sum("n").over(whole)
    cells = sums.withColumn("__e", expected)
    gap = F.col("sum") - F.col("__e")
    return cells.groupBy("feature").agg(F.sum(F.when(F.col("__e") > 0, gap * gap / F.col("__e")).otherwise(0.0)).alias("score"))


def anova_f(df: DataFrame, label: str, features: str = "features") -> DataFrame:
    """F statistic of every feature over the classes."""
    stats = class_sums(df, label, ["mean", "variance"], features)
    whole = Window.partitionBy("feature")
    centre = F.sum(F.col("mean") * F.col("n")).over(whole) / F.sum("n").over(whole)
    cells = stats.withColumn("__g", F.col("n") * F.pow(F.col("mean") - centre, 2))
    between = F.sum("__g") / (F.count(F.lit(1)) - 1)
    within = F.sum(F.col("variance") * (F.col("n") - 1)) / (F.sum("n") - F.count(F.lit(1)))
    return cells.groupBy("feature").agg((between / within).alias("score"))


def best_features(scores: DataFrame, k: int) -> list[int]:
    """Indices of the k best features, lower index first on ties (a table of one row per feature)."""
    rows = scores.orderBy(F.col("score").desc(), "feature").limit(k).select("feature").collect()
    return [int(r[0]) for r in rows]


def pick(df: DataFrame, columns: Sequence[int], features: str = "features") -> DataFrame:
    return df.withColumn(features, F.array(*[F.col(features)[int(c)] for c in columns]))


# ---- wrappers around models ---------------------------------------------------------------------------------

def logistic(rows: int, iterations: int = 2000, cost: float = 1.0, label: str = "label", features: str = "vector") -> LogisticRegression:
    """Multinomial logistic regression with the penalty of a cost C on ``rows`` training rows."""
    return LogisticRegression(
        family="multinomial", regParam=1.0 / (cost * max(rows, 1)), elasticNetParam=0.0, standardization=False, maxIter=iterations, labelCol=label, featuresCol=features
    )


def eliminate(df: DataFrame, label: str, keep: int, share: float = 0.1, iterations: int = 100, features: str = "features") -> DataFrame:
    """Recursive elimination by summed squared logistic weights, a share of all features per step."""
    data = settle(df.select(F.col(label).cast("double").alias("label"), features))
    rows = data.count()
    width = len(data.select(features).first()[0])
    left = list(range(width))
    step = max(1, int(share * width))
    while True:
        weights = logistic(rows, iterations).fit(to_vector(pick(data, left, features), features)).coefficientMatrix.toArray()
        importance = (weights**2).sum(axis=0)
        if len(left) <= keep:
            break
        drop = min(step, len(left) - keep)
        left = sorted(left[i] for i in np.argsort(importance, kind="stable")[drop:])
    order = np.argsort(-importance, kind="stable")
    table = pd.DataFrame({"place": np.arange(1, len(left) + 1), "feature": np.array(left)[order], "score": importance[order]})
    return df.sparkSession.createDataFrame(table, "place int, feature int, score double")


def forest_importances(df: DataFrame, label: str, trees: int = 100, seed: int = 42, features: str = "features", depth: int = 10) -> DataFrame:
    """Features by forest importance, best first, with the running sum."""
    data = to_vector(df.withColumn("label", F.col(label).cast("double")), features)
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featuresCol="vector", labelCol="label").fit(data)
    values = model.featureImportances.toArray()
    order = np.argsort(-values, kind="stable")
    table = pd.DataFrame({"place": np.arange(1, len(order) + 1), "feature": order, "score": values[order], "upto": np.cumsum(values[order])})
    return df.sparkSession.createDataFrame(table, "place int, feature int, score double, upto double")


def smallest_set(ranking: DataFrame, share: float = 0.8) -> DataFrame:
    """Marks the smallest top set of features whose summed importance exceeds a share."""
    return ranking.withColumn("kept", (F.col("upto") - F.col("score")) <= share)


# ---- mutual information ----------------------------------------------------------------------------------------

def discretise(df: DataFrame, features: str = "features", name: str = "codes") -> DataFrame:
    """Levels 0, 1, 2 below, within and above one population deviation around the mean."""
    mean, deviation, _ = population_moments(df, features)
    low, high = literal(mean - deviation), literal(mean + deviation)
    under = F.zip_with(F.col(features), low, lambda x, b: (x < b).cast("int"))
    over = F.zip_with(F.col(features), high, lambda x, b: (x > b).cast("int"))
    return df.withColumn(name, F.zip_with(under, over, lambda u, o: 1 - u + o))


def joint_counts(df: DataFrame, other: Column, width: int, codes: str = "codes") -> DataFrame:
    """(feature, level, other, n): counts are added up inside every task before they are shuffled."""
    rows = df.select(F.col(codes).alias("codes"), other.cast("long").alias("other"))

    def partial(batches):
        for pdf in batches:
            if len(pdf) == 0:
                continue
            matrix = np.array(pdf["codes"].tolist(), dtype=np.int64)
            values, index = np.unique(pdf["other"].to_numpy(), return_inverse=True)
            out = []
            for i, value in enumerate(values):
                mine = matrix[index == i]
                for level in range(3):
                    n = (mine == level).sum(axis=0)
                    at = np.flatnonzero(n)
                    out.append(pd.DataFrame({"feature": at, "level": level, "other": value, "n": n[at]}))
            yield pd.concat(out)

    parts = rows.mapInPandas(partial, "feature int, level int, other long, n long")
    return parts.groupBy("feature", "level", "other").agg(F.sum("n").alias("n"))


def mutual_information(counts: DataFrame) -> DataFrame:
    """Mutual information in nats of every feature with the other variable."""
    per = Window.partitionBy("feature")
    p = F.col("n") / F.sum("n").over(per)
    a = F.sum("n").over(Window.partitionBy("feature", "level")) / F.sum("n").over(per)
    b = F.sum("n").over(Window.partitionBy("feature", "other")) / F.sum("n").over(per)
    cells = counts.select("feature", (p * F.ln(p / (a * b))).alias("i"))
    return cells.groupBy("feature").agg(F.sum("i").alias("information"))


def rank_by_redundancy(df: DataFrame, label: Column, count: int, features: str = "features") -> DataFrame:
    """Greedy minimum redundancy maximum relevance ranking; ties go to the lower feature.

    Each step is one pass that counts every feature against the chosen one; only
    a number per feature comes back.
    """
    table = settle(discretise(df, features).select("codes", label.alias("__y")))
    width = len(table.select("codes").first()[0])

    def shared(other: Column) -> DataFrame:
        return mutual_information(joint_counts(table, other, width)).withColumnRenamed("information", "__i")

    every = df.sparkSession.range(width).select(F.col("id").cast("int").alias("feature"))
    left = every.join(shared(F.col("__y")), "feature", "left").select("feature", F.coalesce("__i", F.lit(0.0)).alias("relevance"), F.lit(0.0).alias("overlap"))
    ranking = []
    while len(ranking) < min(count, width):
        worth = F.col("relevance") - F.col("overlap") / max(1, len(ranking))
        left = settle(left)
        best = left.select("feature", worth.alias("score")).orderBy(F.round("score", 12).desc(), "feature").first()
        ranking.append((len(ranking) + 1, best["feature"], best["score"]))
        with_best = shared(F.col("codes")[best["feature"]])
        left = left.where(F.col("feature") != best["feature"]).join(with_best, "feature", "left")
        left = left.select("feature", "relevance", (F.col("overlap") + F.coalesce("__i", F.lit(0.0))).alias("overlap"))
    return df.sparkSession.createDataFrame(ranking, "place int, feature int, score double")


def principal_axes(df: DataFrame, k: int, features: str = "features") -> np.ndarray:
    """The k first principal axes as columns, the largest entry of each positive.

    The covariance is a distributed correlation. Its decomposition is taken by
    numpy on the driver: the solver of the learners' ``PCA`` need not converge.
    """
    _, deviation, _ = population_moments(df, features)
    correlation = Correlation.corr(df.select(array_to_vector(F.col(features)).alias("v")), "v").head()[0].toArray()
    _, axes = np.linalg.eigh(np.nan_to_num(correlation) * np.outer(deviation, deviation))
    axes = axes[:, ::-1][:, :k]
    return axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])


def joined_blocks(train: DataFrame, test: DataFrame, label: str, k: int, features: str = "features") -> tuple[DataFrame, DataFrame]:
    """Principal components next to the k best features by ANOVA F, in one vector column ``vector``."""
    columns = best_features(anova_f(train, label, features), k)
    axes = principal_axes(train, k, features)

    def score(axis: np.ndarray) -> Column:
        return F.aggregate(F.zip_with(F.col(features), literal(axis), lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x)

    joined = F.array(*[score(axis) for axis in axes.T], *[F.col(features)[c] for c in columns])
    return tuple(df.withColumn("vector", array_to_vector(joined)) for df in (train, test))
