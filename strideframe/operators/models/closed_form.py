"""Classifiers that follow from per-class statistics of one grouped pass."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.operators.prep import literal, population_moments, summarize


def lowest(cells: list[tuple[object, Column]]) -> Column:
    """Label with the lowest value, the earlier (lower) label winning ties."""
    return F.array_min(F.array(*[F.struct(value.alias("v"), F.lit(label).alias("l")) for label, value in cells]))["l"]


def squared_distance(features: Column, point: np.ndarray) -> Column:
    gaps = F.zip_with(features, literal(point), lambda x, m: (x - m) * (x - m))
    return F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x)


def class_statistics(train: DataFrame, label: str, features: str = "features") -> list[dict]:
    """Rows, mean and population variance of every class (labels x features numbers)."""
    rows = summarize(train, ["mean", "variance"], features, [label]).orderBy(label).collect()
    return [
        {"label": r[label], "n": r["n"], "mean": np.array(r["mean"]), "variance": np.array(r["variance"]) * (r["n"] - 1) / r["n"]} for r in rows
    ]


def nearest_centroid(train: DataFrame, test: DataFrame, label: str, features: str = "features") -> DataFrame:
    """Label of the nearest class mean as ``guess``."""
    cells = [(s["label"], squared_distance(F.col(features), s["mean"])) for s in class_statistics(train, label, features)]
    return test.withColumn("guess", lowest(cells))


def naive_bayes(train: DataFrame, test: DataFrame, label: str, features: str = "features", smoothing: float = 1e-9) -> DataFrame:
    """One diagonal Gaussian per class with the class shares as priors."""
    stats = class_statistics(train, label, features)
    _, deviation, rows = population_moments(train, features)
    extra = smoothing * float((deviation**2).max())
    cells = []
    for s in stats:
        variance = s["variance"] + extra
        gaps = F.zip_with(F.col(features), literal(s["mean"]), lambda x, m: (x - m) * (x - m))
        scaled = F.zip_with(gaps, literal(variance), lambda g, v: g / v)
        constant = float(np.log(2 * np.pi * variance).sum()) - 2 * float(np.log(s["n"] / rows))
        cells.append((s["label"], F.aggregate(scaled, F.lit(0.0), lambda a, x: a + x) + constant))
    return test.withColumn("guess", lowest(cells))


def linear_discriminant(train: DataFrame, test: DataFrame, label: str, features: str = "features") -> DataFrame:
    """Discriminant with one covariance shared by all classes.

    The pooled covariance is a distributed correlation of rows centred by their
    class mean; a features x features solve remains for the driver.
    """
    stats = class_statistics(train, label, features)
    rows = sum(s["n"] for s in stats)
    centre = F.lit(None).cast("array<double>")
    for s in stats:
        centre = F.when(F.col(label) == s["label"], literal(s["mean"])).otherwise(centre)
    centred = train.select(F.zip_with(F.col(features), centre, lambda x, m: x - m).alias("c"))
    _, deviation, _ = population_moments(centred, "c")
    correlation = Correlation.corr(centred.select(array_to_vector("c").alias("v")), "v").head()[0].toArray()
    covariance = np.nan_to_num(correlation) * np.outer(deviation, deviation)
    inverse = np.linalg.pinv(covariance, hermitian=True)
    cells = []
    for s in stats:
        weights = inverse @ s["mean"]
        offset = -0.5 * float(s["mean"] @ weights) + float(np.log(s["n"] / rows))
        products = F.zip_with(F.col(features), literal(weights), lambda x, w: x * w)
        cells.append((s["label"], -(F.aggregate(products, F.lit(0.0), lambda a, x: a + x) + offset)))
    return test.withColumn("guess", lowest(cells))
