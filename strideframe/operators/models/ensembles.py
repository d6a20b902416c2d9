"""Trees, forests, stump boosting, kernel features and votes on MLlib learners.

Tables carry ``vector`` (features) and ``label`` (0.. as double). Every fit and
every prediction is a Spark job; the driver keeps models and scores.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import (
    DecisionTreeClassifier, LinearSVC, OneVsRest, RandomForestClassifier,
)
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.operators.models.closed_form import lowest
from strideframe.operators.prep import logistic, to_vector


#: The deepest trees that the learners grow; trees that end sooner are not affected.
DEEPEST = 30


# ---- learners ---------------------------------------------------------------------------------------

def random_forest(trees: int = 100, seed: int = 42, depth: int = DEEPEST) -> RandomForestClassifier:
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featuresCol="vector", labelCol="label")


def bagged_trees(trees: int = 100, seed: int = 42, depth: int = DEEPEST) -> RandomForestClassifier:
    """Bagging: bootstrap samples, every feature open to every split."""
    return random_forest(trees, seed, depth).setFeatureSubsetStrategy("all")


def decision_tree(seed: int = 42, depth: int = DEEPEST) -> DecisionTreeClassifier:
    return DecisionTreeClassifier(maxDepth=depth, seed=seed, featuresCol="vector", labelCol="label")


def linear_regression() -> LinearRegression:
    return LinearRegression(solver="normal", featuresCol="vector", labelCol="label")


def forest_regression(trees: int = 100, seed: int = 42, depth: int = DEEPEST) -> RandomForestRegressor:
    return RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=seed, featuresCol="vector", labelCol="label")


def guesses(model, df: DataFrame) -> DataFrame:
    """Predictions as ``guess``; helper columns of the learner are dropped."""
    out = model.transform(df).withColumn("guess", F.col("prediction"))
    return out.drop(*[c for c in ("prediction", "rawPrediction", "probability") if c not in df.columns])


# ---- radial kernel by random features ------------------------------------------------------------------

def fourier_features(df: DataFrame, gamma: float, count: int = 256, seed: int = 42, features: str = "features", width: int | None = None) -> DataFrame:
    """Random cosines whose products approximate exp(-gamma * squared distance); fixed by the seed."""
    width = width or len(df.select(features).first()[0])
    draw = np.random.default_rng(seed)
    weights = draw.normal(scale=np.sqrt(2 * gamma), size=(width, count))
    shifts = draw.uniform(0, 2 * np.pi, size=count)

    @F.pandas_udf("array<double>")
    def cosines(values: pd.Series) -> pd.Series:
        rows = np.array(values.tolist(), dtype=np.float64)
        return pd.Series(list(np.sqrt(2 / count) * np.cos(rows @ weights + shifts)))

    return to_vector(df.withColumn("__z", cosines(F.col(features))), "__z").drop("__z")


def kernel_machine(cost: float = 1.0, rows: int = 1, iterations: int = 50) -> OneVsRest:
    """Linear machine on random kernel features, one class against the rest."""
    svc = LinearSVC(regParam=1.0 / (cost * max(rows, 1)), maxIter=iterations, featuresCol="vector")
    return OneVsRest(classifier=svc, featuresCol="vector", labelCol="label")


# ---- stump boosting (SAMME) ---------------------------------------------------------------------------------

def fit_stumps(df: DataFrame, classes: int, rounds: int = 50, seed: int = 42, checkpoint_every: int = 10) -> list[tuple[float, object]]:
    """Weighted depth-one trees with their votes.

    The weight of a row after a round is a product of factors of the stumps so
    far; it is kept as a column and the plan is cut every few rounds.
    """
    from strideframe.session import settle

    rows = settle(df.select("vector", "label"))
    n = rows.count()
    current = rows.withColumn("w", F.lit(1.0 / n))
    stumps: list[tuple[float, object]] = []
    for i in range(rounds):
        tree = DecisionTreeClassifier(maxDepth=1, seed=seed, featuresCol="vector", labelCol="label", weightCol="w").fit(current)
        seen = tree.transform(current)
        wrong = F.col("prediction") != F.col("label")
        total, missed = seen.agg(F.sum("w"), F.sum(F.when(wrong, F.col("w")).otherwise(0.0))).first()
        error = missed / total
        if error <= 0:
            stumps.append((1.0, tree))
            break
        if error >= 1 - 1 / classes - 1e-12:
            # No better than chance: of a whole ensemble of such, the first stump alone answers.
            stumps = stumps or [(1.0, tree)]
            break
        alpha = float(np.log((1 - error) / error) + np.log(classes - 1))
        stumps.append((alpha, tree))
        scale = total + missed * (np.exp(alpha) - 1)
        current = seen.select("vector", "label", (F.col("w") * F.when(wrong, F.lit(float(np.exp(alpha)))).otherwise(1.0) / F.lit(float(scale))).alias("w"))
        if (i + 1) % checkpoint_every == 0:
            current = settle(current)
    return stumps


def stump_votes(stumps: Sequence[tuple[float, object]], df: DataFrame, classes: int) -> DataFrame:
    """Label with the largest sum of votes. A stump is one comparison, so all of them fit in column expressions."""
    sums = [F.lit(0.0)] * classes
    values = vector_to_array(F.col("vector"))
    for alpha, tree in stumps:
        guess = stump_expression(tree, values)
        sums = [s + F.when(guess == float(c), alpha).otherwise(0.0) for c, s in enumerate(sums)]
    return df.withColumn("guess", lowest([(float(c), -s) for c, s in enumerate(sums)]))


def stump_expression(tree, values: Column) -> Column:
    root = tree._call_java("rootNode")
    if tree.numNodes == 1:
        return F.lit(float(root.prediction()))
    split = root.split()
    inside = values[int(split.featureIndex())] <= float(split.threshold())
    return F.when(inside, float(root.leftChild().prediction())).otherwise(float(root.rightChild().prediction()))


# ---- tree prefixes, votes --------------------------------------------------------------------------------------

def tune_trees(model, df: DataFrame, counts: Sequence[int], classes: int) -> DataFrame:
    """Accuracy of growing prefixes of one forest; ``best`` marks the first best count."""
    rows = df
    for i, tree in enumerate(model.trees[: max(counts)]):
        rows = tree.setPredictionCol(f"__p{i}").setProbabilityCol(f"__q{i}").setRawPredictionCol(f"__r{i}").transform(rows).drop(f"__p{i}", f"__r{i}")
    parts = []
    for count in counts:
        sums = [sum((vector_to_array(F.col(f"__q{i}"))[c] for i in range(1, count)), vector_to_array(F.col("__q0"))[c]) for c in range(classes)]
        right = (lowest([(float(c), -s) for c, s in enumerate(sums)]) == F.col("label")).cast("double")
        parts.append(F.struct(F.lit(count).alias("trees"), F.avg(right).alias("accuracy")))
    table = rows.agg(F.array(*parts).alias("t")).select(F.inline("t"))
    from pyspark.sql import Window

    top = F.max(F.struct("accuracy", -F.col("trees"))).over(Window.partitionBy())
    return table.withColumn("best", F.struct("accuracy", -F.col("trees")) == top)


def hard_vote(models: Sequence, df: DataFrame) -> DataFrame:
    """Most frequent prediction of several models, the lowest label winning ties."""
    rows = df
    for i, model in enumerate(models):
        rows = guesses(model, rows).withColumnRenamed("guess", f"__g{i}")
    names = [f"__g{i}" for i in range(len(models))]
    votes = F.array(*names)
    ranked = F.transform(F.array_distinct(votes), lambda v: F.struct((-F.size(F.filter(votes, lambda g: g == v))).alias("n"), v.alias("v")))
    return rows.withColumn("guess", F.array_min(ranked)["v"]).drop(*names)


# ---- clusters --------------------------------------------------------------------------------------------------

def best_kmeans(df: DataFrame, k: int, starts: int = 10, seed: int = 42):
    """k-means with the lowest cost over several starts."""
    fits = [KMeans(k=k, seed=seed + i, featuresCol="vector").fit(df) for i in range(starts)]
    return min(fits, key=lambda m: m.summary.trainingCost)


def hierarchical(df: DataFrame, k: int, seed: int = 42):
    """Top-down hierarchy of clusters."""
    return BisectingKMeans(k=k, seed=seed, featuresCol="vector").fit(df)


def assign_clusters(counts: np.ndarray) -> list[int]:
    """Column of every row with the largest total (a small clusters x labels table)."""
    rows, columns = counts.shape
    size = max(rows, columns)
    cost = np.zeros((size, size))
    cost[:rows, :columns] = counts.max() - counts
    u, v = np.zeros(size + 1), np.zeros(size + 1)
    match = np.zeros(size + 1, dtype=int)
    for i in range(1, size + 1):
        match[0], j = i, 0
        reach, way, done = np.full(size + 1, np.inf), np.zeros(size + 1, dtype=int), np.zeros(size + 1, dtype=bool)
        while match[j] != 0:
            done[j] = True
            row = match[j]
            free = np.flatnonzero(~done[1:]) + 1
            slack = cost[row - 1, free - 1] - u[row] - v[free]
            better = slack < reach[free]
            reach[free[better]], way[free[better]] = slack[better], j
            nxt = free[np.argmin(reach[free])]
            delta = reach[nxt]
            u[match[done]] += delta
            v[done] -= delta
            reach[~done] -= delta
            j = nxt
        while j:
            match[j] = match[way[j]]
            j = way[j]
    out = [-1] * rows
    for j in range(1, size + 1):
        if match[j] <= rows:
            out[match[j] - 1] = j - 1 if j <= columns else -1
    return out


def match_clusters(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """(cluster, label) pairs with the largest total count: only the contingency table is collected."""
    spark = df.sparkSession
    cells = df.groupBy(cluster, label).agg(F.count(F.lit(1)).alias("n")).collect()
    clusters = sorted({r[cluster] for r in cells})
    labels = sorted({r[label] for r in cells})
    counts = np.zeros((len(clusters), len(labels)))
    for r in cells:
        counts[clusters.index(r[cluster]), labels.index(r[label])] = r["n"]
    chosen = assign_clusters(counts)
    kinds = dict(df.dtypes)
    rows = [(clusters[i], labels[j]) for i, j in enumerate(chosen) if j >= 0]
    return spark.createDataFrame(rows, f"{cluster} {kinds[cluster]}, {label} {kinds[label]}")


# ---- scores ------------------------------------------------------------------------------------------------------

def fit_and_score(estimator, train: DataFrame, test: DataFrame) -> tuple[object, float, float]:
    """Fitted model with its accuracy and macro F1 on the test table."""
    model = estimator.fit(train)
    return (model, *score(guesses(model, test)))


def score(rows: DataFrame, truth: str = "label", guess: str = "guess") -> tuple[float, float]:
    """Accuracy and macro F1 over the labels seen on either side, from one table of pair counts."""
    cells = rows.groupBy(F.col(truth).alias("t"), F.col(guess).alias("g")).agg(F.count(F.lit(1)).alias("n")).collect()
    labels = {c["t"] for c in cells} | {c["g"] for c in cells}
    total = sum(c["n"] for c in cells)
    hits = {v: sum(c["n"] for c in cells if c["t"] == v and c["g"] == v) for v in labels}
    sizes = {v: sum(c["n"] * ((c["t"] == v) + (c["g"] == v)) for c in cells) for v in labels}
    f1 = [2 * hits[v] / sizes[v] if sizes[v] else 0.0 for v in labels]
    return sum(hits.values()) / total, sum(f1) / len(f1)


def voting_models(train: DataFrame, rows: int, iterations: int = 100) -> list:
    """Logistic regression, a decision tree and a linear machine for the hard vote."""
    return [logistic(rows, iterations).fit(train), decision_tree().fit(train), kernel_machine(1.0, rows).fit(train)]


