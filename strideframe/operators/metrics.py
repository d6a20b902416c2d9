"""Quality measures from true and predicted labels, per group of keys.

Everything starts from one ``groupBy(keys, truth, guess).count()``: the rows are
reduced on the map side to at most labels x labels counts per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.functions.scalars import safe_divide
from strideframe.operators.ordered import add_chunk, sweep


def pair_counts(df: DataFrame, keys: Sequence[str] = (), truth: str = "truth", guess: str = "guess") -> DataFrame:
    return df.groupBy(*keys, F.col(truth).alias("truth"), F.col(guess).alias("guess")).agg(F.count(F.lit(1)).alias("n"))


def pool(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Add up pair counts over everything but the keys."""
    return counts.groupBy(*keys, "truth", "guess").agg(F.sum("n").alias("n"))


def confusion_long(counts: DataFrame, labels: Sequence, keys: Sequence[str] = ()) -> DataFrame:
    """Every pair of the fixed labels in every group, zero where it does not occur.

    A group holds at most labels x labels counts, so they are packed into one map
    per group and read out in order; ``counts`` is evaluated once.
    """
    pair = F.struct("truth", "guess")
    packed = counts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(pair.alias("k"), F.col("n").alias("v")))).alias("m"))
    cells = [
        F.struct(F.lit(t).alias("truth"), F.lit(g).alias("guess"), F.coalesce(F.try_element_at("m", F.struct(F.lit(t).alias("truth"), F.lit(g).alias("guess"))), F.lit(0)).alias("n"))
        for t in labels
        for g in labels
    ]
    return packed.select(*keys, F.inline(F.array(*cells)))


def confusion_wide(counts: DataFrame, labels: Sequence, keys: Sequence[str] = ()) -> DataFrame:
    long = confusion_long(counts, labels, keys)
    return long.groupBy(*keys, "truth").agg(
        *[F.sum(F.when(F.col("guess") == v, F.col("n")).otherwise(0)).alias(f"as_{v}") for v in labels]
    )


def row_percentages(counts: DataFrame, labels: Sequence, keys: Sequence[str] = ()) -> DataFrame:
    """Confusion in percent of the true class, two decimals, half to even."""
    long = confusion_long(counts, labels, keys)
    sums = long.groupBy(*keys, "truth").agg(F.sum("n").alias("__t"))
    share = safe_divide(100.0 * F.col("n"), F.col("__t"), F.lit(0.0))
    return long.join(sums, [*keys, "truth"]).select(*keys, "truth", "guess", F.bround(share, 2).alias("percent"))


def class_counts(counts: DataFrame, labels: Sequence, keys: Sequence[str] = ()) -> DataFrame:
    """Per label: hits, predicted, actual and the rows of the group."""
    sides = counts.select(
        *keys,
        "n",
        F.explode(
            F.array(
                F.struct(F.col("truth").alias("label"), F.lit(1).alias("t"), (F.col("truth") == F.col("guess")).cast("int").alias("h")),
                F.struct(F.col("guess").alias("label"), F.lit(0).alias("t"), F.lit(0).alias("h")),
            )
        ).alias("s"),
    )
    sums = sides.groupBy(*keys, F.col("s.label").alias("label")).agg(
        F.sum(F.col("n") * F.col("s.h")).alias("hits"),
        F.sum(F.col("n") * (1 - F.col("s.t"))).alias("predicted"),
        F.sum(F.col("n") * F.col("s.t")).alias("actual"),
    )
    known = F.col("label").isin(*labels)
    packed = sums.filter(F.col("label").isNotNull()).groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("label", F.struct("hits", "predicted", "actual").alias("v")))).alias("m"),
        F.sum(F.when(known, F.col("actual"))).alias("rows"),
    )
    cells = []
    for label in labels:
        found = F.try_element_at("m", F.lit(label))
        cells.append(F.struct(F.lit(label).alias("label"), *[F.coalesce(found[c], F.lit(0)).alias(c) for c in ("hits", "predicted", "actual")]))
    return packed.select(*keys, F.inline(F.array(*cells)), "rows").select(*keys, "label", "hits", "predicted", "actual", "rows")


def class_scores(counts: DataFrame, labels: Sequence, keys: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, specificity, F1 and support per label; undefined ones are 0."""
    zero = F.lit(0.0)
    hits, predicted, actual, rows = (F.col(c) for c in ("hits", "predicted", "actual", "rows"))
    base = class_counts(counts, labels, keys).select(
        *keys,
        "label",
        safe_divide(hits, predicted, zero).alias("precision"),
        safe_divide(hits, actual, zero).alias("recall"),
        safe_divide(rows - actual - predicted + hits, rows - actual, zero).alias("specificity"),
        actual.alias("support"),
        "hits",
    )
    p, r = F.col("precision"), F.col("recall")
    return base.withColumn("f1", safe_divide(2 * p * r, p + r, zero))


def score_fold(counts: DataFrame, labels: Sequence, keys: Sequence[str] = (), beta: float = 1.0) -> DataFrame:
    """Accuracy, macro precision, recall, specificity, F1, and F from the averaged precision and recall."""
    table = class_scores(counts, labels, keys)
    out = table.groupBy(*keys).agg(
        (F.sum("hits") / F.sum("support")).alias("accuracy"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("specificity").alias("macro_specificity"),
        F.avg("f1").alias("macro_f1"),
    )
    return out.withColumn("f_of_means", f_of_means(F.col("macro_precision"), F.col("macro_recall"), beta))


def f_of_means(precision: Column, recall: Column, beta: float = 1.0) -> Column:
    b = beta * beta
    return F.when(precision + recall > 0, (1 + b) * precision * recall / (b * precision + recall)).otherwise(0.0)


def score_frames(counts: DataFrame, labels: Sequence, null_label, keys: Sequence[str] = ()) -> DataFrame:
    """Precision and recall averaged over all or gesture classes.

    A class never predicted counts 0 in ``precision_*`` and is left out in
    ``precision_*_defined``; a class absent from the truth is left out of recall.
    """
    table = class_counts(counts, labels, keys)
    precision = safe_divide(F.col("hits"), F.col("predicted"))
    recall = safe_divide(F.col("hits"), F.col("actual"))
    gesture = F.col("label") != F.lit(null_label)
    return table.groupBy(*keys).agg(
        F.avg(F.coalesce(precision, F.lit(0.0))).alias("precision_all"),
        F.avg(recall).alias("recall_all"),
        F.avg(F.when(gesture, F.coalesce(precision, F.lit(0.0)))).alias("precision_non_null"),
        F.avg(F.when(gesture, recall)).alias("recall_non_null"),
        F.avg(precision).alias("precision_all_defined"),
        F.avg(F.when(gesture, precision)).alias("precision_non_null_defined"),
        F.count_if(F.col("predicted") == 0).alias("never_predicted"),
        F.count_if(F.col("actual") == 0).alias("absent"),
    )


def class_report(counts: DataFrame, labels: Sequence) -> DataFrame:
    """Per-class rows followed by the macro and the support-weighted averages."""
    table = class_scores(counts, labels)
    names = ["precision", "recall", "f1", "specificity"]
    rows = table.select(F.col("label").cast("string").alias("label"), *names, "support")
    macro = table.agg(*[F.avg(n).alias(n) for n in names], F.sum("support").alias("support"))
    weighted = table.agg(*[(F.sum(F.col(n) * F.col("support")) / F.sum("support")).alias(n) for n in names], F.sum("support").alias("support"))
    return rows.unionByName(macro.withColumn("label", F.lit("macro average"))).unionByName(weighted.withColumn("label", F.lit("weighted average")))


def null_loss(counts: DataFrame, labels: Sequence, null_label, keys: Sequence[str] = ()) -> DataFrame:
    """Per gesture class: recall, share predicted null, share of misses that went to null."""
    to_null = F.sum(F.when(F.col("guess") == F.lit(null_label), F.col("n")).otherwise(0))
    hits = F.sum(F.when(F.col("guess") == F.col("truth"), F.col("n")).otherwise(0))
    long = confusion_long(counts, labels, keys).filter(F.col("truth") != F.lit(null_label))
    table = long.groupBy(*keys, "truth").agg(F.sum("n").alias("frames"), hits.alias("hits"), to_null.alias("lost"))
    frames, lost = F.col("frames"), F.col("lost")
    return table.select(
        *keys,
        "truth",
        "frames",
        safe_divide(F.col("hits"), frames).alias("recall"),
        safe_divide(lost, frames).alias("share_lost_to_null"),
        safe_divide(lost, frames - F.col("hits"), F.lit(0.0)).alias("share_of_misses_to_null"),
    )


def auc_one_vs_rest(scores: DataFrame, keys: Sequence[str] = (), label: str = "label", truth: str = "truth", score: str = "score") -> DataFrame:
    """Area under the ROC curve of every label, from rank sums with average ranks.

    ``scores`` is long: one row per (sample, label). Equal scores are counted
    first; the running count of negatives is chunked over the score range.
    """
    by = [*keys, label]
    hit = (F.col(truth) == F.col(label)).cast("long")
    counted = scores.groupBy(*by, F.col(score).cast("double").alias("__v")).agg(F.sum(hit).alias("__p"), F.sum(1 - hit).alias("__q"))
    ranked = sweep(
        add_chunk(counted, by, "__v", "__chunk"),
        by,
        ["__v"],
        chunk="__chunk",
        sums={"__upto": F.col("__q")},
    )
    wins = F.sum(F.col("__p") * (F.col("__upto") - F.col("__q") / 2))
    return ranked.groupBy(*by).agg(safe_divide(wins, F.sum("__p") * F.sum("__q").cast("double")).alias("auc"))


def log_loss(df: DataFrame, probability: Column, keys: Sequence[str] = (), floor: float = 2.220446049250313e-16) -> DataFrame:
    """Mean of -ln of the probability given to the true label, clipped away from 0 and 1."""
    clipped = F.greatest(F.lit(floor), F.least(probability, F.lit(1 - floor)))
    return df.groupBy(*keys).agg(F.avg(-F.ln(clipped)).alias("log_loss"))


def adjusted_rand(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Adjusted Rand index of two labelings from their pair counts."""

    def pairs(c: Column) -> Column:
        return (c * (c - 1) / 2).cast("double")

    def side(name: str) -> DataFrame:
        sums = counts.groupBy(*keys, name).agg(F.sum("n").alias("s"))
        return sums.groupBy(*keys).agg(F.sum(pairs(F.col("s"))).alias(f"__{name}"))

    both = counts.groupBy(*keys).agg(F.sum(pairs(F.col("n"))).alias("__b"), F.sum("n").alias("__n"))
    if keys:
        joined = both.join(side("truth"), list(keys)).join(side("guess"), list(keys))
    else:
        joined = both.withColumn("__truth", side("truth").scalar()).withColumn("__guess", side("guess").scalar())
    expected = F.col("__truth") * F.col("__guess") / pairs(F.col("__n"))
    top = F.col("__b") - expected
    bottom = (F.col("__truth") + F.col("__guess")) / 2 - expected
    return joined.select(*keys, F.when(bottom == 0, 1.0).otherwise(top / bottom).alias("adjusted_rand"))


def regression_scores(df: DataFrame, truth: Column, guess: Column, keys: Sequence[str] = ()) -> DataFrame:
    error = truth - guess
    return df.groupBy(*keys).agg(
        F.avg(F.abs(error)).alias("mae"),
        F.avg(error * error).alias("mse"),
        (1 - F.avg(error * error) / F.var_pop(truth)).alias("r2"),
    )


def detected_segments(segments: DataFrame, hits: DataFrame, keys: Sequence[str], null_label, label: str = "label") -> DataFrame:
    """Gesture segments per group, and those holding a correctly labelled window centre.

    ``hits`` has (keys, run) of the segment at the centre of every correct window.
    """
    gestures = segments.filter(F.col(label) != F.lit(null_label))
    found = gestures.join(hits.select(*keys, "run").distinct(), [*keys, "run"], "left_semi")
    every = gestures.groupBy(*keys).agg(F.count(F.lit(1)).alias("gesture_segments"))
    return every.join(found.groupBy(*keys).agg(F.count(F.lit(1)).alias("detected")), list(keys), "left").select(
        *keys, "gesture_segments", F.coalesce("detected", F.lit(0)).alias("detected")
    )
