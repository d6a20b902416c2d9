"""Count tables, shares, summaries and histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideframe.functions.scalars import safe_divide
from strideframe.operators.ordered import exact_quantiles


def count_columns(name: str, values: Sequence, weight: Column | None = None) -> list[Column]:
    """One conditional count per fixed value: a pivot that needs no pass to find the values."""
    weight = F.lit(1) if weight is None else weight
    return [F.sum(F.when(F.col(name) == v, weight).otherwise(0)).alias(str(v)) for v in values]


def crosstab(df: DataFrame, row: str, rows: Sequence, column: str, columns: Sequence[str], step_seconds: float) -> DataFrame:
    """Counts of (row, column) for fixed rows and columns with total, share and seconds."""
    counts = df.groupBy(row).agg(*count_columns(column, columns))
    dim = df.limit(1).select(F.explode(F.array(*[F.lit(r) for r in rows])).alias(row))
    table = dim.join(counts, row, "left").select(row, *[F.coalesce(c, F.lit(0)).alias(c) for c in columns])
    table = table.withColumn("total", sum((F.col(c) for c in columns[1:]), F.col(columns[0])))
    whole = F.sum("total").over(Window.partitionBy())
    return table.select("*", safe_divide(F.col("total"), whole).alias("share"), (F.col("total") * step_seconds).alias("seconds"))


def seconds_by_class(df: DataFrame, who: str, label: str, labels: Sequence[str], step_seconds: float) -> DataFrame:
    return df.groupBy(who).agg(*[(c * step_seconds).alias(str(v)) for c, v in zip(count_columns(label, labels), labels)])


def up_down_ratio(table: DataFrame, who: str, up: str, down: str) -> DataFrame:
    """Participants with their duration ratio, lowest first."""
    ratio = safe_divide(F.col(up), F.col(down))
    return table.filter(F.col(down) > 0).select(who, F.col(up).alias("up"), F.col(down).alias("down"), ratio.alias("ratio")).orderBy("ratio", who)


def label_shares(vocabulary: DataFrame, df: DataFrame, label: str) -> DataFrame:
    """Windows and share of every label of the vocabulary, zero for unseen ones."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("windows"))
    table = vocabulary.select(label).join(counts, label, "left").select(label, F.coalesce("windows", F.lit(0)).alias("windows"))
    return table.withColumn("share", safe_divide(F.col("windows"), F.sum("windows").over(Window.partitionBy())))


def inventory(subjects: DataFrame, who: str, label: str, labels: Sequence, counted: dict[str, DataFrame]) -> DataFrame:
    """Rows of every table per (participant, class), all classes listed for every participant."""
    table = subjects.select(who).distinct().withColumn(label, F.explode(F.array(*[F.lit(v) for v in labels])))
    for name, df in counted.items():
        counts = df.groupBy(who, label).agg(F.count(F.lit(1)).alias(name))
        table = table.join(counts, [who, label], "left").fillna(0, [name])
    return table


def class_distribution(df: DataFrame, label: str, split: str, splits: Sequence[str]) -> DataFrame:
    """Counts and shares of every class in each split."""
    counts = df.groupBy(label).agg(*count_columns(split, splits))
    whole = Window.partitionBy()
    out = [label]
    for s in splits:
        out += [F.col(s).alias(f"{s}_windows"), safe_divide(F.col(s), F.sum(s).over(whole)).alias(f"{s}_share")]
    return counts.select(*out)


def describe(long: DataFrame, key: str, value: str) -> DataFrame:
    """Count, mean, deviation, extremes, quartiles and adjusted skew of every key."""
    n = F.count(value).cast("double")
    stats = long.groupBy(key).agg(
        F.count(value).alias("count"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        (F.skewness(value) * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"),
    )
    quartiles = exact_quantiles(long, [key], value, [0.25, 0.5, 0.75], ["quartile1", "median", "quartile3"])
    return stats.join(quartiles, key)


def five_numbers(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return exact_quantiles(df, keys, value, [0, 0.25, 0.5, 0.75, 1], ["low", "quartile1", "median", "quartile3", "high"])


def correlation_counts(df: DataFrame, features: str, skew_limit: float = 1.0, correlation_limit: float = 0.9) -> DataFrame:
    """Features with a large skew, and pairs with a large or undefined correlation."""
    long = df.select(F.posexplode(features).alias("feature", "x"))
    n = F.count("x").cast("double")
    skews = long.groupBy("feature").agg((F.skewness("x") * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"))
    skewed = skews.agg(F.count_if(F.abs("skew") > skew_limit).alias("skewed"))
    matrix = Correlation.corr(df.select(array_to_vector(F.col(features)).alias("v")), "v").head()[0].toArray()
    pairs = matrix[[i for i in range(len(matrix)) for _ in range(i + 1, len(matrix))], [j for i in range(len(matrix)) for j in range(i + 1, len(matrix))]]
    undefined = int((pairs != pairs).sum())
    large = int((abs(pairs[pairs == pairs]) > correlation_limit).sum())
    return skewed.select(
        F.col("skewed").cast("long"),
        F.lit(len(pairs)).cast("long").alias("pairs"),
        F.lit(large).cast("long").alias("correlated"),
        F.lit(undefined).cast("long").alias("undefined"),
    )


def correlation_matrix(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Correlation of every pair of chosen columns, long, in one aggregation."""
    names = list(columns)
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(columns[a], columns[b]).alias("correlation")) for a in names for b in names]
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def fixed_histogram(df: DataFrame, value: str, low: float, high: float, bins: int = 50) -> DataFrame:
    """Counts in equal bins; the last one is closed, values outside are left out, empty bins are listed."""
    number = F.least(F.floor((F.col(value) - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")
    counts = df.filter(F.col(value).between(low, high)).groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = df.limit(1).select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(counts, "bin", "left").fillna(0, ["n"])


def automatic_bins(df: DataFrame, value: str) -> DataFrame:
    """Bin count and range by the narrower of the Sturges and the Freedman-Diaconis width."""
    q = exact_quantiles(df, [], value, [0.25, 0.75], ["q1", "q3"])
    stats = df.agg(F.count(value).alias("rows"), F.min(value).cast("double").alias("low"), F.max(value).cast("double").alias("high"))
    one = stats.withColumn("iqr", q.select(F.col("q3") - F.col("q1")).scalar())
    span = F.col("high") - F.col("low")
    sturges = span / (F.log2(F.col("rows").cast("double")) + 1)
    freedman = 2 * F.col("iqr") / F.pow(F.col("rows").cast("double"), F.lit(1.0 / 3))
    width = F.when(freedman > 0, F.least(freedman, sturges)).otherwise(sturges)
    return one.withColumn("bins", F.when(span > 0, F.ceil(span / width)).otherwise(1).cast("int"))


def automatic_histogram(df: DataFrame, value: str) -> DataFrame:
    bins = automatic_bins(df, value).select(F.struct("low", "high", "bins").alias("b")).scalar()
    rows = df.select(F.col(value).cast("double").alias("v"), bins.alias("b"))
    number = F.least(F.floor((F.col("v") - F.col("b.low")) / (F.col("b.high") - F.col("b.low")) * F.col("b.bins")), F.col("b.bins") - 1)
    return rows.groupBy(number.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def average_rounds(rounds: DataFrame, keys: Sequence[str], metrics: Sequence[str], subject: str, subjects: Sequence, by_subject: Sequence[str], detected: str, segments: str) -> DataFrame:
    """Mean metrics of rounds, detected share as a ratio of sums, and means per test participant."""
    return rounds.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rounds"),
        *[F.avg(m).alias(m) for m in metrics],
        (F.sum(detected) / F.sum(segments)).alias("detected_share"),
        *[F.avg(F.when(F.col(subject) == s, F.col(m))).alias(f"{m}_subject_{s}") for s in subjects for m in by_subject],
    )


def summarise_folds(folds: DataFrame, keys: Sequence[str], means: Sequence[str], deviations: Sequence[str]) -> DataFrame:
    """Fold count, means and sample standard deviations of fold metrics."""
    return folds.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("folds"),
        *[F.avg(m).alias(m) for m in means],
        *[F.stddev_samp(m).alias(f"{m}_std") for m in deviations],
    )


def importance_by_sensor(df: DataFrame, sensor: str, sensors: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Features and summed importances of a fixed list of sensors with their shares."""
    sums = df.groupBy(sensor).agg(F.count(F.lit(1)).alias("features"), *[F.sum(c).alias(c) for c in columns])
    dim = df.limit(1).select(F.explode(F.array(*[F.lit(s) for s in sensors])).alias(sensor))
    table = dim.join(sums, sensor, "left").fillna(0)
    whole = Window.partitionBy()
    return table.select("*", *[safe_divide(F.col(c), F.sum(c).over(whole)).alias(f"{c}_share") for c in ("features", *columns)])


def edge_choices(df: DataFrame, column: str, grid: Sequence, keys: Sequence[str] = ()) -> DataFrame:
    """How many tuned settings lie on the edge of the grid."""
    return df.groupBy(*keys).agg(F.count_if(F.col(column).isin(min(grid), max(grid))).alias("on_edge"), F.count(column).alias("tuned"))


def share_matrix(df: DataFrame, row: str, column: str, columns: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(row).agg(*[F.max(F.when(F.col(column) == c, F.col(value))).alias(str(c)) for c in columns])


def describe_folds(df: DataFrame, fold: str, participant: str) -> DataFrame:
    """Test participants of each fold as sorted text, with test and training windows."""
    sizes = df.groupBy(fold, participant).agg(F.count(F.lit(1)).alias("n"))
    folds = sizes.groupBy(fold).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(participant)), lambda p: p.cast("string")), " ").alias("participants"),
        F.sum("n").alias("test_windows"),
    )
    return folds.withColumn("train_windows", F.sum("test_windows").over(Window.partitionBy()) - F.col("test_windows"))


def overview(counts: dict[str, DataFrame]) -> DataFrame:
    """One (measure, value) row per single-value table."""
    out = None
    for name, df in counts.items():
        row = df.select(F.lit(name).alias("measure"), F.col(df.columns[0]).cast("long").alias("value"))
        out = row if out is None else out.unionByName(row)
    return out
