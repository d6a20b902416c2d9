"""Joins and comparisons of windows, segments, results and reference tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideframe.operators.ordered import add_chunk, chunk_by_position, sweep


def join_centres(windows: DataFrame, runs: DataFrame, keys: Sequence[str], centre: Column) -> DataFrame:
    """Windows with label and run of their centre frame: an equi-join on the frame, not a range join."""
    frames = runs.select(*keys, F.col("pos").alias("__pos"), F.col("label").alias("truth"), "run")
    return windows.withColumn("__pos", centre).join(frames, [*keys, "__pos"]).drop("__pos")


def compare_with_reference(ours: DataFrame, reference: DataFrame, keys: Sequence[str], metrics: Sequence[str], factor: float = 100.0) -> DataFrame:
    """Reference rows with our values and the differences, both in points; unmatched ones stay."""
    renamed = ours.select(*keys, *[(factor * F.col(m)).alias(f"our_{m}") for m in metrics])
    joined = reference.join(renamed, list(keys), "left")
    return joined.select("*", *[(F.col(f"our_{m}") - F.col(m)).alias(f"difference_{m}") for m in metrics])


def spread(df: DataFrame, keys: Sequence[str], column: str, values: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Metrics of each value of a column side by side (rows that have the first value)."""
    out = df.groupBy(*keys).agg(
        *[F.max(F.when(F.col(column) == v, F.col(m))).alias(f"{m}_{v}") for v in values for m in metrics],
        F.count_if(F.col(column) == values[0]).alias("__n"),
    )
    return out.filter("__n > 0").drop("__n")


def add_drops(df: DataFrame, values: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Drop in points from the first value to every other one."""
    return df.select("*", *[(100 * (F.col(f"{m}_{values[0]}") - F.col(f"{m}_{v}"))).alias(f"{m}_drop_{v}") for v in values[1:] for m in metrics])


def match_single(reference: DataFrame, rows: DataFrame, keys: Sequence[str], reference_id: str) -> DataFrame:
    """Reference rows joined to our rows; kept only where exactly one row matches."""
    joined = reference.join(rows, list(keys))
    n = F.count(F.lit(1)).over(Window.partitionBy(reference_id))
    return joined.withColumn("__n", n).filter("__n = 1").drop("__n")


def name_repeats(df: DataFrame, keys: Sequence[str], order: str, identifier: str, name: str = "duplicate_of") -> DataFrame:
    """Identifier of the earliest row with the same key, null on that row itself."""
    firsts = df.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.min(F.struct(order, identifier)).alias("__f"))
    joined = df.join(firsts, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]).drop(*[f"__{k}" for k in keys])
    return joined.withColumn(name, F.when(F.col("__f")[order] < F.col(order), F.col("__f")[identifier])).drop("__f")


# The averaging conventions (set of classes, rule for undefined precision) and the words of the verdicts.
CONVENTIONS = (("all", "zero"), ("all", "defined"), ("gesture", "zero"), ("gesture", "defined"))
SET_WORDS = {"all": "all classes", "gesture": "gesture classes"}
EVEN_SETS, EVEN_RULES, RULE_WORDS = "tie", "same", "{} precision closer"


def closest_convention(df: DataFrame, precision: str, recall: str) -> DataFrame:
    """Absolute gaps under four averaging conventions and which of them lies closest.

    The gaps stand in one ranked array: the nearest set is that of its first
    entry, the nearest rule that of the first entry of that set (of the whole
    table's set when both sets are as near).
    """
    near = lambda kind, c, said: F.abs(100 * F.col(f"{kind}_{c}") - F.col(said))
    name = lambda c: f"gap_{c[0]}_{c[1]}"
    out = df.select("*", *[(near("precision", f"{s}_{r}", precision) + near("recall", f"{s}_{r}", recall)).alias(name((s, r))) for s, r in CONVENTIONS])
    ranked = F.sort_array(F.array(*[F.struct(F.col(name(c)).alias("gap"), F.lit(c[0]).alias("set"), F.lit(c[1]).alias("rule")) for c in CONVENTIONS]))
    out = out.withColumn("__r", ranked)
    of = lambda s: F.filter("__r", lambda e: e["set"] == s)
    out = out.select("*", *[of(s)[0]["gap"].alias(f"best_gap_{s}") for s in SET_WORDS])
    margin = F.abs(F.col("best_gap_all") - F.col("best_gap_gesture"))
    words = F.create_map(*[F.lit(x) for pair in SET_WORDS.items() for x in pair])
    closer = F.when(margin == 0, EVEN_SETS).otherwise(words[F.col("__r")[0]["set"]])
    mine = of(F.when(margin == 0, "all").otherwise(F.col("__r")[0]["set"]))
    rule = F.when(mine[0]["gap"] == mine[1]["gap"], EVEN_RULES).otherwise(F.format_string(RULE_WORDS.replace("{}", "%s"), mine[0]["rule"]))
    return out.select("*", closer.alias("closer_set"), margin.alias("set_margin"), rule.alias("precision_convention")).drop("__r")


def metric_changes(before: DataFrame, after: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Published against rerun metrics of the same configuration with their changes."""
    a = before.select(*keys, *[F.col(m).alias(f"{m}_published") for m in metrics])
    b = after.select(*keys, *[F.col(m).alias(f"{m}_rerun") for m in metrics])
    return a.join(b, list(keys)).select("*", *[(F.col(f"{m}_rerun") - F.col(f"{m}_published")).alias(f"{m}_change") for m in metrics])


def neighbour_leakage(df: DataFrame, bout: str, row: str, is_train: Column) -> DataFrame:
    """Test rows whose neighbour in the same bout is a training row."""
    rows = chunk_by_position(df.withColumn("__train", is_train), row, "__chunk")
    near = F.struct(F.col(row).alias("r"), F.col("__train").alias("t"))
    seen = sweep(rows, [bout], [row], chunk="__chunk", prev={"__p": near}, following={"__f": near})
    left = F.coalesce((F.col("__p")["r"] == F.col(row) - 1) & F.col("__p")["t"], F.lit(False))
    right = F.coalesce((F.col("__f")["r"] == F.col(row) + 1) & F.col("__f")["t"], F.lit(False))
    return seen.filter(~F.col("__train") & (left | right)).select(*df.columns)


def touched_range(start: Column, end: Column, size: int, step: int) -> tuple[Column, Column]:
    """First and last number of the windows that overlap a span [start, end); no window where first > last."""
    first = F.greatest(F.lit(0), F.floor((start - size) / step) + 1).cast("long")
    return first, F.greatest(F.ceil(end / step) - 1, F.lit(-1)).cast("long")


def purge_overlaps(windows: DataFrame, spans: DataFrame, keys: Sequence[str], size: int, step: int, win: str = "win") -> DataFrame:
    """Mark windows that overlap a held-out span [start, end) of their recording.

    A span is turned into the window numbers it touches, so the overlap is an
    equi-join on the window number and no pair outside the overlap is formed.
    """
    first, last = touched_range(F.col("span_start"), F.col("span_end"), size, step)
    touched = spans.select(*keys, *[c for c in spans.columns if c not in (*keys, "span_start", "span_end")], first.alias("__a"), last.alias("__b"))
    touched = touched.filter("__a <= __b").withColumn(win, F.explode(F.sequence("__a", "__b"))).drop("__a", "__b")
    return windows.join(touched, [*keys, win], "left_semi")


def curve_claims(df: DataFrame, keys: Sequence[str], x: str, precision: str, recall: str) -> DataFrame:
    """Where a curve peaks, its lead over the runner-up, and whether recall never rises."""

    def tallest(rows: DataFrame, metric: str, name: str) -> DataFrame:
        return rows.groupBy(*keys).agg(F.min(F.struct((-F.col(metric)).alias("q"), F.col(x).alias("x"))).alias(name))

    first = tallest(df, precision, "__1")
    rest = df.join(first, list(keys)).filter(F.col(x) != F.col("__1")["x"])
    second = tallest(rest, precision, "__2")
    recalls = tallest(df, recall, "__r")
    seen = sweep(add_chunk(df, keys, x, "__c"), keys, [x], chunk="__c", prev={"__was": F.col(recall)})
    falls = seen.groupBy(*keys).agg(F.bool_and(F.coalesce(F.col(recall) <= F.col("__was"), F.lit(True))).alias("recall_never_rises"))
    table = first.join(second, list(keys), "left").join(recalls, list(keys)).join(falls, list(keys))
    return table.select(
        *keys,
        F.col("__1")["x"].alias("peak"),
        F.col("__2")["x"].alias("runner_up"),
        (100 * (F.col("__2")["q"] - F.col("__1")["q"])).alias("lead_points"),
        F.col("__r")["x"].alias("recall_peak"),
        "recall_never_rises",
    )


def stated_choice(df: DataFrame, keys: Sequence[str], choice: str, stated, metrics: Sequence[str]) -> DataFrame:
    """Best choice by each metric and the lead, in points, of a stated choice over the best other one."""
    mine = F.col(choice) == F.lit(stated)
    out = df.groupBy(*keys).agg(
        *[F.min(F.struct((-F.col(m)).alias("q"), F.col(choice).alias("v"))).alias(f"__{m}") for m in metrics],
        *[(100 * (F.max(F.when(mine, F.col(m))) - F.max(F.when(~mine, F.col(m))))).alias(f"{m}_change") for m in metrics],
    )
    return out.select(*keys, *[F.col(f"__{m}")["v"].alias(f"best_by_{m}") for m in metrics], *[f"{m}_change" for m in metrics], *[(F.col(f"{m}_change") > 0).alias(f"{m}_holds") for m in metrics])


def recomputed_f(df: DataFrame, precision: str, recall: str, printed: str, beta: float = 1.0, tolerance: float = 0.01) -> DataFrame:
    b = beta * beta
    value = (1 + b) * F.col(recall) * F.col(precision) / (b * F.col(precision) + F.col(recall))
    return df.withColumn("recomputed", value).withColumn("matches", F.abs(F.col("recomputed") - F.col(printed)) <= tolerance)


def differing_rows(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Keys whose value differs between two tables or that one of them lacks (none when they agree)."""
    a = left.select(*keys, F.col(value).alias("left_value"))
    b = right.select(*keys, F.col(value).alias("right_value"))
    return a.join(b, list(keys), "full_outer").filter(~F.col("left_value").eqNullSafe(F.col("right_value")))
