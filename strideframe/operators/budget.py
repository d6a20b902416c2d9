"""Choosing windows under a budget and carrying predictions forward."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strideframe.functions.scalars import spread_order
from strideframe.operators import metrics as met
from strideframe.operators.features import starts_of
from strideframe.operators.ordered import chunk_by_position, chunk_rows, exact_quantiles, meet, stamped, sweep
from strideframe.operators.ranking import rank_by_hash, rank_rows
from strideframe.session import settle

# Names of the scores and methods, budgets in percent, seeds of the random draws.
SCORES = ("accelerationVariance", "windowChange", "spectralEntropy")
METHODS = ("changeTrigger", "uniformStride", "random", *SCORES, "meanRank")
BUDGETS = (5, 10, 20, 50, 100)
SEEDS = (42, 43, 44)


def keep_count(budget: Column, n: Column) -> Column:
    """Windows allowed by a budget in percent, rounded up to whole windows."""
    return F.ceil(budget * n / 100).cast("long")


def add_lengths(df: DataFrame, stream: str = "stream", pos: str = "pos") -> DataFrame:
    rows = chunk_by_position(df, pos, "__c")
    return sweep(rows, [stream], [pos], chunk="__c", totals={"n": ("sum", F.lit(1))}).drop("__c")


def trigger_thresholds(df: DataFrame, folds: Sequence[int], budgets: Sequence[int] = BUDGETS, change: str = "windowChange", fold: str = "fold") -> DataFrame:
    """Per fold and budget: the upper quantile of the changes in the training windows, minus infinity at 100 %."""
    others = F.array(*[F.lit(f) for f in folds])
    train = df.filter(F.col(change).isNotNull()).select(F.explode(F.filter(others, lambda f: f != F.col(fold))).alias(fold), change)
    below = [b for b in budgets if b < 100]
    wide = exact_quantiles(train, [fold], change, [1 - b / 100 for b in below], [f"b{b}" for b in below])
    cells = [F.struct(F.lit(b).alias("budget"), (F.col(f"b{b}") if b < 100 else F.lit(float("-inf"))).alias("threshold")) for b in budgets]
    return wide.select(fold, F.inline(F.array(*cells)))


def stride_kept(pos: Column, n: Column, k: Column) -> Column:
    """Is ``pos`` one of floor(i * n / k), i < k? Solved for i, so nothing is generated or joined."""
    i = F.ceil(pos * k / n)
    return (i < k) & (F.floor(i * n / k) == pos)


def later_places(df: DataFrame, wanted: Sequence[str], stream: str = "stream", pos: str = "pos") -> DataFrame:
    """Places of the later windows of every stream by each wanted score and, for meanRank, by the mean of all ranks.

    All scores are ranked in one pass over a long table keyed by (stream, score name).
    """
    mean_rank = "meanRank" in wanted
    scores = SCORES if mean_rank else [s for s in SCORES if s in wanted]
    later = df.filter(F.col(pos) > 0)
    long = later.select(stream, pos, F.inline(F.array(*[F.struct(F.lit(s).alias("name"), F.col(s).alias("value")) for s in scores])))
    ranked = settle(rank_rows(long, [stream, "name"], F.col("value"), pos, "place", "rank"))
    every = ranked.select(stream, pos, "name", "place")
    if mean_rank:
        every = every.unionByName(mean_places(ranked, stream, pos))
    return every.groupBy(stream, pos).agg(
        *[F.max(F.when(F.col("name") == s, F.col("place"))).alias(f"place_{s}") for s in (*scores, *(["meanRank"] if mean_rank else []))]
    )


def mean_places(ranked: DataFrame, stream: str, pos: str) -> DataFrame:
    """Places by the mean of the average ranks of all scores."""
    sums = ranked.groupBy(stream, pos).agg((-F.sum("rank")).alias("__mean"))
    return rank_rows(sums, [stream], F.col("__mean"), pos, "place").select(stream, pos, F.lit("meanRank").alias("name"), "place")


def drawn(stream: Column, pos: Column, budget: Column, seed: Column) -> Column:
    """Order key of a window in a draw."""
    return spread_order(stream * 100003 + pos * 101 + budget * 7919 + seed * 104729)


def random_places(df: DataFrame, budgets: Sequence[int], seeds: Sequence[int], stream: str = "stream", pos: str = "pos") -> DataFrame:
    """Places of the later windows in a seeded draw without replacement, one draw per seed and budget."""
    draws = F.array(*[F.struct(F.lit(b).alias("budget"), F.lit(s).alias("seed")) for b in budgets for s in seeds])
    rows = df.filter(F.col(pos) > 0).select(stream, pos, F.inline(draws))
    mixed = drawn(F.col(stream), F.col(pos), F.col("budget"), F.col("seed"))
    return rank_by_hash(rows, [stream, "budget", "seed"], mixed, pos, "place_random")


def runs_of(methods: Sequence[str] = METHODS, budgets: Sequence[int] = BUDGETS, seeds: Sequence[int] = SEEDS) -> list[tuple[str, int, int | None]]:
    """(method, budget, seed) of every run; only random draws have seeds."""
    unknown = set(methods) - set(METHODS)
    if unknown:
        raise ValueError(f"Unknown selection methods {sorted(unknown)}")
    return [(m, b, s) for m in methods for b in budgets for s in (seeds if m == "random" else (None,))]


def by_size(df: DataFrame, stream: str = "stream") -> tuple[DataFrame, DataFrame | None]:
    """Windows of the streams that fit a chunk, and those of longer streams if there are any."""
    sizes = df.groupBy(stream).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > chunk_rows(df)).select(stream)
    if sizes.isEmpty():
        return df, None
    rows, long = stamped(df, [stream]), stamped(settle(sizes), [stream])
    return meet(rows, long, [stream], "left_anti").drop("__edge"), meet(rows, long, [stream], "left_semi").drop("__edge")


def whole_streams(batches: Iterator[pa.RecordBatch], stream: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows in order of the stream (a column's number) as tables of whole streams, with the first row of each."""
    held = None
    for batch in batches:
        more = pa.Table.from_batches([batch])
        held = more if held is None else pa.concat_tables([held, more])
        if len(held):
            starts = starts_of([held[stream].combine_chunks()])
            if len(starts) > 1:
                yield held.slice(0, int(starts[-1])).combine_chunks(), starts[:-1]
                held = held.slice(int(starts[-1]))
    if held is not None and len(held):
        yield held.combine_chunks(), np.zeros(1, dtype=np.int64)


def places_inside(df: DataFrame, wanted: Sequence[str], draws: Sequence[tuple[int, int]], stream: str = "stream", pos: str = "pos") -> DataFrame:
    """Length and all places of streams that fit a chunk: one shuffle, then all orders of many streams at once. Rows stay in order of (stream, pos)."""
    mean_rank = "meanRank" in wanted
    scores = list(SCORES) if mean_rank else [s for s in SCORES if s in wanted]
    keys = [(-F.col(s)).cast("double").alias(f"__k_{s}") for s in scores]
    keys += [drawn(F.col(stream), F.col(pos), F.lit(b), F.lit(s)).cast("long").alias(f"__d_{b}_{s}") for b, s in draws]
    dealt = df.select("*", *keys).repartition(stream).sortWithinPartitions(stream, pos)
    own, at, where = len(df.columns), df.columns.index(stream), df.columns.index(pos)
    names = ["n", *[f"place_{s}" for s in scores], *(["place_meanRank"] if mean_rank else []), *[f"place_{b}_{s}" for b, s in draws]]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_streams(batches, at):
            sizes = np.diff(np.append(starts, len(table)))
            number = np.repeat(np.arange(len(starts)), sizes)
            first = np.repeat(starts, sizes)
            later = pc.fill_null(pc.greater(table[where], 0), False).to_numpy()
            index = np.arange(len(table))

            def ordered(*order: np.ndarray) -> np.ndarray:
                """Rows by stream, the later ones first, then by these; rows with equal ones stay by position."""
                return np.lexsort((index, *reversed(order), ~later, number))

            def places(by: np.ndarray) -> np.ndarray:
                out = np.empty(len(by), dtype=np.int64)
                out[by] = index
                return out - first

            out, ranks = [], np.zeros(len(table), dtype=np.int64)
            for i in range(len(scores)):
                column = table[own + i].combine_chunks()
                gone = column.is_null().to_numpy(zero_copy_only=False)
                value = np.where(gone, 0.0, column.to_numpy(zero_copy_only=False))
                by = ordered(gone, value)
                out.append(places(by))
                # first and last rank of the ties, twice their average
                alike = (gone[by][1:] == gone[by][:-1]) & ((value[by][1:] == value[by][:-1]) | np.isnan(value[by][1:]) & np.isnan(value[by][:-1]))
                alike &= (number[by][1:] == number[by][:-1]) & (later[by][1:] == later[by][:-1])
                opens = np.flatnonzero(np.concatenate([[True], ~alike]))
                many = np.diff(np.append(opens, len(by)))
                ranks[by] += np.repeat(opens + opens + many + 1, many) - 2 * first[by]
            if mean_rank:
                out.append(places(ordered(ranks)))
            out += [places(ordered(table[own + len(scores) + i].to_numpy())) for i in range(len(draws))]
            made = [pa.array(sizes.repeat(sizes)), *[pa.array(v, mask=~later) for v in out]]
            yield from pa.Table.from_arrays([*table.columns[:own], *made], names=[*df_names, *names]).to_batches(max_chunksize=10_000)

    df_names = list(df.columns)
    return dealt.mapInArrow(work, T.StructType([*df.schema.fields, *[T.StructField(n, T.LongType()) for n in names]]))


def filled_inside(df: DataFrame, prediction: str, runs: int, stream: str = "stream") -> DataFrame:
    """``final``: the prediction of the last kept row of the stream for every run. Takes rows as ``places_inside`` leaves them."""
    at, value, kept, names = df.columns.index(stream), df.columns.index(prediction), df.columns.index("kept"), [*df.columns, "final"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_streams(batches, at):
            first, index = np.repeat(starts, np.diff(np.append(starts, len(table)))), np.arange(len(table), dtype=np.int32)
            guess = table[value].combine_chunks()
            known = ~guess.is_null().to_numpy(zero_copy_only=False)
            marks = table[kept].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, runs)
            last, gone = np.empty(marks.shape, dtype=np.int32), np.empty(marks.shape, dtype=bool)
            for i in range(runs):
                last[:, i] = np.maximum.accumulate(np.where(marks[:, i] & known, index, -1))
                gone[:, i] = last[:, i] < first
            took = guess.take(pa.array(last.ravel(), mask=gone.ravel()))
            final = pa.ListArray.from_arrays(pa.array((np.arange(len(table) + 1) * runs).astype(np.int32)), took)
            yield from pa.Table.from_arrays([*table.columns, final], names=names).to_batches(max_chunksize=10_000)

    return df.mapInArrow(work, T.StructType([*df.schema.fields, T.StructField("final", T.ArrayType(df.schema[prediction].dataType))]))


def places_across(df: DataFrame, wanted: Sequence[str], draws: Sequence[tuple[int, int]], stream: str = "stream", pos: str = "pos") -> DataFrame:
    """The same columns for streams of any length, ranked over all tasks."""
    out = add_lengths(df, stream, pos)
    if wanted:
        out = out.join(later_places(df, sorted(wanted), stream, pos), [stream, pos], "left")
    if draws:
        budgets, seeds = dict.fromkeys(b for b, _ in draws), dict.fromkeys(s for _, s in draws)
        placed = random_places(df, list(budgets), list(seeds), stream, pos)
        cells = [F.max(F.when((F.col("budget") == b) & (F.col("seed") == s), F.col("place_random"))).alias(f"place_{b}_{s}") for b, s in draws]
        out = out.join(placed.groupBy(stream, pos).agg(*cells), [stream, pos], "left")
    return out


def run_windows(
    df: DataFrame,
    thresholds: DataFrame | None,
    methods: Sequence[str] = METHODS,
    budgets: Sequence[int] = BUDGETS,
    seeds: Sequence[int] = SEEDS,
    prediction: str | None = None,
) -> DataFrame:
    """Every window once, with arrays over the runs: ``kept``, and ``final`` if a prediction is to be carried forward.

    No window is copied for a run. Streams that fit a chunk are ranked and filled
    on Arrow arrays after one shuffle by stream, longer ones over all tasks.
    """
    runs = runs_of(methods, budgets, seeds)
    wanted = sorted({*methods} & {*SCORES, "meanRank"})
    draws = [(b, s) for m, b, s in runs if m == "random"]
    if "changeTrigger" in methods:
        cells = [F.max(F.when(F.col("budget") == b, F.col("threshold"))).alias(f"__t{b}") for b in budgets]
        levels = settle(thresholds.groupBy("fold").agg(*cells))  # a row for each fold

    def marked(rows: DataFrame) -> DataFrame:
        if "changeTrigger" in methods:
            rows = rows.join(F.broadcast(levels), "fold", "left")
        marks = []
        for m, b, s in runs:
            k = keep_count(F.lit(b), F.col("n"))
            if m == "changeTrigger":
                rule = F.col("windowChange") >= F.col(f"__t{b}")
            elif m == "uniformStride":
                rule = stride_kept(F.col("pos"), F.col("n"), k)
            else:
                rule = F.col(f"place_{b}_{s}" if m == "random" else f"place_{m}") < k - 1
            marks.append((F.col("pos") == 0) | F.coalesce(rule, F.lit(False)))
        return rows.select(*df.columns, F.array(*marks).alias("kept"))

    def filled(rows: DataFrame, across: bool) -> DataFrame:
        if prediction is None:
            return rows
        valid = {f"__f{i}": F.when(F.col("kept")[i], F.col(prediction)) for i in range(len(runs))}
        if across:
            rows = sweep(chunk_by_position(settle(rows), "pos", "__c"), ["stream"], ["pos"], chunk="__c", last_valid=valid)
        else:
            return filled_inside(rows, prediction, len(runs))
        return rows.select(*df.columns, "kept", F.array(*valid).alias("final"))

    short, long = by_size(df)
    out = filled(marked(places_inside(short, wanted, draws)), False)
    return out if long is None else out.unionByName(filled(marked(places_across(long, wanted, draws)), True))


def each_run(windows: DataFrame, runs: Sequence[tuple[str, int, int | None]]) -> DataFrame:
    """Arrays over the runs as rows (method, budget, seed, the window, kept and final)."""
    spread = [c for c in ("kept", "final") if c in windows.columns]
    cells = [
        F.struct(F.lit(m).alias("method"), F.lit(b).alias("budget"), F.lit(s).cast("int").alias("seed"), *[F.col(c)[i].alias(c) for c in spread])
        for i, (m, b, s) in enumerate(runs)
    ]
    carried = [c for c in windows.columns if c not in spread]
    return windows.select(*carried, F.inline(F.array(*cells))).select("method", "budget", "seed", *carried, *spread)


def select_windows(
    df: DataFrame,
    thresholds: DataFrame | None,
    methods: Sequence[str] = METHODS,
    budgets: Sequence[int] = BUDGETS,
    seeds: Sequence[int] = SEEDS,
) -> DataFrame:
    """Every window under every method, budget and seed with its ``kept`` mark.

    ``df``: stream, pos, fold, the three scores and any columns to carry along. The
    first window of a stream always runs and counts toward the budget.
    """
    return each_run(run_windows(df, thresholds, methods, budgets, seeds), runs_of(methods, budgets, seeds))


def final_predictions(
    df: DataFrame,
    thresholds: DataFrame | None,
    methods: Sequence[str] = METHODS,
    budgets: Sequence[int] = BUDGETS,
    seeds: Sequence[int] = SEEDS,
    prediction: str = "full",
) -> DataFrame:
    """``carry_forward`` of ``select_windows``: also the prediction of the last kept window of the stream."""
    return each_run(run_windows(df, thresholds, methods, budgets, seeds, prediction), runs_of(methods, budgets, seeds))


def carry_forward(selected: DataFrame, prediction: str = "full", keys: Sequence[str] = ("method", "budget", "seed", "stream"), pos: str = "pos") -> DataFrame:
    """Every dropped window gets the prediction of the last kept window of its stream."""
    seed = F.coalesce(F.col("seed"), F.lit(-1))
    rows = chunk_by_position(selected.withColumn("seed", seed), pos, "__c")
    out = sweep(rows, keys, [pos], chunk="__c", last_valid={"final": F.when(F.col("kept"), F.col(prediction))})
    return out.drop("__c").withColumn("seed", F.when(F.col("seed") >= 0, F.col("seed")))


RUN_KEYS = ("method", "budget", "seed")


def score_selection(final: DataFrame, labels: Sequence, truth: str = "truth") -> tuple[DataFrame, DataFrame]:
    """Run rows (realised budget, macro F1, accuracy) and activity rows (windows, kept share, recall)."""
    rows = final.withColumn("seed", F.coalesce(F.col("seed"), F.lit(-1)))
    kept = F.sum(F.col("kept").cast("long"))
    counts = settle(rows.groupBy(*RUN_KEYS, F.col(truth).alias("truth"), F.col("final").alias("guess")).agg(
        F.count(F.lit(1)).alias("n"), kept.alias("kept")
    ))
    scores = met.score_fold(counts.drop("kept"), labels, RUN_KEYS).select(*RUN_KEYS, F.col("macro_f1"), "accuracy")
    realised = counts.groupBy(*RUN_KEYS).agg((F.sum("kept") / F.sum("n")).alias("realised_budget"))
    free = F.when(F.col("seed") >= 0, F.col("seed")).alias("seed")
    runs = realised.join(scores, list(RUN_KEYS)).select("method", "budget", free, "realised_budget", "macro_f1", "accuracy")
    activities = counts.groupBy(*RUN_KEYS, "truth").agg(
        F.sum("n").alias("windows"),
        (F.sum("kept") / F.sum("n")).alias("kept_share"),
        (F.sum(F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0)) / F.sum("n")).alias("recall"),
    )
    return runs, activities.select("method", "budget", free, F.col("truth").alias("activity"), "windows", "kept_share", "recall")


def average_seeds(runs: DataFrame) -> DataFrame:
    return runs.groupBy("method", "budget").agg(
        F.avg("realised_budget").alias("realised_budget"),
        F.avg("macro_f1").alias("macro_f1"),
        F.stddev_samp("macro_f1").alias("macro_f1_std"),
        F.avg("accuracy").alias("accuracy"),
        F.count(F.lit(1)).alias("runs"),
    )


def average_activities(activities: DataFrame) -> DataFrame:
    return activities.groupBy("method", "budget", "activity").agg(
        F.max("windows").alias("windows"), F.avg("kept_share").alias("kept_share"), F.avg("recall").alias("recall")
    )


def full_budget_violations(final: DataFrame, prediction: str = "full") -> DataFrame:
    """Windows at 100 % that are dropped or differ from the recognizer (none when all is right)."""
    wrong = ~F.col("kept") | ~F.col("final").eqNullSafe(F.col(prediction))
    return final.filter(F.col("budget") == 100).groupBy("method").agg(F.count_if(wrong).alias("violations"))
