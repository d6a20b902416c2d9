"""Studies: the operators composed end to end, and registries that pick steps by name."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.operators import aggregate as agg, budget as bud, clean, features as feat, folds as fold, metrics as met, prep
from strideframe.operators.compare import neighbour_leakage, touched_range
from strideframe.operators.models import closed_form as closed, ensembles as ens, kernel_grid, neighbours as knn, sequences as seq
from strideframe.operators.windows import majority_of, nearest_unclipped, sliding_arrays
from strideframe.session import settle, stored

# ---- registries ---------------------------------------------------------------------------------------

Predictor = Callable[[DataFrame, DataFrame, str], DataFrame]


def by_neighbours(k: int) -> Predictor:
    def predict(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
        guess = knn.vote(knn.nearest(train, test, "key", label, k), "key")
        return test.join(guess, "key")

    return predict


def by_learner(make: Callable[[int], object]) -> Predictor:
    """Predictor of an MLlib learner; labels must be codes."""

    def predict(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
        a, b = (prep.to_vector(df).withColumn("label", F.col(label).cast("double")) for df in (train, test))
        a = settle(a)
        return ens.guesses(make(a.count()).fit(a), b).drop("vector").withColumn("guess", F.col("guess").cast("long"))

    return predict


def by_stumps(rounds: int) -> Predictor:
    def predict(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
        a, b = (prep.to_vector(df).withColumn("label", F.col(label).cast("double")) for df in (train, test))
        classes = int(a.agg(F.max("label")).first()[0]) + 1
        return ens.stump_votes(ens.fit_stumps(a, classes, rounds), b, classes).drop("vector").withColumn("guess", F.col("guess").cast("long"))

    return predict


CLASSIFIERS: dict[str, Predictor] = {
    "kNearestNeighbour": by_neighbours(1),
    "toolboxNearestNeighbours": by_neighbours(5),
    "nearestClassCentroid": lambda train, test, label: closed.nearest_centroid(train, test, label),
    "linearDiscriminant": lambda train, test, label: closed.linear_discriminant(train, test, label),
    "gaussianNaiveBayes": lambda train, test, label: closed.naive_bayes(train, test, label),
    "adaBoost": by_stumps(50),
    "randomForest": by_learner(lambda rows: ens.random_forest(20)),
    "supportVectorMachine": by_learner(lambda rows: ens.kernel_machine(10.0, rows)),
    "logisticRegression": by_learner(lambda rows: prep.logistic(rows)),
}
FILLS: dict[str, Callable] = {"mean": clean.replace_filled_by_mean, "interpolate": clean.replace_filled_by_line}
FEATURES = feat.FEATURE_TYPES
METHODS = bud.METHODS
PROTOCOLS: dict[str, Callable[[DataFrame, int], DataFrame]] = {
    "shuffledFolds": lambda rows, k: fold.stratified_folds(rows, "code", "key", k),
    "leaveOneSubjectOut": lambda rows, k: rows.withColumn("fold", F.col("who").cast("int")),
}


def union(tables: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def in_parallel(work: Callable, items: Sequence, width: int = 4) -> list:
    """Run independent fits side by side; each one is a set of Spark jobs."""
    with ThreadPoolExecutor(width) as pool:
        return list(pool.map(work, items))


# ---- nearest centroid over all folds in one job -----------------------------------------------------------

def cross_fold_centroids(rows: DataFrame, fold_column: str, label: str, columns: Sequence[str]) -> DataFrame:
    """Guess of every row by the class means of all other folds.

    The means without a fold are the totals minus the fold's own sums, so no row
    is copied per fold and nothing is fitted in a loop.
    """
    sums = rows.groupBy(fold_column, label).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in columns])
    cells = settle(sums)
    total = cells.groupBy(label).agg(F.sum("n").alias("tn"), *[F.sum(c).alias(f"t_{c}") for c in columns])
    folds = cells.select(fold_column).distinct()
    whole = total.agg(F.array_sort(F.collect_list(F.struct(label, "tn", *[f"t_{c}" for c in columns]))).alias("all"))
    grid = folds.withColumn("all", whole.scalar())
    grid = grid.select(fold_column, F.inline("all"))
    own = cells.select(fold_column, label, F.col("n").alias("on"), *[F.col(c).alias(f"o_{c}") for c in columns])
    rest = grid.join(own, [fold_column, label], "left")
    left = F.col("tn") - F.coalesce("on", F.lit(0))
    means = rest.filter(left > 0).select(
        fold_column, F.struct(F.col(label).alias("label"), *[((F.col(f"t_{c}") - F.coalesce(f"o_{c}", F.lit(0.0))) / left).alias(c) for c in columns]).alias("m")
    )
    packed = means.groupBy(fold_column).agg(F.collect_list("m").alias("means"))

    def gap(m: Column) -> Column:
        return sum(((F.col(c) - m[c]) * (F.col(c) - m[c]) for c in columns[1:]), (F.col(columns[0]) - m[columns[0]]) * (F.col(columns[0]) - m[columns[0]]))

    best = F.array_min(F.transform("means", lambda m: F.struct(gap(m).alias("d"), m["label"].alias("label"))))
    return rows.join(packed, fold_column).withColumn("guess", best["label"]).drop("means")


# ---- recognition chain ----------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Configuration:
    """One setting of the recognition chain."""

    name: str = "basic"
    channels: tuple[str, ...] = ("x", "y", "z")
    classifier: str = "nearestClassCentroid"
    features: str = "VerySimple"
    size: int = 8
    step: int = 4
    feature_count: int | None = None


def chain_windows(frames: DataFrame, configuration: Configuration, channels: Sequence[str]) -> DataFrame:
    """Windows with features of the chosen channels, majority label and repetition block.

    ``frames``: subject, recording, pos, n, code, block and the channels.
    ``touched`` lists the blocks whose windows, from the first to the last,
    overlap the window in time.
    """
    keys = ["recording", "win"]
    size, step = configuration.size, configuration.step
    centre = size // 2
    # the windows of a block are those whose centre frame lies in it
    home = F.floor((F.col("pos") - centre) / step).cast("long")
    centres = frames.filter((F.col("pos") >= centre) & ((F.col("pos") - centre) % step == 0) & (home * step + size <= F.col("n")))
    spans = centres.groupBy("recording", "block").agg(F.min(home * step).alias("a"), F.max(home * step + size).alias("b"))
    first, last = touched_range(F.col("a"), F.col("b"), size, step)
    spans = spans.groupBy("recording").agg(F.collect_list(F.struct("block", first.alias("first"), last.alias("last"))).alias("spans"))
    packed = sliding_arrays(frames, ["recording"], [*channels, "code", "subject", "block"], size, step, extra=spans)
    over = F.filter("spans", lambda s: F.col("win").between(s["first"], s["last"]))
    own = {c: F.get(c, F.lit(centre)) for c in ("subject", "block")}
    packed = packed.withColumns({**own, "centre_code": F.get("code", F.lit(centre)), "code": majority_of(F.col("code"), centre), "touched": F.transform(over, lambda s: s["block"])})
    kept = [*keys, "code", "subject", "block", "centre_code", "touched"]
    table, _ = feat.typed_features(packed, kept, list(channels), configuration.features, {c: F.lit(0.0) for c in channels}, size, cepstral=min(10, size // 2 - 1))
    return table.withColumn("key", F.col("recording") * 1_000_000 + F.col("win"))


def rounds_of(table: DataFrame) -> list[dict]:
    """Held-out repetitions of every subject, then every ordered pair of subjects."""
    pairs = sorted((r["subject"], r["block"]) for r in table.select("subject", "block").distinct().collect())
    people = sorted({s for s, _ in pairs})
    out = [{"scheme": "personDependent", "test": s, "train": s, "block": b} for s, b in pairs]
    return out + [{"scheme": "personIndependent", "test": a, "train": b, "block": None} for a in people for b in people if a != b]


def split_round(table: DataFrame, plan: dict) -> tuple[DataFrame, DataFrame]:
    """Training and test windows of a round; windows that overlap the held-out block do not train."""
    if plan["block"] is None:
        return table.filter(F.col("subject") == plan["train"]), table.filter(F.col("subject") == plan["test"])
    mine = table.filter(F.col("subject") == plan["test"])
    other = mine.filter((F.col("block") != plan["block"]) & ~F.array_contains("touched", F.lit(plan["block"])))
    return other, mine.filter(F.col("block") == plan["block"])


def predict_round(table: DataFrame, plan: dict, configuration: Configuration) -> DataFrame:
    """Scale on the training windows, select features if asked, predict the test windows."""
    train, test = split_round(table, plan)
    (train, test), constant = prep.fit_standardise(train, test)
    if configuration.feature_count:
        ranking = prep.rank_by_redundancy(train, F.col("code"), configuration.feature_count)
        chosen = [r["feature"] for r in ranking.orderBy("place").collect()]
        train, test = prep.pick(train, chosen), prep.pick(test, chosen)
    guessed = CLASSIFIERS[configuration.classifier](train, test, "code")
    marks = [F.lit(v).alias(k) if v is not None else F.lit(None).cast("long").alias(k) for k, v in (("scheme", plan["scheme"]), ("train_subject", plan["train"]), ("held", plan["block"]))]
    return guessed.select("subject", "recording", "win", "code", "centre_code", F.col("guess").cast("long").alias("guess"), *marks, F.lit(constant).alias("constant_features"))


def frame_counts(frames: DataFrame, size: int, step: int, labels: Sequence[int]) -> DataFrame:
    """Frames of every block counted by nearest window (unclipped) and label: columns ``__t0``.. and, for labels not listed, ``__rest``."""
    counts = [F.count_if(F.col("code") == v).alias(f"__t{i}") for i, v in enumerate(labels)]
    rest = F.count_if(~F.coalesce(F.col("code").isin(list(labels)), F.lit(False))).alias("__rest")
    return frames.groupBy("recording", "block", nearest_unclipped(F.col("pos"), size, step).alias("near")).agg(*counts, rest)


def evaluate_configuration(table: DataFrame, counted: DataFrame, configuration: Configuration, labels: Sequence[int], null_label: int) -> DataFrame:
    """Frame and event scores of every round of one configuration, under both schemes.

    ``table``: chain windows; ``counted``: frames by their nearest window.
    """
    rounds = rounds_of(table)

    def one(number: int) -> DataFrame:
        guessed = predict_round(table, rounds[number], configuration)
        return guessed.select(F.lit(number).alias("round"), "recording", "win", "centre_code", "guess", "constant_features")

    flat = settle(union(in_parallel(one, range(len(rounds)))))
    marks = [(i, p["scheme"], p["test"], p["train"], -1 if p["block"] is None else p["block"]) for i, p in enumerate(rounds)]
    marks = table.sparkSession.createDataFrame(marks, "round int, scheme string, subject long, train_subject int, held long")
    keys = ["scheme", "subject", "train_subject", "held"]
    size, step = configuration.size, configuration.step
    ends = flat.groupBy("round", "recording").agg(F.min("win").alias("first"), F.max("win").alias("last"))
    ends = ends.join(F.broadcast(marks.select("round", "held")), "round")
    # Frames of a round: those of its held-out block, or all of the test subject's.
    rows = counted.join(ends, "recording").filter((F.col("held") == -1) | (F.col("block") == F.col("held")))
    near = F.greatest("first", F.least("last", "near"))
    columns = [*[f"__t{i}" for i in range(len(labels))], "__rest"]
    scored = rows.select("round", "recording", near.alias("win"), *columns).join(flat.select("round", "recording", "win", "guess"), ["round", "recording", "win"])
    sums = scored.groupBy("round", "guess").agg(*[F.sum(c).alias(c) for c in columns])
    cells = [F.struct(F.lit(v).cast("long").alias("truth"), F.col(c).alias("n")) for v, c in zip([*labels, None], columns)]
    counts = sums.select("round", "guess", F.inline(F.array(*cells))).filter("n > 0")
    by_frame = met.score_frames(met.pool(counts, ["round"]), labels, null_label, ["round"])
    events = met.pair_counts(flat, ["round"], "centre_code", "guess")
    by_event = met.score_frames(events, labels, null_label, ["round"])
    by_event = by_event.select("round", F.col("precision_all").alias("event_precision_all"), F.col("recall_all").alias("event_recall_all"))
    sizes = flat.groupBy("round").agg(F.count(F.lit(1)).alias("test_windows"), F.max("constant_features").alias("constant_features"))
    out = by_frame.join(by_event, "round").join(sizes, "round").join(marks, "round")
    setting = {"configuration": configuration.name, "channels": "+".join(configuration.channels), "features": configuration.features, "classifier": configuration.classifier}
    return out.select(*[F.lit(v).alias(k) for k, v in setting.items()], F.lit(size).alias("size"), F.lit(step).alias("step"), *keys, *[c for c in out.columns if c not in (*keys, "round")])


def sweep_configurations(frames: DataFrame, configurations: Sequence[Configuration], labels: Sequence[int], null_label: int) -> DataFrame:
    """Round tables of several configurations under one another; windows and frame counts that configurations share are built once."""
    tables, counted, out = {}, {}, []
    for c in configurations:
        grid = (c.size, c.step)
        if grid not in counted:
            counted[grid] = stored(frame_counts(frames, *grid, labels), "frame-counts")
        if (*grid, c.channels, c.features) not in tables:
            # a round reads the parts of its subjects and blocks
            tables[(*grid, c.channels, c.features)] = stored(chain_windows(frames, c, c.channels), "chain-windows", ["subject", "block"])
        out.append(evaluate_configuration(tables[(*grid, c.channels, c.features)], counted[grid], c, labels, null_label))
    return union(out)


def sweep_of(base: Configuration, field: str, values: Sequence) -> list[Configuration]:
    out = []
    for value in values:
        changes = {field: value}
        if field == "size":
            changes["step"] = min(value, base.step)
        out.append(replace(base, name=f"{field}={'+'.join(value) if isinstance(value, tuple) else value}", **changes))
    return out


# ---- window selection pilot ---------------------------------------------------------------------------------

def pilot(windows: DataFrame, labels: Sequence[int], folds: int = 5, trees: int = 100, budgets: Sequence[int] = bud.BUDGETS, methods: Sequence[str] = METHODS) -> tuple[DataFrame, DataFrame]:
    """Participant folds, a forest per fold, out-of-fold predictions, selections, curves and activity rows.

    ``windows``: stream, pos, who, code, features and the three scores.
    """
    plan = settle(fold.group_folds(windows, "who", folds))
    rows = settle(prep.to_vector(windows.join(plan, "who")).withColumn("label", F.col("code").cast("double")))

    def one(number: int) -> DataFrame:
        model = ens.random_forest(trees).fit(rows.filter(F.col("fold") != number))
        guessed = ens.guesses(model, rows.filter(F.col("fold") == number))
        return settle(guessed.select("stream", "pos", "fold", *bud.SCORES, F.col("code").cast("long").alias("truth"), F.col("guess").cast("long").alias("full")))

    # the driver holds a forest while it grows and predicts, so there is one at a time
    predicted = union([one(number) for number in range(folds)])
    thresholds = bud.trigger_thresholds(predicted, range(folds), budgets)
    runs, activities = bud.score_selection(bud.final_predictions(predicted, thresholds, methods, budgets), labels)
    return bud.average_seeds(runs), bud.average_activities(activities)


# ---- protocol comparison --------------------------------------------------------------------------------------

def run_folds(rows: DataFrame, variant: str, protocol: str, classifiers: Sequence[str], folds: int, labels: Sequence[int], keep: int | None = None) -> DataFrame:
    """Score of every classifier on every fold: select and scale inside the training rows, fit, predict.

    ``rows``: key, who, code, features.
    """
    placed = settle(PROTOCOLS[protocol](rows, folds))
    numbers = sorted(r[0] for r in placed.select("fold").distinct().collect())

    def one(job: tuple[int, str]) -> DataFrame:
        number, classifier = job
        train, test = placed.filter(F.col("fold") != number), placed.filter(F.col("fold") == number)
        if keep:
            columns = prep.best_features(prep.anova_f(train, "code"), keep)
            train, test = prep.pick(train, columns), prep.pick(test, columns)
        (train, test), _ = prep.fit_standardise(train, test)
        guessed = CLASSIFIERS[classifier](train, test, "code")
        return guessed.select(F.lit(classifier).alias("classifier"), F.lit(number).alias("fold"), F.col("code").alias("truth"), F.col("guess").cast("long").alias("guess"))

    guessed = settle(union(in_parallel(one, [(n, c) for n in numbers for c in classifiers])))
    keys = ["classifier", "fold"]
    scores = met.score_fold(met.pair_counts(guessed, keys), labels, keys)
    return scores.select(F.lit(variant).alias("variant"), F.lit(protocol).alias("protocol"), "*")


def run_clusters(rows: DataFrame, protocol: str, models: Sequence[str], folds: int, clusters: int, labels: Sequence[int]) -> DataFrame:
    """Clusters fitted on the training rows of every fold, matched to labels there, scored on the test rows."""
    placed = settle(PROTOCOLS[protocol](rows, folds))
    numbers = sorted(r[0] for r in placed.select("fold").distinct().collect())
    parts = []
    for number in numbers:
        (train, test), _ = prep.fit_standardise(placed.filter(F.col("fold") != number), placed.filter(F.col("fold") == number))
        train, test = settle(prep.to_vector(train)), prep.to_vector(test)
        for name in models:
            if name == "kMeans":
                model = ens.best_kmeans(train, clusters, 2)
                a, b = (ens.guesses(model, df).withColumnRenamed("guess", "cluster") for df in (train, test))
            else:
                mixture, _ = seq.fit_mixture(train, parts=clusters, rounds=5)
                a, b = (df.withColumn("cluster", seq.mixture_part(mixture, F.col("features"))) for df in (train, test))
            matched = ens.match_clusters(a, "cluster", "code").withColumnRenamed("code", "guess")
            parts.append(b.join(matched, "cluster", "left").select(F.lit(name).alias("classifier"), F.lit(number).alias("fold"), F.col("code").alias("truth"), F.coalesce(F.col("guess"), F.lit(labels[0])).cast("long").alias("guess")))
    guessed = settle(union(parts))
    keys = ["classifier", "fold"]
    return met.score_fold(met.pair_counts(guessed, keys), labels, keys)


# ---- grid search and workflows ------------------------------------------------------------------------------------

def grid_search(train: DataFrame, test: DataFrame, costs: Sequence[float], gammas: Sequence[float], folds: str, width: int, count: int = 256, iterations: int = 100) -> tuple[DataFrame, DataFrame]:
    """Kernel machine of all labels tuned by group folds: mean, population deviation and place of macro F1, then a refit of the first best cell."""
    spark = train.sparkSession
    table, machine = kernel_grid.tune(train, costs, gammas, folds, width, count, iterations=iterations)
    accuracy, f1 = ens.score(kernel_grid.guess_labels(test, machine))
    best = next(row for row in table if row[4] == 1)
    frame = spark.createDataFrame(table, "cost double, gamma double, macro_f1_mean double, macro_f1_std double, place int")
    return frame, spark.createDataFrame([(*best[:3], accuracy, f1)], "cost double, gamma double, macro_f1_mean double, test_accuracy double, test_macro_f1 double")


def workflow_scores(train: DataFrame, test: DataFrame, folds: str, iterations: int = 50, components: int = 5) -> DataFrame:
    """Standardise-then-discriminant and joined-feature-blocks workflows by group folds and on the test rows."""

    def discriminant(a: DataFrame, b: DataFrame) -> tuple[float, float]:
        (a, b), _ = prep.fit_standardise(a, b)
        return ens.score(closed.linear_discriminant(a, b, "label"))

    def blocks(a: DataFrame, b: DataFrame) -> tuple[float, float]:
        (a, b), _ = prep.fit_standardise(a, b)
        a, b = prep.joined_blocks(a, b, "label", components)
        return ens.fit_and_score(prep.logistic(a.count(), iterations), a, b)[1:]

    numbers = sorted(r[0] for r in train.select(folds).distinct().collect())
    out = []
    for name, work in (("standardise, discriminant", discriminant), ("standardise, joined blocks, logistic", blocks)):
        scores = in_parallel(lambda n, work=work: work(train.filter(F.col(folds) != n), train.filter(F.col(folds) == n))[1], numbers)
        accuracy, f1 = work(train, test)
        out.append((name, float(np.mean(scores)), float(np.std(scores, ddof=1)), accuracy, f1))
    return train.sparkSession.createDataFrame(out, "workflow string, fold_macro_f1_mean double, fold_macro_f1_std double, test_accuracy double, test_macro_f1 double")


def compare_learners(train: DataFrame, test: DataFrame, learners: dict[str, object]) -> DataFrame:
    """Test accuracy and macro F1 of several learners."""
    scores = in_parallel(lambda item: (item[0], *ens.fit_and_score(item[1], train, test)[1:]), list(learners.items()))
    return train.sparkSession.createDataFrame(scores, "model string, test_accuracy double, test_macro_f1 double")


def compare_regressors(train: DataFrame, test: DataFrame, learners: dict[str, object]) -> DataFrame:
    parts = [
        met.regression_scores(ens.guesses(model.fit(train), test), F.col("label"), F.col("guess")).select(F.lit(name).alias("model"), "*")
        for name, model in learners.items()
    ]
    return union(parts)


def compare_clusterings(rows: DataFrame, models: dict[str, object], label: str) -> DataFrame:
    """Adjusted Rand index of several clusterings against the labels."""
    parts = []
    for name, model in models.items():
        counts = met.pair_counts(ens.guesses(model, rows), truth=label, guess="guess")
        parts.append(met.adjusted_rand(counts).select(F.lit(name).alias("method"), "*"))
    return union(parts)


# ---- participant identification ------------------------------------------------------------------------------------

def identify_participants(windows: DataFrame, activities: Sequence[str], learner, folds: int = 4, test_share: float = 0.25) -> DataFrame:
    """Participants told apart within each activity: random split against held-out bouts, with leaked neighbours counted.

    ``windows``: key, row, bout, who, activity, features. The models of all
    activities and splits are fitted together (``learner.fit_groups``).
    """

    def prepared(activity: str) -> tuple:
        rows = windows.filter(F.col("activity") == activity)
        codes = prep.label_codes(rows, "who")
        rows = settle(prep.to_vector(rows.join(codes, "who")).withColumn("label", F.col("code").cast("double")))
        total = rows.count()
        split = settle(fold.stratified_split(rows, "who", "key", F.lit(float(np.ceil(test_share * total))), name="part"))
        leaked = neighbour_leakage(split.select("bout", "row", "part"), "bout", "row", F.col("part") == "Train").count()
        held = settle(rows.join(fold.group_folds(rows, "bout", folds, strata="who"), "bout"))
        numbers = sorted(r[0] for r in held.select("fold").distinct().collect())
        return total, codes.count(), split, leaked, held, numbers

    tables = in_parallel(prepared, activities)
    starts = np.cumsum([0, *[1 + len(t[5]) for t in tables]])
    train = []
    for (*_, split, _leaked, held, numbers), first in zip(tables, starts.tolist()):
        train.append(split.filter("part = 'Train'").select(F.lit(first).alias("model"), "vector", "label"))
        others = [F.when(F.col("fold") != number, F.lit(first + 1 + i)) for i, number in enumerate(numbers)]
        train.append(held.select(F.explode(F.array_compact(F.array(*others))).alias("model"), "vector", "label"))
    models = learner.fit_groups(union(train), "model")

    def scored(at: int) -> tuple:
        total, participants, split, leaked, held, numbers = tables[at]
        first = int(starts[at])
        test = split.filter("part = 'Test'")
        accuracy, f1 = ens.score(ens.guesses(models[first], test))

        def one(i: int) -> tuple[float, float, int]:
            a, b = held.filter(F.col("fold") != numbers[i]), held.filter(F.col("fold") == numbers[i])
            unseen = b.select("who").distinct().join(a.select("who").distinct(), "who", "left_anti").count()
            return (*ens.score(ens.guesses(models[first + 1 + i], b)), unseen)

        scores = np.array([one(i) for i in range(len(numbers))])
        deviation = scores.std(axis=0, ddof=1) if len(scores) > 1 else np.full(3, np.nan)
        return (
            activities[at], total, split.count() - test.count(), test.count(), participants, accuracy, f1, leaked, len(numbers), float(scores[:, 0].mean()), float(deviation[0]),
            float(scores[:, 1].mean()), float(deviation[1]), int(scores[:, 2].sum()),
        )

    schema = (
        "activity string, windows long, train_windows long, test_windows long, participants long, accuracy double, macro_f1 double, leaked_test_windows long, "
        "held_out_folds int, held_out_accuracy double, held_out_accuracy_std double, held_out_macro_f1 double, held_out_macro_f1_std double, unseen_participants long"
    )
    return windows.sparkSession.createDataFrame(in_parallel(scored, range(len(activities))), schema)


# ---- inventories ---------------------------------------------------------------------------------------------------

def segment_inventory(runs: DataFrame, blocks: DataFrame, keys: Sequence[str], rate: float, null_label: str, gestures: Sequence[str], shortest: float, longest: float) -> DataFrame:
    """Segment durations per class, and whether every block of the recording holds each gesture once."""
    table = clean.segment_durations(clean.segments(runs, keys), keys, rate, shortest=shortest, longest=longest)
    held = clean.check_blocks(blocks, keys, null_label, gestures)
    every = blocks.select(*keys, "block").distinct().join(held, [*keys, "block"], "left")
    whole = every.groupBy(*keys).agg(F.bool_and(F.coalesce("complete", F.lit(False))).alias("blocks_complete"))
    return table.join(whole, list(keys))


def describe_study(vectors: DataFrame, label: str, split: str, splits: Sequence[str], skew: float, correlation: float) -> DataFrame:
    """Class shares, feature statistics and skew and correlation counts as (table, entry, value) rows."""
    classes = agg.class_distribution(vectors, label, split, splits)
    first = union([classes.select(F.lit("classes").alias("table"), F.concat_ws(" ", F.lit(s), F.col(label).cast("string")).alias("entry"), F.col(f"{s}_share").alias("value")) for s in splits])
    long = vectors.select(F.posexplode("features").alias("feature", "x"))
    stats = agg.describe(long, "feature", "x")
    second = union([stats.select(F.lit("statistics").alias("table"), F.concat_ws(" ", F.lit(m), F.col("feature").cast("string")).alias("entry"), F.col(m).cast("double").alias("value")) for m in ("mean", "median", "skew")])
    counts = agg.correlation_counts(vectors, "features", skew, correlation)
    third = union([counts.select(F.lit("counts").alias("table"), F.lit(m).alias("entry"), F.col(m).cast("double").alias("value")) for m in counts.columns])
    return union([first, second, third])

