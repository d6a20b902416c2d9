"""Gradient boosting over many classes: one softmax for all, one histogram pass a level.

A level of the trees of all classes, and of all groups of rows that have a model
of their own, is one Spark job. Rows lie in blocks of one group. Tasks add up
counts, gradients and curvatures by (class, node, feature, bin); one exchange by
node brings these sums together, where the best cut is taken; the driver sees
one row a node.

Gradients are added as integers (units of 2**-24), so sums, cuts and models do
not depend on how rows are split over tasks; counts may reach 2**39 rows.
A task holds ``HISTOGRAM`` bytes of cells: wider levels take the classes in turn.

Rows without features or label take no part in a fit, rows without features are
guessed null. NaN goes right of every cut. Ties: lowest label, feature and bin.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.session import settle

UNIT = float(1 << 24)
HISTOGRAM = 64 << 20
#: Rows that pass through all trees at once, and levels of trees whose nodes are compared one by one.
SLICE, SHALLOW = 1 << 14, 6
#: Rows of a block at most and its bytes.
ROWS, BLOCK = 1 << 15, 4 << 20


def numbers(column: str) -> Column:
    """A vector as an array, null where there is none."""
    return F.when(F.col(column).isNotNull(), vector_to_array(F.col(column)))


def route(values: np.ndarray, features: np.ndarray, cuts: np.ndarray, levels: int) -> np.ndarray:
    """Node (0.. in its level) of every row in every tree after ``levels`` cuts; trees are heaps, cut -1 stays left."""
    columns = np.ascontiguousarray(values.T)
    found = [node_of(columns, f, c, levels) for f, c in zip(features, cuts)]
    return np.stack(found, axis=1) if found else np.zeros((len(values), 0), dtype=np.int64)


def node_of(columns: np.ndarray, features: np.ndarray, cuts: np.ndarray, levels: int) -> np.ndarray:
    """Node of every row (a column of ``columns``) in one tree.

    A shallow tree is worked out from its lowest level up: every cut is one
    comparison over all rows, and picks the place from its two sides.
    """
    count = columns.shape[1]
    if levels > SHALLOW:
        node, rows = np.zeros(count, dtype=np.int64), np.arange(count)
        for level in range(levels):
            place = node + (1 << level) - 1
            feature = features[place]
            node = 2 * node + ((feature >= 0) & ~(columns[np.maximum(feature, 0), rows] <= cuts[place]))
        return node
    below: list = list(np.arange(1 << levels, dtype=np.uint8))
    features, cuts = features.tolist(), cuts.tolist()  # plain numbers leave the columns in their narrow type
    for level in reversed(range(levels)):
        own = (1 << level) - 1
        for i in range(1 << level):
            left, right = below[2 * i], below[2 * i + 1]
            if features[own + i] >= 0:
                to_left = -(columns[features[own + i]] <= cuts[own + i]).view(np.uint8)  # 255 or 0
                to_left &= left ^ right
                to_left ^= right
                left = to_left
            below[i] = left
    return np.broadcast_to(below[0], count)


def add_trees(margin: np.ndarray, values: np.ndarray, features: np.ndarray, cuts: np.ndarray, leaves: np.ndarray) -> None:
    """Add the leaves of rounds x classes trees to the margins, round after round."""
    rounds, classes, width = leaves.shape
    for start in range(0, len(values) if rounds else 0, SLICE):
        part = slice(start, start + SLICE)
        columns, moved = np.ascontiguousarray(values[part].T), np.ascontiguousarray(margin[part].T)
        for i in range(rounds):
            for c in range(classes):
                moved[c] += leaves[i, c].take(node_of(columns, features[i, c], cuts[i, c], width.bit_length() - 1))
        margin[part] = moved.T


def slopes(margin: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and curvatures of the softmax loss in integer units."""
    classes = margin.shape[1]
    share = np.ascontiguousarray(margin.T)
    share = np.exp(share - share.max(axis=0))
    share /= share.sum(axis=0)
    gradient = share.copy()
    gradient[label, np.arange(len(label))] -= 1
    curvature = share * (1 - share) * (classes / max(classes - 1, 1))
    return np.rint(gradient * UNIT).T, np.rint(curvature * UNIT).T


@dataclass
class SoftmaxTrees:
    """Fitted trees: arrays of rounds x classes x heap places; ``leaves`` already hold the learning rate."""

    prior: np.ndarray
    features: np.ndarray
    bins: np.ndarray
    cuts: np.ndarray
    gains: np.ndarray
    leaves: np.ndarray
    column: str

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction``, the label with the largest margin."""
        prior, features, cuts, leaves = self.prior, self.features, self.cuts, self.leaves

        @F.pandas_udf("double")
        def label(vectors: pd.Series) -> pd.Series:
            out = np.full(len(vectors), np.nan)
            there = vectors.notna().to_numpy()
            if there.any():
                values = np.array(vectors[there].tolist(), dtype=np.float64)
                margin = np.tile(prior, (len(values), 1))
                add_trees(margin, values, features, cuts, leaves)
                out[there] = margin.argmax(axis=1)
            return pd.Series(out).astype("Float64").mask(~there)

        return df.withColumn("prediction", label(numbers(self.column)))

    def importances(self, spark: SparkSession, width: int) -> DataFrame:
        """Split counts and summed gains of every feature, 0 for unused ones."""
        used = self.features >= 0
        splits = np.bincount(self.features[used], minlength=width)
        gain = np.bincount(self.features[used], weights=self.gains[used], minlength=width)
        return spark.createDataFrame([(i, int(splits[i]), float(gain[i])) for i in range(width)], "feature int, splits long, gain double")


@dataclass(frozen=True)
class Part:
    """A group of a fit: its first tree in a round, classes, margins of no trees, bin edges and first cells of its features."""

    first: int
    classes: int
    prior: np.ndarray
    edges: list[np.ndarray]
    starts: np.ndarray

    @property
    def row(self) -> int:
        """Bytes of a row."""
        return 8 * self.classes + len(self.edges) + 4


@dataclass(frozen=True)
class SoftmaxBoosting:
    """Learner: ``fit`` takes ``features`` (vector) and ``label`` (0.. as a number).

    Trees grow level by level to ``depth``. A cut leaves at least ``least_rows``
    rows and ``least_weight`` of curvature on both sides. Cuts are values of the
    ``bins``-quantiles (256 at most) of a feature. Margins are written every
    ``settle_every`` rounds, which cuts the plan. No labelled row is an error.
    """

    rounds: int = 100
    depth: int = 5
    rate: float = 0.1
    bins: int = 255
    least_rows: int = 20
    least_weight: float = 1e-3
    penalty: float = 0.0
    settle_every: int = 5
    features: str = "vector"

    def fit(self, df: DataFrame) -> SoftmaxTrees:
        found = self.fit_groups(df.withColumn("__group", F.lit(0)), "__group")
        if not found:
            raise ValueError("labels must be numbers from 0, at least one row")
        return found[0]

    def fit_groups(self, df: DataFrame, group: str) -> dict[int, SoftmaxTrees]:
        """A model for the rows of every value of ``group`` (a number), the same as fitted alone; a level of all of them is one job."""
        if not 2 <= self.bins <= 256:
            raise ValueError("bins must be 2 to 256")
        known = df.select(F.col(group).cast("int").alias("group"), numbers(self.features).alias("x"), F.col("label").cast("int").alias("label"))
        known = known.filter("group IS NOT NULL AND x IS NOT NULL AND label IS NOT NULL")
        sizes: dict[int, dict[int, int]] = {}
        for r in known.groupBy("group", "label").agg(F.count(F.lit(1)).alias("n")).collect():
            sizes.setdefault(r["group"], {})[r["label"]] = r["n"]
        if any(min(n) < 0 for n in sizes.values()):
            raise ValueError("labels must be numbers from 0, at least one row")
        if not sizes:
            return {}
        edges, first, parts = bin_edges(known, self.bins), 0, {}
        for g, n in sorted(sizes.items()):
            classes, total = max(n) + 1, sum(n.values())
            prior = np.log([max(n.get(c, 0) / total, 1e-15) for c in range(classes)])
            parts[g] = Part(first, classes, prior, edges[g], np.cumsum([0, *[len(e) + 1 for e in edges[g]]]))
            first += classes
        rows = settle(self.blocks(known, parts, sum(sum(n.values()) * parts[g].row for g, n in sizes.items())))

        places, width = (1 << self.depth) - 1, 1 << self.depth
        shape = (self.rounds, first)
        features, bins = np.full((*shape, places), -1), np.full((*shape, places), -1)
        gains, leaves = np.zeros((*shape, places)), np.zeros((*shape, width))
        done = 0
        for i in range(self.rounds):
            if i - done >= self.settle_every:
                rows = settle(rows.mapInArrow(stepper((features[done:i], bins[done:i], leaves[done:i]), parts), rows.schema))
                done = i
            before = (features[done:i], bins[done:i], leaves[done:i])
            self.grow(rows, before, features[i], bins[i], gains[i], leaves[i], parts)
        out = {}
        for g, part in parts.items():
            mine = [v[:, part.first : part.first + part.classes] for v in (features, bins, gains, leaves)]
            cuts = np.full(mine[0].shape, -np.inf)
            for f, values in enumerate(part.edges):
                of_f = mine[0] == f
                cuts[of_f] = values[mine[1][of_f]]
            out[g] = SoftmaxTrees(part.prior, mine[0], mine[1], cuts, mine[2], mine[3], self.features)
        return out

    def blocks(self, known: DataFrame, parts: dict[int, Part], size: int) -> DataFrame:
        """Rows in blocks of one group, dealt evenly so that a task sees few groups."""
        cores = known.sparkSession.sparkContext.defaultParallelism
        salt = F.pmod(F.xxhash64("x", F.spark_partition_id()), F.lit(1 << 12))
        dealt = known.withColumn("salt", salt).repartitionByRange(max(cores, -(-size // (16 * BLOCK))), "group", "salt").sortWithinPartitions("group")
        return dealt.select("group", "x", "label").mapInArrow(coder(parts), "group int, code binary, label binary, margin binary")

    def grow(self, rows: DataFrame, before: tuple, features: np.ndarray, bins: np.ndarray, gains: np.ndarray, leaves: np.ndarray, parts: dict[int, Part]) -> None:
        """One tree for every class of every group, filled into the given arrays."""
        trees, width = leaves.shape
        cells = np.concatenate([[int(p.starts[-1])] * p.classes for p in parts.values()])
        is_open = np.ones((trees, 1), dtype=bool)
        for level in range(self.depth):
            nodes = 1 << level
            opened = np.zeros((trees, 2 * nodes), dtype=bool)
            turn = np.cumsum(cells * nodes * 24) // HISTOGRAM
            for t in np.unique(turn):
                chosen = np.flatnonzero((turn == t) & is_open.any(axis=1))
                if not len(chosen):
                    continue
                found = rows.mapInArrow(adder(before, features, bins, is_open, chosen, level, parts), "tree int, places binary, sums binary")
                for cut in self.best_cuts(found, parts, nodes).collect():
                    c, node = divmod(cut["tree"], nodes)
                    span = width >> level
                    if level == 0:
                        leaves[c] = self.leaf(cut["tg"], cut["th"])
                    if cut["gain"] <= 0:
                        continue
                    place = nodes - 1 + node
                    features[c, place], bins[c, place], gains[c, place] = cut["feature"], cut["bin"], cut["gain"]
                    opened[c, 2 * node : 2 * node + 2] = True
                    middle = node * span + span // 2
                    leaves[c, node * span : middle] = self.leaf(cut["lg"], cut["lh"])
                    leaves[c, middle : (node + 1) * span] = self.leaf(cut["tg"] - cut["lg"], cut["th"] - cut["lh"])
            is_open = opened

    def leaf(self, gradient: int, curvature: int) -> float:
        weight = curvature / UNIT + self.penalty
        return -self.rate * (gradient / UNIT) / weight if weight > 0 else 0.0

    def best_cuts(self, cells: DataFrame, parts: dict[int, Part], nodes: int) -> DataFrame:
        """Best cut of every node; gain -1 where none is allowed. A tree's cells meet in one task, ``HISTOGRAM`` bytes at most for all."""
        least, weight, penalty = max(self.least_rows, 1), self.least_weight, self.penalty
        starts_of = [p.starts for p in parts.values() for _ in range(p.classes)]

        def best(tree: int, sums: np.ndarray) -> tuple:
            starts = starts_of[tree // nodes]
            firsts = np.repeat(starts[:-1], np.diff(starts))
            whole = sums[:, : starts[1]].sum(axis=1, keepdims=True)
            running = np.concatenate([np.zeros((3, 1), dtype=np.int64), np.cumsum(sums, axis=1)], axis=1)
            left = running[:, 1:] - running[:, firsts]
            right = whole - left
            allowed = (np.minimum(left[0], right[0]) >= least) & (np.minimum(left[2], right[2]) / UNIT >= weight)
            with np.errstate(divide="ignore", invalid="ignore"):
                a, b, c = ((v[1] / UNIT) ** 2 / (v[2] / UNIT + penalty) for v in (left, right, whole))
                gain = np.where(allowed, (a + b - c) / 2, -1.0)
            gain = np.where(np.isfinite(gain), gain, -1.0)
            i = int(gain.argmax())
            feature = int(np.searchsorted(starts, i, side="right")) - 1
            return (tree, feature, i - int(starts[feature]), float(gain[i]), *left[1:, i].tolist(), *whole[1:, 0].tolist())

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                for tree, places, values in zip(*(column.to_pylist() for column in batch.columns)):
                    sums = held.setdefault(tree, np.zeros((3, int(starts_of[tree // nodes][-1])), dtype=np.int64))
                    sums[:, np.frombuffer(places, dtype=np.int32)] += np.frombuffer(values, dtype=np.int64).reshape(3, -1)
            if held:
                found = zip(*(best(tree, sums) for tree, sums in sorted(held.items())))
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(found, [pa.int32()] * 3 + [pa.float64()] + [pa.int64()] * 4)], ["tree", "feature", "bin", "gain", "lg", "lh", "tg", "th"])

        dealt = cells.repartition("tree")
        return dealt.mapInArrow(work, "tree int, feature int, bin int, gain double, lg long, lh long, tg long, th long")


def bin_edges(known: DataFrame, bins: int) -> dict[int, list[np.ndarray]]:
    """Upper edges of the bins of every group's features, without its largest value: groups x features x bins numbers."""
    long = known.select("group", F.posexplode("x").alias("feature", "v"))
    number = F.when(F.isnan("v"), None).otherwise(F.col("v"))
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    table = long.groupBy("group", "feature").agg(F.percentile_approx(number, shares, 10_000).alias("q"), F.max(number).alias("top")).collect()
    out: dict[int, list[np.ndarray]] = defaultdict(list)
    for r in sorted(table, key=lambda r: (r["group"], r["feature"])):
        values = np.unique(np.array(r["q"] or [], dtype=np.float64))
        out[r["group"]].append(values[values < r["top"]] if r["top"] is not None else values)
    return out


def unpack(code: bytes, label: bytes, margin: bytes, part: Part) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes by feature, labels and margins by row of a block."""
    label = np.frombuffer(label, dtype=np.int32)
    return np.frombuffer(code, dtype=np.uint8).reshape(-1, len(label)), label, np.frombuffer(margin, dtype=np.float64).reshape(len(label), -1).copy()


def coder(parts: dict[int, Part]):
    """Blocks of rows with one byte a feature, with the margins of no trees."""

    def block(group: int, x: list[np.ndarray], label: list[np.ndarray]) -> pa.RecordBatch:
        part, values, labels = parts[group], np.concatenate(x), np.concatenate(label)
        code = np.empty(values.shape[::-1], dtype=np.uint8)
        for f, cuts in enumerate(part.edges):
            code[f] = np.searchsorted(cuts, values[:, f], side="left")
        margin = np.tile(part.prior, (len(labels), 1))
        row = [[group], [code.tobytes()], [labels.astype(np.int32).tobytes()], [margin.tobytes()]]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["group", "code", "label", "margin"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, x, label, held = None, [], [], 0
        for batch in batches:
            group, labels = (batch.column(i).to_numpy() for i in (0, 2))
            for g in dict.fromkeys(group.tolist()):
                at = np.flatnonzero(group == g)
                mine = batch.column(1).slice(at[0], len(at))
                values = mine.flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1)
                most = max(1, min(ROWS, BLOCK // parts[g].row))
                for start in range(0, len(at), most):
                    if held and (g != now or held + min(most, len(at) - start) > most):
                        yield block(now, x, label)
                        x, label, held = [], [], 0
                    now = g
                    x.append(values[start : start + most])
                    label.append(labels[at[start : start + most]])
                    held += len(x[-1])
        if held:
            yield block(now, x, label)

    return work


def each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(column[i].as_py() for column in batch.columns)


def stepper(before: tuple, parts: dict[int, Part]):
    """Margins with the trees of the last rounds added."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, code, label, margin in each_block(batches):
            part = parts[group]
            columns, _, moved = unpack(code, label, margin, part)
            add_trees(moved, columns.T, *(v[:, part.first : part.first + part.classes] for v in before))
            row = [[group], [code], [label], [moved.tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["group", "code", "label", "margin"])

    return work


def adder(before: tuple, features: np.ndarray, bins: np.ndarray, is_open: np.ndarray, chosen: np.ndarray, level: int, parts: dict[int, Part]):
    """Cells of the chosen trees' open nodes, added up over the blocks of a group in a task."""
    features, bins, is_open, wanted = features.copy(), bins.copy(), is_open.copy(), set(chosen.tolist())
    nodes = 1 << level

    def add(part: Part, sums: dict[int, np.ndarray], code: bytes, label: bytes, margin: bytes) -> None:
        columns, label, margin = unpack(code, label, margin, part)
        add_trees(margin, columns.T, *(v[:, part.first : part.first + part.classes] for v in before))
        gradient, curvature = slopes(margin, label)
        wide = columns.astype(np.int64)
        for tree, cells in sums.items():
            node = node_of(columns, features[tree], bins[tree], level).astype(np.int64)
            weights = (None, *(np.ascontiguousarray(w[:, tree - part.first]) for w in (gradient, curvature)))
            for f, (start, end) in enumerate(zip(part.starts[:-1].tolist(), part.starts[1:].tolist())):
                cell = node * (end - start) + wide[f]
                for j, w in enumerate(weights):
                    cells[j, :, start:end] += np.bincount(cell, w, nodes * (end - start)).astype(np.int64).reshape(nodes, -1)

    def told(sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for tree, cells in sums.items():
            for node in np.flatnonzero(cells[0].any(axis=1) & is_open[tree]):
                place = np.flatnonzero(cells[0, node])
                row = [[tree * nodes + int(node)], [place.astype(np.int32).tobytes()], [cells[:, node, place].tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, (pa.int32(), pa.binary(), pa.binary()))], ["tree", "places", "sums"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, {}
        for group, code, label, margin in each_block(batches):
            part = parts[group]
            if group != now:
                yield from told(sums)
                mine = [t for t in range(part.first, part.first + part.classes) if t in wanted]
                now, sums = group, {t: np.zeros((3, nodes, int(part.starts[-1])), dtype=np.int64) for t in mine}
            if sums:
                add(part, sums, code, label, margin)
        yield from told(sums)

    return work
