"""Exact nearest neighbours without comparing every pair.

Rows are put into cells around pivots. A test row first meets the cell of its
own pivot, and the k nearest there bound how far the k nearest of all can be. The
triangle inequality and the planes halfway between pivots tell which other cells
reach below that bound; only those meet the row as well. Cells are cut into
blocks of bounded size on both sides, so a cell with a third of all rows is
spread over many tasks, and each pair of blocks returns only k rows per test
row. Some training rows that every task knows (landmarks) give a first bound: a
pair of blocks only looks at pairs below the bound.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from strideframe.functions.scalars import spread_order
from strideframe.session import settle

#: Cells at least and at most, and the training rows for which there is one more.
PIVOTS, MOST_PIVOTS, CELL_ROWS = 64, 512, 4096
#: Training rows whose distances bound those of the k nearest; the first ones are the pivots.
LANDMARKS = 2048
#: Rows and bytes of a block at most: a row is sent once for each block of the other side that it meets.
BLOCK_ROWS, BLOCK_BYTES = 1 << 16, 16 << 20
#: Pairs of a few test rows and a block whose rough distances are taken at once, such test rows at most, and their near pairs whose distances are taken at once.
TILE, TILE_ROWS = 1 << 21, 256
TILE_PAIRS = 1 << 14


def distances(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    squares = (rows**2).sum(axis=1)[:, None] + (points**2).sum(axis=1)[None, :] - 2 * rows @ points.T
    return np.sqrt(np.maximum(squares, 0.0))


def matrix(values: pa.Array) -> np.ndarray:
    """Rows of an Arrow array of equally long lists."""
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(values), -1 if len(values) else 0)


def rows_of_block(width: int) -> int:
    """Rows of ``width`` features in a block."""
    return max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * (width + 3))))


def upper_bounds(test: np.ndarray, landmarks: np.ndarray, k: int) -> np.ndarray:
    """Squared distance of every test row to its k-th nearest landmark or farther, infinite without k of them."""
    bounds = np.full(len(test), np.inf)
    if k <= len(landmarks):
        for first in range(0, len(test), TILE_ROWS):
            a = test[first : first + TILE_ROWS]
            some = np.argpartition(distances(a, landmarks), k - 1, axis=1)[:, :k]
            exact = ((landmarks[some] - a[:, None, :]) ** 2).sum(axis=2).max(axis=1)
            bounds[first : first + TILE_ROWS] = np.where(np.isnan(exact), np.inf, exact)
    return bounds


def reachable_cells(to_pivots: np.ndarray, radius: np.ndarray, sizes: np.ndarray, k: int, known: np.ndarray | float = np.inf, scale: np.ndarray | float = 0.0) -> np.ndarray:
    """Mask (test rows, cells) of the cells that may hold one of the k nearest training rows.

    ``known`` bounds their distance as well; ``scale`` is the length of the rows, for rounding.
    """
    far = to_pivots + radius
    order = np.argsort(far, axis=1)
    enough = np.argmax(np.cumsum(sizes[order], axis=1) >= min(k, sizes.sum()), axis=1)
    bound = np.minimum(far[np.arange(len(far)), order[np.arange(len(far)), enough]], known)
    slack = 1e-7 * (1 + bound + scale)
    return (to_pivots - radius <= (bound + slack)[:, None]) & (sizes > 0)


def crossed_cells(to_pivots: np.ndarray, home: np.ndarray, gaps: np.ndarray, reach: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Mask (test rows, cells) of the cells whose side of the plane between their pivot and the row's own is within ``reach``.

    ``gaps`` are distances between pivots; ``scale`` bounds the squared length of the rows on both sides, for rounding.
    """
    squares = to_pivots**2
    own = squares[np.arange(len(home)), home]
    return squares - own[:, None] <= 2 * gaps[home] * reach[:, None] + 1e-11 * scale[:, None]


def nearest_in_block(train: np.ndarray, keys: np.ndarray, test: np.ndarray, k: int, bounds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Test row, training row and distance of the k nearest training rows of every test row, by (distance, key).

    ``bounds`` are squared distances beyond which no training row is asked for.
    """
    k = min(k, len(train))
    bounds = np.full(len(test), np.inf) if bounds is None else bounds
    squares = (train**2).sum(axis=1)
    most = squares[np.isfinite(squares)].max(initial=0.0)
    # (a, 1) times (-2 b, b b) is the squared distance of a and b but for a a
    turned = np.vstack([-2 * train.T, squares])
    found = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))]
    tile = max(1, min(TILE_ROWS, TILE // max(len(train), 1)))
    for first in range(0, len(test), tile):
        a = test[first : first + tile]
        own = (a**2).sum(axis=1)
        slack = 1e-12 * (own + most)
        rough = np.column_stack([a, np.ones(len(a))]) @ turned
        near = rough <= (bounds[first : first + tile] * (1 + 1e-12) + slack - own)[:, None]
        if np.count_nonzero(near) > TILE_PAIRS:  # bounds that say little: the k nearest of this block say more
            limit = np.partition(rough, k - 1, axis=1)[:, k - 1]
            near &= rough <= (limit + 2 * slack)[:, None]
        places = np.flatnonzero(near)
        all_i, all_j = np.divmod(places, len(train))
        upto = (np.cumsum(np.bincount(all_i, minlength=len(a))) // TILE_PAIRS)[all_i]  # many ties: fewer rows at once
        for piece in np.unique(upto):
            i, j = all_i[upto == piece], all_j[upto == piece]
            exact = ((train[j] - a[i]) ** 2).sum(axis=1)
            best = np.lexsort((keys[j], exact, i))
            i, j, exact = i[best], j[best], exact[best]
            kept = np.arange(len(i)) - np.searchsorted(i, i) < k
            found.append((first + i[kept], j[kept], exact[kept]))
    return tuple(np.concatenate(part) for part in zip(*found))


def nearest(train: DataFrame, test: DataFrame, key: str, label: str, k: int, features: str = "features", pivots: int | None = None, block: int | None = None) -> DataFrame:
    """(key, place, neighbour, neighbour_label, distance): the k nearest training rows of each test row.

    ``distance`` is the squared Euclidean distance; ties go to the lower training key.
    """
    spark = train.sparkSession
    left = train.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(features).alias("features"))
    right = test.select(F.col(key).alias("key"), F.col(features).alias("features"))
    landmarks = np.array([r[0] for r in left.orderBy(spread_order(F.col("key")), "key").limit(max(pivots or 0, LANDMARKS)).select("features").collect()], dtype=np.float64)
    if len(landmarks) == 0:
        raise ValueError("no training rows")
    pivots = pivots or (PIVOTS if len(landmarks) < LANDMARKS else min(MOST_PIVOTS, max(PIVOTS, left.count() // CELL_ROWS)))
    points = landmarks[:pivots]
    gaps = np.sqrt(((points[:, None, :] - points[None, :, :]) ** 2).sum(axis=2))
    block = block or rows_of_block(landmarks.shape[1])

    @F.arrow_udf("cell int, reach double")
    def home(values: pa.Array) -> pa.Array:
        d = distances(matrix(values), points)
        cell = d.argmin(axis=1)
        return pa.StructArray.from_arrays([pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], ["cell", "reach"])

    placed = left.withColumn("h", home("features")).select("*", "h.cell", "h.reach").drop("h")
    stats = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("reach").alias("r")).collect()
    sizes, radius = np.zeros(len(points), dtype=np.int64), np.zeros(len(points))
    for row in stats:
        sizes[row["cell"]], radius[row["cell"]] = row["n"], row["r"]
    longest = (np.sqrt((points**2).sum(axis=1)) + radius).max() ** 2

    @F.arrow_udf("cell int, bound double")
    def first_cell(values: pa.Array) -> pa.Array:
        rows = matrix(values)
        cell = distances(rows, points).argmin(axis=1)
        return pa.StructArray.from_arrays([pa.array(cell.astype(np.int32)), pa.array(upper_bounds(rows, landmarks, k))], ["cell", "bound"])

    @F.arrow_udf("array<int>")
    def other_cells(values: pa.Array, bound: pa.Array) -> pa.Array:
        rows, bounds = matrix(values), np.asarray(bound)
        ends, found = [np.zeros(1, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for first in range(0, len(rows), TILE_ROWS):
            part, known = rows[first : first + TILE_ROWS], np.sqrt(bounds[first : first + TILE_ROWS])
            to_pivots, squares = distances(part, points), (part**2).sum(axis=1)
            own = to_pivots.argmin(axis=1)
            mask = reachable_cells(to_pivots, radius, sizes, k, known, np.sqrt(squares))
            mask &= crossed_cells(to_pivots, own, gaps, known + 1e-7 * (1 + known + np.sqrt(squares)), squares + longest)
            mask[np.arange(len(part)), own] = False
            ends.append(mask.sum(axis=1))
            found.append(np.nonzero(mask)[1])
        return pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(ends)).astype(np.int32)), pa.array(np.concatenate(found).astype(np.int32)))

    salt = F.pmod(F.xxhash64("key"), F.lit(1 << 31))
    kinds = {f.name: f.dataType for f in left.schema.fields}
    schema = T.StructType([
        T.StructField("key", kinds["key"]), T.StructField("neighbour", kinds["key"]), T.StructField("neighbour_label", kinds["label"]), T.StructField("distance", T.DoubleType()),
    ])
    fields = to_arrow_schema(schema)

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if len(a) == 0 or len(b) == 0:
            return fields.empty_table()
        keys = a["key"].to_numpy()
        i, j, distance = nearest_in_block(matrix(a["features"].combine_chunks()), keys, matrix(b["features"].combine_chunks()), k, b["bound"].to_numpy())
        return pa.Table.from_arrays([b["key"].take(pa.array(i)), a["key"].take(pa.array(j)), a["label"].take(pa.array(j)), pa.array(distance)], schema=fields)

    def met(asked: DataFrame) -> DataFrame:
        """k rows of every pair of blocks in the cells that the test rows (key, features, bound, cell) ask for."""
        demand = {r["cell"]: r["n"] for r in asked.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
        plan = [(c, int(max(1, -(-sizes[c] // block))), -(-n // block)) for c, n in sorted(demand.items())]
        plan = spark.createDataFrame(plan, "cell int, tb int, sb int")
        spread_train = placed.join(plan, "cell").select(
            "key", "label", "features", "cell", (salt % F.col("tb")).cast("int").alias("t"), F.explode(F.sequence(F.lit(0), F.col("sb") - 1)).alias("s")
        )
        spread_test = asked.join(plan, "cell").select(
            "key", "features", "bound", "cell", F.explode(F.sequence(F.lit(0), F.col("tb") - 1)).alias("t"), (salt % F.col("sb")).cast("int").alias("s")
        )
        by = ["cell", "t", "s"]
        return spread_train.groupBy(*by).cogroup(spread_test.groupBy(*by)).applyInArrow(meet, schema)

    w = Window.partitionBy("key").orderBy("distance", "neighbour")

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)

    at_home = settle(best(met(right.withColumn("c", first_cell("features")).select("key", "features", "c.bound", "c.cell"))))
    kth = at_home.filter(F.col("place") == k).select("key", F.col("distance").alias("kth"))
    # a row without k neighbours at home keeps the bound of the landmarks
    bounded = right.join(kth, "key", "left").withColumn("bound", F.coalesce("kth", first_cell("features")["bound"]))
    asked = bounded.select("key", "features", "bound", F.explode(other_cells("features", "bound")).alias("cell"))
    ranked = best(at_home.drop("place").unionByName(met(asked)))
    return ranked.select(F.col("key").alias(key), "place", "neighbour", "neighbour_label", "distance")


def vote(neighbours: DataFrame, key: str, k: int | None = None) -> DataFrame:
    """Most frequent label of the first k neighbours, the lowest label winning ties."""
    rows = neighbours if k is None else neighbours.filter(F.col("place") <= k)
    counts = rows.groupBy(key, "neighbour_label").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("a"), F.col("neighbour_label").alias("v")))
    return counts.groupBy(key).agg(best.alias("b")).select(key, F.col("b.v").alias("guess"))


def tune_neighbours(neighbours: DataFrame, truth: DataFrame, key: str, label: str, counts: Sequence[int]) -> DataFrame:
    """Accuracy of every neighbour count from one neighbour query; ``best`` marks the first best count."""
    widened = neighbours.select(key, "neighbour_label", F.explode(F.filter(F.array(*[F.lit(c) for c in counts]), lambda c: c >= F.col("place"))).alias("k"))
    votes = widened.groupBy("k", key, "neighbour_label").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("a"), F.col("neighbour_label").alias("v")))
    guesses = votes.groupBy("k", key).agg(best.alias("b")).select("k", key, F.col("b.v").alias("guess"))
    table = guesses.join(truth.select(key, F.col(label).alias("truth")), key)
    scores = table.groupBy("k").agg(F.avg((F.col("guess") == F.col("truth")).cast("double")).alias("accuracy"))
    top = F.max(F.struct("accuracy", -F.col("k"))).over(Window.partitionBy())
    return scores.withColumn("best", F.struct("accuracy", -F.col("k")) == top)
