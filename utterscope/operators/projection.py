"""Two-dimensional PCA view of embeddings and of the movement of centroids between splits."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utterscope.functions.vectors import as_doubles, dot
from utterscope.operators.semantic import attach_centroid
from utterscope.operators.sums import matrix, position_sums
from utterscope.sources.intermediate import BROADCAST_LIMIT_BYTES

COMPONENTS = 2
#: Directions that are followed at a time, the most passes over the rows, and when the plane counts as found.
BLOCK, PASSES, STILL, SEED = 128, 100, 1e-11, 12


@dataclass(frozen=True)
class Projection:
    """A fitted plane: two loading vectors, the projected mean, and the explained variance ratios."""

    loadings: list[list[float]]
    offsets: list[float]
    explained: list[float]

    def coordinates(self, vec: Column) -> Column:
        """A struct with fields ``x`` and ``y``."""
        x, y = (
            dot(vec, F.lit(weights)) - F.lit(offset)
            for weights, offset in zip(self.loadings, self.offsets)
        )
        return F.struct(x.alias("x"), y.alias("y"))


def fit(vectors: DataFrame, column: str = "vec", cents: DataFrame | None = None, block: int = BLOCK) -> Projection:
    """Fit the plane of greatest variance by subspace iteration over the rows.

    Each pass multiplies the centred rows with at most ``block`` directions and back; the tasks add up their
    products, and only one number per direction and dimension reaches the driver, never a square
    matrix of a long vector. Vectors of no more than ``block`` dimensions need one pass, as the
    directions span everything. Longer ones start from fixed random directions and are passed over until the
    plane turns by less than :data:`STILL`. The sign of a component is fixed by making its largest loading
    positive. ``cents``, the materialized centroids of the same rows, saves the pass for the mean.
    """
    weight = F.lit(1.0) if cents is None else F.col("n").cast("double")
    mean = _mean(vectors, column) if cents is None else _mean(cents, "centroid", weight)
    d = len(mean)
    if d < COMPONENTS:
        raise ValueError(f"at least {COMPONENTS} dimensions are needed")
    size = min(d, block)
    directions = np.eye(d) if size == d else np.linalg.qr(np.random.default_rng(SEED).normal(size=(d, size)))[0]
    rows = vectors.where(F.size(column) > 0).select(F.col(column).alias("vec"))
    plane = None
    for _ in range(PASSES):
        turned, total = _passed(rows, mean, directions)
        # Within the span of the directions the variances are those of this small matrix.
        small = directions.T @ turned
        values, inner = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-values)
        loadings = (directions @ inner[:, order[:COMPONENTS]]).T
        still = plane is not None and np.linalg.norm(loadings - (loadings @ plane.T) @ plane) < STILL
        plane = loadings
        if size == d or still:
            break
        directions = np.linalg.qr(turned @ inner[:, order])[0]
    variances = values[order[:COMPONENTS]]
    signs = np.sign(plane[np.arange(COMPONENTS), np.abs(plane).argmax(axis=1)])
    plane = plane * signs[:, None]
    return Projection(plane.tolist(), (plane @ mean).tolist(), (variances / total if total else variances).tolist())


def _mean(vectors: DataFrame, column: str, weight: Column | None = None) -> np.ndarray:
    """The mean vector; one number per dimension reaches the driver."""
    if weight is None:
        sums = position_sums(vectors, (), column).select("pos", (F.col("x") / F.col("n")).alias("x"))
    else:
        elements = vectors.where(F.size(column) > 0).select(weight.alias("w"), F.posexplode(column).alias("pos", "e"))
        sums = elements.groupBy("pos").agg((F.sum(F.col("w") * F.col("e")) / F.sum("w")).alias("x"))
    return np.array([row["x"] for row in sums.orderBy("pos").collect()], np.float64)


def _passed(rows: DataFrame, mean: np.ndarray, directions: np.ndarray) -> tuple[np.ndarray, float]:
    """``(A Q, trace A)`` for the scatter matrix A of the centred rows and the directions Q."""
    shared = rows.sparkSession.sparkContext.broadcast((mean, directions))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, directions = shared.value
        sums, total = np.zeros(directions.shape), 0.0
        for batch in batches:
            if batch.num_rows:
                centred = matrix(batch.column("vec")) - mean
                sums += centred.T @ (centred @ directions)
                total += float((centred * centred).sum())
        values = pa.array([np.append(sums.ravel(), total)], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([values], ["sums"])

    partial = rows.mapInArrow(task, "sums array<double>").select(F.posexplode("sums").alias("pos", "x"))
    merged = partial.groupBy("pos").agg(F.sum("x").alias("x")).orderBy("pos").collect()
    found = np.array([row["x"] for row in merged]) if merged else np.zeros(directions.size + 1)
    return found[:-1].reshape(directions.shape), float(found[-1])


def project(
    emb: DataFrame,
    cents: DataFrame,
    plane: Projection,
    by: Sequence[str] = ("label",),
    limit: int = BROADCAST_LIMIT_BYTES,
) -> DataFrame:
    """``id, *by, x, y, centroid_x, centroid_y, distance`` with the distance to the own 2-D centroid.

    The projection is linear, so the 2-D centroid is the projected centroid. ``cents`` must be a
    materialized table.
    """
    flat = cents.select(*by, _pair(plane.coordinates(F.col("centroid"))).alias("centroid"))
    points = emb.where(F.col("vec").isNotNull()).select(
        "id", *by, plane.coordinates(F.col("vec")).alias("p")
    )
    x, y, cx, cy = F.col("p.x"), F.col("p.y"), F.col("centroid")[0], F.col("centroid")[1]
    return attach_centroid(points, flat, by, limit).select(
        "id",
        *by,
        x.alias("x"),
        y.alias("y"),
        cx.alias("centroid_x"),
        cy.alias("centroid_y"),
        F.hypot(x - cx, y - cy).alias("distance"),
    )


def _pair(point: Column) -> Column:
    return F.array(point["x"], point["y"])


def ranges(projected: DataFrame, by: Sequence[str] = ("label",)) -> DataFrame:
    """``*by, x_min, x_max, y_min, y_max`` of a :func:`project` table."""
    return projected.groupBy(*by).agg(
        F.min("x").alias("x_min"),
        F.max("x").alias("x_max"),
        F.min("y").alias("y_min"),
        F.max("y").alias("y_max"),
    )


def explained_variance(emb: DataFrame, plane: Projection) -> DataFrame:
    rows = [(i + 1, float(share)) for i, share in enumerate(plane.explained)]
    return emb.sparkSession.createDataFrame(rows, "component int, explained_variance_ratio double")


def _shared_plane(emb: DataFrame, cents: DataFrame, first: str, second: str) -> tuple[DataFrame, DataFrame, Projection]:
    """Both centroids of the labels of both splits, the rows of these labels, and the plane of all of them."""
    pair = (
        cents.where(F.col("centroid").isNotNull())
        .groupBy("label")
        .agg(
            F.first(F.when(F.col("split") == first, F.col("centroid")), ignorenulls=True).alias("c1"),
            F.first(F.when(F.col("split") == second, F.col("centroid")), ignorenulls=True).alias("c2"),
        )
        .where(F.col("c1").isNotNull() & F.col("c2").isNotNull())
    )
    if pair.isEmpty():
        raise ValueError("no label occurs in both splits")
    rows = emb.where(F.col("vec").isNotNull() & F.col("split").isin(first, second)).join(
        pair.select("label"), "label", "left_semi"
    )
    both = pair.select(F.explode(F.array("c1", "c2")).alias("vec"))
    return pair, rows, fit(rows.select(as_doubles(F.col("vec")).alias("vec")).unionByName(both))


def centroid_shift(
    emb: DataFrame,
    cents: DataFrame,
    first: str = "train",
    second: str = "test",
) -> DataFrame:
    """``label, x1, y1, x2, y2, shift``: where the centroid of a label lies in either split.

    The plane is fitted on all rows of these labels together with the centroids. Labels of both
    splits only; none is an error.
    """
    pair, _, plane = _shared_plane(emb, cents, first, second)
    placed = pair.select(
        "label",
        plane.coordinates(F.col("c1")).alias("a"),
        plane.coordinates(F.col("c2")).alias("b"),
    )
    return placed.select(
        "label",
        F.col("a.x").alias("x1"),
        F.col("a.y").alias("y1"),
        F.col("b.x").alias("x2"),
        F.col("b.y").alias("y2"),
        F.hypot(F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")).alias("shift"),
    )


def shift_points(emb: DataFrame, cents: DataFrame, first: str = "train", second: str = "test") -> DataFrame:
    """``id, split, label, x, y``: the rows of the labels of both splits in the plane of :func:`centroid_shift`."""
    _, rows, plane = _shared_plane(emb, cents, first, second)
    point = plane.coordinates(F.col("vec"))
    return rows.select("id", "split", "label", point.alias("p")).select(
        "id", "split", "label", F.col("p.x").alias("x"), F.col("p.y").alias("y")
    )


def centroid_plane(cents: DataFrame) -> DataFrame:
    """``label, x, y``: the centroids in the plane in which they themselves are spread most."""
    known = cents.where(F.col("centroid").isNotNull())
    plane = fit(known, "centroid")
    return known.select("label", plane.coordinates(F.col("centroid")).alias("p")).select(
        "label", F.col("p.x").alias("x"), F.col("p.y").alias("y")
    )
