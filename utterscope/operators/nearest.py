"""The nearest centroid of every row, for any number of rows and centroids.

Distances are those of unit vectors, where the triangle inequality holds. Some centroids serve as pivots;
every other one belongs to the cell of its nearest pivot. A row looks into a cell only if the cell can
hold a centroid at least as near as the nearest pivot: if the row's distance to the cell's pivot, less
the cell's radius, does not exceed that. Cells, and the rows that look into one, are cut into lots of
bounded size, and each pair of lots is one matrix product. Comparing a row with a cell costs far more
than bringing it there, so rows travel and no task ever holds all centroids. Where the centroids fill less
than one lot they all go to every task, and no row travels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utterscope.functions.vectors import norm, unit
from utterscope.operators.sums import matrix, unit_rows
from utterscope.sources.intermediate import materialize, vector_table_bytes

#: Bytes of vectors in one lot, and centroids in one matrix product.
LOT_BYTES = 32 * 1024 * 1024
TILE = 512
#: Distances that differ by less count as ties.
TIE = 1e-12
#: Room for rounding where a cell is left out.
SLACK = 1e-6
PIVOTS_PER_LOT = 4


def nearest_centroid(emb: DataFrame, cents: DataFrame, limit: int = LOT_BYTES) -> DataFrame:
    """``id, label, nearest, distance``: the label whose centroid has the least cosine distance.

    ``cents`` must be a materialized table with one row per label. Ties within :data:`TIE` go to the smaller
    label. A zero vector is at distance 1 from everything. Repeated ids give repeated rows. Without any
    centroid, or for a vector with null or NaN in it, ``nearest`` and ``distance`` are null; rows without a
    vector are left out.
    """
    known = cents.where(F.size("centroid") > 0).select(F.col("label").alias("nearest"), unit(F.col("centroid")).alias("centroid"))
    known = materialize(known, "unit-centroids")
    rows = emb.where(F.size("vec") > 0).select("id", "label", "vec")
    size = vector_table_bytes(known, "centroid")[1]
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "label")}
    kinds["nearest"] = known.schema["nearest"].dataType.simpleString()
    if size <= limit:
        shared = emb.sparkSession.sparkContext.broadcast(lot_of(known.orderBy("nearest")))
        found = ", ".join(f"{c} {kind}" for c, kind in kinds.items()) + ", distance double"
        return rows.mapInArrow(_of_all(shared), found)
    return _by_cells(rows, known, kinds, size, limit)


def lot_of(known: DataFrame) -> tuple[pa.Array, np.ndarray]:
    """Labels and vectors of centroids that fit one lot."""
    table = known.select("nearest", "centroid").toArrow().combine_chunks()
    if not table.num_rows:
        return pa.nulls(0), np.empty((0, 0))
    labels, vectors = (c.chunk(0) if c.num_chunks else c.combine_chunks() for c in table.columns)
    return labels, matrix(vectors)


def _best(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least distance of each vector, infinite where there is none, and the first place with it."""
    best, chosen = np.full(len(vectors), np.inf), np.full(len(vectors), -1)
    for at in range(0, len(centroids), TILE):
        distances = 1.0 - vectors @ centroids[at : at + TILE].T
        least = distances.min(axis=1)
        first = (distances <= least[:, None] + TIE).argmax(axis=1)
        closer = least < best - TIE
        best[closer], chosen[closer] = least[closer], at + first[closer]
    return best, chosen


def _of_all(shared):
    """The nearest of all centroids, which stand in the order of their labels."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, centroids = shared.value
        for batch in batches:
            best, chosen = _best(unit_rows(matrix(batch.column("vec"))), centroids)
            taken = labels.take(pa.array(chosen, mask=chosen < 0))
            distance = pa.array(best, mask=np.isinf(best))
            columns = [batch.column("id"), batch.column("label"), taken, distance]
            yield pa.RecordBatch.from_arrays(columns, ["id", "label", "nearest", "distance"])

    return task


def apart(cosines: np.ndarray) -> np.ndarray:
    """Distances of unit vectors from their cosines."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosines))


def homes(shared):
    """The cell and the distance to its pivot of each row with a unit vector ``centroid``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value
        for batch in batches:
            cosines = matrix(batch.column("centroid")) @ pivots.T
            cell = cosines.argmax(axis=1) if batch.num_rows else np.empty(0, np.int64)
            away = apart(cosines[np.arange(len(cell)), cell])
            columns = [*batch.columns, pa.array(cell, pa.int32()), pa.array(away, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "cell", "away"])

    return task


def _visits(shared):
    """The cells that each row has to look into; none for rows without a direction."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, cells, radii = shared.value
        for batch in batches:
            vectors = unit_rows(matrix(batch.column("vec")))
            distances = apart(vectors @ pivots.T)
            usable = np.isfinite(distances).all(axis=1) & vectors.any(axis=1)
            nearest = distances.min(axis=1, initial=np.inf)
            wanted = (distances[:, cells] - radii <= nearest[:, None] + SLACK) & usable[:, None]
            ends = pa.array(np.append(0, np.cumsum(wanted.sum(axis=1))), pa.int32())
            columns = [*batch.columns, pa.ListArray.from_arrays(ends, pa.array(np.nonzero(wanted)[1], pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["row", "id", "label", "vec", "visits"])

    return task


def _compared(rows: pa.Table, lot: pa.Table) -> pa.Table:
    """The nearest of one lot of a cell for one lot of rows."""
    if not rows.num_rows or not lot.num_rows:
        nothing = [rows.column("row").slice(0, 0), lot.column("nearest").slice(0, 0), pa.array([], pa.float64())]
        return pa.table(nothing, ["row", "nearest", "distance"])
    lot = lot.sort_by("nearest")
    vectors = unit_rows(matrix(rows.column("vec").combine_chunks()))
    best, chosen = _best(vectors, matrix(lot.column("centroid").combine_chunks()))
    taken = lot.column("nearest").combine_chunks().take(pa.array(chosen))
    return pa.table([rows.column("row"), taken, pa.array(best)], ["row", "nearest", "distance"])


def _by_cells(rows: DataFrame, known: DataFrame, kinds: dict[str, str], size: int, limit: int) -> DataFrame:
    context = rows.sparkSession.sparkContext
    # Zero centroids have no direction: all of them are at distance 1, and the smallest label stands for them.
    aimed = known.where(norm(F.col("centroid")) > 0)
    ends = known.agg(F.min("nearest").alias("least"), F.min(F.when(norm(F.col("centroid")) == 0, F.col("nearest"))).alias("zero"))
    least, zero = ends.first()
    width = 8 * len(known.select("centroid").first()[0])
    wanted = max(1, min(PIVOTS_PER_LOT * -(-size // limit), limit // width))
    _, pivots = lot_of(aimed.orderBy(F.xxhash64("nearest"), "nearest").limit(wanted))
    pivots = pivots.reshape(len(pivots), width // 8)
    placed = materialize(
        aimed.mapInArrow(homes(context.broadcast(pivots)), f"nearest {kinds['nearest']}, centroid array<double>, cell int, away double"),
        "cells",
    )
    # A cell of more than one lot is cut by a hash; each piece has a radius of its own.
    pieces = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) * (width + 64) / limit).cast("int").alias("pieces"))
    piece = F.pmod(F.xxhash64("nearest"), F.col("pieces")).cast("int")
    cut = placed.join(F.broadcast(pieces), "cell").withColumn("piece", piece)
    # One row per lot of centroids.
    lots = cut.groupBy("cell", "piece").agg(F.max("away").alias("radius")).orderBy("cell", "piece").toArrow()
    cells, numbers, radii = (lots.column(c).to_numpy() for c in ("cell", "piece", "radius"))
    listed = rows.sparkSession.createDataFrame(
        [(i, int(c), int(p)) for i, (c, p) in enumerate(zip(cells, numbers))], "lot int, cell int, piece int"
    )
    visited = materialize(
        rows.select(F.monotonically_increasing_id().alias("row"), "id", "label", "vec").mapInArrow(
            _visits(context.broadcast((pivots, cells, radii))),
            f"row long, id {kinds['id']}, label {kinds['label']}, vec {rows.schema['vec'].dataType.simpleString()}, visits array<int>",
        ),
        "visits",
    )
    calls = visited.select("row", "vec", F.explode("visits").alias("lot"))
    blocks = calls.groupBy("lot").agg(F.ceil(F.count(F.lit(1)) * (width + 64) / limit).cast("int").alias("blocks"))
    blocks = F.broadcast(materialize(blocks, "blocks"))
    dealt = calls.join(blocks, "lot").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    lots_of = cut.join(F.broadcast(listed), ["cell", "piece"]).join(blocks, "lot")
    copies = lots_of.select("lot", "nearest", "centroid", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))

    def compared(left: pa.Table, right: pa.Table) -> pa.Table:
        return _compared(left.select(["row", "vec"]), right.select(["nearest", "centroid"]))

    found = (
        dealt.select("lot", "block", "row", "vec").groupBy("lot", "block")
        .cogroup(copies.select("lot", "block", "nearest", "centroid").groupBy("lot", "block"))
        .applyInArrow(compared, f"row long, nearest {kinds['nearest']}, distance double")
    )
    # As many entries per row as lots that it looked into.
    entries = found.groupBy("row").agg(F.collect_list(F.struct("distance", "nearest")).alias("found"))
    of_zero = F.struct(F.lit(1.0).alias("distance"), F.lit(zero).cast(kinds["nearest"]).alias("nearest"))
    all_found = F.concat("found", F.array(of_zero)) if zero is not None else F.col("found")
    nearest = F.array_min(F.transform(all_found, lambda e: e["distance"]))
    ranked = entries.select("row", all_found.alias("found"), nearest.alias("distance")).select(
        F.col("row").alias("of"),
        "distance",
        F.array_min(
            F.transform(F.filter("found", lambda e: e["distance"] <= F.col("distance") + TIE), lambda e: e["nearest"])
        ).alias("nearest"),
    )
    still = F.size(F.filter("vec", lambda x: x != 0)) == 0
    sound = ~F.exists("vec", lambda x: x.isNull() | F.isnan(x))
    no_visit = F.lit(zero is not None) & F.col("of").isNull() & sound
    label, of_no_visit = F.lit(least).cast(kinds["nearest"]), F.lit(zero).cast(kinds["nearest"])
    return visited.join(ranked, F.col("row") == F.col("of"), "left").select(
        "id",
        "label",
        F.when(still, label).when(no_visit, of_no_visit).otherwise(F.col("nearest")).alias("nearest"),
        F.when(still | no_visit, 1.0).otherwise(F.col("distance")).alias("distance"),
    )
