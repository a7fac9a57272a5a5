"""Near-duplicate embeddings by an exact metric range join over pivot cells.

Cosine >= c of unit vectors is Euclidean distance <= e = sqrt(2 - 2c). Every vector has a home cell,
that of its nearest pivot. A vector also visits the cell of another pivot unless the triangle
inequality rules out that a vector at home there lies within e: that takes
d(x, pivot) <= d(x, home pivot) + 2e, and (d(x, pivot)^2 - d(x, home pivot)^2) / (2 d(pivot, home pivot)) <= e
for the plane between the two cells. So each linked pair meets in the home cell of either vector, and
the cells are joined independently.

Cells are cut further by their counted sizes into (part of the home vectors) x (part of the visitors),
so the work of a task is bounded whatever the number of vectors near a pivot. A task multiplies
matrices in single precision, confirms what is near the threshold or above it in double precision,
and returns link counts and at most one edge per vector, never a list of pairs. Equal vectors are
joined once and counted with their number.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utterscope.llm.common import save, shards, small
from utterscope.llm.components import components

THRESHOLD = 0.95
#: Vectors at home in a cell, about, and the largest number of pivots of a dimension. Beyond it cells
#: grow and are cut into more parts.
HOME, MAX_PIVOTS = 4096, 512
VISITORS = 8192
#: Single precision is trusted to this much.
SLACK = 1e-4
SEED = 8
PREPARED = "row long, vec_id long, dim int, digest binary, unit binary"


def _unit(vector) -> np.ndarray | None:
    """The vector at length 1 in double precision; None for what links with nothing."""
    if vector is None or len(vector) == 0 or any(v is None for v in vector):
        return None
    x = np.asarray(vector, np.float64)
    top = np.abs(x).max()
    if not np.isfinite(top) or top == 0:
        return None
    x = x / top
    return x / math.sqrt(float(x @ x))


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        units = [_unit(v) for v in batch.column(2).to_pylist()]
        # Adding 0.0 turns a negative zero into a positive one.
        raw = [None if u is None else (u + 0.0).tobytes() for u in units]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array([None if u is None else len(u) for u in units], pa.int32()),
                pa.array([None if r is None else hashlib.blake2b(r, digest_size=16).digest() for r in raw], pa.binary()),
                pa.array(raw, pa.binary()),
            ],
            ["row", "vec_id", "dim", "digest", "unit"],
        )


def _assign(pivots: dict[int, np.ndarray], reach: float):
    """(rep, dim, cell, home) of the home cell and of all cells that a vector has to visit."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps = batch.column(0).to_numpy()
            dims = batch.column(1).to_numpy()
            raw = batch.column(2).to_pylist()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = np.frombuffer(b"".join(raw[i] for i in at), np.float64).reshape(len(at), dim)
                p = pivots[int(dim)]
                far = np.sqrt(np.maximum(0, 2 - 2 * x @ p.T))
                home = far.argmin(axis=1)
                near = far[np.arange(len(at)), home][:, None]
                between = np.sqrt(np.maximum(0, 2 - 2 * p @ p.T))[home]
                beyond = (far**2 - near**2) > 2 * between * (reach + SLACK)
                visits = (far <= near + 2 * reach + SLACK) & ~beyond
                visits[np.arange(len(at)), home] = True
                who, cell = np.nonzero(visits)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(reps[at][who]),
                        pa.array(np.full(len(who), dim, np.int32)),
                        pa.array(cell.astype(np.int32)),
                        pa.array(cell == home[who]),
                    ],
                    ["rep", "dim", "cell", "home"],
                )

    return task


def _lowest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the lowest node that the links (a, b) connect it with."""
    low = np.arange(n)
    while True:
        new = low.copy()
        least = np.minimum(low[a], low[b])
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _join_cell(threshold: float):
    def task(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.reset_index(drop=True)
        dim = int(rows["dim"].iloc[0])
        units = np.frombuffer(b"".join(rows["unit"]), np.float64).reshape(len(rows), dim)
        single = units.astype(np.float32)
        at_home = np.flatnonzero(rows["side"].to_numpy())
        visiting = np.flatnonzero(~rows["side"].to_numpy())
        reps, copies = rows["rep"].to_numpy(), rows["copies"].to_numpy()
        homes = single[at_home].T
        counts = np.zeros(len(rows), np.int64)
        first, second = [], []
        for start in range(0, len(visiting), 512):
            part = visiting[start : start + 512]
            i, j = np.nonzero(single[part] @ homes >= threshold - SLACK)
            i, j = part[i], at_home[j]
            other = reps[i] != reps[j]
            i, j = i[other], j[other]
            sure = np.concatenate(
                [np.einsum("ij,ij->i", units[i[k : k + 65536]], units[j[k : k + 65536]]) >= threshold
                 for k in range(0, len(i), 65536)] or [np.empty(0, bool)]
            )
            i, j = i[sure], j[sure]
            np.add.at(counts, i, copies[j])
            # Within the part a node needs no more than its lowest neighbour's component.
            low = _lowest(len(rows), i, j)
            moved = np.flatnonzero(low != np.arange(len(rows)))
            first.append(moved)
            second.append(low[moved])
        first = np.concatenate(first) if first else np.empty(0, np.int64)
        second = np.concatenate(second) if second else np.empty(0, np.int64)
        # A vector stands on both sides of its own home cell; its two rows are one node.
        names, node = np.unique(reps, return_inverse=True)
        low = _lowest(len(names), node[first], node[second])
        moved = np.flatnonzero(low != np.arange(len(names)))
        counted = np.flatnonzero(counts)
        return pd.DataFrame(
            {
                "a": np.concatenate([names[moved], reps[counted]]),
                "b": np.concatenate([names[low[moved]], reps[counted]]),
                "links": np.concatenate([np.zeros(len(moved), np.int64), counts[counted]]),
            }
        )

    return task


def vector_dedup(
    vectors: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    threshold: float = THRESHOLD,
    home: int = HOME,
    visitors: int = VISITORS,
    max_pivots: int = MAX_PIVOTS,
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Two vectors of equal length are linked when their cosine in double precision is at least
    ``threshold``. Vectors that are null, empty, zero, or hold a null or non-finite component have no
    links and are components of their own, as have vectors of another length than all others.
    ``n_links`` counts the other rows linked directly, equal vectors included. ``component_id`` is the
    smallest id in the component, nulls aside; ``kept`` says that the row has it, so repeated rows are
    kept together. An empty table gives no rows. Other columns are not read.
    """
    prepared = save(
        vectors.select(
            F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("long"), F.col(vector_column)
        ).mapInArrow(_prepare, PREPARED),
        "vector-prepared",
    )
    classes = save(
        prepared.where("digest is not null").groupBy("digest").agg(
            F.min("row").alias("rep"), F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("copies")
        ),
        "vector-classes",
    )
    reps = save(
        prepared.join(classes.select(F.col("rep").alias("row"), "copies"), "row").select(
            F.col("row").alias("rep"), "dim", "unit", "copies"
        ),
        "vector-reps",
    )
    sizes = {r["dim"]: r["count"] for r in reps.groupBy("dim").count().collect()}  # one row per vector length
    pivots = {}
    for dim, n in sizes.items():
        drawn = (
            reps.where(F.col("dim") == dim)
            .orderBy(F.xxhash64(F.lit(SEED), "rep"), "rep")
            .limit(min(max_pivots, shards(n, home)))
            .select("unit")
            .collect()
        )
        pivots[dim] = np.frombuffer(b"".join(r["unit"] for r in drawn), np.float64).reshape(-1, dim)
    reach = math.sqrt(2 - 2 * threshold)
    assigned = save(
        reps.select("rep", "dim", "unit").mapInArrow(
            _assign(pivots, reach), "rep long, dim int, cell int, home boolean"
        ),
        "vector-assigned",
    )
    # At most max_pivots rows per vector length.
    cells = assigned.groupBy("dim", "cell").agg(F.count_if("home").alias("at_home"), F.count(F.lit(1)).alias("all"))
    drawn = F.xxhash64(F.lit(SEED), "rep")
    parts = (
        assigned.join(F.broadcast(cells), ["dim", "cell"])
        .withColumn("home_parts", F.ceil(F.col("at_home") / home).cast("int"))
        .withColumn("visit_parts", F.ceil(F.col("all") / visitors).cast("int"))
        .withColumn("home_part", F.pmod(drawn, F.col("home_parts")).cast("int"))
        .withColumn("visit_part", F.pmod(F.xxhash64(drawn), F.col("visit_parts")).cast("int"))
        .where("home_parts > 0")
    )
    as_home = parts.where("home").select(
        "rep", "dim", "cell", "home_part",
        F.explode(F.sequence(F.lit(0), F.col("visit_parts") - 1)).alias("visit_part"), F.lit(True).alias("side"),
    )
    as_visitor = parts.select(
        "rep", "dim", "cell",
        F.explode(F.sequence(F.lit(0), F.col("home_parts") - 1)).alias("home_part"), "visit_part",
        F.lit(False).alias("side"),
    )
    found = save(
        as_home.unionByName(as_visitor)
        .join(reps.select("rep", "unit", "copies"), "rep")
        .groupBy("dim", "cell", "home_part", "visit_part")
        .applyInPandas(_join_cell(threshold), "a long, b long, links long"),
        "vector-found",
    )
    counts = found.where("links > 0").groupBy(F.col("a").alias("counted")).agg(F.sum("links").alias("links"))
    named = components(found.where("links = 0").select("a", "b"))
    roots = save(
        classes.join(named, classes["rep"] == named["node"], "left")
        .join(counts, classes["rep"] == counts["counted"], "left")
        .select(
            "digest",
            "low",
            F.coalesce("component", "rep").alias("root"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        ),
        "vector-roots",
    )
    lows = roots.groupBy("root").agg(F.min("low").alias("component_id"))
    known = save(
        roots.where("n_links > 0").join(lows, "root").select("digest", "n_links", "component_id"), "vector-known"
    )
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return prepared.select("vec_id", "digest").join(small(known, 72), "digest", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
