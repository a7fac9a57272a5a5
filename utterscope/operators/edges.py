"""Pairs of centroids above a similarity, without computing those that cannot reach it.

Some centroids serve as pivots and every other one joins the block of its nearest pivot. The distance of two
pivots, less the radii of their blocks, bounds the distance of any two members, and with it their cosine: pairs
of blocks whose bound lies below the threshold are never brought together.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utterscope.functions.vectors import dot, norm, unit
from utterscope.operators.nearest import LOT_BYTES, SLACK, apart, homes, lot_of
from utterscope.operators.semantic import centroid_pairs
from utterscope.sources.intermediate import materialize, spread

#: Members of a block.
PAIR_BLOCK = 256


def similarity_edges(
    cents: DataFrame, threshold: float = 0.0, within: Sequence[str] = ("split",), block: int = PAIR_BLOCK
) -> DataFrame:
    """``*within, label1, label2, similarity``: the centroid pairs whose similarity is at least ``threshold``.

    ``cents`` must be a materialized table. A zero centroid has similarity 0 with every other one. From 0
    downwards, and among the members of a single block, there is nothing to leave out and all pairs are computed.
    """
    if threshold <= 0 or cents.count() <= block:
        return centroid_pairs(cents, within).where(F.col("similarity") >= threshold)
    return candidate_pairs(cents, threshold, within, block).where(F.col("similarity") >= threshold)


def candidate_pairs(cents: DataFrame, threshold: float, within: Sequence[str], block: int = PAIR_BLOCK) -> DataFrame:
    """All pairs of the blocks whose bound reaches ``threshold``, with their similarity."""
    spark = cents.sparkSession
    known = materialize(
        cents.where(norm(F.col("centroid")) > 0).select(*within, "label", unit(F.col("centroid")).alias("centroid")),
        "unit-centroids",
    )
    kinds = ", ".join(f"`{c}` {known.schema[c].dataType.simpleString()}" for c in (*within, "label"))
    n, first = known.count(), known.select("centroid").first()
    width = 8 * len(first[0]) if first else 8
    wanted = max(1, min(-(-n // block), LOT_BYTES // width))
    some = known.orderBy(F.xxhash64(*within, "label")).limit(wanted).select(F.col("label").alias("nearest"), "centroid")
    pivots = lot_of(some)[1].reshape(-1, width // 8)
    shared = spark.sparkContext.broadcast(pivots)
    placed = materialize(known.mapInArrow(homes(shared), f"{kinds}, centroid array<double>, cell int, away double"), "blocks")
    # A cell of more members than a block is cut by a hash; every block has a radius of its own.
    sizes = placed.groupBy(*within, "cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("pieces"))
    same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in (*within, "cell")]
    renamed = sizes.withColumnsRenamed({c: f"of_{c}" for c in (*within, "cell")})
    cut = placed.join(renamed, _all(same)).drop(*[f"of_{c}" for c in (*within, "cell")])
    cut = cut.withColumn("block", F.xxhash64(*within, "cell", F.pmod(F.xxhash64("label"), F.col("pieces"))))
    cut = materialize(cut.select(*within, "label", "centroid", "cell", "away", "block"), "blocked")
    of = F.xxhash64(*within) if within else F.lit(0).cast("long")
    blocks = materialize(cut.groupBy("block", of.alias("of"), "cell").agg(F.max("away").alias("radius")), "block-list")
    # One row per block goes to the tasks; there each block finds its partners, itself and greater ones.
    listed = blocks.toArrow().combine_chunks()
    every = spark.sparkContext.broadcast((pivots, *(listed.column(c).to_numpy() for c in ("block", "of", "cell", "radius"))))
    pairs = materialize(spread(blocks).mapInArrow(_partners(every, threshold), "block1 long, block2 long"), "block-pairs")
    left = cut.select(*within, F.col("label").alias("label1"), F.col("centroid").alias("v1"), F.col("block").alias("b1"))
    right = cut.select(F.col("label").alias("label2"), F.col("centroid").alias("v2"), F.col("block").alias("b2"))
    met = left.join(pairs, F.col("b1") == F.col("block1")).join(right, F.col("b2") == F.col("block2"))
    both = met.where((F.col("block1") < F.col("block2")) | (F.col("label1") < F.col("label2")))
    return both.select(
        *within,
        F.least("label1", "label2").alias("label1"),
        F.greatest("label1", "label2").alias("label2"),
        dot(F.col("v1"), F.col("v2")).alias("similarity"),
    )


def _all(conditions: list):
    whole = F.lit(True)
    for condition in conditions:
        whole = whole & condition
    return whole


def _partners(shared, threshold: float):
    """Pairs of blocks, the smaller number first, whose members can be as similar as the threshold."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, blocks, groups, cells, radii = shared.value
        for batch in batches:
            for block, group, cell, radius in zip(*(c.to_pylist() for c in batch.columns)):
                least = apart(pivots[cells] @ pivots[cell]) - radii - radius
                bound = 1.0 - np.maximum(0.0, least - SLACK) ** 2 / 2
                found = blocks[(bound >= threshold) & (groups == group) & (blocks >= block)]
                ones = pa.array(np.full(len(found), block), pa.int64())
                yield pa.RecordBatch.from_arrays([ones, pa.array(found, pa.int64())], ["block1", "block2"])

    return task
