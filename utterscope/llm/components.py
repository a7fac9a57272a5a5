"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utterscope.llm.common import BROADCAST_BYTES, save


def _with_minimum(edges: DataFrame, count: int) -> DataFrame:
    """Each (u, v) with the smallest neighbour of u; the minima, at most one per edge end, are joined."""
    minima = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(F.broadcast(minima) if 2 * count * 32 <= BROADCAST_BYTES else minima, "u")


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a long, b long); the component is its smallest node.

    Large-star hangs the larger neighbours of every node under its smallest neighbour, small-star
    the smaller ones; both keep the components. They alternate until the edges stay as they are and
    so are stars. Minima combine before the shuffle, so a node with very many neighbours is no hot
    key there. Each round is written to the shared folder. No links give no rows.
    """
    edges = save(
        links.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "component-edges",
    )
    seen = None
    while True:
        state = edges.agg(
            F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("mark")
        ).first()
        if state == seen or not state["n"]:
            break
        seen = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            _with_minimum(both, state["n"])
            .where("v > u")
            .select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
            .distinct()
        )
        # A node of a large-star edge is above its new neighbour, so all edges point downwards.
        minimum = _with_minimum(large, state["n"])
        small = (
            minimum.where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(minimum.select("u", F.col("m").alias("v")))
            .distinct()
        )
        edges = save(small, "component-edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
