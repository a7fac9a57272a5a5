"""Geometry of labelled embeddings: centroids, cohesion, similarity between labels and splits.

Input: ``id, split, label, vec`` with vectors of one length. Sums over rows are taken up by each task as
a matrix and merged per group and position: a label that holds most of the rows costs no more there
than any other. Operators on pairs work on centroids, one row per label, never on pairs of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from utterscope.functions.vectors import cosine_from_sums, dot, euclidean, norm, unit
from utterscope.operators.quantiles import grouped_stats, join_groups
from utterscope.operators.sums import position_sums
from utterscope.sources.intermediate import (
    BROADCAST_LIMIT_BYTES,
    broadcast_if_small,
    materialize,
    vector_table_bytes,
)

BY_SPLIT = ("split", "label")
METRICS = ("cosine", "euclidean")
PAIR_BLOCK = 256
#: Rows of one group that share a key where rows meet centroids in a shuffle.
ROWS_PER_SALT = 1_000_000
WINNER_BYTES = 256


def _joined_labels(frame: DataFrame, keys: Sequence[str], manifest: DataFrame | None) -> DataFrame:
    if manifest is None:
        return frame
    return manifest.select(*keys).distinct().join(frame, list(keys), "left")


def centroids(
    emb: DataFrame, by: Sequence[str] = BY_SPLIT, manifest: DataFrame | None = None
) -> DataFrame:
    """``*by, n, centroid``: the plain mean vector per group.

    ``manifest`` adds a row with null centroid for groups without any text.
    """
    means = position_sums(emb, by).withColumn("x", F.col("x") / F.col("n"))
    # As many entries per group as the vector is long.
    entries = F.sort_array(F.collect_list(F.struct("pos", "x")))
    found = means.groupBy(*by).agg(
        F.max("n").alias("n"), F.transform(entries, lambda e: e["x"]).alias("centroid")
    )
    return _joined_labels(found, by, manifest).withColumn(
        "n", F.coalesce("n", F.lit(0).cast("long"))
    )


def cohesion(
    emb: DataFrame, by: Sequence[str] = BY_SPLIT, manifest: DataFrame | None = None
) -> DataFrame:
    """``*by, cohesion, n``: mean cosine similarity of the rows of a group to its centroid.

    The mean of ``cos(x, c)`` equals the inner product of ``c / |c|`` with the mean of ``x / |x|``,
    so a single pass and no join with the centroids is enough.
    """
    means = position_sums(emb, by)
    c, u = F.col("x") / F.col("n"), F.col("u") / F.col("n")
    found = means.groupBy(*by).agg(
        F.coalesce(F.try_divide(F.sum(c * u), F.sqrt(F.sum(c * c))), F.lit(0.0)).alias("cohesion"),
        F.max("n").alias("n"),
    )
    return _joined_labels(found, by, manifest).withColumn(
        "n", F.coalesce("n", F.lit(0).cast("long"))
    )


def attach_centroid(
    emb: DataFrame,
    cents: DataFrame,
    by: Sequence[str] = BY_SPLIT,
    limit: int = BROADCAST_LIMIT_BYTES,
) -> DataFrame:
    """Join every row with the centroid of its own group.

    ``cents`` must be a materialized table. Up to ``limit`` bytes it is broadcast; beyond that both
    sides are shuffled. A group of more than ``ROWS_PER_SALT`` rows, which are counted, is then spread over
    as many keys as it takes; there are few such groups. Null is a group like any other.
    """
    size = vector_table_bytes(cents, "centroid")[1]
    own = cents.select(*by, "centroid")
    if size <= limit:
        return join_groups(emb, F.broadcast(own), by)
    counts = materialize(emb.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / ROWS_PER_SALT).cast("int").alias("salts")), "salts")
    large = broadcast_if_small(counts.where("salts > 1"), WINNER_BYTES)
    salt = F.pmod(F.xxhash64("id"), F.coalesce("salts", F.lit(1))).cast("int")
    salted = join_groups(emb, large, by, "left").withColumn("salt", salt).drop("salts")
    copies = join_groups(own, large, by, "left").select(
        *by, "centroid", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt")
    )
    return join_groups(salted, copies, [*by, "salt"]).drop("salt")


def row_similarity(
    emb: DataFrame,
    cents: DataFrame,
    by: Sequence[str] = BY_SPLIT,
    limit: int = BROADCAST_LIMIT_BYTES,
) -> DataFrame:
    """``id, *by, similarity``: cosine similarity of each row to the centroid of its group."""
    # Scaling the centroids first leaves two sums per row instead of three.
    scaled = cents.withColumn("centroid", unit(F.col("centroid")))
    joined = attach_centroid(emb.where(F.col("vec").isNotNull()), scaled, by, limit)
    along, length = dot(F.col("vec"), F.col("centroid")), norm(F.col("vec"))
    return joined.select(
        "id", *by, F.coalesce(F.try_divide(along, length), F.lit(0.0)).alias("similarity")
    )


def cohesion_stats(
    emb: DataFrame,
    cents: DataFrame,
    by: Sequence[str] = BY_SPLIT,
    limit: int = BROADCAST_LIMIT_BYTES,
) -> DataFrame:
    """``*by, mean, median, std`` of the similarities to the own centroid.

    ``cents`` must be a materialized table. The median is exact and found by radix selection, so no
    task ever holds the values of a group.
    """
    similarity = materialize(row_similarity(emb, cents, by, limit).drop("id"), "similarity")
    return grouped_stats(similarity, by, "similarity")


def scaled_similarity(similarity: DataFrame) -> DataFrame:
    """Min-max scale a materialized :func:`row_similarity` table over all of its rows.

    When all rows have the same value they are left as they are.
    """
    bounds = similarity.agg(
        F.struct(F.min("similarity").alias("low"), F.max("similarity").alias("high"))
    ).scalar()
    low, high = bounds["low"], bounds["high"]
    value = F.col("similarity")
    return similarity.withColumn(
        "scaled", F.coalesce(F.try_divide(value - low, high - low), value)
    )


def _paired(cents: DataFrame, value: Column, keep: Column, n: int, within: Sequence[str]) -> DataFrame:
    """Pairs of centroids for which ``keep`` holds, computed block against block.

    Labels are hashed into blocks and every pair of blocks is one key of an equi-join, so a task
    gets about ``PAIR_BLOCK`` squared pairs, however many labels there are. Two different blocks
    meet once, and their pairs are turned so that the smaller label comes first; only inside a block
    does ``keep`` have to choose between the two orders.
    """
    blocks = max(1, -(-n // PAIR_BLOCK))
    block = F.pmod(F.xxhash64("label"), F.lit(blocks)).cast("int")
    side = cents.select(*within, "label", value.alias("v"), block.alias("block"))
    left = side.select(
        *within, F.col("label").alias("label1"), F.col("v").alias("v1"), F.col("block").alias("block1"),
        F.explode(F.sequence("block", F.lit(blocks - 1))).alias("block2"),
    )
    right = side.select(
        *within, F.col("label").alias("label2"), F.col("v").alias("v2"), F.col("block").alias("block2"),
        F.explode(F.sequence(F.lit(0), "block")).alias("block1"),
    )
    pairs = left.join(right, [*within, "block1", "block2"]).where((F.col("block1") < F.col("block2")) | keep)
    turned = F.col("label1") > F.col("label2")
    return pairs.select(
        *within,
        F.when(turned, F.col("label2")).otherwise(F.col("label1")).alias("label1"),
        F.when(turned, F.col("label1")).otherwise(F.col("label2")).alias("label2"),
        "v1",
        "v2",
    )


def centroid_pairs(cents: DataFrame, within: Sequence[str] = ("split",)) -> DataFrame:
    """``*within, label1, label2, similarity`` for ``label1 < label2``; null if a side has no centroid.

    ``cents`` must be a materialized table.
    """
    pairs = _paired(
        cents, unit(F.col("centroid")), F.col("label1") < F.col("label2"), cents.count(), within
    )
    return pairs.select(
        *within, "label1", "label2", dot(F.col("v1"), F.col("v2")).alias("similarity")
    )


def similarity_matrix(cents: DataFrame, metric: str = "cosine") -> DataFrame:
    """``label1, label2, similarity`` for all ordered pairs of labels, the diagonal included.

    ``cents`` must be a materialized table with one row per label. The measure is symmetric: each
    pair is computed once and mirrored.
    """
    if metric not in METRICS:
        raise ValueError(f"Unsupported metric: {metric}")
    n = cents.count()
    if n < 2:
        raise ValueError("at least two labels are needed")
    value = unit(F.col("centroid")) if metric == "cosine" else F.col("centroid")
    pairs = _paired(cents, value, F.col("label1") <= F.col("label2"), n, ())
    v1, v2 = F.col("v1"), F.col("v2")
    score = dot(v1, v2) if metric == "cosine" else 1 / (1 + euclidean(v1, v2))
    upper = pairs.select("label1", "label2", score.alias("similarity"))
    l1, l2 = F.col("label1"), F.col("label2")
    same = F.struct(l1.alias("label1"), l2.alias("label2"))
    swapped = F.struct(l2.alias("label1"), l1.alias("label2"))
    return upper.select(
        F.inline(F.when(l1 == l2, F.array(same)).otherwise(F.array(same, swapped))), "similarity"
    )


def matrix_wide(matrix: DataFrame, labels: Sequence[str | int]) -> DataFrame:
    """One row per label and one column for each of ``labels``, from a :func:`similarity_matrix`."""
    return matrix.groupBy("label1").pivot("label2", list(labels)).agg(F.first("similarity"))


def rounded_matrix(matrix: DataFrame, digits: int = 2) -> DataFrame:
    return matrix.withColumn("similarity", F.round("similarity", digits))


def cross_split_similarity(
    emb: DataFrame,
    first: str = "train",
    second: str = "test",
    manifest: DataFrame | None = None,
) -> DataFrame:
    """``label, cross_similarity``: cosine of the two centroids of a label.

    Labels of both splits only. With a ``manifest`` these are the labels of its files, and the value
    is null where a file holds no text. No vector is ever rebuilt: the inner products are sums over
    positions.
    """
    found = _split_products(emb, first, second).where(
        F.col("aa").isNotNull() & F.col("bb").isNotNull()
    )
    similar = found.select(
        "label",
        cosine_from_sums(F.col("ab"), F.col("aa"), F.col("bb")).alias("cross_similarity"),
    )
    if manifest is None:
        return similar
    common = (
        manifest.groupBy("label")
        .agg(
            F.max(F.col("split") == first).alias("in_first"),
            F.max(F.col("split") == second).alias("in_second"),
        )
        .where(F.col("in_first") & F.col("in_second"))
        .select("label")
    )
    return common.join(similar, "label", "left")


def _split_products(emb: DataFrame, first: str, second: str) -> DataFrame:
    mean = F.col("x") / F.col("n")
    sides = position_sums(emb.where(F.col("split").isin(first, second)), ("label", "split")).groupBy("label", "pos").agg(
        F.max(F.when(F.col("split") == first, mean)).alias("a"), F.max(F.when(F.col("split") == second, mean)).alias("b")
    )
    a, b = F.col("a"), F.col("b")
    return sides.groupBy("label").agg(
        F.sum(a * b).alias("ab"), F.sum(a * a).alias("aa"), F.sum(b * b).alias("bb")
    )


def split_consistency(emb: DataFrame, first: str = "train", second: str = "test") -> DataFrame:
    """``label, similarity, consistency`` for labels with a usable centroid in both splits.

    Zero centroids and values that are not finite are left out; order with
    :func:`most_consistent_first` at the sink. Reading the result fails when the splits have no label
    in common, or when no label has a usable similarity.
    """
    products = _split_products(emb, first, second)
    similarity = F.try_divide(F.col("ab"), F.sqrt("aa") * F.sqrt("bb"))
    usable = ~F.isnan("similarity") & (F.abs("similarity") < float("inf"))
    found = (
        products.select("label", similarity.alias("similarity"))
        .where(usable)
        .withColumn("consistency", F.col("similarity"))
    )
    counts = products.agg(
        F.count_if(F.col("aa").isNotNull() & F.col("bb").isNotNull()).alias("common"),
        F.count_if(~F.isnan(similarity) & (F.abs(similarity) < float("inf"))).alias("usable"),
    )
    # A branch that gives no rows and fails where there is nothing to compare; the sums are shared.
    fault = F.when(F.col("common") == 0, F.raise_error("no label occurs in both splits").cast("string")).when(
        F.col("usable") == 0, F.raise_error("no label has a usable similarity").cast("string")
    )
    nothing = counts.where(fault.isNotNull()).select(
        F.lit(None).cast(found.schema["label"].dataType).alias("label"),
        F.lit(None).cast("double").alias("similarity"),
        F.lit(None).cast("double").alias("consistency"),
    )
    return found.unionByName(nothing)


def most_consistent_first(frame: DataFrame) -> DataFrame:
    return frame.orderBy(F.desc("similarity"), "label")


def label_sample(
    emb: DataFrame, size: int = 100, by: Sequence[str] = BY_SPLIT, seed: int = 0
) -> DataFrame:
    """At most ``size`` rows per group and their ``rank``, the same rows on every run with the same seed.

    Rows are ranked by a hash of their id; ids are distinct within a group. Only group, id and hash are
    sorted and exchanged, and each task passes on no more than ``size`` of a group; the winners then
    pick up their other columns.
    """
    draw = F.md5(F.concat_ws(":", F.lit(seed), F.col("id").cast("string")))
    place = F.row_number().over(Window.partitionBy(*by).orderBy("draw", "id"))
    drawn = emb.select(*by, "id", draw.alias("draw")).withColumn("rank", place)
    winners = materialize(drawn.where(F.col("rank") <= size).drop("draw"), "winners")
    return join_groups(emb, broadcast_if_small(winners, WINNER_BYTES), [*by, "id"])
