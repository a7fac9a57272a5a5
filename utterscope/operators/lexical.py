"""Vocabulary size and type-token ratio of a labelled corpus (``split, label, text``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utterscope.functions.numeric import ratio
from utterscope.functions.text import tokens

#: Sketches hold 2 to this power registers.
PRECISION = 14


def token_counts(corpus: DataFrame) -> DataFrame:
    """Occurrences of each token per (split, label).

    A group whose texts hold no token at all appears with a null token.
    """
    exploded = corpus.where(F.col("text").isNotNull()).select(
        "split", "label", F.explode_outer(tokens(F.col("text"))).alias("token")
    )
    # The shuffle key holds the token, so a label with most of the text still spreads out, and
    # frequent tokens are summed up before the shuffle.
    return exploded.groupBy("split", "label", "token").agg(
        F.count(F.col("token")).alias("occurrences")
    )


def vocabulary(corpus: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """``split, label, vocab_size, token_count, type_token_ratio``.

    ``manifest`` (``split, label``) adds zero rows for files that hold no text.
    """
    sizes = (
        token_counts(corpus)
        .groupBy("split", "label")
        .agg(
            F.count("token").alias("vocab_size"),
            F.sum("occurrences").alias("token_count"),
        )
    )
    if manifest is not None:
        zero = F.lit(0).cast("long")
        known = manifest.select(
            "split", "label", zero.alias("vocab_size"), zero.alias("token_count")
        )
        sizes = (
            sizes.unionByName(known)
            .groupBy("split", "label")
            .agg(F.sum("vocab_size").alias("vocab_size"), F.sum("token_count").alias("token_count"))
        )
    return sizes.withColumn(
        "type_token_ratio", ratio(F.col("vocab_size"), F.col("token_count"))
    )


def vocabulary_sketches(corpus: DataFrame, precision: int = PRECISION) -> DataFrame:
    """``split, label, sketch, token_count``: a distinct-count sketch of the tokens of each group.

    A sketch has a bounded size whatever the number of tokens, and sketches unite: stored ones of
    several days or parts give the estimate of all of them, see :func:`estimated_vocabulary`. No token is
    shuffled. Its relative standard error is about ``1.04 / sqrt(2 ** precision)``.
    """
    exploded = corpus.where(F.col("text").isNotNull()).select(
        "split", "label", F.explode_outer(tokens(F.col("text"))).alias("token")
    )
    return exploded.groupBy("split", "label").agg(
        F.hll_sketch_agg("token", precision).alias("sketch"), F.count("token").alias("token_count")
    )


def estimated_vocabulary(sketches: DataFrame, by: Sequence[str] = ("split", "label")) -> DataFrame:
    """``*by, vocab_size, token_count, type_token_ratio``, estimated from :func:`vocabulary_sketches`.

    Groups of ``by`` may unite any number of stored sketches of one precision.
    """
    united = sketches.groupBy(*by).agg(
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("vocab_size"), F.sum("token_count").alias("token_count")
    )
    return united.withColumn("type_token_ratio", ratio(F.col("vocab_size"), F.col("token_count")))


def ratio_difference(vocab: DataFrame, test: str = "test", train: str = "train") -> DataFrame:
    """``label, test_ttr, train_ttr, type_token_ratio_diff`` for the labels found in both splits."""
    ttr = F.col("type_token_ratio")
    return (
        vocab.groupBy("label")
        .agg(
            F.max(F.when(F.col("split") == test, ttr)).alias("test_ttr"),
            F.max(F.when(F.col("split") == train, ttr)).alias("train_ttr"),
        )
        .where(F.col("test_ttr").isNotNull() & F.col("train_ttr").isNotNull())
        .withColumn("type_token_ratio_diff", F.abs(F.col("test_ttr") - F.col("train_ttr")))
    )


def label_union(corpus: DataFrame) -> DataFrame:
    """Labels that occur in any split."""
    return corpus.select("label").distinct()


def label_intersection(
    corpus: DataFrame, first: str = "test", second: str = "train"
) -> DataFrame:
    """Labels that occur in both splits; one pass instead of two scans and a join."""
    present = corpus.groupBy("label").agg(
        F.max(F.col("split") == first).alias("in_first"),
        F.max(F.col("split") == second).alias("in_second"),
    )
    return present.where(F.col("in_first") & F.col("in_second")).select("label")
