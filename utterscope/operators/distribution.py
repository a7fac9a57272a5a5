"""Length distributions of a labelled corpus: histogram, kurtosis, earth mover's distance, JS.

All of them come from one histogram of (label, kind, length). Building it is the only step whose
cost follows the size of the corpus; it holds one row per distinct length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from utterscope.functions.numeric import count_where
from utterscope.functions.text import tokens

# The two kinds of length, the smoothing constant of the divergence, and the number
# of observations up to which a kurtosis is not given.
SENTENCE = "sentence"
WORD = "word"
SMOOTHING = 1e-9
KURTOSIS_MIN_COUNT = 3


def histogram(corpus: DataFrame, test: str = "test", train: str = "train") -> DataFrame:
    """``label, kind, x, n_test, n_train`` over every length that occurs in either split.

    A ``sentence`` length is the number of tokens of a text, a ``word`` length the number of
    characters of a token.
    """
    texts = (
        corpus.where(F.col("text").isNotNull())
        .select("split", "label", tokens(F.col("text")).alias("tokens"))
        .withColumn("size", F.size("tokens"))
    )
    # The size is a column of its own by now: the array itself must not travel with every token.
    words = texts.select(
        "split", "label", "size", F.posexplode_outer("tokens").alias("pos", "token")
    )
    # The first row of a text also carries its sentence length, so one pass over the tokens counts
    # both kinds without building an array of lengths.
    first = F.coalesce("pos", F.lit(0)) == 0
    pairs = words.groupBy(
        "label",
        F.when(first, F.col("size")).alias("sentence"),
        F.char_length("token").alias("word"),
    ).agg(
        count_where(F.col("split") == test).alias("n_test"),
        count_where(F.col("split") == train).alias("n_train"),
    )
    kinds = F.array(
        F.struct(F.lit(SENTENCE).alias("kind"), F.col("sentence").alias("x")),
        F.struct(F.lit(WORD).alias("kind"), F.col("word").alias("x")),
    )
    return (
        pairs.select("label", F.inline(kinds), "n_test", "n_train")
        .where(F.col("x").isNotNull())
        .groupBy("label", "kind", "x")
        .agg(F.sum("n_test").alias("n_test"), F.sum("n_train").alias("n_train"))
    )


def length_stats(hist: DataFrame) -> DataFrame:
    """``label, split, kind, n, mean, min, max`` of the lengths in a :func:`histogram`."""
    weighted = _by_split(hist)
    return weighted.groupBy("label", "split", "kind").agg(
        F.sum("n").alias("n"),
        (F.sum(F.col("n") * F.col("x")) / F.sum("n")).alias("mean"),
        F.min("x").alias("min"),
        F.max("x").alias("max"),
    )


def _by_split(hist: DataFrame) -> DataFrame:
    sides = F.array(
        F.struct(F.lit("test").alias("split"), F.col("n_test").alias("n")),
        F.struct(F.lit("train").alias("split"), F.col("n_train").alias("n")),
    )
    return hist.select("label", "kind", "x", F.inline(sides)).where(F.col("n") > 0)


def _one_row_per_label(frame: DataFrame, values: dict[str, Column], order: list[str]) -> DataFrame:
    return frame.groupBy("label").agg(*[F.max(values[name]).alias(name) for name in order])


def kurtosis(hist: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """Excess kurtosis (biased) of both kinds in both splits, one row per label of either split.

    Null for up to three observations and for a constant series. ``manifest`` (``label``) adds a row of
    nulls for labels without any text.
    """
    group = Window.partitionBy("label", "kind", "split")
    n, x = F.col("n"), F.col("x")
    deviation = x - F.sum(n * x).over(group) / F.sum(n).over(group)
    moments = (
        _by_split(hist)
        .withColumn("d2", F.pow(deviation, F.lit(2)))
        .groupBy("label", "kind", "split")
        .agg(
            F.sum("n").alias("n"),
            F.sum(n * F.col("d2")).alias("m2"),
            F.sum(n * F.col("d2") * F.col("d2")).alias("m4"),
        )
    )
    value = F.when(
        (n > KURTOSIS_MIN_COUNT) & (F.col("m2") > 0),
        n * F.col("m4") / (F.col("m2") * F.col("m2")) - 3,
    )
    columns = {
        f"{split}_{kind}_length_kurtosis": F.when(
            (F.col("split") == split) & (F.col("kind") == kind), F.col("value")
        )
        for split in ("test", "train")
        for kind in (SENTENCE, WORD)
    }
    found = _one_row_per_label(moments.withColumn("value", value), columns, list(columns))
    if manifest is None:
        return found
    return manifest.select("label").distinct().join(found, "label", "left")


def divergences(hist: DataFrame) -> DataFrame:
    """``label, kind, emd, js`` between the two splits, for the labels found in both."""
    whole = Window.partitionBy("label", "kind")
    walk = whole.orderBy("x")
    so_far = walk.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total_a, total_b = F.sum("n_test").over(whole), F.sum("n_train").over(whole)
    support = F.count(F.lit(1)).over(whole)
    p = (F.col("n_test") + SMOOTHING) / (total_a + SMOOTHING * support)
    q = (F.col("n_train") + SMOOTHING) / (total_b + SMOOTHING * support)
    steps = hist.select(
        "label",
        "kind",
        total_a.alias("total_a"),
        total_b.alias("total_b"),
        F.abs(
            F.try_divide(F.sum("n_test").over(so_far), total_a)
            - F.try_divide(F.sum("n_train").over(so_far), total_b)
        ).alias("gap"),
        (F.lead("x").over(walk) - F.col("x")).alias("width"),
        p.alias("p"),
        q.alias("q"),
    )
    mid = (F.col("p") + F.col("q")) / 2
    term = F.col("p") * F.log(F.col("p") / mid) + F.col("q") * F.log(F.col("q") / mid)
    both = (F.col("total_a") > 0) & (F.col("total_b") > 0)
    # The last step has no width. With a single length both splits are equal: distance zero.
    moved = F.coalesce(F.col("gap") * F.col("width"), F.lit(0.0))
    return steps.groupBy("label", "kind").agg(
        F.when(F.max(both), F.sum(moved)).alias("emd"),
        (F.sum(term) / 2).alias("js"),
        F.max(F.col("total_a") > 0).alias("in_test"),
        F.max(F.col("total_b") > 0).alias("in_train"),
    )


def _in_both_splits(hist: DataFrame, name: str) -> DataFrame:
    columns = {
        f"{name}_{kind}_length": F.when(F.col("kind") == kind, F.col(name))
        for kind in (SENTENCE, WORD)
    }
    # A label belongs to a split as soon as it has a text there, whether or not that has words.
    texts = F.col("kind") == SENTENCE
    found = (
        divergences(hist)
        .groupBy("label")
        .agg(
            *[F.max(column).alias(key) for key, column in columns.items()],
            F.max(texts & F.col("in_test") & F.col("in_train")).alias("found"),
        )
    )
    return found.where("found").drop("found")


def earth_movers_distance(hist: DataFrame) -> DataFrame:
    """``label, emd_sentence_length, emd_word_length``; null where a split has no such length."""
    return _in_both_splits(hist, "emd")


def js_divergence(hist: DataFrame) -> DataFrame:
    """``label, js_sentence_length, js_word_length`` with natural logarithms, not the square root."""
    return _in_both_splits(hist, "js")
