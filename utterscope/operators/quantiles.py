"""Exact medians and moments of groups that are too large for one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from utterscope.sources.intermediate import BROADCAST_LIMIT_BYTES, materialize

#: Bits of a value that one pass looks at, and values that one task may rank.
DIGIT_BITS = 16
RANKED = 1 << 16
MIDDLE_ROW_BYTES = 256

# Fixed values of the 64-bit floating-point format: bits of the fraction, exponents of the least and the
# greatest normal number, and the distance between numbers below the least normal one.
FRACTION_BITS, LEAST_EXPONENT, GREATEST_EXPONENT, LEAST_STEP = 52, -1022, 1023, 5e-324


def ordered_key(value: Column) -> Column:
    """A long that is ordered and distinct as the doubles are; NaN is the greatest, -0.0 equals 0.0.

    A normal number is ``m * 2^e`` with m from 1 up to 2. Its key is made of e and of the 52 bits of m
    behind the point; smaller ones are counted by their distance from 0. A negative value has the key of its
    positive one, negated.
    """
    size = F.abs(value)

    def power(exponent: Column) -> Column:
        return F.pow(F.lit(2.0), exponent.cast("double"))

    # The logarithm may be off by a little next to a power of two; the division by a power of two is exact.
    guess = F.least(F.greatest(F.floor(F.log2(size)), F.lit(LEAST_EXPONENT)), F.lit(GREATEST_EXPONENT)).cast("int")
    exponent = (
        F.when(size < power(guess), guess - 1)
        .when((guess < GREATEST_EXPONENT) & (size >= power(guess + 1)), guess + 1)
        .otherwise(guess)
    )
    steps = 1 << FRACTION_BITS
    fraction = ((size / power(exponent) - 1.0) * F.lit(float(steps))).cast("long")
    normal = (exponent - LEAST_EXPONENT + 1).cast("long") * F.lit(steps) + fraction
    beyond = (GREATEST_EXPONENT - LEAST_EXPONENT + 2) * steps
    positive = (
        F.when(size < F.lit(2.0**LEAST_EXPONENT), (size / F.lit(LEAST_STEP)).cast("long"))
        .when(size == float("inf"), F.lit(beyond))
        .otherwise(normal)
    )
    return F.when(F.isnan(value), F.lit(beyond + 1)).when(value < 0, -positive).otherwise(positive)


def join_groups(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on the columns ``by``, where null is a group like any other."""
    renamed = right.withColumnsRenamed({c: f"_{c}" for c in by})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])
    return left.join(renamed, same, how).drop(*[f"_{c}" for c in by])


def grouped_stats(frame: DataFrame, by: Sequence[str], value: str, ranked: int = RANKED) -> DataFrame:
    """``*by, mean, median, std`` (of the population) of a column; ``frame`` is a materialized table.

    The median is found by radix selection on the ordered bits of the values: a histogram of the first 16
    bits per group shows where the middle ranks lie; while more than ``ranked`` values lie there, the
    next 16 bits are counted, of these values only. The few values left are ranked. So whatever the
    distribution, no task holds more values of a group than that, and four passes see every bit. Mean and
    spread come from the first histogram. Null values are left out, groups with a null key are groups
    like any other.
    """
    placed = frame.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("value"))
    shift = 64 - DIGIT_BITS
    found = _middle(_counted(placed, by, shift, []), by, ["n", "mean", "std"], first=True)
    while True:
        watched = Observation()
        sizes = (F.count(F.lit(1)).alias("rows"), F.max("inside").alias("inside"))
        found = materialize(found.observe(watched, *sizes), "middle-cells")
        size = watched.get
        small = F.broadcast(found) if size["rows"] * MIDDLE_ROW_BYTES <= BROADCAST_LIMIT_BYTES else found
        inside = _inside(placed, small, by, shift)
        if shift == 0 or (size["inside"] or 0) <= ranked:
            break
        shift -= DIGIT_BITS
        carried = ["before", "rank1", "rank2", "mean", "std", "cell"]
        found = _middle(_counted(inside, by, shift, carried), by, carried)
    return _picked(inside, by)


def grouped_median(frame: DataFrame, by: Sequence[str], value: str, ranked: int = RANKED) -> DataFrame:
    """``*by, median`` of a column, see :func:`grouped_stats`."""
    return grouped_stats(frame, by, value, ranked).select(*by, "median")


def _counted(placed: DataFrame, by: Sequence[str], shift: int, carried: list[str]) -> DataFrame:
    """A histogram of the leading bits of the values, down to ``shift``."""
    leading = F.shiftright(ordered_key(F.col("value")), shift).alias("lead")
    moments = [] if carried else [F.avg("value").alias("cell_mean"), F.var_pop("value").alias("cell_var")]
    return (
        placed.select(*by, *carried, "value", leading)
        .groupBy(*by, *carried, "lead")
        .agg(F.count(F.lit(1)).alias("inside"), *moments)
    )


def _middle(counted: DataFrame, by: Sequence[str], carried: list[str], first: bool = False) -> DataFrame:
    """The cells that hold the middle ranks of a group: at most two, with their moments on the first pass.

    The windows hold one row per cell of a group.
    """
    cells = Window.partitionBy(*by, *([] if first else ["cell"]))
    upto = F.sum("inside").over(cells.orderBy("lead").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    if first:
        total, mean = F.sum("inside").over(cells), F.sum(F.col("inside") * F.col("cell_mean")).over(cells)
        counted = counted.withColumn("n", total).withColumn("mean", mean / F.col("n"))
        apart = F.col("cell_mean") - F.col("mean")
        spread = F.sum(F.col("inside") * (F.col("cell_var") + apart * apart)).over(cells)
        counted = counted.withColumn("std", F.sqrt(spread / F.col("n"))).select(
            "*",
            F.lit(0).cast("long").alias("before"),
            # 1-based ranks of the two middle values; they coincide for an odd count.
            F.floor((F.col("n") + 1) / 2).alias("rank1"),
            F.floor((F.col("n") + 2) / 2).alias("rank2"),
        )
    within = counted.withColumn("through", F.col("before") + upto).withColumn("start", F.col("through") - F.col("inside"))
    holds = [(F.col("start") < F.col(r)) & (F.col(r) <= F.col("through")) for r in ("rank1", "rank2")]
    return within.where(holds[0] | holds[1]).select(
        *by, F.col("lead").alias("cell"), F.col("start").alias("before"), "rank1", "rank2", "mean", "std", "inside"
    )


def _inside(placed: DataFrame, cells: DataFrame, by: Sequence[str], shift: int) -> DataFrame:
    """The values that lie in one of the cells, with what is known of it."""
    led = placed.select(*by, "value", F.shiftright(ordered_key(F.col("value")), shift).alias("cell"))
    return join_groups(led, cells, [*by, "cell"])


def _picked(inside: DataFrame, by: Sequence[str]) -> DataFrame:
    """The median of each group from the values of its middle cells."""
    kept = ["cell", "before", "rank1", "rank2", "mean", "std"]
    # Equal values are summed up: a cell of one repeated value is a single row.
    values = inside.groupBy(*by, *kept, "value").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy(*by, "cell").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = values.withColumn("last", F.col("before") + F.sum("n").over(upto)).withColumn(
        "first", F.col("last") - F.col("n") + 1
    )

    def at(rank: str) -> Column:
        return F.max(F.when(F.col(rank).between(F.col("first"), F.col("last")), F.col("value")))

    return ranked.groupBy(*by).agg(
        F.max("mean").alias("mean"), ((at("rank1") + at("rank2")) / 2).alias("median"), F.max("std").alias("std")
    )
