"""Mixing sources to target weights by weighted fair queueing.

Each source is a flow. Its documents queue in a repeatable random order, repeated epoch after epoch
up to ``max_epochs`` times. A copy gets a virtual finish time: the words of its source up to its own
middle, divided by the source's target. (Up to its middle and not its end, so that the cut rounds a
source to the nearest whole document instead of always downwards.) All copies are range-sorted by it
and the sorted stream is cut where it has used up the total budget; what lies before is the mix.

No step groups the rows of a source in one task: the running totals of a source come from totals of
hash ranges, whose number grows with the rows, plus a running sum inside one range; the cut comes
from totals of the partitions of the range sort plus a running sum inside one partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from utterscope.llm.common import fresh_names, save, shards, small, word_count

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
SEED = 10
#: Documents in one hash range of a source, about.
ROWS_PER_RANGE = 2_000
#: Copies in one partition of the range sort, about; there are at least as many partitions as in any shuffle.
COPIES_PER_PARTITION = 500_000


def source_targets(totals: DataFrame, weights: tuple[float, ...], max_epochs: int) -> DataFrame:
    """Targets of the sources in ``totals`` (source, source_size, source_rows).

    Weights repeat over the sources in code point order, null last. The targets share all words in
    proportion to the weights; one that would exceed ``max_epochs`` times its source's size stops
    there and the excess is shared again by weight. Closed form: sort by size / weight, and find the
    first source from which on all of them can bear the common level. The table has one row per
    source, so its windows see no document.
    """
    table = F.array(*[F.lit(float(w)) for w in weights])
    ranked = totals.withColumn(
        "rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ).withColumn("weight", F.element_at(table, (F.col("rank") % len(weights) + 1).cast("int")))
    limit = F.col("source_size") * F.lit(float(max_epochs))
    by_level = Window.orderBy(F.col("limit") / F.col("weight"), "rank")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    bearing = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    levels = ranked.withColumn("limit", limit).withColumn("level", left / bearing)
    free = F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.col("level"))
    return levels.withColumn("common", F.first(free, ignorenulls=True).over(everything)).select(
        "source",
        "source_size",
        "source_rows",
        F.least(F.col("limit"), F.coalesce("common", F.lit(0.0)) * F.col("weight")).alias("target"),
    )


def _same_source(left: DataFrame, right: DataFrame) -> Column:
    return left["source"].eqNullSafe(right["source"])


def mix(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
    rows_per_range: int = ROWS_PER_RANGE,
    copies_per_partition: int = COPIES_PER_PARTITION,
) -> tuple[DataFrame, DataFrame]:
    """``(schedule, stream)``.

    ``schedule`` has one row per document: row, doc_id, source, hash, size, source_size, target,
    epochs (copies in the mix) and taken (their words). ``stream`` has one row per copy in the mix:
    row, doc_id, source, hash, size, epoch, finish; its range-sorted order is the order of the mix.

    The budget is the number of words of all documents. The size of a document is its number of
    words, 0 for a null, empty or blank text; such a document has no finish time of its own and is
    never taken. A null source is a source like any other, ordered last. Ties in the random order
    are resolved by id, text hash and row; rows that are equal in all of these are interchangeable.
    Whole documents are taken, so a source misses its target by about one document. An empty table,
    or one without any word, gives an empty mix. Other columns are not read.
    """
    measured = save(
        documents.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(id_column).alias("doc_id"),
            F.col(source_column).alias("source"),
            F.xxhash64(F.col(text_column)).alias("hash"),
            word_count(F.col(text_column)).alias("size"),
        ),
        "mix-measured",
    )
    sources = save(
        source_targets(
            measured.groupBy("source").agg(
                F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows")
            ),
            weights,
            max_epochs,
        ),
        "mix-sources",
    )
    known = small(sources, 200)
    drawn = F.xxhash64(F.lit(seed), F.col("source"), F.col("doc_id"), F.col("hash"))
    # The hash is read as a number from 0 to 2^63 - 1; equal steps of it give a source's ranges.
    ranges = F.ceil(F.col("source_rows") / rows_per_range)
    placed = (
        measured.join(known, _same_source(measured, known))
        .select(*[measured[c] for c in measured.columns], "source_size", "source_rows", "target")
        .withColumn("draw", F.shiftrightunsigned(drawn, 1))
        .withColumn("range", F.floor(F.col("draw") / F.lit(float(1 << 63)) * ranges))
    )
    totals = placed.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    ahead = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("offset", F.coalesce(F.sum("range_size").over(ahead), F.lit(0)))
    offsets = save(offsets, "mix-offsets")
    inside = Window.partitionBy("source", "range").orderBy("draw", "doc_id", "hash", "row")
    queued = placed.withColumn("inside", F.sum("size").over(inside))
    first = small(offsets, 64).withColumnRenamed("range", "range_of")
    kept = (*measured.columns, "draw", "source_size", "target")
    queued = save(
        queued.join(first, _same_source(queued, first) & (queued["range"] == first["range_of"])).select(
            *[queued[c] for c in kept], (F.col("offset") + F.col("inside")).alias("served")
        ),
        "mix-queued",
    )

    copies = queued.where("size > 0").select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))).alias("epoch")
    )
    served = F.col("epoch") * F.col("source_size") + F.col("served") - F.col("size") / 2
    finish = served / F.col("target")
    # Twice the common level serves every source twice over or whole: no later copy can be reached.
    copies = copies.withColumn("finish", finish).where("target > 0 and finish <= 2")
    order = ["finish", "draw", "doc_id", "hash", "row"]
    least = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, shards(measured.count() * max_epochs, copies_per_partition))
    stream = save(
        copies.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id()),
        "mix-stream",
    )
    part_totals = stream.groupBy("part").agg(F.sum("size").alias("part_size"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    part_offsets = part_totals.select(
        "part", F.coalesce(F.sum("part_size").over(earlier), F.lit(0)).alias("part_offset")
    )
    part_offsets = small(save(part_offsets, "mix-part-offsets"), 32)
    running = F.sum("size").over(Window.partitionBy("part").orderBy(*order))
    budget = sources.agg(F.sum("source_size").alias("budget")).first()["budget"] or 0
    mixed = (
        stream.withColumn("running", running)
        .join(part_offsets, "part")
        .where(F.col("part_offset") + F.col("running") <= F.lit(budget))
    )
    mixed = save(mixed.select("row", "doc_id", "source", "hash", "size", "epoch", "finish"), "mix-mixed")
    taken = mixed.groupBy("row").agg(F.count(F.lit(1)).alias("epochs"))
    schedule = queued.join(taken, "row", "left").select(
        "row", "doc_id", "source", "hash", "size", "source_size", "target",
        F.coalesce("epochs", F.lit(0)).alias("epochs"),
        (F.coalesce("epochs", F.lit(0)) * F.col("size")).alias("taken"),
    )
    return schedule, mixed


def mixed_documents(documents: DataFrame, **options) -> DataFrame:
    """``documents`` with each row repeated as often as the mix takes it; other rows are left out.

    Rows are matched by id, source and text hash. Rows equal in all three are interchangeable: their
    copies in the mix are shared out evenly, and where that leaves a rest the first of them get one more.
    """
    schedule, _ = mix(documents, **options)
    id_column, source, text = (
        options.get(k, v) for k, v in (("id_column", "doc_id"), ("source_column", "source"), ("text_column", "text"))
    )
    total, n = F.sum("epochs"), F.count(F.lit(1))
    names = fresh_names(documents, "id_", "source_", "hash_", "each", "more", "copy", "number")
    of_id, of_source, of_hash, each, more, copy, number = names
    chosen = save(
        schedule.groupBy(F.col("doc_id").alias(of_id), F.col("source").alias(of_source), F.col("hash").alias(of_hash))
        .agg(F.floor(total / n).cast("int").alias(each), (total % n).alias(more))
        .where((F.col(each) > 0) | (F.col(more) > 0)),
        "mix-chosen",
    )

    def joined(part: DataFrame) -> DataFrame:
        return documents.join(
            small(part, 96),
            documents[id_column].eqNullSafe(F.col(of_id))
            & documents[source].eqNullSafe(F.col(of_source))
            & (F.xxhash64(documents[text]) == F.col(of_hash)),
        )

    def copied(rows: DataFrame) -> DataFrame:
        return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(each)))).select(
            *[documents[c] for c in documents.columns]
        )

    even = copied(joined(chosen.where(F.col(more) == 0)))
    # Equal rows queue one after the other, so only where the cut meets a source can they differ.
    uneven = chosen.where(F.col(more) > 0)
    if uneven.isEmpty():
        return even
    place = F.row_number().over(Window.partitionBy(of_id, of_source, of_hash).orderBy(F.lit(1)))
    rest = joined(uneven).withColumn(number, place)
    rest = rest.withColumn(each, F.col(each) + (F.col(number) <= F.col(more)).cast("int"))
    return even.unionByName(copied(rest.where(F.col(each) > 0)))
