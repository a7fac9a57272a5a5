"""Per-entity accuracy, engine and method breakdowns, and utterance-level success.

Input: one row per (utterance, entity) with ``report, utterance, entity, correct, engine, method``.
A row without an entity name belongs to an utterance in which no entity was expected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from utterscope.functions.numeric import count_where, ratio

# Names and prefixes that appear in the output tables.
NO_ENTITY = ""
MICRO = "micro"
TOTAL = "Total"
ENGINE_CATEGORY = "EntityIdentifiedBy"
METHOD_CATEGORY = "entityIdentifiedUsing"
CLUSTER_PREFIXES = ["Full Match", "Partial Match"]
SUCCESS_METRIC = "utterance_level_success"


def has_entity(entity: Column) -> Column:
    return F.coalesce(entity != "", F.lit(False))


def clustered_method(method: Column) -> Column:
    """Collapse the variants of a full or a partial match; other methods pass unchanged."""
    clustered = method
    for prefix in CLUSTER_PREFIXES:
        clustered = F.when(method.startswith(prefix), F.lit(prefix)).otherwise(clustered)
    return clustered


def metrics(results: DataFrame, reports: DataFrame | None = None) -> DataFrame:
    """``report, entity, accuracy, support, is_average``.

    Besides the entities each report gets a row for utterances without entity and a ``micro`` row.
    ``reports`` (one ``report`` column) adds those two rows for reports without any data row.
    """
    per_entity = results.groupBy("report", "entity").agg(
        F.count(F.lit(1)).alias("n"), count_where(F.col("correct")).alias("right")
    )
    if reports is not None:
        empty = reports.select(
            "report",
            F.lit(None).cast("string").alias("entity"),
            F.lit(0).cast("long").alias("n"),
            F.lit(0).cast("long").alias("right"),
        )
        per_entity = per_entity.unionByName(empty)
    named = has_entity(F.col("entity"))
    n, right = F.col("n"), F.col("right")
    levels = (
        per_entity.withColumn("name", F.when(named, F.col("entity")))
        .groupingSets([["report", "name"], ["report"]], "report", "name")
        .agg(
            F.grouping("name").alias("is_average"),
            F.sum("n").alias("rows"),
            F.sum("right").alias("right"),
            count_where(named, n).alias("entity_rows"),
            count_where(named, right).alias("entity_right"),
        )
    )
    rows, entity_rows = F.col("rows"), F.col("entity_rows")
    without = F.struct(
        F.lit(NO_ENTITY).alias("entity"),
        F.lit(1.0).alias("accuracy"),
        (rows - entity_rows).alias("support"),
    )
    micro = F.struct(
        F.lit(MICRO).alias("entity"),
        ratio(F.col("entity_right"), entity_rows).alias("accuracy"),
        rows.alias("support"),
    )
    own = F.struct(
        F.col("name").alias("entity"),
        ratio(F.col("right"), rows).alias("accuracy"),
        rows.alias("support"),
    )
    is_average = F.col("is_average") == 1
    return (
        levels.where(is_average | F.col("name").isNotNull())
        .select(
            "report",
            is_average.alias("is_average"),
            F.inline(F.when(is_average, F.array(without, micro)).otherwise(F.array(own))),
        )
        .select("report", "entity", "accuracy", "support", "is_average")
    )


def identification(results: DataFrame) -> DataFrame:
    """``report, entity, method, count, percentage, category, sub_method``.

    ``Total`` rows give the share of an engine among the rows of the entity with a known engine;
    the others give the share of a method among the rows of the engine with a known method.
    """
    counted = (
        results.where(has_entity(F.col("entity")) & F.col("engine").isNotNull())
        .groupBy("report", "entity", "engine", "method")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # The method is clustered after counting, on a handful of rows instead of on all of them.
    levels = (
        counted.withColumn("method", clustered_method(F.col("method")))
        .groupingSets(
            [["report", "entity", "engine"], ["report", "entity", "engine", "method"]],
            "report",
            "entity",
            "engine",
            "method",
        )
        .agg(F.grouping("method").alias("is_total"), F.sum("n").alias("count"))
        .where((F.col("is_total") == 1) | F.col("method").isNotNull())
    )
    is_total = F.col("is_total") == 1
    whole = Window.partitionBy(
        "report", "entity", "is_total", F.when(~is_total, F.col("engine"))
    )
    share = F.col("count") / F.sum("count").over(whole) * 100
    return levels.select(
        "report",
        "entity",
        F.col("engine").alias("method"),
        "count",
        share.alias("percentage"),
        F.when(is_total, ENGINE_CATEGORY).otherwise(METHOD_CATEGORY).alias("category"),
        F.when(is_total, TOTAL).otherwise(F.col("method")).alias("sub_method"),
    )


def engine_summary(identified: DataFrame) -> DataFrame:
    """``report, entity, engine, count, percentage`` from an :func:`identification` table."""
    return identified.where(
        (F.col("category") == ENGINE_CATEGORY) & (F.col("method") != "")
    ).select("report", "entity", F.col("method").alias("engine"), "count", "percentage")


def methods(identified: DataFrame) -> DataFrame:
    """``report, entity, engine, method, count, percentage`` from an :func:`identification` table."""
    return identified.where(
        (F.col("category") == METHOD_CATEGORY)
        & (F.col("method") != "")
        & (F.col("sub_method") != "")
    ).select(
        "report",
        "entity",
        F.col("method").alias("engine"),
        F.col("sub_method").alias("method"),
        "count",
        "percentage",
    )


def utterance_success(results: DataFrame, reports: DataFrame | None = None) -> DataFrame:
    """``report, metric, value``: the share of utterances with entities whose entities are all right.

    A report that has rows but no utterance with an entity gets 0.0, and so does every report that
    only ``reports`` names.
    """
    counted = has_entity(F.col("entity")) & F.col("utterance").isNotNull()
    # Rows that do not count collapse to one group per report and keep the report in the result.
    per_utterance = (
        results.select(
            "report",
            F.when(counted, F.col("utterance")).alias("utterance"),
            F.coalesce("correct", F.lit(False)).alias("correct"),
        )
        .groupBy("report", "utterance")
        .agg(F.min("correct").alias("all_correct"))
    )
    known = F.col("utterance").isNotNull()
    per_report = per_utterance.groupBy("report").agg(
        count_where(known & F.col("all_correct")).alias("good"), F.count("utterance").alias("n")
    )
    if reports is not None:
        zero = F.lit(0).cast("long")
        empty = reports.select("report", zero.alias("good"), zero.alias("n"))
        per_report = (
            per_report.unionByName(empty)
            .groupBy("report")
            .agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
        )
    return per_report.select(
        "report", F.lit(SUCCESS_METRIC).alias("metric"), ratio(F.col("good"), F.col("n")).alias("value")
    )


def metrics_in_report_order(frame: DataFrame) -> DataFrame:
    """Entities ascending, then the row without entity, then ``micro``; for the sink."""
    return frame.orderBy(
        "report", "is_average", F.when(F.col("is_average"), F.col("entity") == MICRO), "entity"
    )


def breakdown_in_report_order(frame: DataFrame) -> DataFrame:
    """Entity ascending and count descending, ties by name; for the sink."""
    ties = [c for c in ("engine", "method", "sub_method") if c in frame.columns]
    if "category" not in frame.columns:
        return frame.orderBy("report", "entity", F.desc("count"), *ties)
    # The total of an engine comes before its methods, engines by descending total.
    engine_count = F.max(F.when(F.col("category") == ENGINE_CATEGORY, F.col("count"))).over(
        Window.partitionBy("report", "entity", "method")
    )
    return (
        frame.withColumn("engine_count", engine_count)
        .orderBy(
            "report",
            "entity",
            F.desc("engine_count"),
            "method",
            "category",
            F.desc("count"),
            "sub_method",
        )
        .drop("engine_count")
    )
