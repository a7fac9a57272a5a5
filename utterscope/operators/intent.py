"""Per-intent classification metrics.

Input: one row per tested utterance with ``report, expected, matched, result_type``. The rows are
read once and reduced to a cube of counts; everything after that works on the cube, whose size
depends on the number of intents and not on the number of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The label of "no intent" and the names of the two average rows.
NO_INTENT = "none"
MICRO = "micro"
MACRO = "macro"

COUNTS = ["tp", "fp", "fn", "tn"]
METRICS = ["precision", "recall", "f1", "support", "accuracy"]


def _spelled_cube(results: DataFrame) -> DataFrame:
    # Keyed by the spelling found in the data: lower-casing then runs on the cube only, and the
    # display name comes for free. All keys hash, so the aggregation never has to sort the rows.
    return results.groupBy("report", "expected", "matched", "result_type").agg(
        F.count(F.lit(1)).alias("n")
    )


def confusion(results: DataFrame) -> DataFrame:
    """Row counts by (report, expected, matched, result_type), intents in lower case."""
    return (
        _spelled_cube(results)
        .groupBy(
            "report",
            F.lower("expected").alias("expected"),
            F.lower("matched").alias("matched"),
            "result_type",
        )
        .agg(F.sum("n").alias("n"))
    )


def display_names(results: DataFrame) -> DataFrame:
    """One spelling per lower-case expected intent: the greatest in code-point order."""
    spellings = results.groupBy("report", "expected").agg(F.count(F.lit(1)).alias("n"))
    return (
        spellings.where(F.col("expected") != "")
        .groupBy("report", F.lower("expected").alias("intent"))
        .agg(F.max("expected").alias("display"))
    )


def counts(results: DataFrame) -> DataFrame:
    """True/false positives and negatives per expected intent.

    ``tp/fp/fn/tn`` follow the rule of the intent (``none`` has its own), ``plain_*`` always follow
    the rule of a regular intent, as the micro average needs them, and ``total`` is the number of
    rows of the report.
    """
    cube = _spelled_cube(results).selectExpr(
        "report", "expected", "lower(expected) as exp", "lower(matched) as mat", "result_type", "n"
    )
    # Every cube row counts for its expected intent, for its matched intent, and for the report as a
    # whole. The row of the whole holds the counts of the special rule of "no intent".
    shares = cube.selectExpr(
        "report",
        f"""inline(array(
            struct(false as whole, exp as intent, expected as display,
                   {_rows("result_type = 'TP'")} as tp, 0L as fp,
                   {_rows("result_type = 'FN'")} as fn, 0L as tn, 0L as total),
            struct(false as whole, mat as intent, cast(null as string) as display,
                   0L as tp, {_rows("not exp <=> mat and result_type = 'FP'")} as fp,
                   0L as fn, 0L as tn, 0L as total),
            struct(true as whole, '' as intent, cast(null as string) as display,
                   {_rows("exp = 'none' and result_type = 'TN'")} as tp,
                   {_rows("not exp <=> 'none' and mat = 'none' and result_type = 'FN'")} as fp,
                   {_rows("exp = 'none' and result_type = 'FP'")} as fn,
                   {_rows("not exp <=> 'none' and not mat <=> 'none' and not result_type <=> 'FN'")} as tn,
                   n as total)))""",
    )
    summed = (
        shares.where("whole or intent <> ''")
        .groupBy("report", "whole", "intent")
        .agg(F.max("display").alias("display"), *[F.sum(c).alias(c) for c in (*COUNTS, "total")])
        .where("whole or display is not null")
    )
    # The window sees one row per intent.
    return (
        summed.selectExpr(
            "*",
            "max(total) over (partition by report) as rows",
            "max(if(whole, struct(tp, fp, fn, tn), null)) over (partition by report) as special",
        )
        .where("not whole")
        .selectExpr(
            "report",
            "intent",
            "display",
            f"""inline(array(if(intent = '{NO_INTENT}', special,
                struct(tp, fp, fn, rows - tp - fp - fn as tn))))""",
            "tp as plain_tp",
            "fp as plain_fp",
            "fn as plain_fn",
            "rows as total",
        )
    )


def _rows(condition: str) -> str:
    return f"if({condition}, n, 0L)"


def _ratio(numerator: str, denominator: str) -> str:
    return f"coalesce(double({numerator}) / nullif(double({denominator}), 0), 0d)"


def metrics(results: DataFrame) -> DataFrame:
    """``report, intent, precision, recall, f1, support, accuracy, is_average``.

    One row per expected intent under its display name, plus a ``micro`` and a ``macro`` row per
    report. A report without any expected intent gives no rows.
    """
    rates = counts(results).selectExpr(
        "*", f"{_ratio('tp', 'tp + fp')} as precision", f"{_ratio('tp', 'tp + fn')} as recall"
    )
    scored = rates.selectExpr(
        "*",
        f"{_ratio('2 * precision * recall', 'precision + recall')} as f1",
        "double(tp + fn) as support",
        f"{_ratio('tp + tn', 'total')} as accuracy",
    )
    # One aggregation yields both levels: on the fine level a group is a single intent, so the
    # means are its own values; on the report level they are the macro average.
    levels = scored.groupingSets(
        [["report", "display"], ["report"]], "report", "display"
    ).agg(
        F.expr("grouping(display) = 1").alias("is_average"),
        *[F.avg(c).alias(c) for c in METRICS],
        F.sum("plain_tp").alias("tp"),
        F.sum("plain_fp").alias("fp"),
        F.sum("plain_fn").alias("fn"),
        F.max("total").alias("total"),
    )
    micro = levels.selectExpr(
        "*", f"{_ratio('tp', 'tp + fp')} as micro_p", f"{_ratio('tp', 'tp + fn')} as micro_r"
    )
    values = ", ".join(METRICS)
    return micro.selectExpr(
        "report",
        f"""inline(if(is_average,
            array(struct('{MICRO}' as intent, micro_p as precision, micro_r as recall,
                         {_ratio("2 * micro_p * micro_r", "micro_p + micro_r")} as f1,
                         double(tp + fn) as support,
                         {_ratio("total - fp - fn", "total")} as accuracy),
                  struct('{MACRO}' as intent, {values})),
            array(struct(display as intent, {values}))))""",
        "is_average",
    )


def in_report_order(frame: DataFrame) -> DataFrame:
    """Intents in ascending lower-case order, averages last (micro before macro); for the sink."""
    return frame.orderBy(
        "report", "is_average", F.when(F.col("is_average"), F.col("intent") != MICRO),
        F.lower("intent"),
    )
