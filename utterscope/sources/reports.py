"""Test reports: a preamble of key/value lines followed by a CSV table of results."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from utterscope.functions.text import strip, unquote
from utterscope.sources.files import file_stem, folder_name, model_name
from utterscope.sources.intermediate import BROADCAST_LIMIT_BYTES, broadcast_if_small, materialize
from utterscope.sources.quoted import NO_HEADER, read_records, same_parts

# The first cell of the header row, the columns of the result table with the names
# used by the operators, and the suffix of the tables of a split report.
HEADER_CELL = "Utterance"
RESULT_COLUMNS = {
    "Utterance": "utterance",
    "ExpectedIntent": "expected",
    "MatchedIntent": "matched",
    "ResultType": "result_type",
    "Entity Name": "entity",
    "Entity Result": "correct",
    "EntityIdentifiedBy": "engine",
    "entityIdentifiedUsing": "method",
}
RESULTS_SUFFIX = "_results"

PATH_ROW_BYTES = 4096

_TEXT_COLUMNS = [name for name in RESULT_COLUMNS.values() if name != "correct"]


def boolean(text: Column) -> Column:
    """True or false in any case; anything else is null."""
    lowered = F.lower(strip(text))
    return F.when(lowered == "true", True).when(lowered == "false", False)


def report_name(stem: Column) -> Column:
    """The name of a report from the file name of its raw text or of its result table."""
    return F.regexp_replace(stem, f"{RESULTS_SUFFIX}\\z", "")


def _report_of(path: Column, report_folders: bool) -> Column:
    return folder_name(path) if report_folders else report_name(file_stem(path))


def split_reports(spark: SparkSession, paths: str | list[str], report_folders: bool = False) -> DataFrame:
    """Rows of the result tables of reports, and one row with ``reject`` per unusable report.

    Columns: ``report``, those of :data:`RESULT_COLUMNS`, ``extra`` with the other columns of the
    table, and ``reject``. Tables that are already split off are reports with an empty preamble.

    The file name gives the report, or with ``report_folders`` the name of its folder (``report=x`` counts as
    ``x``): files that a partitioned write leaves in several folders may all have the same name.

    The table begins at the first line whose first cell is :data:`HEADER_CELL`; what stands above it
    may hold any quotes. Reports of any size are read in parallel parts, see
    :func:`utterscope.sources.quoted.read_records`. Tables may have any width and no cell is lost: in
    ``extra`` a column without a name and a cell right of the header go by their position (``_c7``,
    from 0, where they hold something), and a repeated name gets a number (``Note``, ``Note.1``).
    """
    records, read = read_records(spark, paths, HEADER_CELL)
    widths = records.groupBy("path").agg(
        F.max(F.when(F.col("header"), F.col("cells"))).alias("cells"), F.max(F.size("cells")).alias("width")
    )
    # One row per report, with the place of every column that any of its rows has.
    layouts = materialize(widths.mapInArrow(_layouts, LAYOUT), "layouts")
    size = layouts.agg(F.coalesce(F.sum(F.size("others") * 64 + 512), F.lit(0)).alias("bytes")).first()["bytes"]
    layouts = F.broadcast(layouts) if size <= BROADCAST_LIMIT_BYTES else layouts
    placed = records.where(~F.col("header")).join(layouts, "path")
    cell = {name: F.get("cells", F.col("places")[name]) for name in RESULT_COLUMNS.values()}
    other = F.transform(
        "others",
        lambda o: F.struct(o["name"].alias("name"), F.get("cells", o["place"]).alias("value"), o["named"].alias("named")),
    )
    held = F.filter(other, lambda o: o["named"] | o["value"].isNotNull())
    rows = placed.select(
        "path",
        *[cell[name].alias(name) for name in _TEXT_COLUMNS],
        boolean(cell["correct"]).alias("correct"),
        F.map_from_entries(F.transform(held, lambda o: F.struct(o["name"], o["value"]))).alias("extra"),
        F.lit(None).cast("string").alias("reject"),
    )
    nothing = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns[1:-1]]
    faults = read.where(F.col("fault").isNotNull()).select("path", *nothing, F.col("fault").alias("reject"))
    report = _report_of(F.col("path"), report_folders).alias("report")
    return rows.unionByName(faults).select(report, *rows.columns[1:])


def _layouts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        places, others = [], []
        for header, width in zip(batch.column("cells").to_pylist(), batch.column("width").to_pylist()):
            names = _column_names((header + [None] * width)[: max(width, len(header))])
            at = {name: i for i, (name, _) in enumerate(names)}
            places.append({target: at.get(source) for source, target in RESULT_COLUMNS.items()})
            others.append([
                {"name": name, "place": i, "named": named}
                for i, (name, named) in enumerate(names) if name not in RESULT_COLUMNS
            ])
        columns = [batch.column("path"), pa.array(places, _PLACES_ARROW), pa.array(others, pa.list_(_OTHER_ARROW))]
        yield pa.RecordBatch.from_arrays(columns, ["path", "places", "others"])


_PLACES_ARROW = pa.struct([(name, pa.int32()) for name in RESULT_COLUMNS.values()])
_OTHER_ARROW = pa.struct([("name", pa.string()), ("place", pa.int32()), ("named", pa.bool_())])
LAYOUT = (
    f"path string, places struct<{', '.join(f'{name}: int' for name in RESULT_COLUMNS.values())}>, "
    "others array<struct<name: string, place: int, named: boolean>>"
)


def _column_names(header: list[str | None]) -> list[tuple[str, bool]]:
    """A name of its own for each column, and whether the header gives one."""
    given = [(name or "").strip() for name in header]
    names: list[tuple[str, bool]] = []
    taken = set(given)
    seen: set[str] = set()
    for i, name in enumerate(given):
        wanted, number = name or f"_c{i}", 0
        unique = wanted
        while unique in seen or (unique in taken and unique != name):
            number += 1
            unique = f"{wanted}.{number}"
        seen.add(unique)
        names.append((unique, bool(name)))
    return names


def results(split: DataFrame) -> DataFrame:
    """The result rows of :func:`split_reports`."""
    return split.where(F.col("reject").isNull()).drop("reject")


def rejects(split: DataFrame) -> DataFrame:
    """``report, reject`` for the reports that could not be used.

    Spark does not scan files of zero bytes; they appear neither here nor in the manifest.
    """
    return split.where(F.col("reject").isNotNull()).select("report", "reject")


def report_manifest(spark: SparkSession, paths: str | list[str], report_folders: bool = False) -> DataFrame:
    """``report, model, bytes`` of every file. Contents are not read."""
    name = folder_name(F.col("path")) if report_folders else file_stem(F.col("path"))
    return (
        spark.read.format("binaryFile")
        .load(paths)
        .select(
            _report_of(F.col("path"), report_folders).alias("report"),
            model_name(name).alias("model"),
            F.col("length").alias("bytes"),
        )
    )


def preamble(spark: SparkSession, paths: str | list[str], report_folders: bool = False) -> DataFrame:
    """``report, line_no, line``: the lines above the header row, unchanged.

    ``report_folders`` names reports as in :func:`split_reports`. Lines are numbered through all files of a
    report, in the order of their paths.

    Lines are read in parallel parts of a file. Their order is (start of the part, position in the
    part); the first header line of each file bounds its preamble. The result is a stored table.
    """
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("path"),
        F.struct(
            F.col("_metadata.file_block_start").alias("part"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("at"),
        F.col("value").alias("line"),
    )
    first_cell = unquote(F.substring_index("line", ",", 1))
    headers = (
        lines.where(first_cell == HEADER_CELL).groupBy("path").agg(F.min("at").alias("header_at"))
    )
    with same_parts(spark):
        # One row per file. Knowing its size up front keeps the lines from being shuffled to it.
        headers = broadcast_if_small(materialize(headers, "headers"), PATH_ROW_BYTES)
        above = materialize(lines.join(headers, "path").where(F.col("at") < F.col("header_at")), "above-headers")
    named = above.withColumn("report", folder_name(F.col("path")) if report_folders else file_stem(F.col("path")))
    # Only preamble lines are numbered here, a handful per file.
    earlier = F.row_number().over(Window.partitionBy("report").orderBy("path", "at"))
    return named.select("report", earlier.alias("line_no"), "line")


def key_values(lines: DataFrame) -> DataFrame:
    """``report, key, value`` from preamble lines; the last of several equal keys wins.

    The first comma separates key and value, both lose blanks and quotes at their ends, and lines
    without a comma are ignored.
    """
    comma = F.instr("line", ",")
    return (
        lines.where(comma > 0)
        .select(
            "report",
            "line_no",
            unquote(F.substring_index("line", ",", 1)).alias("key"),
            unquote(F.col("line").substr(comma + 1, F.char_length("line"))).alias("value"),
        )
        .groupBy("report", "key")
        .agg(F.max_by("value", "line_no").alias("value"))
    )


def text_lines(frame: DataFrame, report: str, text: str) -> DataFrame:
    """``report, line_no, line`` from whole texts held in a column."""
    return frame.select(
        F.col(report).alias("report"),
        F.posexplode(F.split(F.col(text), "\r\n|\r|\n")).alias("line_no", "line"),
    )
