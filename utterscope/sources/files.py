"""Reading and writing result tables, and names taken from file paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Options of a CSV writer that keeps every cell as it is.
EXACT = {"escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def file_stem(path: Column) -> Column:
    """The file name without folder and last extension, with escaped characters restored."""
    name = F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)
    # Spark reports paths as URIs. A plus sign is an ordinary character there.
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def folder_name(path: Column) -> Column:
    """The name of the folder that holds a file; that of a partition (``x=value``) counts as its value."""
    folder = file_stem(F.concat(F.regexp_extract(path, "([^/]+)/[^/]*$", 1), F.lit(".x")))
    # The folder of a partition holds its value with escapes of its own.
    value = F.url_decode(F.replace(F.regexp_replace(folder, "^[^=]*=", ""), F.lit("+"), F.lit("%2B")))
    return F.when(F.contains(folder, F.lit("=")), value).otherwise(folder)


def model_name(stem: Column) -> Column:
    """The part of a report name up to the first underscore."""
    return F.substring_index(stem, "_", 1)


def read_csv(
    spark: SparkSession, paths: str | list[str], schema: T.StructType | str
) -> DataFrame:
    """CSV with a header and quoted line breaks; only an empty field is null."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .csv(paths)
    )


def write_csv(frame: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """CSV with a header, one folder per value of ``partition_by``."""
    writer = frame.write.mode("overwrite").option("header", True).options(**EXACT)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.csv(path)


def write_json(frame: DataFrame, path: str) -> None:
    """One JSON object per line, UTF-8, unescaped; nulls are kept."""
    frame.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_json(
    spark: SparkSession, path: str, schema: T.StructType | str, multi_line: bool = False
) -> DataFrame:
    """JSON lines, or with ``multi_line`` one document (object or array) per file."""
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)
