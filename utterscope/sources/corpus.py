"""Labelled corpora: folders of one-column CSV files, one file (or one folder) per label."""

from __future__ import annotations

import bz2
import gzip
import io
import zlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from utterscope.sources.files import file_stem, folder_name
from utterscope.sources.intermediate import materialize
from utterscope.sources.quoted import NO_HEADER, NOT_TEXT, UNCLOSED, Record, read_records, records_of

#: Compressed files that are unpacked here, as a stream, so that a damaged one gives a reason.
PACKED = {".gz": gzip.open, ".bz2": bz2.open}
UNREADABLE = "cannot be unpacked"
ROWS_PER_BATCH = 1000


def scan_folder(
    spark: SparkSession, folder: str | list[str], extension: str = ".csv", label_folders: bool = False
) -> DataFrame:
    """``label, text, reject``: the first column of every file, and one row with ``reject`` per unusable file.

    The file name gives the label, or with ``label_folders`` the name of its folder (``label=x`` counts as
    ``x``), so that a label may have any number of files. The first line is the header; empty cells are left
    out. A file is read as a whole or rejected as a whole, whatever is wrong with it: no line at all, a
    quoted cell that is never closed, bytes that are not UTF-8, or a compressed file that cannot be
    unpacked. Uncompressed files are read in parallel parts. The result is a stored table.
    """
    named = _label_of(F.col("path"), label_folders, extension).alias("label")
    nothing, no_fault = F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("reject")
    listed = spark.read.format("binaryFile").option("pathGlobFilter", f"*{extension}").load(folder)
    empty = _unscanned(listed).select(named, nothing, F.lit(NO_HEADER).alias("reject"))
    if any(extension.endswith(kind) for kind in PACKED):
        unpacked = listed.select("path", "content").mapInArrow(
            _unpacked, "path string, text string, reject string"
        )
        return materialize(unpacked.select(named, "text", "reject").unionByName(empty), "corpus")
    records, read = read_records(spark, folder, glob=f"*{extension}")
    texts = records.where(~F.col("header")).select(named, F.get("cells", F.lit(0)).alias("text"), no_fault)
    faults = read.where(F.col("fault").isNotNull()).select(named, nothing, F.col("fault").alias("reject"))
    return texts.where(F.col("text").isNotNull()).unionByName(faults).unionByName(empty)


def _unscanned(listed: DataFrame) -> DataFrame:
    """``path`` of the files that Spark lists but, as they have no bytes, does not scan."""
    paths = listed.sparkSession.createDataFrame([(path,) for path in listed.inputFiles()], "path string")
    plain = F.regexp_replace(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), r"^(\w+:)/+", "$1/")
    scanned = listed.select(F.regexp_replace("path", r"^(\w+:)/+", "$1/").alias("plain"))
    return paths.withColumn("plain", plain).join(scanned, "plain", "left_anti")


def _label_of(path: Column, label_folders: bool, extension: str) -> Column:
    if label_folders:
        return folder_name(path)
    for kind in PACKED:
        if extension.endswith(kind):
            path = F.regexp_replace(path, rf"\Q{kind}\E$", "")
    return file_stem(path)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of packed files. A file is unpacked twice: once to see that it is sound, once for its rows, so
    that no more than a batch of it is held in memory."""
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
            fault = _fault(path, content)
            if fault:
                yield _texts(path, [None], fault)
                continue
            held: list[str] = []
            for i, cells in enumerate(records_of(_lines(path, content))):
                if i and cells[0] is not None:
                    held.append(cells[0])
                if len(held) == ROWS_PER_BATCH:
                    yield _texts(path, held)
                    held = []
            yield _texts(path, held)


def _lines(path: str, content: bytes) -> Iterator[str]:
    opened = next(way for kind, way in PACKED.items() if path.endswith(kind))
    with opened(io.BytesIO(content)) as unpacked, io.TextIOWrapper(unpacked, "utf-8") as text:
        for line in text:
            yield line.removesuffix("\n")


def _fault(path: str, content: bytes) -> str | None:
    record = Record()
    try:
        for line in _lines(path, content):
            record.add(line)
    except UnicodeDecodeError:
        return NOT_TEXT
    except (OSError, EOFError, zlib.error):
        return UNREADABLE
    return UNCLOSED if record.inside else None if record.lines else NO_HEADER


def _texts(path: str, texts: list[str | None], fault: str | None = None) -> pa.RecordBatch:
    n = len(texts)
    columns = [pa.array([path] * n, pa.string()), pa.array(texts, pa.string()), pa.array([fault] * n, pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["path", "text", "reject"])


def texts(scanned: DataFrame) -> DataFrame:
    """The texts of :func:`scan_folder`."""
    return scanned.where(F.col("reject").isNull()).drop("reject")


def rejects(scanned: DataFrame) -> DataFrame:
    """The labels of the files that could not be used, with the reason."""
    return scanned.where(F.col("reject").isNotNull()).drop("text")


def read_folder(
    spark: SparkSession, folder: str | list[str], extension: str = ".csv", label_folders: bool = False
) -> DataFrame:
    """``label, text`` of the usable files of a folder, see :func:`scan_folder`."""
    return texts(scan_folder(spark, folder, extension, label_folders))


def read_manifest(spark: SparkSession, folder: str | list[str], extension: str = ".csv") -> DataFrame:
    """``label, bytes``: every file of a folder, with or without texts. Contents are not read."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", f"*{extension}").load(folder)
    )
    return files.select(file_stem(F.col("path")).alias("label"), F.col("length").alias("bytes"))


def scan_corpus(spark: SparkSession, folders: dict[str, str | list[str]], extension: str = ".csv") -> DataFrame:
    """``split, label, text, reject`` from one folder per split, see :func:`scan_folder`."""
    return _stack(
        scan_folder(spark, folder, extension).select(F.lit(split).alias("split"), "label", "text", "reject")
        for split, folder in folders.items()
    )


def read_corpus(spark: SparkSession, folders: dict[str, str | list[str]], extension: str = ".csv") -> DataFrame:
    """``split, label, text`` of the usable files of one folder per split."""
    return texts(scan_corpus(spark, folders, extension))


def read_corpus_manifest(
    spark: SparkSession, folders: dict[str, str | list[str]], extension: str = ".csv"
) -> DataFrame:
    """``split, label`` of every file, so that files without any text keep a row in the results."""
    return _stack(
        read_manifest(spark, folder, extension).select(F.lit(split).alias("split"), "label")
        for split, folder in folders.items()
    )


def missing_files(corpus: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files of the manifest that gave no text: empty ones and those that could not be read."""
    return manifest.join(corpus.select("split", "label").distinct(), ["split", "label"], "left_anti")


def _stack(frames) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
