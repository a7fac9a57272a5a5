"""Quoted CSV files of any size, read in parallel parts.

A quoted cell may hold line breaks, so whether a line begins a record depends on every quote above it. A
line, and so a part of a file, maps the state ahead of it (outside or inside a quoted cell) to the state
behind it. These maps are put together:

1. Each part is read once for its map, for the first header line in it, and for bytes that are not UTF-8.
2. Per file, one row per part, the state ahead of every part follows from the maps of the parts above: the
   last part after which the state is fixed, and the number of times that it turns over from there on.
3. Each part is read again and its records are taken apart. A record that runs across the end of a part
   leaves one fragment in each of the parts; only fragments are brought together.

A file is read as a whole or not at all: a file with a fault gives its reason and no record.
"""

from __future__ import annotations

import csv
import re
import sys
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from utterscope.sources.intermediate import BROADCAST_LIMIT_BYTES, materialize

NO_HEADER = "no data header"
UNCLOSED = "a quoted cell is never closed"
NOT_TEXT = "not UTF-8"

PART = "path string, part long, first long, n long, text boolean, header long, beyond boolean, outside boolean, inside boolean"
RECORD = "path string, part long, header boolean, cells array<string>, fragment string, opens boolean"
PARTITIONS_SETTING = "spark.sql.files.minPartitionNum"
_CLOSING = re.compile(r'[^"]*(?:""[^"]*)*"(?!")')


class Records(NamedTuple):
    """``records``: path, header (true for the header record), cells; an empty cell is null.
    ``files``: path and fault (null where the file was read)."""

    records: DataFrame
    files: DataFrame


def open_after(line: str, inside: bool) -> bool:
    """Whether a quoted cell is open behind ``line`` when ``inside`` tells whether one was ahead of it.

    Only a quote that starts a cell opens one, and a doubled quote does not close it; quotes
    elsewhere are ordinary characters.
    """
    if inside:
        at = 0
    elif line.startswith('"'):
        at = 1
    else:
        found = line.find(',"')
        if found < 0:
            return False
        at = found + 2
    while True:
        closing = _CLOSING.match(line, at)
        if not closing:
            return True
        found = line.find(',"', closing.end())
        if found < 0:
            return False
        at = found + 2


def _is_header(line: str, header_cell: str) -> bool:
    return line.partition(",")[0].strip().strip('"') == header_cell


def _decoded(lines: pa.Array) -> list[str]:
    return [(line or b"").decode("utf-8", "replace") for line in lines.cast(pa.binary()).to_pylist()]


def _is_text(lines: pa.Array) -> bool:
    try:
        lines.cast(pa.binary()).cast(pa.string())
    except pa.ArrowInvalid:
        return False
    return True


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], bool, pa.RecordBatch]]:
    """(path, part) with its rows, batch by batch, and whether a part begins; rows arrive in file order."""
    last = None
    for batch in batches:
        paths, parts = batch.column("path"), batch.column("part").to_numpy()
        codes = paths.dictionary_encode()
        code = codes.indices.to_numpy(zero_copy_only=False)
        changes = np.flatnonzero((np.diff(code) != 0) | (np.diff(parts) != 0)) + 1
        for start, stop in zip([0, *changes], [*changes, batch.num_rows]):
            if start < stop:
                key = (codes.dictionary[int(code[start])].as_py(), int(parts[start]))
                yield key, key != last, batch.slice(start, stop - start)
                last = key


def _quoted(lines: pa.Array) -> np.ndarray:
    return pc.match_substring(lines.cast(pa.binary()), b'"').to_numpy(zero_copy_only=False)


def _part_maps(header_cell: str | None):
    """One row of :data:`PART` per part.

    ``header`` is the row of the first header line and ``beyond`` the state behind the part when its
    records begin there; ``outside`` and ``inside`` are the states behind it by the state ahead.
    """

    def finished(key: tuple, state: dict) -> pa.RecordBatch:
        row = {"path": key[0], "part": key[1], **state}
        return pa.RecordBatch.from_pylist([row], schema=_PART_ARROW)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, {}
        for key, begins, rows in _runs(batches):
            lines, numbers = rows.column("line"), rows.column("row")
            if begins:
                if last:
                    yield finished(last, state)
                last = key
                state = {"first": numbers[0].as_py(), "n": 0, "text": True, "header": None, "beyond": False}
                state |= {"outside": False, "inside": True}
                if header_cell is None and key[1] == 0:
                    state["header"] = state["first"]
            state["n"] += rows.num_rows
            state["text"] = state["text"] and _is_text(lines)
            # Lines without a quote change nothing; only they and possible headers are looked at.
            wanted = _quoted(lines)
            if header_cell is not None and state["header"] is None:
                wanted |= pc.match_substring(lines.cast(pa.binary()), header_cell.encode()).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(wanted)
            for i, line in zip(at, _decoded(lines.take(pa.array(at)))):
                if state["header"] is None and header_cell is not None and _is_header(line, header_cell):
                    state["header"] = numbers[int(i)].as_py()
                if state["header"] is not None:
                    state["beyond"] = open_after(line, state["beyond"])
                state["outside"], state["inside"] = open_after(line, state["outside"]), open_after(line, state["inside"])
        if last:
            yield finished(last, state)

    return task


_PART_ARROW = pa.schema(
    [("path", pa.string()), ("part", pa.int64()), ("first", pa.int64()), ("n", pa.int64()), ("text", pa.bool_())]
    + [("header", pa.int64()), ("beyond", pa.bool_()), ("outside", pa.bool_()), ("inside", pa.bool_())]
)


def _placed(parts: DataFrame) -> DataFrame:
    """``parts`` with ``fault`` of the file, ``header_part`` and ``ahead``, the state ahead of the part.

    The windows hold one row per part of a file.
    """
    whole = Window.partitionBy("path")
    upto = whole.orderBy("part")
    above = upto.rowsBetween(Window.unboundedPreceding, -1)
    at_header, below = F.col("part") == F.col("header_part"), F.col("part") > F.col("header_part")
    fixed = at_header | (below & (F.col("outside") == F.col("inside")))
    state = F.when(at_header, F.col("beyond")).otherwise(F.col("outside"))
    turned = (below & F.col("outside") & ~F.col("inside")).cast("int")
    known = (
        parts.withColumn("header_part", F.min(F.when(F.col("header").isNotNull(), F.col("part"))).over(whole))
        .withColumn("turns", F.sum(F.coalesce(turned, F.lit(0))).over(upto))
        .withColumn("set", F.when(fixed, F.struct(state.cast("int").alias("to"), F.col("turns").alias("turns"))))
    )

    def after(anchor: Column, turns: Column) -> Column:
        return (anchor["to"] + turns - anchor["turns"]) % 2 == 1

    last = F.col("part") == F.max("part").over(whole)
    return (
        known.withColumn("ahead", after(F.last("set", True).over(above), F.last("turns").over(above)))
        .withColumn("behind", after(F.last("set", True).over(upto), F.col("turns")))
        .withColumn("unclosed", F.bool_or(last & F.col("behind")).over(whole))
        .withColumn(
            "fault",
            F.when(~F.bool_and("text").over(whole), NOT_TEXT)
            .when(F.col("header_part").isNull(), NO_HEADER)
            .when(F.col("unclosed"), UNCLOSED),
        )
        .select("path", "part", "first", "n", "header", "header_part", "ahead", "fault")
    )


class Record:
    """Follows the lines of a file: whether a quoted cell is open behind the last one."""

    def __init__(self):
        self.inside, self.lines = False, 0

    def add(self, line: str) -> None:
        self.inside, self.lines = open_after(line, self.inside), self.lines + 1


def records_of(lines: Iterable[str]) -> Iterator[list[str | None]]:
    """The cells of the records that begin and end in these lines; blank lines are none, empty cells are null."""
    csv.field_size_limit(sys.maxsize)
    for row in csv.reader(f"{line}\n" for line in lines):
        if row:
            yield [cell or None for cell in row]


def _part_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records and fragments of the parts; what a part needs to know comes with its first line."""
    part = None
    for key, begins, rows in _runs(batches):
        if begins:
            if part:
                yield part.ended()
            known = rows.column("known")[0].as_py()
            if known is None:
                raise ValueError(f"{key[0]} was cut into other parts than before")
            part = _Part(key, known)
            rows = rows.slice(1) if rows.column("line")[0].as_py() is None else rows
        yield part.taken(rows)
    if part:
        yield part.ended()


class _Part:
    """What is known of a part, and the lines of a record of it that is not closed yet."""

    def __init__(self, key: tuple[str, int], known: dict):
        self.key, self.lines, self.seen = key, known["n"], 0
        self.skipped = known["fault"] is not None or key[1] < known["header_part"]
        self.header = not self.skipped and key[1] == known["header_part"]
        self.above = known["header"] - known["first"] if self.header else 0
        # Whether the lines so far belong to a record of an earlier part.
        self.head = not self.skipped and not self.header and known["ahead"]
        self.inside = self.head
        self.held: list[str] = []

    def taken(self, rows: pa.RecordBatch) -> pa.RecordBatch:
        self.seen += rows.num_rows
        skipped = rows.num_rows if self.skipped else min(self.above, rows.num_rows)
        self.above -= skipped
        lines = rows.column("line").slice(skipped)
        held = len(self.held)
        texts = self.held + _decoded(lines)
        fragments, first, begun = [], 0, 0
        for i in np.flatnonzero(_quoted(lines)) + held:
            after = open_after(texts[i], self.inside)
            if after and not self.inside:
                begun = int(i)
            if self.head and not after:
                first = int(i) + 1
                fragments.append(("\n".join(texts[:first]), False))
                self.head = False
            self.inside = after
        if self.head:
            self.held = texts
            return self._batch([], [])
        end = begun if self.inside else len(texts)
        self.held = texts[end:]
        return self._batch(list(records_of(texts[first:end])), fragments)

    def ended(self) -> pa.RecordBatch:
        if self.seen != self.lines:
            raise ValueError(f"{self.key[0]} was cut into other parts than before")
        return self._batch([], [("\n".join(self.held), not self.head)] if self.held else [])

    def _batch(self, records: list, fragments: list) -> pa.RecordBatch:
        n, m = len(records), len(fragments)
        header = np.zeros(n + m, bool)
        if self.header and n + m:
            header[0], self.header = True, False
        columns = [
            pa.array([self.key[0]] * (n + m), pa.string()),
            pa.array([self.key[1]] * (n + m), pa.int64()),
            pa.array(header),
            pa.array([*records, *[None] * m], pa.list_(pa.string())),
            pa.array([*[None] * n, *(text for text, _ in fragments)], pa.string()),
            pa.array([*[None] * n, *(opens for _, opens in fragments)], pa.bool_()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["path", "part", "header", "cells", "fragment", "opens"])


def _joined_fragments(pieces: DataFrame) -> DataFrame:
    """The records that run across parts. There are at most two fragments per part."""
    upto = Window.partitionBy("path").orderBy("part", "opens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = pieces.where("fragment is not null").withColumn("number", F.count_if("opens").over(upto))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("part", "opens", "fragment"))), lambda f: f["fragment"])
    whole = numbered.groupBy("path", "number").agg(
        F.bool_or("header").alias("header"), F.array_join(in_order, "\n").alias("record")
    )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [next(records_of(record.split("\n"))) for record in batch.column("record").to_pylist()]
            columns = [batch.column("path"), batch.column("header"), pa.array(cells, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["path", "header", "cells"])

    return whole.mapInArrow(task, "path string, header boolean, cells array<string>")


@contextmanager
def same_parts(spark: SparkSession) -> Iterator[None]:
    """Files are cut alike by all jobs inside, even if the cluster grows or shrinks meanwhile."""
    before = spark.conf.get(PARTITIONS_SETTING, None)
    spark.conf.set(PARTITIONS_SETTING, before or str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PARTITIONS_SETTING)
        else:
            spark.conf.set(PARTITIONS_SETTING, before)


def read_records(
    spark: SparkSession,
    paths: str | list[str],
    header_cell: str | None = None,
    glob: str | None = None,
    limit: int = BROADCAST_LIMIT_BYTES,
) -> Records:
    """All records of CSV files, read twice and in parallel; the result is a stored table.

    The header is the first line whose first cell, bare of white space and quotes, is ``header_cell``, whatever
    stands above it; without ``header_cell`` it is the first line. Lines end at \\n, \\r\\n or \\r and
    blank lines are no records; a line break in a quoted cell becomes \\n. ``glob`` chooses files by name.
    Faults: :data:`NOT_TEXT`, :data:`NO_HEADER`, :data:`UNCLOSED`. Spark does not scan files of zero bytes; they
    appear in neither table.
    """
    reader = spark.read.option("pathGlobFilter", glob) if glob else spark.read
    lines = reader.text(paths).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("part"),
        F.monotonically_increasing_id().alias("row"),
        F.col("value").alias("line"),
    )
    with same_parts(spark):
        maps = materialize(lines.mapInArrow(_part_maps(header_cell), PART), "part-maps")
        parts = materialize(_placed(maps), "parts")
        known = F.struct("first", "n", "header", "header_part", "ahead", "fault").alias("known")
        size = parts.agg(F.coalesce(F.sum(F.octet_length("path") + 128), F.lit(0)).alias("bytes")).first()["bytes"]
        if size <= limit:
            told = parts.select(F.col("path").alias("of"), F.col("part").alias("of_part"), "first", known)
            of = (F.col("path") == F.col("of")) & (F.col("part") == F.col("of_part"))
            at_first = F.when(F.col("row") == F.col("first"), F.col("known")).alias("known")
            dealt = lines.join(F.broadcast(told), of, "left").select("path", "part", "row", "line", at_first)
        else:
            # What is known of a part is sorted in ahead of its lines.
            told = parts.select("path", "part", F.col("first").alias("row"), F.lit(None).cast("string").alias("line"), known)
            both = lines.withColumn("known", F.lit(None).cast(told.schema["known"].dataType)).unionByName(told)
            order = ["path", "part", "row", F.asc_nulls_first("line")]
            dealt = both.repartition("path", "part").sortWithinPartitions(*order)
        pieces = materialize(dealt.mapInArrow(_part_records, RECORD), "records")
    records = pieces.where("fragment is null").select("path", "header", "cells")
    return Records(records.unionByName(_joined_fragments(pieces)), parts.groupBy("path").agg(F.first("fault").alias("fault")))
