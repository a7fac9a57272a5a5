"""Sums of vectors per group, taken up by the tasks as matrices."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of sums that a task holds before it passes them on.
HELD_BYTES = 64 * 1024 * 1024


def position_sums(vectors: DataFrame, by: Sequence[str], column: str = "vec") -> DataFrame:
    """``*by, pos, n, x, u``: the sums of the elements at each position, plain and of unit vectors.

    A task adds up whole Arrow batches and hands on one row per group with its two sum vectors; only
    these rows are taken apart by position and merged. So the exchange holds as many elements as there are
    groups in a task, whatever the number of vectors, and a group with most of the rows costs no more
    than any other. Null is a group like any other. Vectors must be of one length; null and empty ones are
    left out, a null element counts as NaN, and the unit vector of a zero vector is zero.
    """
    rows = vectors.where(F.size(column) > 0).select(*by, F.col(column).alias("vec"))
    keys = ", ".join(f"`{c}` {vectors.schema[c].dataType.simpleString()}" for c in by)
    partial = rows.mapInArrow(
        _partial_sums(list(by)), f"{keys}{', ' if keys else ''}n long, x array<double>, u array<double>"
    )
    elements = partial.select(*by, "n", F.posexplode(F.arrays_zip("x", "u")).alias("pos", "at"))
    return elements.groupBy(*by, "pos").agg(
        F.sum("n").alias("n"), F.sum("at.x").alias("x"), F.sum("at.u").alias("u")
    )


def matrix(vectors: pa.Array) -> np.ndarray:
    """One row per vector, in double precision."""
    lengths = vectors.value_lengths().to_numpy()
    if len(lengths) and lengths.min() != lengths.max():
        raise ValueError("vectors must be of one length")
    values = vectors.flatten().to_numpy(zero_copy_only=False)
    return values.astype(np.float64).reshape(len(lengths), lengths[0] if len(lengths) else 0)


def unit_rows(rows: np.ndarray) -> np.ndarray:
    """The rows scaled to length one; zero rows stay zero."""
    lengths = np.linalg.norm(rows, axis=1)
    return rows / np.where(lengths == 0, 1.0, lengths)[:, None]


def _groups(batch: pa.RecordBatch, by: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``(first, group)``: a row of each group, and the group of each row."""
    code = np.zeros(batch.num_rows, np.int64)
    for name in by:
        coded = batch.column(name).dictionary_encode(null_encoding="encode")
        # Codes stay below the number of rows squared.
        code = np.unique(code, return_inverse=True)[1] * max(1, len(coded.dictionary))
        code = code + coded.indices.to_numpy(zero_copy_only=False)
    _, first, group = np.unique(code, return_index=True, return_inverse=True)
    return first, group


def _partial_sums(by: list[str]):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        types: list = []

        def passed_on() -> pa.RecordBatch:
            columns = [pa.array([key[i] for key in held], kind) for i, kind in enumerate(types)]
            columns.append(pa.array([n for n, _, _ in held.values()], pa.int64()))
            ends = np.cumsum([0, *(len(x) for _, x, _ in held.values())])
            for part in (1, 2):
                values = np.concatenate([sums[part] for sums in held.values()])
                columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values)))
            return pa.RecordBatch.from_arrays(columns, [*by, "n", "x", "u"])

        for batch in batches:
            if not batch.num_rows:
                continue
            types = [batch.schema.field(name).type for name in by]
            rows = matrix(batch.column("vec"))
            first, group = _groups(batch, by)
            order = np.argsort(group, kind="stable")
            starts = np.searchsorted(group[order], np.arange(len(first)))
            counts = np.bincount(group, minlength=len(first))
            plain = np.add.reduceat(rows[order], starts, axis=0)
            units = np.add.reduceat(unit_rows(rows)[order], starts, axis=0)
            names = zip(*(batch.column(name).take(pa.array(first)).to_pylist() for name in by)) if by else [()]
            for key, n, x, u in zip(names, counts.tolist(), plain, units):
                if key in held:
                    sums = held[key]
                    if len(sums[1]) != len(x):
                        raise ValueError("vectors must be of one length")
                    held[key] = [sums[0] + n, sums[1] + x, sums[2] + u]
                else:
                    held[key] = [n, x, u]
            if len(held) * rows.shape[1] * 16 > HELD_BYTES:
                yield passed_on()
                held = {}
        if held:
            yield passed_on()

    return task
