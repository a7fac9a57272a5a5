"""Turning texts into vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utterscope.functions.text import tokens
from utterscope.sources.intermediate import batches_of, materialize

Encoder = Callable[[Sequence[str]], np.ndarray]

#: Length of the hashed vectors.
DIMENSIONS = 256

#: Texts in an Arrow batch of terms, and terms or vector elements that a task works on at once.
BATCH_TEXTS = 1000
AT_ONCE = 1 << 18

#: The encoder that this Python worker has loaded last, by the digest of its loader.
_LOADED: dict[str, Encoder] = {}


def _loaded(key: str, load_encoder: Callable[[], Encoder]) -> Encoder:
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = load_encoder()
    return _LOADED[key]


def encode(corpus: DataFrame, load_encoder: Callable[[], Encoder]) -> DataFrame:
    """Replace ``text`` by ``vec ARRAY<FLOAT>`` with an encoder of the caller.

    ``load_encoder`` runs once per Python worker, which serves many tasks, and returns a function from a list of texts
    to a matrix with one row per text, such as the ``encode`` method of a sentence model.
    """

    key = hashlib.sha256(cloudpickle.dumps(load_encoder)).hexdigest()

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _loaded(key, load_encoder)
        for texts in batches:
            if len(texts) == 0:
                yield pd.Series([], dtype=object)
                continue
            matrix = np.asarray(encoder(texts.tolist()), dtype=np.float32)
            yield pd.Series(list(matrix))

    return (
        corpus.where(F.col("text").isNotNull()).withColumn("vec", vectors("text")).drop("text")
    )


def hashed_tfidf(corpus: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """Replace ``text`` by ``vec ARRAY<FLOAT>``, a signed hashed TF-IDF vector.

    The default when no sentence model is at hand; its similarities are not comparable with those of
    a model. The MD5 digest of a term gives its position (the first eight hexadecimal digits modulo
    ``dimensions``) and its sign (an odd ninth digit counts down), so that terms that meet at a position
    do not all add up. A value is the signed count times ``ln((texts + 1) / (held + 1))``, where
    ``held`` counts the texts with any term at the position. Each text is taken apart once: its counts are
    written to the shared folder and only ``dimensions`` numbers of the corpus reach the driver. A task holds
    a batch of :data:`BATCH_TEXTS` texts and works on :data:`AT_ONCE` terms of it (one text at least), so its
    memory does not grow with the corpus.
    """
    rest = [c for c in corpus.columns if c != "text"]
    kinds = {c: corpus.schema[c].dataType.simpleString() for c in rest}
    listed = ", ".join(f"`{c}` {kind}" for c, kind in kinds.items())
    separate = f"{listed}{', ' if rest else ''}"
    terms = corpus.where(F.col("text").isNotNull()).select(*rest, tokens(F.col("text")).alias("terms"))
    counts = terms.mapInArrow(_counts(dimensions), f"{separate}positions array<int>, counts array<int>")
    with batches_of(corpus.sparkSession, BATCH_TEXTS):
        counted = materialize(counts, "term-counts")
    held = counted.select(F.explode("positions").alias("position")).groupBy("position").agg(F.count(F.lit(1)).alias("held"))
    weights = np.log(np.full(dimensions, counted.count() + 1.0))
    for row in held.collect():  # at most one row per dimension
        weights[row["position"]] -= np.log(row["held"] + 1.0)
    return counted.mapInArrow(_weighted(weights), f"{separate}vec array<float>")


def _runs(batch: pa.RecordBatch, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose sizes add up to at most :data:`AT_ONCE`, or single rows."""
    ends, start = np.cumsum(sizes), 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + AT_ONCE, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def _counts(dimensions: int):
    """The positions that a text has terms at, ascending, and the signed counts there."""

    def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
        terms = batch.column("terms")
        coded = terms.flatten().dictionary_encode()
        digests = b"".join(hashlib.md5(t).digest() for t in coded.dictionary.cast(pa.binary()).to_pylist())
        words = np.frombuffer(digests, ">u4").reshape(-1, 4).astype(np.int64)
        code = coded.indices.to_numpy()
        # The ninth hexadecimal digit is the highest of the second word.
        position, sign = (words[:, 0] % dimensions)[code], (1 - 2 * (words[:, 1] >> 28 & 1))[code]
        row = np.repeat(np.arange(batch.num_rows), terms.value_lengths().to_numpy())
        places, of = np.unique(row * dimensions + position, return_inverse=True)
        sums = np.zeros(len(places), np.int64)
        np.add.at(sums, of, sign)
        ends = pa.array(np.searchsorted(places, np.arange(batch.num_rows + 1) * dimensions), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (places % dimensions, sums)]
        names = [name for name in batch.schema.names if name != "terms"]
        return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *lists], [*names, "positions", "counts"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in _runs(batch, batch.column("terms").value_lengths().to_numpy()):
                yield counted(run)

    return task


def _weighted(weights: np.ndarray):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (run for whole in batches for run in _runs(whole, np.full(whole.num_rows, len(weights)))):
            n = batch.num_rows
            values = np.zeros((n, len(weights)))
            positions, counts = batch.column("positions"), batch.column("counts")
            at = positions.flatten().to_numpy()
            row = np.repeat(np.arange(n), positions.value_lengths().to_numpy())
            values[row, at] = counts.flatten().to_numpy() * weights[at]
            ends = pa.array(np.arange(n + 1) * len(weights), pa.int32())
            vec = pa.ListArray.from_arrays(ends, pa.array(values.ravel(), pa.float32()))
            names = [name for name in batch.schema.names if name not in ("positions", "counts")]
            yield pa.RecordBatch.from_arrays([*(batch.column(name) for name in names), vec], [*names, "vec"])

    return task
