"""Token ids of documents in ORC files.

Writing: the documents are range-partitioned by id and encoded in that order, once; each partition
becomes one ORC file. In a file the ids of a document are one list, stored as run-length coded
integers; next to it lie the document id, its place, and the number of ids before it in the file. Row
indexes and Bloom filters on the document id tell which stripes and row groups can hold a document.

Reading: stripes are read in parallel, whichever files they lie in. Where a document starts in the
whole corpus is the sum over the earlier files, read from one short column, plus its place in its own
file, so nothing has to be sorted again. A search for documents opens only the row groups whose
statistics and Bloom filters let them through.

Encoding: texts are cut where a byte-level tokenizer cuts them anyway, ahead of white space and
punctuation; every distinct piece is encoded once and remembered in the Python worker.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.models import BPE

from utterscope.llm.common import save, shards, slices, small, small_batches

END_ID = 0
#: Documents in one file, about; there are at least as many files as partitions in any shuffle.
DOCUMENTS_PER_FILE = 500_000
SLICE_BYTES = 8 * 1024 * 1024
#: Pieces that a Python worker remembers; when they are full, it starts anew.
REMEMBERED = 1_000_000
#: Settings of the writer: rows of a row group, bytes of a stripe, false positives of a Bloom filter.
ROW_GROUP, STRIPE_BYTES, FALSE_POSITIVES = 1_000, 16 * 1024 * 1024, 0.01
FILE_SCHEMA = "part int, place long, doc_id long, before long, n_tokens long, ids array<int>"

_SPACE, _SOLID, _ALNUM = (np.zeros(256, bool) for _ in range(3))
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SOLID[0x21:0x7F] = True
for _low, _high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)):
    _ALNUM[_low : _high + 1] = True
_PUNCTUATION = _SOLID & ~_ALNUM
#: A piece that is one word whatever surrounds it: Latin letters, U+00D7 and U+00F7 not among them.
_WORD = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")


def _written() -> dict[int, str]:
    """The character that a byte-level model writes for each byte: printable ones as they are, others from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


_WRITTEN = _written()


def _letter_before(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte but the first: whether a two-byte character without white space, and whether a
    two-byte Latin letter, ends just before it."""
    character, letter = np.zeros(max(0, len(data) - 1), bool), np.zeros(max(0, len(data) - 1), bool)
    lead, last = data[:-2], data[1:-1]
    character[1:] = (lead >= 0xC3) & (lead <= 0xDF) & (last >= 0x80)
    # U+00D7 and U+00F7 are signs between the letters.
    letter[1:] = (lead == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7)
    return character, letter


def _cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the pieces of texts that lie one after the other in ``data``.

    Each text starts a piece. So does white space after a character that is none, and ASCII punctuation after
    a letter or digit: the pattern of a byte-level tokenizer starts a new word at both, whatever
    follows, and the pieces alone give the same words as the text.
    """
    cut = np.zeros(len(data), bool)
    character, letter = _letter_before(data)
    cut[1:] = (_SPACE[data[1:]] & (_SOLID[data[:-1]] | character)) | (
        _PUNCTUATION[data[1:]] & (_ALNUM[data[:-1]] | letter)
    )
    starts = offsets[:-1]
    cut[starts[starts < len(data)]] = True
    return np.flatnonzero(cut)


class Encoder:
    """A tokenizer of a file that remembers the pieces it has seen."""

    def __init__(self, path: str):
        # Spark runs a task per core; the tokenizer is not to start threads of its own on top.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        # The strings of special tokens are ordinary text in a document.
        self.tokenizer.encode_special_tokens = True
        state = self.tokenizer.pre_tokenizer and json.loads(self.tokenizer.pre_tokenizer.__getstate__())
        self.by_piece = bool(
            state
            and isinstance(self.tokenizer.model, BPE)
            and self.tokenizer.normalizer is None
            and state.get("type") == "ByteLevel"
            and state.get("use_regex")
            and not state.get("add_prefix_space")
        )
        self._forget()

    def _forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.values = np.empty(0, np.int32)
        self.ends = np.zeros(1, np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, ends)``: the ids of all texts one after the other, and where those of each text end."""
        if not len(texts):
            return np.empty(0, np.int32), np.empty(0, np.int64)
        if not self.by_piece:
            return _joined(self._encoded(texts.to_pylist()))
        texts = pa.concat_arrays([texts.cast(pa.string())])
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[: len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[: offsets[-1]]
        starts = _cuts(data, offsets)
        bounds = pa.py_buffer(np.append(starts, len(data)).astype(np.int32))
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, bounds, pa.py_buffer(data)])
        coded = pieces.dictionary_encode()
        where = self._places(coded.dictionary)[coded.indices.to_numpy()]
        known = pa.ListArray.from_arrays(pa.array(self.ends.astype(np.int32)), pa.array(self.values))
        found = known.take(pa.array(where))
        ends = np.append(0, np.cumsum(np.diff(self.ends)[where]))
        return found.flatten().to_numpy(), ends[np.searchsorted(starts, offsets[1:])]

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        done = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [np.array(e.ids, np.int32) for e in done]

    def _places(self, pieces: pa.Array) -> np.ndarray:
        """Where the ids of each of these distinct pieces are remembered; those of new ones are added."""
        names = pieces.to_pylist()
        if len(self.place) + len(names) > REMEMBERED:
            self._forget()
        get = self.place.get
        where = np.fromiter((get(name, -1) for name in names), np.int64, len(names))
        new = np.flatnonzero(where < 0)
        if not len(new):
            return where
        found = self._encoded_pieces([names[n] for n in new])
        start, ends = len(self.ends) - 1, np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        self.values = np.concatenate([self.values, np.fromiter((i for ids in found for i in ids), np.int32, ends[-1])])
        self.ends = np.concatenate([self.ends, self.ends[-1] + ends])
        where[new] = start + np.arange(len(new))
        self.place.update(zip((names[n] for n in new), range(start, start + len(new))))
        return where

    def _encoded_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of pieces; most are a single word, which the tokenizer's model takes as it is."""
        out: list[list[int]] = [[]] * len(pieces)
        rest = []
        tokenize = self.tokenizer.model.tokenize
        for i, piece in enumerate(pieces):
            if _WORD.fullmatch(piece):
                out[i] = [token.id for token in tokenize(piece.decode("latin-1").translate(_WRITTEN))]
            else:
                rest.append(i)
        others = self.tokenizer.encode_batch([pieces[i].decode() for i in rest], add_special_tokens=False)
        for i, encoded in zip(rest, others):
            out[i] = encoded.ids
        return out


def _joined(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    ids = np.concatenate([np.empty(0, np.int32), *parts])
    return ids, np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def _encode(tokenizer: str, end_id: int):
    """Rows of a file from (doc_id, text) in the order of the partition."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = before = 0
        for batch in batches:
            for part in slices(batch.column(1), SLICE_BYTES):
                some = batch.slice(part.start, part.stop - part.start)
                ids, ends = _encoder(tokenizer).encode(some.column(1))
                ids = np.insert(ids, ends, np.int32(end_id))
                ends = ends + np.arange(1, len(ends) + 1)
                sizes = np.diff(ends, prepend=0)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(place + np.arange(len(sizes)), pa.int64()),
                        some.column(0),
                        pa.array(before + ends - sizes, pa.int64()),
                        pa.array(sizes, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids)),
                    ],
                    ["place", "doc_id", "before", "n_tokens", "ids"],
                )
                place, before = place + len(sizes), before + int(sizes.sum())

    return task


def write_token_files(
    documents: DataFrame,
    path: str,
    tokenizer: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    end_id: int = END_ID,
    per_file: int = DOCUMENTS_PER_FILE,
    stripe_bytes: int = STRIPE_BYTES,
    row_group: int = ROW_GROUP,
) -> None:
    """Write the ids of every whole text of ``documents``, ``end_id`` after each, as ORC files in ``path``.

    ``tokenizer`` is a tokenizer file that every executor can open. Documents go by ascending id,
    null ids first, equal ids by the hash of the text; so rows that repeat an id can lie in several
    files, and rows equal in both are interchangeable. A null text counts as empty and gives the end
    id alone. An empty table gives files without rows. Other columns are not read.
    """
    spark = documents.sparkSession
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = documents.select(
        F.col(id_column).cast("long").alias("doc_id"),
        text.alias("text"),
        F.xxhash64(text).alias("hash"),
        F.monotonically_increasing_id().alias("row"),
    )
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["doc_id", "hash", "row"]
    dealt = rows.repartitionByRange(max(least, shards(documents.count(), per_file)), *order)
    encoded = (
        dealt.sortWithinPartitions(*order)
        .select("doc_id", "text")
        .mapInArrow(_encode(tokenizer, end_id), "place long, doc_id long, before long, n_tokens long, ids array<int>")
        .select(F.spark_partition_id().alias("part"), "place", "doc_id", "before", "n_tokens", "ids")
    )
    with small_batches(spark):
        (
            encoded.write.mode("errorifexists")
            .option("compression", "zstd")
            .option("orc.create.index", "true")
            .option("orc.row.index.stride", str(row_group))
            .option("orc.stripe.size", str(stripe_bytes))
            .option("orc.bloom.filter.columns", "doc_id")
            .option("orc.bloom.filter.fpp", str(FALSE_POSITIVES))
            .orc(path)
        )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Rows of :func:`write_token_files`: part, place, doc_id, before, n_tokens, ids."""
    return spark.read.schema(FILE_SCHEMA).orc(path)


def find_documents(spark: SparkSession, path: str, doc_ids: Sequence[int]) -> DataFrame:
    """The rows of these documents; stripes and row groups that cannot hold them are not read."""
    return read_token_files(spark, path).where(F.col("doc_id").isin(list(doc_ids)))


def part_starts(files: DataFrame) -> DataFrame:
    """``part, part_start``: the number of ids in all files before each; one row per file.

    Only two short columns of the files are read, and the window sees as many rows as there are files.
    """
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    upto = F.expr("sum(part_tokens) over (order by part)")
    return totals.select("part", (upto - F.col("part_tokens")).alias("part_start"))


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        values = ids.flatten().to_numpy().astype("<u4")
        ends = np.cumsum(ids.value_lengths().to_numpy())
        sums = [zlib.crc32(values[start:end]) for start, end in zip([0, *ends[:-1]], ends)]
        kept = [batch.column(c) for c in ("part", "doc_id", "before", "n_tokens")]
        yield pa.RecordBatch.from_arrays(
            [*kept, ids.value_lengths().cast(pa.int64()), pa.array(sums, pa.int64())],
            ["part", "doc_id", "before", "n_tokens", "held", "ids_crc32"],
        )


def token_digests(files: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document of :func:`read_token_files`.

    ``start`` counts the ids of all documents before it, ``ids_crc32`` is the unsigned CRC-32 of its ids as
    little-endian unsigned 32-bit integers. Reading fails where a list is not as long as stated.
    """
    read = save(
        files.mapInArrow(
            _checksums, "part int, doc_id long, before long, n_tokens long, held long, ids_crc32 long"
        ),
        "token-checksums",
    )
    starts = small(save(part_starts(files), "token-parts"), 24)
    return read.join(starts, "part").select(
        "doc_id",
        (F.col("part_start") + F.col("before")).alias("start"),
        _stated(F.col("held"), F.col("n_tokens")).alias("n_tokens"),
        "ids_crc32",
    )


def _stated(held: Column, stated: Column) -> Column:
    return F.when(held == stated, held).otherwise(
        F.raise_error(F.lit("a list of ids is not as long as its file states")).cast("long")
    )
