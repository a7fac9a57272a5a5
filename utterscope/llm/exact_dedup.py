"""Exact deduplication by an exchange of Golomb-coded fingerprints.

1. One pass over the texts writes a ledger: row number, document id, 64-bit hash, SHA-256.
2. Each partition of the ledger shortens its hashes to fingerprints from a range 2^``spare_bits``
   times the number of rows, sorts and deduplicates them, and sends each owner of a part of the
   range one message: the gaps between its fingerprints, Golomb-Rice coded, and a bitmap of those
   it holds more than once itself.
3. An owner decodes the messages for its part and answers each with a bitmap of the fingerprints
   that occur elsewhere too. The partitions turn the bitmaps back into suspect fingerprints.
4. Only texts with a suspect fingerprint are shuffled, grouped by their bytes, which confirms the
   groups found in the ledger. False suspects (about one row in 2^``spare_bits``) fall out here.

A hot text is one fingerprint per partition in the exchange and one partial group per task in the
verification, whatever its number of copies.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utterscope.llm.common import save, shards, small

SPARE_BITS = 8
FINGERPRINTS_PER_OWNER = 1 << 18
MESSAGE = "block int, owner int, n int, rest int, unary binary, remainders binary, own binary"


def rice_encode(values: np.ndarray, low: int) -> tuple[int, bytes, bytes]:
    """Code sorted distinct ``values`` of at least ``low``: remainder bits, unary plane, remainder plane.

    A gap is its quotient by 2^r in unary and its remainder in r bits. Quotients and remainders lie
    in two planes, so that both are coded and decoded as whole arrays.
    """
    gaps = np.diff(values.astype(np.int64), prepend=np.int64(low))
    rest = max(0, int(math.log2(max(1.0, float(gaps.mean()))))) if len(gaps) else 0
    ends = np.cumsum((gaps >> rest) + 1)
    unary = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    unary[ends - 1] = 1
    planes = ((gaps[:, None] >> np.arange(rest)) & 1).astype(np.uint8)
    return rest, np.packbits(unary).tobytes(), np.packbits(planes).tobytes()


def rice_decode(n: int, rest: int, unary: bytes, remainders: bytes, low: int) -> np.ndarray:
    """The values that :func:`rice_encode` coded."""
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n]
    quotients = np.diff(ends, prepend=-1) - 1
    bits = np.unpackbits(np.frombuffer(remainders, np.uint8), count=n * rest).reshape(n, rest)
    gaps = (quotients << rest) + bits.astype(np.int64) @ (np.int64(1) << np.arange(rest))
    return low + np.cumsum(gaps)


def _bitmap(flags: np.ndarray) -> bytes:
    return np.packbits(flags.astype(np.uint8)).tobytes()


def _flags(bitmap: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bitmap, np.uint8), count=n).astype(bool)


def _send(width: int):
    """Messages of one partition: one per owner that is to hear of any fingerprint."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [batch.column(0).to_numpy(zero_copy_only=False) for batch in batches]
        if not parts:
            return
        values, counts = np.unique(np.concatenate(parts), return_counts=True)
        owners = values // width
        starts = np.flatnonzero(np.diff(owners, prepend=-1))
        out = []
        for start, end in zip(starts, [*starts[1:], len(values)]):
            owner = int(owners[start])
            rest, unary, remainders = rice_encode(values[start:end], owner * width)
            out.append(
                {
                    "block": TaskContext.get().partitionId(),
                    "owner": owner,
                    "n": int(end - start),
                    "rest": rest,
                    "unary": unary,
                    "remainders": remainders,
                    "own": _bitmap(counts[start:end] > 1),
                }
            )
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_MESSAGE_ARROW)

    return task


_MESSAGE_ARROW = pa.schema(
    [(n, pa.int32()) for n in ("block", "owner", "n", "rest")]
    + [(n, pa.binary()) for n in ("unary", "remainders", "own")]
)


def _answer(width: int):
    """Replies of one owner to all its messages."""

    def task(messages: pd.DataFrame) -> pd.DataFrame:
        decoded = [
            rice_decode(m.n, m.rest, m.unary, m.remainders, m.owner * width)
            for m in messages.itertuples()
        ]
        values, counts = np.unique(np.concatenate(decoded), return_counts=True)
        shared = values[counts > 1]
        replies = [
            _bitmap(np.isin(own, shared) | _flags(m.own, m.n))
            for own, m in zip(decoded, messages.itertuples())
        ]
        return messages[["block", "owner"]].assign(reply=replies)

    return task


def _suspects(width: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m in batch.to_pylist():
                values = rice_decode(m["n"], m["rest"], m["unary"], m["remainders"], m["owner"] * width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values[_flags(m["reply"], m["n"])], pa.int64())], ["fingerprint"]
                )

    return task


def exact_dedup(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    spare_bits: int = SPARE_BITS,
    per_owner: int = FINGERPRINTS_PER_OWNER,
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are compared as they are; a null text counts as empty, and empty texts are equal to each
    other. Of equal texts the row with the largest id stays; of rows that share it (repeated rows)
    exactly one has ``kept`` true. A null id is smaller than any other and stays only where all ids
    of the group are null. An empty table gives no rows. Other columns are not read. Should two
    different texts ever share a SHA-256, the job fails instead of merging them.
    """
    rows = documents.select(
        F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text")
    )
    ledger = save(
        rows.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            F.xxhash64("text").alias("hash"),
            F.unhex(F.sha2("text", 256)).alias("sha"),
        ),
        "exact-ledger",
    )
    total = ledger.count()
    bits = max(1, total).bit_length() + spare_bits
    owners = shards(total, per_owner)
    width = -(-(1 << bits) // owners)
    mask = F.lit((1 << bits) - 1).cast("long")

    messages = save(
        ledger.select(F.col("hash").bitwiseAND(mask).alias("fingerprint")).mapInArrow(
            _send(width), MESSAGE
        ),
        "exact-messages",
    )
    replies = messages.groupBy("owner").applyInPandas(
        _answer(width), "block int, owner int, reply binary"
    )
    suspects = save(
        messages.join(replies, ["block", "owner"])
        .mapInArrow(_suspects(width), "fingerprint long")
        .distinct(),
        "exact-suspects",
    )

    verified = (
        rows.withColumn("fingerprint", F.xxhash64("text").bitwiseAND(mask))
        .join(small(suspects, 16), "fingerprint", "left_semi")
        .groupBy("text")
        .agg(F.count(F.lit(1)).alias("equal"))
        .where("equal > 1")
        .select(F.unhex(F.sha2("text", 256)).alias("sha"), "equal")
    )
    groups = (
        ledger.withColumn("fingerprint", F.col("hash").bitwiseAND(mask))
        .join(small(suspects, 16), "fingerprint", "left_semi")
        .groupBy("sha")
        .agg(F.max(F.struct("doc_id", "row")).alias("keeper"), F.count(F.lit(1)).alias("size"))
        .where("size > 1")
    )
    collision = F.raise_error(F.lit("two different texts have one SHA-256")).cast("long")
    groups = save(
        groups.join(verified, "sha", "left").select(
            "sha",
            "keeper",
            F.when(F.col("equal") == F.col("size"), F.col("size")).otherwise(collision).alias("size"),
        ),
        "exact-groups",
    )
    return ledger.join(small(groups, 80), "sha", "left").select(
        "doc_id",
        F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("keeper.doc_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).alias("group_size"),
        (F.col("size").isNull() | (F.col("keeper.row") == F.col("row"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
