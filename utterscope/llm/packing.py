"""Conflict-constrained best-fit packing of documents into bins of fixed capacity.

Documents are cut into pieces of at most the capacity; pieces are dealt to shards by a hash and each
shard packs its own bins, largest pieces first. A shard keeps its bins ordered by residual. Every
bin carries bitmaps: one bit per duplicate cluster, and for each allowed repetition one bit per
source. The search starts at the smallest residual that fits (the successor of the size) and goes
on to the next larger ones until it meets a bin whose bitmaps allow the piece; only if no bin does
is a new one opened. So each piece goes to the tightest compatible bin of its shard.

The number of shards grows with the pieces, so a task holds a bounded number of small records; no
text is shuffled. Shards are dealt by row, so a source or cluster with a third of all rows is
spread over all of them. What a shard leaves behind, its bins that are not nearly full, is taken apart and
packed again, dealt anew into as many fewer shards, round after round until one shard holds the rest or a
round closes less than half of its pieces. So part-filled bins do not add up over the shards.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utterscope.llm.common import lower_ascii, save, shards, word_count

#: Words of a bin.
CAPACITY = 2048
#: Pieces of one source that a bin may hold.
PER_SOURCE = 4
ROWS_PER_SHARD = 2048
#: A bin is closed from this share of its capacity on.
CLOSED = 0.98
PACKED = (
    "row long, doc_id {id}, source {source}, cluster long, piece int, shard int, bin int, position int, "
    "words int, filled int"
)


class ShardBins:
    """The bins of one shard, kept in the order of their residuals."""

    def __init__(self, capacity: int, per_source: int, sources: int, clusters: int, rows: int):
        self.capacity, self.per_source = capacity, per_source
        self.residuals = np.empty(rows, np.int64)
        self.order = np.empty(rows, np.int64)
        self.count = 0
        self.source_bits = np.zeros((per_source, rows, sources // 64 + 1), np.uint64)
        self.cluster_bits = np.zeros((rows, clusters // 64 + 1), np.uint64)

    def _compatible(self, bins: np.ndarray, source: int, cluster: int) -> np.ndarray:
        full = self.source_bits[self.per_source - 1, bins, source >> 6] >> np.uint64(source & 63)
        if cluster >= 0:
            full |= self.cluster_bits[bins, cluster >> 6] >> np.uint64(cluster & 63)
        return (full & np.uint64(1)) == 0

    def place(self, size: int, source: int, cluster: int) -> int:
        """The number of the tightest compatible bin, or of a new one."""
        start, step = int(np.searchsorted(self.residuals[: self.count], size)), 8
        at = -1
        low = start
        while low < self.count:
            fits = self._compatible(self.order[low : min(low + step, self.count)], source, cluster)
            hit = int(fits.argmax())
            if fits[hit]:
                at = low + hit
                break
            low, step = low + step, step * 4
        if at < 0:
            chosen, residual = self.count, self.capacity - size
            end = self.count
            self.count += 1
        else:
            chosen, residual = int(self.order[at]), int(self.residuals[at]) - size
            end = at
        # The bin moves left to its new place; those in between move right by one.
        to = int(np.searchsorted(self.residuals[:end], residual))
        self.residuals[to + 1 : end + 1] = self.residuals[to:end]
        self.order[to + 1 : end + 1] = self.order[to:end]
        self.residuals[to], self.order[to] = residual, chosen
        word, bit = source >> 6, np.uint64(1 << (source & 63))
        for plane in self.source_bits:
            if not plane[chosen, word] & bit:
                plane[chosen, word] |= bit
                break
        if cluster >= 0:
            self.cluster_bits[chosen, cluster >> 6] |= np.uint64(1 << (cluster & 63))
        return chosen


def _pack_shard(capacity: int, per_source: int):
    def task(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(
            ["words", "cluster", "source", "doc_id", "row", "piece"], ascending=[False] + [True] * 5
        ).reset_index(drop=True)
        sources = pd.factorize(rows["source"], use_na_sentinel=False)[0]
        # Only clusters met more than once in the shard can conflict; the others need no bit.
        codes, names = pd.factorize(rows["cluster"])
        repeated = np.bincount(codes, minlength=len(names)) > 1
        numbers = np.where(repeated, np.cumsum(repeated) - 1, -1)
        clusters = numbers[codes]
        bins = ShardBins(
            capacity, per_source, int(sources.max()) + 1, int(repeated.sum()), len(rows)
        )
        sizes = rows["words"].to_numpy()
        placed = [bins.place(int(s), int(o), int(c)) for s, o, c in zip(sizes, sources, clusters)]
        out = rows[["row", "doc_id", "source", "cluster", "piece", "shard"]].assign(bin=placed)
        grouped = rows.groupby(out["bin"])["words"]
        return out.assign(position=grouped.cumcount(), words=sizes, filled=grouped.transform("sum"))

    return task


def same_text_cluster(text: Column) -> Column:
    """Default duplicate cluster: texts that are equal but for ASCII case and white space."""
    bare = F.btrim(F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+", " "))
    return F.xxhash64(bare)


def pack(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    cluster: Column | None = None,
    capacity: int = CAPACITY,
    per_source: int = PER_SOURCE,
    rows_per_shard: int = ROWS_PER_SHARD,
) -> DataFrame:
    """One row per piece: doc_id, piece, first_word, words, bin, position, filled.

    A document of more than ``capacity`` words is cut: piece k starts at word k * capacity. Words are
    runs of characters other than ASCII white space, and every word of every text is packed. A text
    without words (null, empty, blank) is one piece of zero words and is packed as well. ``bin`` is
    ``round:shard:number``, ``position`` the place of the piece in its bin, ``filled`` the words of the bin.
    No bin exceeds the capacity, holds two pieces of one duplicate ``cluster`` (equal texts unless
    another column is given; a null cluster is one of its own kind per row) or more than ``per_source``
    pieces of one source; a null source counts as a source. Pieces of one document share its cluster,
    so they lie in different bins. Repeated rows are packed as often as they occur. An empty table
    gives no rows. Other columns are not read.
    """
    text = F.col(text_column)
    measured = save(
        documents.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(id_column).alias("doc_id"),
            F.col(source_column).alias("source"),
            (same_text_cluster(text) if cluster is None else F.xxhash64(cluster)).alias("cluster"),
            (F.lit(False) if cluster is None else cluster.isNull()).alias("alone"),
            word_count(text).alias("size"),
        ).withColumn("cluster", F.when(F.col("alone"), F.xxhash64("row")).otherwise(F.col("cluster"))),
        "pack-measured",
    )
    last = F.greatest(F.ceil(F.col("size") / capacity) - 1, F.lit(0)).cast("int")
    pieces = measured.select(
        "row", "doc_id", "source", "cluster", "size",
        F.explode(F.sequence(F.lit(0), last)).alias("piece"),
    ).withColumn("words", F.least(F.col("size") - F.col("piece").cast("long") * capacity, F.lit(capacity)).cast("int"))
    kinds = {c: pieces.schema[name].dataType.simpleString() for c, name in (("id", "doc_id"), ("source", "source"))}
    done, left, turn = [], pieces.select("row", "doc_id", "source", "cluster", "piece", "words"), 0
    n = left.count()
    while True:
        parts = shards(n, rows_per_shard)
        drawn = F.xxhash64(F.lit(7 + turn), "doc_id", "cluster", "row", "piece")
        packed = save(
            left.withColumn("shard", F.pmod(drawn, F.lit(parts)).cast("int"))
            .groupBy("shard")
            .applyInPandas(_pack_shard(capacity, per_source), PACKED.format(**kinds)),
            "packed",
        ).withColumn("turn", F.lit(turn))
        open_ = F.col("filled") < CLOSED * capacity
        remaining = packed.where(open_).count()
        if parts == 1 or 2 * remaining > n:
            done.append(packed)
            break
        done.append(packed.where(~open_))
        left, n, turn = packed.where(open_).select(*left.columns), remaining, turn + 1
    whole = done[0]
    for more in done[1:]:
        whole = whole.unionByName(more)
    return whole.select(
        "doc_id",
        "piece",
        (F.col("piece").cast("long") * capacity).alias("first_word"),
        F.col("words").cast("long").alias("words"),
        F.concat_ws(":", "turn", "shard", "bin").alias("bin"),
        "position",
        F.col("filled").cast("long").alias("filled"),
    )
