"""Ranked lexical search: for each item the best documents, by a hybrid of term-at-a-time and document-at-a-time.

1. One pass over the texts keeps, per document, its number of terms and the frequencies of those terms
   that some item asks for.
2. Counts of documents and terms, combined before the shuffle, give the weights and length norms.
3. The documents are searched in blocks, each by one task and without a shuffle. A block sorts its
   entries into posting lists. For each item the short lists are worked off term at a time into
   summed accumulators; these stand as one more list, with the greatest of their sums as its bound,
   among the long lists, which are read document at a time: in windows of ascending documents,
   lists whose bounds together cannot lift a document over the threshold are only looked up for the
   documents that the others bring, and documents that cannot reach it any more are dropped before that.
   The threshold is the lowest of the best scores so far and carries on to the next block.
4. The best of the tasks, at most ``k`` an item, are ranked.

Skipping never loses a document: bounds hold for whole lists and only strictly smaller sums are dropped. Items travel to
the tasks in lots of a bounded size; more than one lot means one pass for each.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from utterscope.llm.common import save, slices

TOP = 20
#: Bytes of item texts that are searched in one pass.
LOT_BYTES = 16 * 1024 * 1024
#: Entries (document, term) and documents of a block, at most, but for a single document of more entries.
BLOCK_ENTRIES, BLOCK_DOCUMENTS = 4_000_000, 1 << 17
#: Short lists hold at most this share of the documents of a block together.
SHORT_SHARE = 1 / 16
WINDOW = 1 << 13
#: Scores are whole numbers: impacts are thousandths, weights too. Length norms are per cent.
SCALE, WEIGHT_SCALE, SATURATION, LENGTH_SHARE = 1_000_000_000, 1000, 12, 25

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x80:] = np.arange(0x80, 0x100)
for _low, _high, _to in ((0x30, 0x39, 0x30), (0x41, 0x5A, 0x61), (0x61, 0x7A, 0x61)):
    _FOLD[_low : _high + 1] = np.arange(_to, _to + _high - _low + 1)


def terms_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """``(owner, term)`` for every term of the texts, in order.

    Terms are the longest runs of ASCII letters, ASCII digits and characters above 127; only A to Z are
    lower-cased. A null text has none.
    """
    texts = pa.concat_arrays([pc.fill_null(texts.cast(pa.string()), "")])
    ends = texts.buffers()[1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    folded = pa.Array.from_buffers(pa.string(), len(texts), [None, ends, pa.py_buffer(_FOLD[data])])
    split = pc.ascii_split_whitespace(folded)
    owner, flat = pc.list_parent_indices(split), pc.list_flatten(split)
    filled = pc.greater(pc.binary_length(flat), 0)
    return owner.filter(filled).to_numpy(), flat.filter(filled)


def _counted(shared):
    """Number of terms of each document and the frequencies of the known ones."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(shared.value.terms, pa.string())
        for batch in batches:
            for part in slices(batch.column(1)):
                some = batch.slice(part.start, part.stop - part.start)
                owner, terms = terms_of(some.column(1))
                coded = terms.dictionary_encode()
                numbers = pc.fill_null(pc.index_in(coded.dictionary, known), -1).to_numpy()
                number = numbers[coded.indices.to_numpy()] if len(numbers) else np.empty(0, np.int64)
                asked = number >= 0
                entries, tf = np.unique(owner[asked] * np.int64(max(1, len(known))) + number[asked], return_counts=True)
                of, term = np.divmod(entries, max(1, len(known)))
                ends = pa.array(np.append(0, np.searchsorted(of, np.arange(len(some)), side="right")), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column(0),
                        pa.array(np.bincount(owner, minlength=len(some)), pa.int64()),
                        pa.ListArray.from_arrays(ends, pa.array(term, pa.int32())),
                        pa.ListArray.from_arrays(ends, pa.array(tf, pa.int64())),
                    ],
                    ["doc_id", "n", "terms", "tfs"],
                )

    return task


@dataclass
class Lot:
    """Items whose texts travel together: their terms, numbered, and what each item asks for."""

    items: list[int]
    terms: list[str]
    asked: list[list[tuple[int, int]]]  # per item (term, how often)


def _lot(rows: list) -> Lot:
    numbers: dict[str, int] = {}
    asked = []
    for row in rows:
        _, terms = terms_of(pa.array([row["text"]], pa.string()))
        counted = Counter(terms.to_pylist())
        asked.append([(numbers.setdefault(term, len(numbers)), often) for term, often in counted.items()])
    return Lot([row["item"] for row in rows], list(numbers), asked)


@dataclass
class Statistics:
    """What the scores take from the whole corpus."""

    documents: int
    terms: int
    weights: np.ndarray

    def impacts(self, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        norm = 100 - LENGTH_SHARE + (LENGTH_SHARE * n * self.documents) // self.terms
        return (SCALE * tf) // (1000 * tf + SATURATION * norm)


def _statistics(counted: DataFrame, lot: Lot) -> Statistics:
    row = counted.where("n > 0").agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    held = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    df = [0] * len(lot.terms)
    for found in held.toLocalIterator():  # at most one row per term of the lot
        df[found["term"]] = found["df"]
    # One logarithm at a time: those of whole arrays may differ in the last bit.
    weights = [math.floor(WEIGHT_SCALE * math.log((2 * row["documents"] + 2) / (2 * held_by + 1))) for held_by in df]
    return Statistics(row["documents"], max(1, row["terms"]), np.array(weights, np.int64))


class Block:
    """Posting lists over some documents; a document goes by its place in the order of the ids."""

    def __init__(self, doc_ids: pa.Array, n: np.ndarray, terms: pa.ListArray, tfs: pa.ListArray, statistics: Statistics):
        order = pc.array_sort_indices(doc_ids, null_placement="at_end").to_numpy()
        self.doc_ids, self.size = doc_ids.take(pa.array(order)), len(doc_ids)
        place = np.empty(self.size, np.int64)
        place[order] = np.arange(self.size)
        counts = terms.value_lengths().to_numpy()
        document, of = place[np.repeat(np.arange(self.size), counts)], np.repeat(n, counts)
        term, tf = terms.flatten().to_numpy(), tfs.flatten().to_numpy()
        by_term = np.lexsort((document, term))
        self.documents = document[by_term]
        self.impacts = statistics.impacts(tf[by_term], of[by_term])
        numbers = np.arange(len(statistics.weights))
        self.starts = np.searchsorted(term[by_term], numbers)
        self.ends = np.searchsorted(term[by_term], numbers, side="right")

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.starts[term], self.ends[term])
        return self.documents[part], self.impacts[part]


def _summed(documents: list[np.ndarray], scores: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct documents and the sums of their scores."""
    found, of = np.unique(np.concatenate(documents), return_inverse=True)
    sums = np.zeros(len(found), np.int64)
    np.add.at(sums, of, np.concatenate(scores))
    return found, sums


def _hybrid(lists: list[tuple[np.ndarray, np.ndarray]], documents: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(documents, scores, bound) of the accumulators and the long lists, by ascending bound."""
    ascending = sorted(lists, key=lambda x: len(x[0]))
    room, cut = documents * SHORT_SHARE, 0
    while cut < len(ascending) and (cut == 0 or len(ascending[cut][0]) <= room):
        room -= len(ascending[cut][0])
        cut += 1
    short = _summed(*(list(x) for x in zip(*ascending[:cut])))
    return sorted(((d, s, int(s.max())) for d, s in [short, *ascending[cut:]]), key=lambda x: x[2])


def search_block(block: Block, weighted: list[tuple[int, int]], k: int, best: list[tuple]) -> list[tuple]:
    """The ``k`` best of ``best`` and the block, as (-score, no id, id); ``weighted`` holds (term, weight)."""
    lists = []
    for term, weight in weighted:
        documents, impacts = block.postings(term)
        if len(documents) and weight > 0:
            lists.append((documents, impacts * weight))
    if not lists:
        return best
    lists = _hybrid(lists, block.size)
    bounds = np.cumsum([bound for _, _, bound in lists])
    for low in range(0, block.size, WINDOW):
        threshold = -best[-1][0] if len(best) == k else 1
        # Lists up to here cannot reach the threshold together: no document is taken from them alone.
        passive = int(np.searchsorted(bounds, threshold))
        if passive == len(lists):
            break
        sums = np.zeros(min(WINDOW, block.size - low), np.int64)
        for documents, scores, _ in lists[passive:]:
            start, end = np.searchsorted(documents, (low, low + WINDOW))
            sums[documents[start:end] - low] += scores[start:end]
        found = np.flatnonzero(sums)
        sums = sums[found]
        for i in range(passive - 1, -1, -1):
            alive = sums + bounds[i] >= threshold
            found, sums = found[alive], sums[alive]
            if not len(found):
                break
            documents, scores, _ = lists[i]
            at = np.searchsorted(documents, found + low)
            at[at == len(documents)] = 0
            sums = sums + np.where(documents[at] == found + low, scores[at], 0)
        alive = sums >= threshold
        found, sums = found[alive], sums[alive]
        if len(found) > k:
            kept = np.lexsort((found, -sums))[:k]
            found, sums = found[kept], sums[kept]
        if len(found):
            ids = block.doc_ids.take(pa.array(found + low)).to_pylist()
            new = [(-int(s), i is None, i or 0) for s, i in zip(sums, ids)]
            best = sorted([*best, *new])[:k]
    return best


def _searched(shared, k: int, block_entries: int, block_documents: int):
    """The best documents of one partition for every item of the lot."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot, statistics = shared.value
        weighted = [[(t, int(statistics.weights[t]) * often) for t, often in asked] for asked in lot.asked]
        best: list[list[tuple]] = [[] for _ in lot.items]
        for rows in _blocks(batches, block_entries, block_documents):
            columns = [rows.column(c).combine_chunks() for c in ("doc_id", "n", "terms", "tfs")]
            block = Block(columns[0], columns[1].to_numpy(), *columns[2:], statistics)
            for i, asked in enumerate(weighted):
                best[i] = search_block(block, asked, k, best[i])
        found = [(lot.items[i], None if none else doc, -score) for i, top in enumerate(best) for score, none, doc in top]
        columns = list(zip(*found)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item", "doc_id", "score"])

    return task


def _blocks(batches: Iterator[pa.RecordBatch], entries: int, documents: int) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    n = size = 0
    for batch in batches:
        lengths = np.cumsum(batch.column("terms").value_lengths().to_numpy())
        start = 0
        while start < batch.num_rows:
            before = int(lengths[start - 1]) if start else 0
            stop = int(np.searchsorted(lengths, before + entries - size, side="right"))
            stop = min(stop, start + documents - n, batch.num_rows)
            if stop <= start and held:
                yield pa.Table.from_batches(held)
                held, n, size = [], 0, 0
                continue
            stop = max(stop, start + 1)
            held.append(batch.slice(start, stop - start))
            n, size = n + stop - start, size + int(lengths[stop - 1]) - before
            start = stop
    if held:
        yield pa.Table.from_batches(held)


def _lots(items: DataFrame, limit: int) -> int:
    """Into how many lots the items are dealt so that none is larger than ``limit``, but for one of a single item."""
    lots, rows = 1, items.count()
    while lots < rows:
        dealt = items.groupBy(F.pmod(F.xxhash64("item"), F.lit(lots)).alias("lot")).agg(
            F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("bytes"), F.count(F.lit(1)).alias("n")
        )
        if dealt.where((F.col("bytes") > limit) & (F.col("n") > 1)).isEmpty():
            break
        lots *= 2
    return lots


def search(
    documents: DataFrame,
    items: DataFrame,
    k: int = TOP,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    lot_bytes: int = LOT_BYTES,
    block_entries: int = BLOCK_ENTRIES,
    block_documents: int = BLOCK_DOCUMENTS,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` highest-scoring documents of each item, ranks from 1.

    Whole texts count; see :func:`terms_of` for terms. With N documents that have a term, L terms in all, n terms in
    a document, and a term in df documents and tf times in this one, the score sums over the
    item's terms, repeats included, ``w * ((10^9 * tf) div (1000 * tf + 12 * m))`` in whole numbers, where w is
    ``floor(1000 * ln((2N + 2) / (2df + 1)))`` and m is ``75 + (25 * n * N) div L``. Documents without a
    score above 0 are left out; equal scores go by ascending id, null ids last, and rows that repeat an id are
    documents of their own. Every row of ``items`` is an item of its own; one without terms, or a null text, finds nothing.
    Empty tables give no rows. Other columns are not read.
    """
    spark = documents.sparkSession
    texts = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    asked = save(
        items.select(
            F.monotonically_increasing_id().alias("item"),
            F.col(item_column).alias("item_id"),
            F.col(item_text_column).alias("text"),
        ),
        "search-items",
    )
    lots = _lots(asked, lot_bytes)
    found = None
    for i in range(lots):
        lot = _lot(asked.where(F.pmod(F.xxhash64("item"), F.lit(lots)) == i).select("item", "text").collect())
        known = spark.sparkContext.broadcast(lot)
        counted = save(
            texts.mapInArrow(_counted(known), "doc_id long, n long, terms array<int>, tfs array<long>"), "search-counted"
        )
        with_statistics = spark.sparkContext.broadcast((lot, _statistics(counted, lot)))
        holding = counted.where(F.size("terms") > 0)
        tops = save(
            holding.mapInArrow(
                _searched(with_statistics, k, block_entries, block_documents), "item long, doc_id long, score long"
            ),
            "search-tops",
        )
        found = tops if found is None else found.unionByName(tops)
    in_order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(in_order)).where(F.col("rank") <= k)
    return ranked.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
