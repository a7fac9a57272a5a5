"""Near-duplicate documents by MinHash, banding, exact confirmation and connected components.

1. One pass makes a sketch of every document: the digest of its set of word shingles and, from
   many universal hash functions, the minima. Documents with equal sets form a class; one row stands
   for it from here on, so copies cost nothing further.
2. Bands of minima give bucket keys; buckets of one class are dropped by counting.
3. First round: in every bucket all members are paired with one centre only, the member that shares
   most buckets. Pairs whose minima agree too rarely are dropped, the others are confirmed on their
   full sets. This links nearly everything, with at most one pair per member and bucket.
4. Second round, which makes the result exact: buckets whose members are still in different components
   are cut into blocks, and pairs of blocks are compared in runs of bounded size. Minima come first: a
   run keeps the members that agree often enough with a member of another component, each pair in the
   first band that it shares. Only these members bring their sets to the runs that kept them, where
   the links that join something new are returned. No list of all pairs of a bucket is ever made.
5. Components of all links by alternating large-star and small-star.

With the 32 bands of 4 minima, a pair of similarity 0.85 is missed with probability 6e-11 and one of
0.8 with 5e-8.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utterscope.llm.common import fresh_names, released, save, slices, small
from utterscope.llm.components import components

WORDS = 5
BANDS, MINIMA_PER_BAND = 32, 4
MINIMA = BANDS * MINIMA_PER_BAND
#: Members of a block of a bucket.
BLOCK = 256
SEED = 9
_MIX = np.uint64(0x9E3779B97F4A7C15)
SKETCH = "row long, doc_id long, text_hash long, n_shingles long, digest binary, minima binary"
SET = "rep long, shingles binary"


def _hash_functions() -> tuple[np.ndarray, np.ndarray]:
    """Multiply-shift functions a * x + b modulo 2^64, read by their upper bits; a is odd."""
    draw = np.random.default_rng(SEED)
    a, b = draw.integers(0, 2**63, (2, MINIMA), dtype=np.uint64)
    return a * np.uint64(2) + np.uint64(1), b


def shingle_sets(texts: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; empty without words."""
    for part in slices(texts):
        yield from _shingle_sets(texts[part], words)


def _shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    if isinstance(split, pa.ChunkedArray):
        split = split.combine_chunks()
    owner = pc.list_parent_indices(split)
    flat = pc.list_flatten(split)
    filled = pc.greater(pc.binary_length(flat), 0)
    flat, owner = flat.filter(filled), owner.filter(filled).to_numpy()
    coded = flat.dictionary_encode()
    names = np.array([xxhash.xxh64_intdigest(w.encode()) for w in coded.dictionary.to_pylist()], np.uint64)
    hashes = names[coded.indices.to_numpy()] if len(names) else np.empty(0, np.uint64)
    ends = np.searchsorted(owner, np.arange(len(split)), side="right")
    starts = np.concatenate([[0], ends[:-1]]) if len(split) else ends

    def mixed(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))

    rolled = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
    for i in range(words):
        rolled = rolled * _MIX + hashes[i : i + len(rolled)]
    rolled = mixed(rolled)
    out = []
    for start, end in zip(starts, ends):
        if end - start >= words:
            out.append(np.unique(rolled[start : end - words + 1]))
        elif end > start:
            whole = np.uint64(end - start)
            with np.errstate(over="ignore"):
                for h in hashes[start:end]:
                    whole = whole * _MIX + h
            out.append(mixed(np.array([whole], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def minima_of(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        part = shingles[at : at + 2048]
        low = np.minimum(low, (a[:, None] * part[None, :] + b[:, None]).min(axis=1))
    return (low >> np.uint64(32)).astype(np.uint32)


def _sketch(words: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _hash_functions()
        for batch in batches:
            sizes, digests, minima = [], [], []
            for s in shingle_sets(batch.column(3), words):
                sizes.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                minima.append(minima_of(s, a, b).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i) for i in range(3)),
                    pa.array(sizes, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array(minima, pa.binary()),
                ],
                ["row", "doc_id", "text_hash", "n_shingles", "digest", "minima"],
            )

    return task


def _sets(words: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in slices(batch.column(1)):
                some = batch.slice(at, part.stop - part.start)
                at = part.stop
                sets = [s.tobytes() for s in _shingle_sets(some.column(1), words)]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(sets, pa.binary())],
                    ["rep", "shingles"],
                )

    return task


def _agreement_floor(percent: int) -> float:
    """Share of equal minima below which a pair is not confirmed: five standard deviations under the threshold."""
    s = percent / 100
    return s - 5 * math.sqrt(s * (1 - s) / MINIMA)


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (len(x) + len(y) - common)


def _agreeing(percent: int):
    """Keep the pairs (a, b) whose minima agree often enough."""
    floor = _agreement_floor(percent)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (
                np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, MINIMA)
                for i in (2, 3)
            )
            keep = pa.array((x == y).mean(axis=1) >= floor)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in (0, 1)], ["a", "b"])

    return task


def _confirmed(percent: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array(
                [
                    _similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)
                    for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
                ],
                pa.bool_(),
            )
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in (0, 1)], ["a", "b"])

    return task


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (key, left, right) of a sorted partition."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in ("key", "left", "right")])
        starts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1), batch.num_rows]
        for start, stop in zip(starts, starts[1:]):
            this = tuple(keys[:, start])
            if held and this != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, stop - start))
            last = this
    if held:
        yield pa.Table.from_batches(held)


class _Run:
    """The members of one pair of blocks of a bucket."""

    def __init__(self, rows: pa.Table):
        first = rows.slice(0, 1)
        self.band, self.left, self.right = (first.column(c)[0].as_py() for c in ("band", "left", "right"))
        self.nodes, self.components, self.blocks = (rows.column(c).to_numpy() for c in ("rep", "component", "block"))
        self.minima = np.frombuffer(b"".join(rows.column("minima").to_pylist()), np.uint32).reshape(-1, MINIMA)

    def candidates(self, floor: float) -> Iterator[tuple[int, np.ndarray]]:
        """A member of the left block and those of the right one in other components that may be similar to it."""
        second = np.flatnonzero(self.blocks == self.right)
        for i in np.flatnonzero(self.blocks == self.left):
            others = second[
                (self.components[second] != self.components[i]) & ((self.left != self.right) | (second > i))
            ]
            if not len(others):
                continue
            same = self.minima[others] == self.minima[i]
            likely = same.mean(axis=1) >= floor
            if likely.any():
                shared = same[likely].reshape(-1, BANDS, MINIMA_PER_BAND).all(axis=2)
                yield int(i), others[likely][shared.argmax(axis=1) == self.band]


def _promising(percent: int):
    """The members of each run that have a candidate."""
    floor = _agreement_floor(percent)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches):
            kept = np.zeros(rows.num_rows, bool)
            for i, others in _Run(rows).candidates(floor):
                kept[others] = True
                kept[i] |= bool(len(others))
            if kept.any():
                yield from rows.filter(pa.array(kept)).combine_chunks().to_batches()

    return task


def _joining(percent: int):
    """Links between different components of a run, no more than join all that belong together in it."""
    floor = _agreement_floor(percent)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches):
            run = _Run(rows)
            sets = [np.frombuffer(x, np.uint64) for x in rows.column("shingles").to_pylist()]
            roots = {int(c): int(c) for c in run.components}

            def root(c: int) -> int:
                while roots[c] != c:
                    roots[c] = roots[roots[c]]
                    c = roots[c]
                return c

            found = []
            for i, others in run.candidates(floor):
                for j in others:
                    x, y = root(int(run.components[i])), root(int(run.components[j]))
                    if x != y and _similar(sets[i], sets[j], percent):
                        roots[max(x, y)] = min(x, y)
                        found.append((int(run.nodes[i]), int(run.nodes[j])))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["a", "b"])

    return task


def _links(reps: DataFrame, sets: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Confirmed links of the two rounds; every component of the full link graph is connected by them."""
    members_of = members.groupBy("rep").agg(F.sum("held").alias("weight"))
    centres = (
        members.join(members_of, "rep")
        .groupBy("key")
        .agg(F.max(F.struct("weight", (-F.col("rep")).alias("minus"))).alias("best"))
        .select("key", (-F.col("best.minus")).alias("centre"))
    )
    pairs = members.join(centres, "key").where("rep <> centre").select("rep", "centre").distinct()

    def with_both(pairs: DataFrame, nodes: DataFrame, column: str) -> DataFrame:
        a = nodes.select(F.col("rep").alias("a"), F.col(column).alias("of_a"))
        b = nodes.select(F.col("rep").alias("b"), F.col(column).alias("of_b"))
        return pairs.join(a, "a").join(b, "b").select("a", "b", "of_a", "of_b")

    renamed = pairs.select(F.col("rep").alias("a"), F.col("centre").alias("b"))
    likely = save(
        with_both(renamed, reps, "minima").mapInArrow(released(_agreeing(percent)), "a long, b long"), "near-likely"
    )
    first = save(
        with_both(likely, sets, "shingles").mapInArrow(released(_confirmed(percent)), "a long, b long"), "near-links"
    )
    named = components(first)
    placed = save(
        members.join(named.withColumnRenamed("node", "rep"), "rep", "left").select(
            "key", "band", "held", "rep", F.coalesce("component", "rep").alias("component")
        ),
        "near-placed",
    )
    open_ = save(
        placed.groupBy("key")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .where("low <> high")
        .select("key"),
        "near-open",
    )
    blocks = F.ceil(F.col("held") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64(F.lit(SEED), "rep"), F.col("blocks")).cast("int")
    dealt = (
        placed.join(small(open_, 16), "key")
        .withColumn("blocks", blocks)
        .withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "key", "band", "rep", "component", "block",
            F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"),
        )
    )

    def in_runs(members: DataFrame) -> DataFrame:
        # At most two blocks make a run, so a bucket of any size is spread over many tasks.
        return members.repartition("key", "left", "right").sortWithinPartitions("key", "left", "right")

    with_minima = in_runs(dealt.join(reps.select("rep", "minima"), "rep"))
    kept = save(with_minima.mapInArrow(released(_promising(percent)), with_minima.schema), "near-promising")
    second = in_runs(kept.join(sets, "rep")).mapInArrow(released(_joining(percent)), "a long, b long")
    return first.unionByName(save(second, "near-late-links"))


def near_dedup(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    percent: int = 80,
    words: int = WORDS,
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, component_size, keeper.

    Texts are lower-cased (A to Z) and cut at ASCII white space. The set of a document holds its
    distinct runs of ``words`` words; one of fewer words has its whole sequence as the only element,
    and a null, empty or blank one has the empty set and is linked with nothing, not even with another
    such text. Two documents are linked when 100 * |intersection| >= ``percent`` * |union|.
    ``component_id`` is the smallest id in the connected component, nulls aside (null if all are), and
    ``kept`` tells whether the document has it. Repeated rows are kept together; ``keeper`` is true for
    exactly one row of each component. An empty table gives no rows. Other columns are not read.
    """
    return _near_dedup(documents, id_column, text_column, percent, words).drop("text_hash")


def _near_dedup(
    documents: DataFrame, id_column: str, text_column: str, percent: int = 80, words: int = WORDS
) -> DataFrame:
    """The rows of :func:`near_dedup` and the text_hash of each."""
    rows = documents.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.xxhash64(F.col(text_column)).alias("text_hash"),
        F.col(text_column).alias("text"),
    )
    sketches = save(
        rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text_hash", "text").mapInArrow(
            released(_sketch(words)), SKETCH
        ),
        "near-sketches",
    )
    classes = save(
        sketches.where("digest is not null").groupBy("digest").agg(
            F.min("row").alias("rep"), F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("copies")
        ),
        "near-classes",
    )
    reps = save(
        sketches.drop("digest")
        .join(classes.select(F.col("rep").alias("row")), "row")
        .withColumnRenamed("row", "rep"),
        "near-reps",
    )
    width = 4 * MINIMA_PER_BAND
    keys = [F.xxhash64(F.lit(b), F.substring("minima", b * width + 1, width)) for b in range(BANDS)]
    banded = reps.select("rep", F.posexplode(F.array(*keys)).alias("band", "key"))
    buckets = save(
        banded.groupBy("key").agg(F.count(F.lit(1)).alias("held")).where("held > 1"), "near-buckets"
    )
    members = save(banded.join(small(buckets, 24), "key"), "near-members")

    wanted = save(
        reps.join(members.select("rep").distinct(), "rep", "left_semi").select(
            "rep", F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")
        ),
        "near-wanted",
    )
    texts = rows.join(
        small(wanted, 48), rows["doc_id"].eqNullSafe(F.col("_id")) & (rows["text_hash"] == F.col("_hash"))
    ).select("rep", "text")
    # Repeated rows give a representative's set more than once.
    sets = save(texts.mapInArrow(released(_sets(words)), SET).dropDuplicates(["rep"]), "near-sets")
    named = components(_links(reps, sets, members, percent))

    lows = (
        classes.join(named, classes["rep"] == named["node"], "left")
        .withColumn("root", F.coalesce("component", "rep"))
        .select("digest", "root", "low", "rep", "copies")
    )
    lows = save(lows, "near-roots")
    grouped = lows.groupBy("root").agg(
        F.min("low").alias("component_id"),
        F.sum("copies").alias("component_size"),
        F.count(F.lit(1)).alias("classes"),
    )
    # Classes of one document that no link touches need no entry.
    known = save(
        lows.join(grouped, "root").where("component_size > 1").select("digest", "root", "component_id", "component_size"),
        "near-known",
    )
    labelled = sketches.select("row", "doc_id", "text_hash", "n_shingles", "digest").join(
        small(known, 72), "digest", "left"
    )
    # One row per component stays: the smallest id, then the smallest row.
    first = labelled.where("root is not null").groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    ).select(F.col("first.row").alias("first_row"))
    first = small(save(first, "near-first"), 16)
    return labelled.join(first, labelled["row"] == first["first_row"], "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.col("doc_id").eqNullSafe(
            F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
        ).alias("kept"),
        F.coalesce("component_size", F.lit(1)).alias("component_size"),
        (F.col("root").isNull() | F.col("first_row").isNotNull()).alias("keeper"),
        "text_hash",
    )


def keep_one_of_each(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """``documents`` without the near duplicates: of each component one row stays, one of the smallest id.

    Rows are matched by id, nulls included, and text hash. Rows equal in both lie in one component, so
    none or one of them stays, or, for texts without words, which are linked with nothing, all of them.
    Which one of such rows stays is open when they differ in other columns.
    """
    result = _near_dedup(documents, id_column, text_column, **options)
    key, text, of_id, of_hash, one = fresh_names(documents, "key", "text_hash", "id_", "hash_", "one")
    dropped = save(
        result.groupBy(F.col("doc_id").alias(of_id), F.col("text_hash").alias(of_hash))
        .agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("keeper").cast("int")).alias("n_kept"))
        .where("n_kept < n_rows")
        .select(of_id, of_hash, (F.col("n_kept") > 0).alias(one)),
        "near-dropped",
    )
    hashed = documents.select(
        "*", F.col(id_column).cast("long").alias(key), F.xxhash64(F.col(text_column)).alias(text)
    )

    def same(table: DataFrame):
        return hashed[key].eqNullSafe(table[of_id]) & (hashed[text] == table[of_hash])

    known = small(dropped, 32)
    left = hashed.join(known, same(known), "left_anti").select(*documents.columns)
    repeated = dropped.where(F.col(one))
    if repeated.isEmpty():
        return left
    repeated = small(repeated, 32)
    kept = hashed.join(repeated, same(repeated), "left_semi").dropDuplicates([key, text])
    return left.unionByName(kept.select(*documents.columns))
