"""Line deduplication with range-partitioned hashes and per-document keep bitmaps; no Python on the executors.

1. Every line long enough gives a record: two 64-bit hashes of its key, document, position.
2. The records are range-partitioned by (hash, document) and sorted by position within; a stream over
   this order keeps the first occurrence of a key in each document. As the document is part of the
   range, a line that a third of all documents share is spread over many partitions.
3. First occurrences are counted per key, combined before the shuffle; keys of enough documents get
   the largest document as their owner.
4. Lines of an owned key outside its owner are marked in bitmaps of 64 lines a word, compressed by leaving
   out the words without a dropped line.
5. The bitmaps, not texts, go back to the documents, which expand them and filter their own lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from utterscope.llm.common import BLANKS, fresh_names, lower_ascii, save, shards, small

MIN_CHARS = 20
MIN_DOCUMENTS = 3
ROWS_PER_RANGE = 100_000


def line_key(line: Column) -> Column:
    """A line without white space at its ends and with A to Z in lower case."""
    return lower_ascii(F.btrim(line, F.lit(BLANKS)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keep_bitmaps(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    min_chars: int = MIN_CHARS,
    min_documents: int = MIN_DOCUMENTS,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """One row per document that loses lines: doc_id, text_hash, keep (map of 64-bit words), n_dropped.

    Bit i of word j tells whether line 64 * j + i stays. The bitmap is compressed: words whose lines all stay
    are left out, so it grows with the lines that go and not with the length of the text. Documents
    are told apart by their id: rows that share an id, all null ids included, count as one document,
    and a null id is smaller than any other. An empty table gives no rows.
    """
    text = F.col(text_column)
    lines = save(
        documents.select(
            F.col(id_column).alias("doc_id"),
            F.xxhash64(text).alias("text_hash"),
            F.posexplode(_lines(text)).alias("position", "line"),
        )
        .withColumn("key", line_key(F.col("line")))
        .where(F.length("key") >= min_chars)
        .select(
            F.xxhash64("key").alias("hash"),
            F.xxhash64(F.lit("second"), F.col("key")).alias("hash2"),
            "doc_id",
            "text_hash",
            "position",
        ),
        "line-keys",
    )
    in_document = Window.partitionBy("hash", "hash2", "doc_id").orderBy("position", "text_hash")
    owners = save(
        lines.repartitionByRange(shards(lines.count(), rows_per_range), "hash", "hash2", "doc_id")
        .withColumn("occurrence", F.row_number().over(in_document))
        .where("occurrence = 1")
        .groupBy("hash", "hash2")
        .agg(F.count(F.lit(1)).alias("found_in"), F.max("doc_id").alias("owner"))
        .where(F.col("found_in") >= min_documents)
        .select("hash", "hash2", "owner"),
        "line-owners",
    )
    words = (
        lines.join(small(owners, 48), ["hash", "hash2"])
        .where(~F.col("doc_id").eqNullSafe(F.col("owner")))
        .groupBy("doc_id", "text_hash", F.expr("position div 64").cast("int").alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, position % 64))").alias("drop"))
    )
    by_document = words.groupBy("doc_id", "text_hash").agg(
        F.map_from_entries(F.collect_list(F.struct("word", F.bitwise_not("drop").alias("keep")))).alias("keep"),
        F.sum(F.bit_count("drop")).cast("long").alias("n_dropped"),
    )
    return save(by_document, "line-bitmaps")


def _expanded(keep: Column) -> Column:
    """All words of a compressed bitmap up to the last one in it."""
    words = F.sequence(F.lit(0), F.array_max(F.map_keys(keep)))
    return F.transform(words, lambda word: F.coalesce(F.element_at(keep, word), F.lit(-1).cast("long")))


def dedup_lines(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """``documents`` with the columns kept_text, n_lines (before) and n_dropped added.

    Lines end at \\n only; a null or empty text is one empty line. Lines are compared by their keys
    (see :func:`line_key`); keys of at least ``min_chars`` code points that occur in at least
    ``min_documents`` documents lose all their lines but those in the document of the largest id.
    A text that loses all its lines becomes empty. Equal rows get equal results. A column of
    ``documents`` that has the name of an added one is replaced.
    """
    bitmaps = keep_bitmaps(documents, id_column, text_column, **options)
    doc, text_hash, keep, dropped = fresh_names(documents, "doc", "hash", "keep", "dropped")
    matched = small(bitmaps, 128).select("doc_id", "text_hash", _expanded(F.col("keep")), "n_dropped").toDF(
        doc, text_hash, keep, dropped
    )
    joined = documents.join(
        matched,
        documents[id_column].eqNullSafe(F.col(doc)) & (F.xxhash64(documents[text_column]) == F.col(text_hash)),
        "left",
    )
    lines = _lines(documents[text_column])
    stays = lambda line, i: F.expr("1") == F.coalesce(
        F.getbit(F.get(keep, (i / 64).cast("int")), i % 64), F.lit(1)
    )
    rebuilt = F.when(F.col(keep).isNull(), F.coalesce(documents[text_column], F.lit(""))).otherwise(
        F.array_join(F.filter(lines, stays), "\n")
    )
    added = {
        "kept_text": rebuilt,
        "n_lines": F.size(lines).cast("long"),
        "n_dropped": F.coalesce(dropped, F.lit(0).cast("long")),
    }
    return joined.select(
        *[documents[c] for c in documents.columns if c not in added],
        *[column.alias(name) for name, column in added.items()],
    )
