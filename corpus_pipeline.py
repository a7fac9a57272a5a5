"""A corpus pipeline: drop toxic documents, repeated lines and near duplicates, mix the sources, pack.

Every stage works on all rows that the one before it kept. All but the last return the columns of the
documents they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utterscope.llm.common import save, set_aside, table
from utterscope.llm.line_dedup import dedup_lines
from utterscope.llm.mixing import mixed_documents
from utterscope.llm.near_dedup import keep_one_of_each
from utterscope.llm.packing import pack
from utterscope.llm.toxicity import score_documents

NEAR_PERCENT = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject, written, so that texts go to Python in small batches."""
    plain, own = set_aside(docs, "held_out", "score", "predicted")
    scored = score_documents(plain, table(spark, sf_dir, "labels"))
    return save(scored.where("predicted = 0").select(*own), "stage-toxicity")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that a document of a larger id holds as well.

    A text that loses nothing stays as it is, null included; ``n_chars`` follows the text.
    """
    plain, own = set_aside(docs, "kept_text", "n_lines", "n_dropped")
    lost = F.col("n_dropped") > 0
    changed = {"text": F.when(lost, F.col("kept_text")).otherwise(F.col("text")).alias("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(lost, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    return dedup_lines(plain).select(*[changed.get(c, column) for c, column in zip(docs.columns, own)])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id."""
    return keep_one_of_each(docs, percent=NEAR_PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document comes as often as it is taken, up to three times, or not at all."""
    return mixed_documents(docs)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their bins."""
    return pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("source_mix", mix_sources),
    ("packing", pack_documents),
]
#: Trained scores and minima of hash functions cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; what a stage returns is written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        if stage is not drop_toxic:
            docs = save(docs, f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
