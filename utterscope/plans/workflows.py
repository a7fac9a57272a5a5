"""The two workflows from files to result tables: test reports, and labelled corpora.

Each function returns its tables by name; :func:`save` writes them as CSV, one folder per table.
Tables that several others need are materialized once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utterscope.operators import distribution, encoding, entity, intent, lexical, semantic
from utterscope.sources import corpus as corpora
from utterscope.sources import reports
from utterscope.sources.files import model_name, write_csv
from utterscope.sources.intermediate import materialize, spread

Tables = dict[str, DataFrame]
Paths = str | list[str]


def save(tables: Tables, folder: str) -> None:
    """Write each table below ``folder``, split by report or by split where it has one."""
    for name, table in tables.items():
        parts = [c for c in ("report", "split") if c in table.columns]
        write_csv(table, f"{folder.rstrip('/')}/{name}", parts)


def process_reports(spark: SparkSession, paths: Paths, report_folders: bool = False) -> Tables:
    """Raw reports of any number: ``results``, ``metadata``, ``preamble`` and ``rejects``.

    Files give their names to reports, or with ``report_folders`` their folders do.
    """
    split = reports.split_reports(spark, paths, report_folders)
    lines = materialize(reports.preamble(spark, paths, report_folders), "preamble")
    return {
        "results": reports.results(split),
        "metadata": reports.key_values(lines),
        "preamble": lines.orderBy("report", "line_no"),
        "rejects": reports.rejects(split),
    }


def intent_tables(results: DataFrame) -> Tables:
    """``intent_metrics`` for every report of a results table, under its model name."""
    ordered = intent.in_report_order(intent.metrics(results))
    return {"intent_metrics": _with_model(ordered.drop("is_average"))}


def entity_tables(results: DataFrame, reports_known: DataFrame | None = None) -> Tables:
    """The five entity tables for every report of a results table.

    ``reports_known`` (one ``report`` column) keeps reports whose result table is empty. The results
    are read more than once: hand over a stored table.
    """
    identified = materialize(entity.identification(results), "identification")
    metrics = entity.metrics_in_report_order(entity.metrics(results, reports_known))
    ordered = entity.breakdown_in_report_order
    tables = {
        "entity_metrics": metrics.drop("is_average"),
        "entity_identification": ordered(identified),
        "entity_methods": ordered(entity.methods(identified)),
        "entity_engine_summary": ordered(entity.engine_summary(identified)),
        "entity_success": entity.utterance_success(results, reports_known).orderBy("report"),
    }
    return {name: _with_model(table) for name, table in tables.items()}


def evaluate_reports(spark: SparkSession, paths: Paths, report_folders: bool = False) -> Tables:
    """All intent and entity tables straight from raw reports or from split-off result tables."""
    split = reports.split_reports(spark, paths, report_folders)
    results = reports.results(split)
    return {
        **intent_tables(results),
        **entity_tables(results, _usable_reports(spark, paths, split, report_folders)),
        "rejects": reports.rejects(split),
    }


def _usable_reports(spark: SparkSession, paths: Paths, split: DataFrame, report_folders: bool) -> DataFrame:
    known = reports.report_manifest(spark, paths, report_folders).select("report").distinct()
    return known.join(reports.rejects(split).select("report"), "report", "left_anti")


def lexical_tables(corpus: DataFrame, manifest: DataFrame | None = None) -> Tables:
    """``intra_lexical`` per split and ``ttr_inter_set_diff`` between the splits."""
    vocab = materialize(lexical.vocabulary(corpus, manifest), "vocabulary")
    return {
        "intra_lexical": vocab.drop("token_count").orderBy("split", "label"),
        "ttr_inter_set_diff": lexical.ratio_difference(vocab).orderBy("label"),
    }


def distribution_tables(corpus: DataFrame, manifest: DataFrame | None = None) -> Tables:
    """``distribution_kurtosis``, ``distribution_emd`` and ``distribution_js`` from one histogram.

    ``manifest`` keeps labels whose files hold no text; they have nulls for their kurtosis.
    """
    hist = materialize(distribution.histogram(corpus), "histogram")
    return {
        "distribution_kurtosis": distribution.kurtosis(hist, manifest).orderBy("label"),
        "distribution_emd": distribution.earth_movers_distance(hist).orderBy("label"),
        "distribution_js": distribution.js_divergence(hist).orderBy("label"),
    }


def semantic_tables(
    corpus: DataFrame,
    manifest: DataFrame | None = None,
    load_encoder: Callable[[], encoding.Encoder] | None = None,
) -> Tables:
    """Cohesion and similarity tables from texts.

    ``load_encoder`` supplies the sentence model, see :func:`utterscope.operators.encoding.encode`;
    without it the hashed TF-IDF vectors are used.
    """
    encoded = (
        encoding.hashed_tfidf(corpus) if load_encoder is None else encoding.encode(corpus, load_encoder)
    )
    emb = materialize(encoded, "embeddings")
    cents = materialize(semantic.centroids(emb, manifest=manifest), "centroids")
    return {
        "intra_semantic_cohesion": semantic.cohesion(emb, manifest=manifest)
        .drop("n")
        .orderBy("split", "label"),
        "intra_semantic_similarity": semantic.centroid_pairs(cents).orderBy(
            "split", "label1", "label2"
        ),
        "cross_semantic_similarity": semantic.cross_split_similarity(
            emb, manifest=manifest
        ).orderBy("label"),
    }


def analyze_corpus(
    spark: SparkSession,
    test: Paths,
    train: Paths,
    load_encoder: Callable[[], encoding.Encoder] | None = None,
) -> Tables:
    """Lexical, distribution and semantic tables of two folders with one file per label.

    Files that cannot be read are left out and listed in ``rejects`` with the reason.
    """
    folders = {"test": test, "train": train}
    scanned = corpora.scan_corpus(spark, folders)
    corpus = spread(corpora.texts(scanned))
    manifest = corpora.read_corpus_manifest(spark, folders)
    return {
        **lexical_tables(corpus, manifest),
        **distribution_tables(corpus, manifest),
        **semantic_tables(corpus, manifest, load_encoder),
        "rejects": corpora.rejects(scanned),
        "files_without_text": corpora.missing_files(corpus, manifest),
    }


def _with_model(table: DataFrame) -> DataFrame:
    return table.withColumn("model", model_name(F.col("report")))
