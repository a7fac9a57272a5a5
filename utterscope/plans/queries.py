"""The operators as queries over the shared test tables, floats rounded to six digits.

Each query reads the whole of its tables. :mod:`utterscope.plans.oracle` holds the SQL that gives
the same rows in another engine.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from utterscope.functions.text import preview
from utterscope.operators import (
    distribution,
    edges,
    encoding,
    entity,
    intent,
    lexical,
    nearest,
    projection,
    scoring,
    semantic,
)
from utterscope.plans import views
from utterscope.sources import corpus as corpora
from utterscope.sources import files, reports
from utterscope.sources.intermediate import fresh_folder, materialize, spread

Query = Callable[[SparkSession, str], DataFrame]

DIGITS = 6
BY_LABEL = ("label",)
# Fixed values shared with the SQL checks.
EDGE_THRESHOLD = 0.05
SKETCH_DEVIATIONS = 4
SAMPLE_SIZE = 5
SAMPLE_SEED = 0
LINE_WEIGHTS = {"l_quantity": 0.05, "l_discount": 2.0, "l_tax": -3.0}
LINE_BIAS = -1.0
VECTOR_WEIGHTS = [((i % 7) - 3) / 10 for i in range(64)]
VECTOR_BIAS = 0.01
SCORED_ACTIVATIONS = ["step", "sigmoid", "tanh", "relu", "leaky_relu", "leaky_relu_max", "elu", "swish"]


def rounded(frame: DataFrame) -> DataFrame:
    """Round every double column; the rest of the frame is unchanged."""
    return frame.select(
        *[
            F.round(name, DIGITS).alias(name) if kind == "double" else F.col(name)
            for name, kind in frame.dtypes
        ]
    )


def _batch(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: rounded(operator(views.batch(spark, sf_dir)))


def _ent(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: rounded(operator(views.ent(spark, sf_dir)))


def _corpus(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: rounded(operator(views.corpus(spark, sf_dir)))


def _lengths(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return _corpus(lambda corpus: operator(distribution.histogram(corpus)))


def _emb(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: rounded(operator(views.emb(spark, sf_dir)))


def _by_label(operator: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    """An operator on embeddings and the centroids of their labels."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        emb = views.emb(spark, sf_dir)
        cents = materialize(semantic.centroids(emb, BY_LABEL), "label-centroids")
        return rounded(operator(emb, cents))

    return run


def _by_split(operator: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    """An operator on embeddings and the centroids of their labels in each split."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        emb = views.emb(spark, sf_dir)
        cents = materialize(semantic.centroids(emb), "split-centroids")
        return rounded(operator(emb, cents))

    return run


def _centroid_entries(emb: DataFrame) -> DataFrame:
    return semantic.centroids(emb).select(
        "split", "label", "n", F.posexplode("centroid").alias("pos", "value")
    )


def _estimates(corpus: DataFrame) -> DataFrame:
    """Exact vocabularies per split and label, per split, and of all, and whether united sketches come close."""
    sketches = materialize(lexical.vocabulary_sketches(corpus), "sketches")
    counted = materialize(lexical.token_counts(corpus), "token-counts").where("token is not null")
    bound = SKETCH_DEVIATIONS * 1.04 / 2 ** (lexical.PRECISION / 2)
    out = None
    for by in (["split", "label"], ["split"], []):
        estimate = lexical.estimated_vocabulary(sketches, by).select(*by, F.col("vocab_size").alias("estimate"))
        exact = counted.groupBy(*by).agg(F.countDistinct("token").alias("vocab_size"))
        both = exact.join(estimate, by) if by else exact.join(estimate)
        none = F.lit(None).cast("string")
        found = both.select(
            *[(F.col(c) if c in by else none).alias(c) for c in ("split", "label")],
            "vocab_size",
            (F.abs(F.col("estimate") - F.col("vocab_size")) <= 1 + bound * F.col("vocab_size")).alias("is_close"),
        )
        out = found if out is None else out.unionByName(found)
    return out


def _embedded(corpus: DataFrame) -> DataFrame:
    """The elements of the hashed vectors that are not 0."""
    vectors = encoding.hashed_tfidf(corpus)
    elements = vectors.select("doc_id", "split", "label", F.posexplode("vec").alias("pos", "value"))
    return elements.where("value <> 0").withColumn("value", F.col("value").cast("double"))


def _scaled(emb: DataFrame, cents: DataFrame) -> DataFrame:
    similarity = semantic.row_similarity(emb, cents, BY_LABEL)
    return semantic.scaled_similarity(materialize(similarity, "similarity"))


def _projected(emb: DataFrame, cents: DataFrame) -> DataFrame:
    return projection.project(emb, cents, projection.fit(emb, cents=cents))


def _report_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spread(views.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return reports.key_values(reports.text_lines(documents, "doc_id", "text"))


def _numbered(ordered: DataFrame, name: str) -> DataFrame:
    """``report, name, position``: the place of each row of an ordered table in its report."""
    at = ordered.select("report", name, F.monotonically_increasing_id().alias("at"))
    place = F.row_number().over(Window.partitionBy("report").orderBy("at"))
    return at.select("report", name, place.cast("long").alias("position"))


def _numbered_breakdown(ent: DataFrame) -> DataFrame:
    """The rows of the breakdown with their places in the order of the report; a handful per entity."""
    ordered = entity.breakdown_in_report_order(entity.identification(ent))
    at = ordered.withColumn("at", F.monotonically_increasing_id())
    place = F.row_number().over(Window.partitionBy("report").orderBy("at"))
    return at.select("report", "entity", "method", "category", "sub_method", place.cast("long").alias("position"))


def _ranked_consistency(emb: DataFrame) -> DataFrame:
    """Consistency with the place of each label in the order of the sink; one row per label."""
    ordered = semantic.most_consistent_first(semantic.split_consistency(emb))
    at = ordered.withColumn("at", F.monotonically_increasing_id())
    place = F.row_number().over(Window.orderBy("at"))
    return at.withColumn("position", place.cast("long")).drop("at")


def _json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = views.table(spark, sf_dir, "documents")
    path = fresh_folder(spark, "json")
    files.write_json(documents, path)
    return files.read_json(spark, path, documents.schema)


def _csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = views.batch(spark, sf_dir)
    path = fresh_folder(spark, "csv")
    files.write_csv(results, path)
    return files.read_csv(spark, path, results.schema)


# Lines above the table of a written report, with quotes that open nothing there.
PREAMBLE = ['Bot Name:,"Bank', '"Threshold:",5" pipe', "", 'Notes:,"a ""b""","c']
ROWS_PER_REPORT = 5000
DAMAGED_LABEL = "damaged"


def _written_reports(spark: SparkSession, sf_dir: str) -> str:
    """The folder of raw reports that hold all documents as rows, a range of ids in each."""
    report = F.concat(F.lit("r"), F.expr(f"doc_id div {ROWS_PER_REPORT}")).alias("report")
    documents = views.table(spark, sf_dir, "documents").select(report, "doc_id", "text", "lang", "source")
    cells = F.to_csv(F.struct("text", "lang", "source", "doc_id"), files.EXACT | {"quoteAll": "true", "emptyValue": ""})
    above = F.array(*[F.lit(line) for line in [*PREAMBLE, "Utterance,ExpectedIntent,MatchedIntent,Document"]])
    heads = documents.select("report").distinct().select("report", F.posexplode(above).alias("place", "line"))
    lines = heads.unionByName(documents.select("report", F.lit(len(PREAMBLE) + 1).alias("place"), cells.alias("line")))
    path = fresh_folder(spark, "raw-reports")
    in_order = lines.repartition("report").sortWithinPartitions("report", "place").select("report", "line")
    in_order.write.partitionBy("report").text(path)
    return path


def _report_preamble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and values above the tables of the written reports, and how many reports have them."""
    lines = reports.preamble(spark, _written_reports(spark, sf_dir), report_folders=True)
    found = reports.key_values(lines)
    return found.groupBy("key", "value").agg(F.count(F.lit(1)).alias("reports"))


def _report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the written reports, split again."""
    return reports.split_reports(spark, _written_reports(spark, sf_dir), report_folders=True).select(
        F.col("extra")["Document"].cast("long").alias("doc_id"), "utterance", "expected", "matched", "result_type", "reject"
    )


def _corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts as corpus files, some for each label, and next to them a damaged one; read again."""
    path = fresh_folder(spark, "corpus-files")
    files.write_csv(views.corpus(spark, sf_dir).select("label", "text"), path, ["label"])
    broken = spark.range(1).coalesce(1).select(F.explode(F.array(F.lit("text"), F.lit('"never closed'))))
    broken.write.text(f"{path}/label={DAMAGED_LABEL}")
    return corpora.scan_folder(spark, path, "", label_folders=True)


def _model_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    stem = files.file_stem(F.col("path"))
    return (
        views.report_paths(spark, sf_dir)
        .select(
            reports.report_name(stem).alias("report"), files.model_name(stem).alias("model")
        )
        .groupBy("report", "model")
        .agg(F.count(F.lit(1)).alias("files"))
    )


def _perceptron(activation: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = views.table(spark, sf_dir, "lineitem")
    scored = scoring.perceptron(lines, scoring.linear(LINE_WEIGHTS, LINE_BIAS), activation)
    return rounded(scored.select("l_orderkey", "l_linenumber", "z", "y"))


def _activation_summary(emb: DataFrame) -> DataFrame:
    z = scoring.linear_vector(F.col("vec"), VECTOR_WEIGHTS, VECTOR_BIAS)
    return scoring.activation_summary(scoring.perceptron(emb, z, "tanh"), ["split", "label"])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["intent_metrics"](spark, sf_dir)


QUERIES: dict[str, Query] = {
    # Sources.
    "corpus_scan": _corpus(lambda c: c.where(F.col("text").isNotNull())),
    "report_metadata": _report_metadata,
    "report_rows": _report_rows,
    "report_preamble": _report_preamble,
    "corpus_files": _corpus_files,
    "json_round_trip": _json_round_trip,
    "csv_round_trip": _csv_round_trip,
    "model_name": _model_name,
    "point_preview": _corpus(lambda c: c.select("doc_id", preview(F.col("text")).alias("preview"))),
    # Intents.
    "intent_confusion": _batch(intent.confusion),
    "intent_display": _batch(intent.display_names),
    "intent_counts": _batch(
        lambda b: intent.counts(b).select("report", "intent", "display", "tp", "fp", "fn", "tn")
    ),
    "intent_metrics": _batch(lambda b: intent.metrics(b).drop("is_average")),
    "intent_order": _batch(lambda b: _numbered(intent.in_report_order(intent.metrics(b)), "intent")),
    # Entities.
    "entity_metrics": _ent(lambda e: entity.metrics(e).drop("is_average")),
    "entity_order": _ent(
        lambda e: _numbered(entity.metrics_in_report_order(entity.metrics(e)), "entity")
    ),
    "entity_breakdown_order": _ent(_numbered_breakdown),
    "entity_identification": _ent(entity.identification),
    "entity_engine_summary": _ent(lambda e: entity.engine_summary(entity.identification(e))),
    "entity_methods": _ent(lambda e: entity.methods(entity.identification(e))),
    "utterance_success": _ent(entity.utterance_success),
    # Text.
    "token_counts": _corpus(lexical.token_counts),
    "vocab_ttr": _corpus(lexical.vocabulary),
    "vocab_sketches": _corpus(_estimates),
    "ttr_split_diff": _corpus(lambda c: lexical.ratio_difference(lexical.vocabulary(c))),
    "label_union": _corpus(lexical.label_union),
    "label_intersect": _corpus(lexical.label_intersection),
    "length_histogram": _corpus(distribution.histogram),
    "length_stats": _lengths(distribution.length_stats),
    "length_kurtosis": _lengths(distribution.kurtosis),
    "length_emd": _lengths(distribution.earth_movers_distance),
    "length_js": _lengths(distribution.js_divergence),
    # Embeddings.
    "text_embed_hash": _corpus(_embedded),
    "centroids": _emb(_centroid_entries),
    "cohesion": _emb(semantic.cohesion),
    "cohesion_stats": _by_label(lambda e, c: semantic.cohesion_stats(e, c, BY_LABEL)),
    "cohesion_scaled": _by_label(_scaled),
    "centroid_pairs": _by_split(lambda e, c: semantic.centroid_pairs(c)),
    "similarity_edges": _by_split(lambda e, c: edges.similarity_edges(c, EDGE_THRESHOLD)),
    "centroid_cross_split": _emb(semantic.cross_split_similarity),
    "split_consistency": _emb(_ranked_consistency),
    "distinctiveness_cosine": _by_label(lambda e, c: semantic.similarity_matrix(c, "cosine")),
    "distinctiveness_euclidean": _by_label(lambda e, c: semantic.similarity_matrix(c, "euclidean")),
    "distinctiveness_rounded": _by_label(
        lambda e, c: semantic.rounded_matrix(semantic.similarity_matrix(c, "cosine"))
    ),
    "nearest_centroid": _by_label(nearest.nearest_centroid),
    "label_sample": _emb(
        lambda e: semantic.label_sample(e, SAMPLE_SIZE, seed=SAMPLE_SEED).drop("vec")
    ),
    "pca_projection": _by_label(_projected),
    "pca_ranges": _by_label(lambda e, c: projection.ranges(_projected(e, c))),
    "pca_explained_variance": _emb(lambda e: projection.explained_variance(e, projection.fit(e))),
    "centroid_shift": _by_split(projection.centroid_shift),
    "centroid_shift_points": _by_split(projection.shift_points),
    "centroid_plane": _by_label(lambda e, c: projection.centroid_plane(c)),
    # Scoring.
    **{f"perceptron_{name}": partial(_perceptron, name) for name in SCORED_ACTIVATIONS},
    "activation_summary": _emb(_activation_summary),
}
