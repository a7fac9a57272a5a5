import hashlib
import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import MEDIUM, rows

from utterscope.operators import distribution, encoding, lexical
from utterscope.plans import views

SCHEMA = "split string, label string, text string"

DATA = [
    ("test", "fees", "¿Qué comisión, comisión?"),
    ("test", "fees", "la comisión"),
    ("test", "fees", "!!!"),
    ("train", "fees", "comisión de la cuenta"),
    ("train", "fees", None),
    ("test", "only", "hola hola"),
    ("train", "mute", "?"),
]


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame(DATA, SCHEMA)


def test_vocabulary(spark, data):
    assert rows(lexical.vocabulary(data), "split", "label") == [
        ("test", "fees", 3, 5, 0.6),
        ("test", "only", 1, 2, 0.5),
        ("train", "fees", 4, 4, 1.0),
        ("train", "mute", 0, 0, 0.0),
    ]


def test_manifest_keeps_empty_files(spark, data):
    manifest = spark.createDataFrame([("test", "fees"), ("test", "blank")], "split string, label string")
    vocab = {(r[0], r[1]): r[2:] for r in rows(lexical.vocabulary(data, manifest))}
    assert vocab["test", "blank"] == (0, 0, 0.0)
    assert vocab["test", "fees"] == (3, 5, 0.6)


def test_ratio_difference_needs_both_splits(data):
    got = rows(lexical.ratio_difference(lexical.vocabulary(data)))
    assert got == [("fees", 0.6, 1.0, pytest.approx(0.4))]


def test_label_sets(data):
    assert rows(lexical.label_union(data)) == [("fees",), ("mute",), ("only",)]
    assert rows(lexical.label_intersection(data)) == [("fees",)]


def test_histogram(data):
    got = rows(distribution.histogram(data).where("label = 'fees'"))
    assert got == [
        ("fees", "sentence", 0, 1, 0),
        ("fees", "sentence", 2, 1, 0),
        ("fees", "sentence", 3, 1, 0),
        ("fees", "sentence", 4, 0, 1),
        ("fees", "word", 2, 1, 2),
        ("fees", "word", 3, 1, 0),
        ("fees", "word", 6, 0, 1),
        ("fees", "word", 8, 3, 1),
    ]


def hist(spark, test, train, label="x"):
    found = [
        (label, kind, x, Counter(test)[x], Counter(train)[x])
        for kind in ("sentence", "word")
        for x in set(test) | set(train)
    ]
    return spark.createDataFrame(found, "label string, kind string, x int, n_test long, n_train long")


def naive_kurtosis(values):
    n = len(values)
    mean = sum(values) / n
    m2 = sum((v - mean) ** 2 for v in values) / n
    m4 = sum((v - mean) ** 4 for v in values) / n
    return None if n <= 3 or m2 == 0 else m4 / m2**2 - 3


def naive_emd(a, b):
    points = sorted(set(a) | set(b))
    total = 0.0
    for x, following in zip(points, points[1:]):
        gap = sum(v <= x for v in a) / len(a) - sum(v <= x for v in b) / len(b)
        total += abs(gap) * (following - x)
    return total


def naive_js(a, b):
    points, eps = sorted(set(a) | set(b)), 1e-9
    p = [(a.count(x) + eps) / (len(a) + eps * len(points)) for x in points]
    q = [(b.count(x) + eps) / (len(b) + eps * len(points)) for x in points]
    return sum(
        0.5 * s * math.log(s / (0.5 * (s + t))) + 0.5 * t * math.log(t / (0.5 * (s + t)))
        for s, t in zip(p, q)
    )


@pytest.mark.parametrize("seed", range(4))
def test_measures_match_their_definitions(spark, seed):
    draw = random.Random(seed)
    a = [draw.randint(0, 12) for _ in range(40 + seed)]
    b = [draw.randint(3, 20) for _ in range(25)]
    frame = hist(spark, a, b)
    kurt = distribution.kurtosis(frame).first()
    assert kurt["test_word_length_kurtosis"] == pytest.approx(naive_kurtosis(a))
    assert kurt["train_sentence_length_kurtosis"] == pytest.approx(naive_kurtosis(b))
    forward = distribution.divergences(frame).first()
    backward = distribution.divergences(hist(spark, b, a)).first()
    assert forward["emd"] == pytest.approx(naive_emd(a, b))
    assert forward["js"] == pytest.approx(naive_js(a, b))
    assert backward["emd"] == pytest.approx(forward["emd"])
    assert backward["js"] == pytest.approx(forward["js"])


def test_identical_and_disjoint_distributions(spark):
    same = distribution.divergences(hist(spark, [1, 2, 2], [1, 2, 2])).first()
    assert (same["emd"], same["js"]) == (0.0, 0.0)
    single = distribution.divergences(hist(spark, [4, 4], [4])).first()
    assert (single["emd"], single["js"]) == (0.0, 0.0)
    apart = distribution.divergences(hist(spark, [1, 1], [5])).first()
    assert apart["emd"] == 4.0
    assert apart["js"] == pytest.approx(math.log(2), abs=1e-6)


def test_kurtosis_needs_four_different_values(spark):
    assert distribution.kurtosis(hist(spark, [1, 2, 3], [5, 5, 5, 5])).first()[1:] == (None,) * 4


def test_labels_of_one_split(spark, data):
    built = distribution.histogram(data)
    assert [r[0] for r in rows(distribution.earth_movers_distance(built))] == ["fees"]
    assert [r[0] for r in rows(distribution.js_divergence(built))] == ["fees"]
    assert [r[0] for r in rows(distribution.kurtosis(built))] == ["fees", "mute", "only"]


def test_results_do_not_depend_on_partitions(spark):
    corpus = views.corpus(spark, MEDIUM)
    one = rows(distribution.histogram(corpus.coalesce(1)))
    many = rows(distribution.histogram(corpus.repartition(7)))
    assert one == many


def test_document_table(spark):
    corpus = views.corpus(spark, MEDIUM)
    found = {r.label: r for r in distribution.earth_movers_distance(distribution.histogram(corpus)).collect()}
    assert found["de"]["emd_sentence_length"] == pytest.approx(63.352381, abs=1e-6)
    assert found["de"]["emd_word_length"] == pytest.approx(0.040014, abs=1e-6)
    tokens = lexical.vocabulary(corpus).groupBy("label").sum("token_count")
    assert dict(rows(tokens)) == {"de": 50148, "en": 237020, "es": 40028, "fr": 58155}


def test_signed_hashing(spark):
    texts = [(1, "a b a"), (2, "b c"), (3, ""), (4, None), (5, "!!")]
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(2)
    vectors = {r.doc_id: np.array(r.vec) for r in encoding.hashed_tfidf(frame, 7).collect()}
    assert set(vectors) == {1, 2, 3, 5}

    def place(term):
        digest = hashlib.md5(term.encode()).hexdigest()
        return int(digest[:8], 16) % 7, 1 - 2 * (int(digest[8], 16) % 2)

    held = {}
    for _, text in texts:
        for pos in {place(t)[0] for t in (text or "").replace("!", "").split()}:
            held[pos] = held.get(pos, 0) + 1
    for i, text in texts[:3]:
        expected = np.zeros(7)
        for term in text.split():
            pos, sign = place(term)
            expected[pos] += sign * math.log(5 / (held[pos] + 1))
        assert vectors[i] == pytest.approx(expected, rel=1e-6)
    assert encoding.hashed_tfidf(frame.limit(0)).collect() == []


def test_hashing_holds_little_of_a_large_batch():
    texts = [["a", f"w{i % 50}"] * 500 for i in range(1000)] + [["a"] * (encoding.AT_ONCE + 5), []]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "terms"])
    tracemalloc.start()
    parts = list(encoding._counts(16)([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 * 2**20  # 88 MB for all terms in one go
    got = pa.Table.from_batches(parts).to_pylist()
    assert [r["doc_id"] for r in got] == list(range(len(texts)))

    def place(term):
        digest = hashlib.md5(term.encode()).hexdigest()
        return int(digest[:8], 16) % 16, 1 - 2 * (int(digest[8], 16) % 2)

    for text, row in zip(texts, got):
        sums = {}
        for term in set(text):
            pos, sign = place(term)
            sums[pos] = sums.get(pos, 0) + sign * text.count(term)
        assert dict(zip(row["positions"], row["counts"])) == sums


def test_hashing_takes_texts_in_small_batches(spark, monkeypatch):
    plain, limit = encoding._counts, encoding.BATCH_TEXTS

    def counts(dimensions):
        task = plain(dimensions)

        def limited(batches):
            for batch in batches:
                assert batch.num_rows <= limit
                yield from task([batch])

        return limited

    monkeypatch.setattr(encoding, "_counts", counts)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    frame = spark.range(0, 2 * limit + 1, 1, 1).selectExpr("id as doc_id", "concat('a w', id) as text")
    assert encoding.hashed_tfidf(frame).count() == 2 * limit + 1
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_stored_sketches_unite(spark, tmp_path):
    def part(first, last, label):
        return [("train", label, " ".join(f"w{i}" for i in range(first, last)))]

    days = [part(0, 3000, "a") + part(0, 10, "b"), part(2000, 6000, "a") + [("test", "a", None), ("test", "c", "!")]]
    for i, day in enumerate(days):
        lexical.vocabulary_sketches(spark.createDataFrame(day, SCHEMA)).write.parquet(str(tmp_path / str(i)))
    stored = spark.read.parquet(*(str(tmp_path / str(i)) for i in range(2)))
    got = {(r.split, r.label): r for r in lexical.estimated_vocabulary(stored).collect()}
    assert got["train", "a"].token_count == 7000
    assert got["train", "a"].vocab_size == pytest.approx(6000, rel=0.035)
    assert (got["train", "b"].vocab_size, got["test", "c"].vocab_size) == (10, 0)
    assert got["test", "c"].type_token_ratio == 0.0 and set(got) == {("train", "a"), ("train", "b"), ("test", "c")}
    whole = lexical.estimated_vocabulary(stored, []).first()
    assert whole.vocab_size == pytest.approx(6000, rel=0.035)
