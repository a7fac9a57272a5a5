import numpy as np
import pytest
from conftest import MEDIUM, rows
from pyspark.sql import functions as F

from utterscope.operators import edges, nearest, projection, semantic, sums
from utterscope.operators.quantiles import grouped_median, grouped_stats, ordered_key
from utterscope.plans import views
from utterscope.sources.intermediate import materialize

BY_LABEL = ("label",)
SCHEMA = "id long, split string, label string, vec array<float>"


def make(seed=0, n=60, d=5):
    draw = np.random.default_rng(seed)
    data = []
    for i in range(n):
        label = "abc"[i % 3]
        vec = draw.normal(size=d) + np.eye(d)[i % 3] * 2
        data.append((i, "test" if i % 4 == 0 else "train", label, [float(np.float32(v)) for v in vec]))
    data.append((n, "test", "a", [0.0] * d))
    data.append((n + 1, "train", "d", [1.0] + [0.0] * (d - 1)))
    data.append((n + 2, "test", "e", None))
    return data


DATA = make()
KEPT = [r for r in DATA if r[3] is not None]


def cosine(a, b):
    lengths = np.linalg.norm(a) * np.linalg.norm(b)
    return float(a @ b / lengths) if lengths > 0 else 0.0


def group(*keys):
    found = {}
    for r in KEPT:
        row = {"split": r[1], "label": r[2]}
        found.setdefault(tuple(row[k] for k in keys), []).append(np.array(r[3]))
    return {k: np.array(v) for k, v in found.items()}


@pytest.fixture(scope="module")
def emb(spark):
    return spark.createDataFrame(DATA, SCHEMA)


@pytest.fixture(scope="module")
def by_label(emb):
    return materialize(semantic.centroids(emb, BY_LABEL), "test")


@pytest.fixture(scope="module")
def by_split(emb):
    return materialize(semantic.centroids(emb), "test")


def test_centroids(by_split):
    expected = group("split", "label")
    got = {(r.split, r.label): r for r in by_split.collect()}
    assert set(got) == set(expected)
    for key, vectors in expected.items():
        assert got[key].centroid == pytest.approx(vectors.mean(axis=0).tolist())
        assert got[key].n == len(vectors)


@pytest.mark.parametrize("held", [1 << 20, 1])
def test_position_sums(spark, monkeypatch, held):
    monkeypatch.setattr(sums, "HELD_BYTES", held)
    data = [(k, m, [float(i), 0.0, -1.5 * i]) for i in range(5) for k in (None, "a", "b") for m in (None, 1, 2)]
    frame = spark.createDataFrame([*data, ("a", 1, None), ("a", 1, [])], "k string, m int, v array<double>").coalesce(2)
    for by in ([], ["m"], ["k", "m"]):
        got = {tuple(r[c] for c in [*by, "pos"]): (r.n, r.x, r.u) for r in sums.position_sums(frame, by, "v").collect()}
        expected = {}
        for k, m, v in data:
            length = np.linalg.norm(v) or 1.0
            for pos, x in enumerate(v):
                key = (*[{"k": k, "m": m}[c] for c in by], pos)
                n, a, b = expected.get(key, (0, 0.0, 0.0))
                expected[key] = (n + 1, a + x, b + x / length)
        assert got == {key: pytest.approx(v) for key, v in expected.items()}
    plan = semantic.cohesion(frame.withColumnsRenamed({"k": "split", "m": "label", "v": "vec"}))._jdf.queryExecution()
    assert plan.optimizedPlan().toString().count("Generate") == 1
    with pytest.raises(Exception, match="one length"):
        sums.position_sums(spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "v array<double>").coalesce(1), [], "v").collect()


def test_manifest_gives_null_centroid_and_cohesion(spark, emb):
    manifest = spark.createDataFrame(
        [("test", "a"), ("train", "a"), ("test", "d"), ("train", "d"), ("test", "none")],
        "split string, label string",
    )
    cents = {(r.split, r.label): (r.n, r.centroid) for r in semantic.centroids(emb, manifest=manifest).collect()}
    assert cents["test", "none"] == (0, None)
    assert len(cents) == 5
    cohesion = {(r.split, r.label): r.cohesion for r in semantic.cohesion(emb, manifest=manifest).collect()}
    assert cohesion["test", "none"] is None
    assert cohesion["train", "d"] == pytest.approx(1.0)
    cross = {r.label: r.cross_similarity for r in semantic.cross_split_similarity(emb, manifest=manifest).collect()}
    assert set(cross) == {"a", "d"} and cross["d"] is None
    table = materialize(semantic.centroids(emb, manifest=manifest), "test")
    pairs = {(r.split, r.label1, r.label2): r.similarity for r in semantic.centroid_pairs(table).collect()}
    assert pairs["test", "a", "none"] is None


def test_cohesion_and_its_spread(monkeypatch, emb, by_label):
    similar = {
        k[0]: np.array([cosine(v, vs.mean(axis=0)) for v in vs]) for k, vs in group("label").items()
    }
    mean = {r.label: r.cohesion for r in semantic.cohesion(emb, BY_LABEL).collect()}
    assert mean == {k: pytest.approx(v.mean()) for k, v in similar.items()}
    monkeypatch.setattr(semantic, "ROWS_PER_SALT", 7)
    for options in ({}, {"limit": 0}):
        for r in semantic.cohesion_stats(emb, by_label, BY_LABEL, **options).collect():
            v = similar[r.label]
            assert (r["mean"], r["median"], r["std"]) == pytest.approx(
                (v.mean(), np.median(v), v.std())
            )


@pytest.mark.parametrize("values", [[0.5], [0.1, 0.9], [0.3] * 7, [-1.0, 1.0, 1.0], [2.5, -3.0, 0.0, 0.1]])
def test_grouped_median(spark, values):
    frame = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    for ranked in (0, 1 << 16):
        got = grouped_stats(frame, ["g"], "v", ranked).first()
        assert got["median"] == np.median(values)
        assert (got["mean"], got["std"]) == pytest.approx((np.mean(values), np.std(values)))


def test_grouped_median_random(spark):
    draw = np.random.default_rng(3)
    data = [(g, float(np.round(v, 2))) for g in "ab" for v in draw.normal(scale=0.4, size=301)]
    frame = spark.createDataFrame(data, "g string, v double")
    got = dict(rows(grouped_median(frame, ["g"], "v", 20)))
    for g in "ab":
        assert got[g] == pytest.approx(np.median([v for h, v in data if h == g]))


def test_scaling(spark, emb, by_label):
    similarity = materialize(semantic.row_similarity(emb, by_label, BY_LABEL), "test")
    scaled = semantic.scaled_similarity(similarity).collect()
    raw = np.array([r.similarity for r in scaled])
    expected = (raw - raw.min()) / (raw.max() - raw.min())
    assert [r.scaled for r in scaled] == pytest.approx(expected.tolist())
    flat = spark.createDataFrame([(1, "a", 0.4), (2, "a", 0.4)], "id int, label string, similarity double")
    assert [r.scaled for r in semantic.scaled_similarity(flat).collect()] == [0.4, 0.4]


@pytest.mark.parametrize("block", [256, 1])
def test_pairs_and_edges(monkeypatch, by_split, block):
    monkeypatch.setattr(semantic, "PAIR_BLOCK", block)
    means = {k: v.mean(axis=0) for k, v in group("split", "label").items()}
    expected = {
        (s, a, b): pytest.approx(cosine(means[s, a], means[s, b]))
        for (s, a) in means
        for (t, b) in means
        if s == t and a < b
    }
    got = {(r.split, r.label1, r.label2): r.similarity for r in semantic.centroid_pairs(by_split).collect()}
    assert got == expected
    for threshold in (0.1, -0.2):
        found = edges.similarity_edges(by_split, threshold, block=block).collect()
        assert {(r.split, r.label1, r.label2) for r in found} == {k for k, v in got.items() if v >= threshold}


def test_high_thresholds_compute_fewer_pairs(spark):
    draw = np.random.default_rng(7)
    middles = draw.normal(size=(12, 10))
    vectors = np.vstack([middles[i % 12] + draw.normal(scale=0.15, size=10) for i in range(240)] + [np.zeros(10)])
    data = [(i % 2, i, v.tolist()) for i, v in enumerate(vectors)]
    cents = materialize(spark.createDataFrame(data, "split int, label int, centroid array<double>"), "test")
    units = vectors / np.maximum(np.linalg.norm(vectors, axis=1), 1e-300)[:, None]
    cosines = units @ units.T
    counted = []
    for threshold in (0.2, 0.6, 0.9, 0.97):
        expected = {(i, j) for i in range(241) for j in range(i + 2, 241, 2) if cosines[i, j] >= threshold}
        found = edges.similarity_edges(cents, threshold, block=10).collect()
        assert {(r.label1, r.label2) for r in found} == expected and len(found) == len(expected)
        counted.append(edges.candidate_pairs(cents, threshold, ["split"], block=10).count())
    assert counted == sorted(counted, reverse=True) and counted[-1] < 120 * 119 / 2
    assert edges.similarity_edges(cents.limit(0), 0.5).count() == 0


@pytest.mark.parametrize("metric", semantic.METRICS)
@pytest.mark.parametrize("block", [256, 2])
def test_matrix(monkeypatch, by_label, metric, block):
    monkeypatch.setattr(semantic, "PAIR_BLOCK", block)
    means = {k[0]: v.mean(axis=0) for k, v in group("label").items()}
    measure = cosine if metric == "cosine" else lambda a, b: 1 / (1 + np.linalg.norm(a - b))
    matrix = semantic.similarity_matrix(by_label, metric)
    got = {(r.label1, r.label2): r.similarity for r in matrix.collect()}
    assert got == {(a, b): pytest.approx(measure(means[a], means[b])) for a in means for b in means}
    wide = semantic.matrix_wide(matrix, sorted(means))
    assert wide.columns == ["label1", *sorted(means)]
    assert wide.where("label1 = 'a'").first()["b"] == got["a", "b"]
    rounded = semantic.rounded_matrix(matrix).where("label1 = 'a' and label2 = 'b'").first()
    assert rounded.similarity == round(got["a", "b"], 2)


def test_matrix_errors(by_label):
    with pytest.raises(ValueError):
        semantic.similarity_matrix(by_label, "manhattan")
    with pytest.raises(ValueError):
        semantic.similarity_matrix(by_label.where("label = 'a'"))


def test_cross_split_and_consistency(emb):
    means = {k: v.mean(axis=0) for k, v in group("split", "label").items()}
    both = [label for label in "abc"]
    expected = {
        label: pytest.approx(cosine(means["train", label], means["test", label])) for label in both
    }
    cross = {r.label: r.cross_similarity for r in semantic.cross_split_similarity(emb).collect()}
    assert cross == expected
    ordered = semantic.most_consistent_first(semantic.split_consistency(emb)).collect()
    assert {r.label: r.similarity for r in ordered} == expected
    assert [r.consistency for r in ordered] == sorted((r.similarity for r in ordered), reverse=True)


def test_consistency_skips_zero_vectors(spark):
    data = [(1, "train", "z", [0.0, 0.0]), (2, "test", "z", [1.0, 0.0]),
            (3, "train", "y", [1.0, 1.0]), (4, "test", "y", [1.0, 0.0])]
    frame = spark.createDataFrame(data, SCHEMA)
    assert [r[0] for r in rows(semantic.split_consistency(frame))] == ["y"]
    assert dict(rows(semantic.cross_split_similarity(frame)))["z"] == 0.0


@pytest.mark.parametrize(
    "data, reason",
    [
        ([], "no label occurs in both splits"),
        ([(1, "train", "z", [1.0, 0.0]), (2, "test", "y", [1.0, 0.0])], "no label occurs in both splits"),
        ([(1, "train", "z", [0.0, 0.0]), (2, "test", "z", [1.0, 0.0])], "no label has a usable similarity"),
    ],
)
def test_consistency_fails_where_nothing_is_left(spark, data, reason):
    with pytest.raises(Exception, match=reason):
        semantic.split_consistency(spark.createDataFrame(data, SCHEMA)).collect()


@pytest.mark.parametrize("limit", [64 << 20, 600, 1])
def test_nearest_centroid(emb, by_label, limit):
    means = {k[0]: v.mean(axis=0) for k, v in group("label").items()}
    got = {r.id: r for r in nearest.nearest_centroid(emb, by_label, limit).collect()}
    assert len(got) == len(KEPT)
    for r in KEPT:
        distances = {label: 1 - cosine(np.array(r[3]), c) for label, c in means.items()}
        assert got[r[0]].distance == pytest.approx(min(distances.values()))
        assert distances[got[r[0]].nearest] == pytest.approx(min(distances.values()))
    # The zero vector is equally far from all centroids: the smallest label wins.
    assert got[60].nearest == "a"


@pytest.mark.parametrize("limit", [64 << 20, 1])
def test_nearest_centroid_edge_cases(spark, by_label, limit):
    data = [(1, "train", "a", [1.0, 0.0]), (1, "train", "a", [1.0, 0.0]), (1, "test", None, [1.0, 0.0]),
            (2, "test", "b", [1.0, 1.0]), (3, "test", "b", [float("nan"), 1.0]), (4, "test", "b", None)]
    emb = spark.createDataFrame(data, SCHEMA)
    cents = spark.createDataFrame([("y", [0.0, 2.0]), ("x", [3.0, 0.0]), ("z", None)], "label string, centroid array<double>")
    got = rows(nearest.nearest_centroid(emb, cents, limit).select("id", "nearest"), "id")
    assert [tuple(r) for r in got] == [(1, "x")] * 3 + [(2, "x"), (3, None)]
    empty = nearest.nearest_centroid(emb, cents.limit(0), limit).collect()
    assert len(empty) == 5 and {(r.nearest, r.distance) for r in empty} == {(None, None)}


def test_nearest_of_very_many_centroids(spark):
    n = 100_000
    angle = F.col("id") * (6.0 / n)
    cents = spark.range(n).select(F.col("id").alias("label"), F.array(F.cos(angle), F.sin(angle)).alias("centroid"))
    emb = spark.range(0, n, 997).select("id", F.lit(0).alias("label"), F.array(F.cos(angle), F.sin(angle)).alias("vec"))
    got = nearest.nearest_centroid(emb, cents, 4 << 20)
    # Next to each other, centroids differ by 2e-9 in distance.
    assert got.where("nearest <> id").count() == 0 and got.count() == 101


@pytest.mark.parametrize("limit", [1 << 25, 20_000, 3000])
def test_nearest_matches_all_products(spark, limit):
    draw = np.random.default_rng(2)
    cents = np.round(draw.normal(size=(150, 6)) * draw.choice([0.1, 1, 30], (150, 1)), 3)
    cents[[7, 90]] = 0.0
    cents[33], cents[120] = cents[12], 2 * cents[12]
    vectors = np.vstack([draw.normal(size=(300, 6)), cents[:40], np.zeros((2, 6)), -cents[:3]])
    table = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(cents)], "label int, centroid array<double>")
    emb = spark.createDataFrame([(i, "x", v.tolist()) for i, v in enumerate(vectors)], "id long, label string, vec array<double>")
    got = {r.id: (r.nearest, r.distance) for r in nearest.nearest_centroid(emb, table, limit).collect()}
    lengths = np.linalg.norm(cents, axis=1)
    units = cents / np.where(lengths == 0, 1, lengths)[:, None]
    for i, v in enumerate(vectors):
        distances = 1 - units @ (v / (np.linalg.norm(v) or 1.0))
        assert got[i] == (np.flatnonzero(distances <= distances.min() + 1e-12)[0], pytest.approx(distances.min(), abs=1e-12))
    only_zero = table.where("label in (7, 90)")
    assert {(r.nearest, r.distance) for r in nearest.nearest_centroid(emb, only_zero, 1).collect()} == {(7, 1.0)}


def test_null_labels_and_nan_in_statistics(spark):
    data = [(i, "train", None if i < 3 else "a", [1.0, float(i)]) for i in range(6)]
    emb = spark.createDataFrame(data, SCHEMA)
    cents = materialize(semantic.centroids(emb, BY_LABEL), "test")
    stats = {r.label: r for r in semantic.cohesion_stats(emb, cents, BY_LABEL).collect()}
    means = {r.label: r.cohesion for r in semantic.cohesion(emb, BY_LABEL).collect()}
    assert {k: pytest.approx(v.mean) for k, v in stats.items()} == means and set(means) == {None, "a"}
    frame = spark.createDataFrame([("g", v) for v in (0.1, 0.5, float("nan"))], "g string, v double")
    for ranked in (0, 1 << 16):
        assert grouped_median(frame, ["g"], "v", ranked).first()["median"] == 0.5


def test_median_of_a_crowded_cell(spark):
    # All values share their first 48 bits, and half of them are one value.
    base = np.float64(0.7).view(np.int64)
    values = [float(np.int64(base + (i * 7919) % 5000).view(np.float64)) for i in range(3001)] + [0.7] * 2999
    frame = spark.createDataFrame([(k, v) for v in values for k in (None, "g")], "g string, v double")
    got = grouped_stats(frame.repartition(3), ["g"], "v", ranked=100)
    assert {r.g: r.median for r in got.collect()} == dict.fromkeys((None, "g"), float(np.median(values)))


def test_keys_are_ordered_as_the_values(spark):
    draw = np.random.default_rng(8)
    some = draw.integers(-(2**63), 2**63, 4000).view(np.float64)
    powers = [s * 2.0**e * f for e in range(-1074, 1024, 7) for f in (1.0, 1 + 2**-52, 1.5, 2 - 2**-52) for s in (1, -1)]
    values = [*some[~np.isnan(some)].tolist(), *powers, 0.0, -0.0, 5e-324, -5e-324, 1.7976931348623157e308, np.inf, -np.inf]
    values += np.nextafter(2.0 ** np.arange(-1022.0, 1024), 0).tolist()
    frame = spark.createDataFrame([(float(v),) for v in values], "v double")
    keys = dict(frame.select("v", ordered_key(F.col("v"))).collect())
    distinct = sorted(set(values))
    assert all(keys[a] < keys[b] for a, b in zip(distinct, distinct[1:]))
    assert spark.range(1).select(ordered_key(F.lit(float("nan")))).first()[0] > keys[np.inf]


def test_label_sample(emb):
    first = rows(semantic.label_sample(emb, 3).drop("vec"), "id")
    again = rows(semantic.label_sample(emb.repartition(5), 3).drop("vec"), "id")
    other = rows(semantic.label_sample(emb, 3, seed=1).drop("vec"), "id")
    plan = semantic.label_sample(emb, 3)._jdf.queryExecution().executedPlan().toString()
    assert "vec" in plan and "Sort" not in plan and "Exchange hash" not in plan
    assert first == again != other
    sizes = {}
    for _, split, label, _ in first:
        sizes[split, label] = sizes.get((split, label), 0) + 1
    assert set(sizes.values()) <= {1, 3} and sizes["train", "a"] == 3 and sizes["train", "d"] == 1


def test_projection_keeps_variance_and_centroids(spark):
    emb = views.emb(spark, MEDIUM)
    cents = materialize(semantic.centroids(emb, BY_LABEL), "test")
    plane = projection.fit(emb)
    shortcut = projection.fit(emb, cents=cents)
    assert shortcut.offsets == pytest.approx(plane.offsets)
    assert np.array(shortcut.loadings) == pytest.approx(np.array(plane.loadings))
    followed = projection.fit(emb, block=24)
    assert np.array(followed.loadings) == pytest.approx(np.array(plane.loadings), abs=1e-9)
    assert followed.explained == pytest.approx(plane.explained)
    matrix = np.array([r.vec for r in emb.select("vec").collect()], dtype=np.float64)
    values = np.linalg.eigvalsh(np.cov(matrix.T))[::-1]
    assert plane.explained == pytest.approx((values[:2] / values.sum()).tolist())
    points = projection.project(emb, cents, plane)
    spread = points.agg(F.avg("x"), F.avg("y"), F.var_samp("x"), F.var_samp("y"), F.corr("x", "y")).first()
    assert list(spread) == pytest.approx([0, 0, values[0], values[1], 0], abs=1e-9)
    own = points.groupBy("label").agg(
        F.avg("x").alias("x"), F.avg("y").alias("y"),
        F.first("centroid_x").alias("cx"), F.first("centroid_y").alias("cy"),
    )
    for r in own.collect():
        assert (r.x, r.y) == pytest.approx((r.cx, r.cy), abs=1e-9)
    for loading in plane.loadings:
        assert max(loading, key=abs) > 0
    ranges = {r.label: r for r in projection.ranges(points).collect()}
    assert len(ranges) == 10 and all(r.x_min <= r.x_max for r in ranges.values())
    assert projection.explained_variance(emb, plane).count() == 2


def test_centroid_shift(spark, emb, by_split):
    shifts = {r.label: r for r in projection.centroid_shift(emb, by_split).collect()}
    assert set(shifts) == {"a", "b", "c"}
    means = {k: v.mean(axis=0) for k, v in group("split", "label").items()}
    for label, r in shifts.items():
        assert r.shift == pytest.approx(np.hypot(r.x2 - r.x1, r.y2 - r.y1))
        full = np.linalg.norm(means["train", label] - means["test", label])
        assert r.shift <= full + 1e-9
    with pytest.raises(ValueError):
        projection.centroid_shift(emb, by_split.where("split = 'train'"))
    points = projection.shift_points(emb, by_split)
    for r in points.groupBy("split", "label").agg(F.avg("x").alias("x"), F.avg("y").alias("y")).collect():
        end = ("x1", "y1") if r.split == "train" else ("x2", "y2")
        assert (r.x, r.y) == pytest.approx([shifts[r.label][c] for c in end], abs=1e-9)
    assert points.where("label in ('d', 'e')").count() == 0


def test_plane_of_long_vectors(spark):
    # More dimensions than directions, and than rows.
    draw = np.random.default_rng(4)
    rows_ = draw.normal(size=(120, 300)) + np.outer(draw.normal(size=120) * 6, draw.normal(size=300))
    rows_ += np.outer(draw.normal(size=120) * 3, draw.normal(size=300)) + 5
    frame = spark.createDataFrame([(v.tolist(),) for v in rows_], "vec array<double>").repartition(3)
    plane = projection.fit(frame, block=8)
    _, values, axes = np.linalg.svd(rows_ - rows_.mean(axis=0), full_matrices=False)
    for found, axis in zip(plane.loadings, axes):
        assert abs(np.dot(found, axis)) == pytest.approx(1.0, abs=1e-10)
    assert plane.explained == pytest.approx((values[:2] ** 2 / (values**2).sum()).tolist())
    with pytest.raises(ValueError):
        projection.fit(spark.createDataFrame([([1.0],)], "vec array<double>"))


def test_centroid_plane(spark, by_label):
    got = projection.centroid_plane(by_label).collect()
    means = {k[0]: v.mean(axis=0) for k, v in group("label").items()}
    centred = np.array([means[r.label] for r in got]) - np.mean(list(means.values()), axis=0)
    values = np.linalg.svd(centred, compute_uv=False)
    assert sorted(np.linalg.svd(np.array([[r.x, r.y] for r in got]), compute_uv=False)) == pytest.approx(sorted(values[:2]))
