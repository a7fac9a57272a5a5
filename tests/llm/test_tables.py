"""Exact and line dedup, archive, mixing, packing, vectors, toxicity and the pipeline."""

import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from check import TABLES, normal
from utterscope.llm.exact_dedup import exact_dedup, rice_decode, rice_encode
from utterscope.llm.line_dedup import dedup_lines
from utterscope.llm.mixing import mix, mixed_documents
from utterscope.llm.packing import ShardBins, pack
from utterscope.llm.queries import ORACLE, QUERIES
from utterscope.llm.toxicity import score_documents
from utterscope.llm.vector_dedup import vector_dedup
from utterscope.llm.warc import Archive, read_archive, round_trip, write_archive

DOCUMENT = "doc_id long, text string, source string, row int, hash string, key string"


def frame(spark, rows):
    """Documents with extra columns whose names clash with internal ones."""
    return spark.createDataFrame([(i, t, s, 0, "h", "k") for i, t, s in rows], DOCUMENT)


ODD = [
    (1, None, "a"), (2, "", None), (3, "one\ntwo", "a"), (3, "one\ntwo", "a"), (None, "one\ntwo", "b"), (None, None, None),
    (4, "x " * 30000, "b"), (5, " \t", "c"), (6, "x " * 30000, "b"),
]


@pytest.mark.parametrize("name", list(ORACLE))
def test_queries_match_sql(spark, name):
    duck = duckdb.connect()
    for table in TABLES:
        duck.execute(f"create view {table} as select * from '{SMALL}/{table}.parquet'")
    result = duck.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    got = QUERIES[name](spark, SMALL)
    assert sorted(names) == sorted(got.columns)
    assert normal([tuple(r) for r in got.collect()], got.columns) == normal(result.fetchall(), names)


def test_rice_codes_round_trip():
    draw = np.random.default_rng(1)
    for n, top in ((1, 5), (3, 3), (1000, 10**6), (5000, 2**40)):
        values = np.unique(draw.integers(0, top, n))
        rest, unary, remainders = rice_encode(values, 0)
        assert (rice_decode(len(values), rest, unary, remainders, 0) == values).all()


def test_exact_dedup_odd_rows(spark):
    got = exact_dedup(frame(spark, ODD), spare_bits=0, per_owner=2).collect()
    assert len(got) == len(ODD)
    by_text = defaultdict(list)
    for r in got:
        by_text[r.text_sha256].append(r)
    assert sorted(len(v) for v in by_text.values()) == [1, 2, 3, 3]
    for same in by_text.values():
        ids = [r.doc_id for r in same if r.doc_id is not None]
        assert {r.keep_id for r in same} == {max(ids)} and {r.group_size for r in same} == {len(same)}
        assert sum(r.kept for r in same) == 1
    assert exact_dedup(frame(spark, [])).count() == 0


def test_line_dedup_odd_rows(spark):
    line = "A line of more than twenty characters"
    rows = [(1, f"{line}\nrest", "a"), (2, f"  {line.upper()}\t\n{line}", "a"), (3, line, "a"), (None, line, "a"), (9, None, "a")]
    got = {r.doc_id: r for r in dedup_lines(frame(spark, [*rows, rows[0]])).collect()}
    assert got[1].kept_text == "rest" and got[2].kept_text == "" and got[3].kept_text == line
    assert got[None].n_dropped == 1 and (got[9].n_lines, got[9].kept_text) == (1, "")
    many = [(i, "\n".join([f"own {i} {'x' * 20}", line] * 100), "a") for i in range(4)]
    got = {r.doc_id: r for r in dedup_lines(frame(spark, many)).collect()}
    assert [got[i].n_dropped for i in range(4)] == [100, 100, 100, 0] and line not in got[0].kept_text
    assert dedup_lines(frame(spark, [])).count() == 0


def test_archive_round_trip(spark):
    big = "é" * 600
    pages = [(1, "u1", big), (2, "u2", big), (3, None, "small"), (4, "a\r\nb", "small"), (None, "u", big), (5, "u", None), (2, "u2", big)]
    data = spark.createDataFrame([(*p, b"x") for p in pages], "page_id long, url string, html string, payload binary")
    got = round_trip(data).collect()
    assert len(got) == len(pages)
    for r in got:
        record = bytes(r.record)
        header, _, body = record.partition(b"\r\n\r\n")
        length = int(header.rpartition(b"Content-Length: ")[2])
        assert body.endswith(b"\r\n\r\n") and len(body) == length + 4
        if r.record_type == "response":
            assert record.endswith(bytes(r.payload) + b"\r\n\r\n")
    ids = {re.search(rb"WARC-Record-ID: (\S+)", bytes(r.record))[1]: r for r in got}
    assert len(ids) == len(pages)
    for r in got:
        if r.record_type == "revisit":
            other = ids[re.search(rb"WARC-Refers-To: (\S+)", bytes(r.record))[1]]
            assert (other.page_id, other.record_type) == (r.refers_to, "response")
    kinds = Counter((r.page_id, r.record_type, r.refers_to) for r in got)
    assert kinds == {
        (1, "revisit", 2): 1, (2, "response", None): 1, (2, "revisit", 2): 1, (None, "revisit", 2): 1,
        (3, "response", None): 1, (4, "response", None): 1, (5, "response", None): 1,
    }
    assert round_trip(data.limit(0)).count() == 0


def test_a_wrong_length_stops_the_reading(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ok")], "page_id long, url string, html string")
    archive = write_archive(pages, str(tmp_path))
    records = [(bytes(r.header), bytes(r.address)) for r in spark.read.parquet(archive.records).collect()]
    assert read_archive(spark, archive).count() == 1
    changed = [(header.replace(b"msgtype=response\r\nContent-Length: ", b"msgtype=response\r\nContent-Length: 1"), a) for header, a in records]
    assert changed != records
    spark.createDataFrame(changed, "header binary, address binary").write.parquet(str(tmp_path / "wrong"))
    with pytest.raises(Exception, match="missing or damaged"):
        read_archive(spark, Archive(str(tmp_path / "wrong"), archive.payloads)).collect()


def test_mix_odd_rows(spark):
    schedule, stream = mix(frame(spark, ODD), rows_per_range=2, copies_per_partition=2)
    got = schedule.collect()
    assert len(got) == len(ODD) and all(r.taken in (0, r.size, 2 * r.size, 3 * r.size) for r in got)
    assert sorted(tuple(r) for r in stream.collect()) == sorted(tuple(r) for r in mix(frame(spark, ODD), rows_per_range=2)[1].collect())
    copies = mixed_documents(frame(spark, ODD))
    assert copies.columns == frame(spark, ODD).columns
    assert mix(frame(spark, []))[0].count() == 0
    assert mix(frame(spark, [(1, None, None)]))[0].collect()[0].taken == 0


def test_mix_meets_targets(spark):
    got = QUERIES["op10_source_mix"](spark, "/root/testdata/sf0.01").collect()
    sums = defaultdict(lambda: [0, 0, 0.0, 0])
    for r in got:
        s = sums[r.source]
        s[0], s[1], s[2], s[3] = s[0] + r.size, s[1] + r.taken, r.target, max(s[3], r.size)
        assert r.taken <= 3 * r.size
    total = sum(s[0] for s in sums.values())
    limits = {k: 3.0 * s[0] for k, s in sums.items()}
    weights = {k: (5, 2, 1)[i % 3] for i, k in enumerate(sorted(sums))}
    targets, fixed = {}, set()
    while True:
        left = total - sum(limits[k] for k in fixed)
        free = sum(w for k, w in weights.items() if k not in fixed)
        targets = {k: limits[k] if k in fixed else left * w / free for k, w in weights.items()}
        over = {k for k in targets if targets[k] > limits[k]}
        if not over:
            break
        fixed |= over
    for k, (size, taken, target, largest) in sums.items():
        assert math.isclose(target, targets[k], rel_tol=1e-9)
        assert abs(taken - target) <= largest


def test_packing_rules(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "source")
    rows = [tuple(r) for r in docs.collect()] + [(10**6 + i, "same text again", "a") for i in range(150)]
    rows += [(i if i is None else 2 * 10**6 + i, t, s) for i, t, s in ODD]
    data = frame(spark, rows)
    got = pack(data, rows_per_shard=128).collect()
    words = Counter()
    bins = defaultdict(list)
    source = {i: s for i, _, s in rows}
    text = {i: " ".join((t or "").lower().split()) for i, t, _ in rows}
    for r in got:
        words[r.doc_id] += r.words
        bins[r.bin].append(r)
    expected = Counter()
    for i, t, _ in rows:
        expected[i] += len((t or "").split())
    assert words == expected
    for pieces in bins.values():
        known = [p for p in pieces if p.doc_id is not None]
        assert sum(p.words for p in pieces) == pieces[0].filled <= 2048
        assert max(Counter(source[p.doc_id] for p in known).values(), default=0) <= 4
        assert max(Counter(text[p.doc_id] for p in known).values(), default=0) <= 1
    assert pack(frame(spark, [])).count() == 0


def test_a_piece_goes_to_the_tightest_compatible_bin():
    draw = random.Random(3)
    for trial in range(40):
        sources, clusters, capacity, per_source = draw.choice([1, 3, 70]), draw.choice([1, 5, 130]), 100, draw.choice([1, 2, 4])
        pieces = [(draw.randrange(101), draw.randrange(sources), draw.randrange(-1, clusters)) for _ in range(200)]
        bins = ShardBins(capacity, per_source, sources, clusters, len(pieces))
        naive: list[list[tuple]] = []
        for size, source, cluster in pieces:
            free = [capacity - sum(p[0] for p in b) for b in naive]
            fits = [
                i for i, b in enumerate(naive)
                if free[i] >= size and sum(p[1] == source for p in b) < per_source
                and (cluster < 0 or all(p[2] != cluster for p in b))
            ]
            chosen = bins.place(size, source, cluster)
            if fits:
                assert chosen in fits and free[chosen] == min(free[i] for i in fits)
                naive[chosen].append((size, source, cluster))
            else:
                assert chosen == len(naive)
                naive.append([(size, source, cluster)])


def test_shards_leave_few_part_filled_bins(spark):
    draw = random.Random(4)
    rows = [(i, " ".join(["w"] * draw.randrange(1, 120)) + f" {i}", f"s{i % 23}") for i in range(3000)]
    data = frame(spark, rows)
    one = pack(data, rows_per_shard=10**6, capacity=256, per_source=40).select("bin").distinct().count()
    many = pack(data, rows_per_shard=100, capacity=256, per_source=40)
    assert many.select("bin").distinct().count() <= 1.01 * one
    assert many.count() == 3000 and many.groupBy("bin").agg(F.sum("words").alias("w"), F.max("filled").alias("f")).where("w <> f or w > 256").count() == 0


def test_vectors_match_brute_force(spark):
    draw = np.random.default_rng(4)
    base = draw.normal(size=(60, 16))
    near = [b + draw.normal(scale=s, size=16) for b in base[:12] for s in (0.02, 0.05, 0.08, 0.1, 0.12) for _ in range(4)]
    vectors = [list(map(float, v)) for v in [*base, *near, base[0], base[0], 2 * base[1], np.zeros(16)]]
    vectors += [None, [], [1.0, None], [float("nan")] * 16, [1.0, 2.0], [2.0, 4.0]]
    data = [(i, v, 1) for i, v in enumerate(vectors)] + [(3, vectors[3], 1), (None, vectors[5], 1)]
    table = spark.createDataFrame(data, "vec_id long, embedding array<double>, rep int")
    got = vector_dedup(table, home=16, visitors=64).collect()
    fine = [(i, np.array(v)) for i, v, _ in data if v and None not in v and np.isfinite(v).all() and np.any(v)]
    linked = defaultdict(set)
    for x, (_, a) in enumerate(fine):
        for y, (_, b) in enumerate(fine):
            if x != y and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.95:
                linked[x].add(y)
    low = list(range(len(fine)))
    ids = [10**9 if i is None else i for i, _ in fine]
    low = ids[:]
    for _ in range(len(fine)):
        new = [min([low[x], *(low[y] for y in linked[x])]) for x in range(len(fine))]
        if new == low:
            break
        low = new
    expected = Counter((i, len(linked[x]), low[x]) for x, (i, _) in enumerate(fine))
    assert len(got) == len(data)
    good = {i for i, _ in fine}
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got if r.vec_id in good) == expected
    assert all(r.n_links == 0 and r.kept and r.component_id == r.vec_id for r in got if r.vec_id not in good)
    assert vector_dedup(table.limit(0)).count() == 0


def test_toxicity(spark):
    folder = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in QUERIES["op3_toxicity"](spark, folder).collect()}
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{folder}/labels.parquet").collect()]
    held = [(got[i].score, y) for i, y in labels if got[i].held_out]
    toxic, clean = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([a > b for a in toxic for b in clean]) > 0.97
    assert np.mean([s >= 0.7 for s in toxic]) > 0.85 and np.mean([s >= 0.7 for s in clean]) < 0.01
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())


def test_toxicity_odd_rows(spark):
    labels = spark.createDataFrame([(1, None), (None, 1), (3, 0), (3, 1)], "doc_id long, toxic int")
    docs = frame(spark, ODD)
    got = score_documents(docs, labels)
    assert got.columns == [*docs.columns, "held_out", "score", "predicted"]
    assert got.count() == len(ODD)
    assert score_documents(frame(spark, []), labels.limit(0)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == columns
    assert corpus_pipeline.run(spark, SMALL).count() > 0


#: Names of columns that operators and stages use inside or add themselves, now or in earlier versions.
CLASHING = (
    "_keep _doc _hash _dropped _key _text _id _source _each _copy _more _number _one score held_out predicted "
    "kept_text n_lines n_dropped keep doc hash dropped key text_hash id_ source_ hash_ each more copy number one "
    "row size epochs taken target finish part lot bin shard piece rep digest minima shingles keeper Kept N_Rows"
).split()


def test_stages_give_clashing_columns_back(spark):
    import corpus_pipeline

    plain = spark.read.parquet(f"{SMALL}/documents.parquet")
    copies = plain.where("doc_id % 20 = 0")
    plain = plain.unionByName(copies.withColumn("doc_id", F.col("doc_id") + 10**6))
    clashing = plain.select("*", *[F.concat(F.lit(f"{c}:"), F.col("doc_id")).alias(c) for c in CLASHING])
    for name, stage in corpus_pipeline.STAGES:
        expected = stage(spark, plain, SMALL)
        got = stage(spark, clashing, SMALL)
        if name != "packing":
            assert got.columns == clashing.columns, name
            wrong = " or ".join(f"not `{c}` <=> concat('{c}:', doc_id)" for c in CLASHING)
            assert got.where(wrong).count() == 0, name
        columns = expected.columns
        assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, expected.collect())), name
    lines = dedup_lines(clashing.drop("kept_text", "n_lines", "n_dropped"))
    assert lines.where("_keep <> concat('_keep:', doc_id)").count() == 0


def test_mixed_documents_writes_the_copies_of_the_schedule_for_equal_rows(spark):
    data = [(1, "a b c d", "s")] * 7 + [(2, "e f g", "t")] * 6 + [(3, "h i", "u")] * 5 + [(None, "k l", None)] * 3
    table = spark.createDataFrame(data, "doc_id long, text string, source string")
    schedule, _ = mix(table)
    wanted = {r.source: r.n for r in schedule.groupBy("source").agg(F.sum("epochs").alias("n")).collect() if r.n}
    uneven = schedule.groupBy("source").agg(F.countDistinct("epochs").alias("n")).where("n > 1").count()
    assert uneven > 0
    assert {r.source: r["count"] for r in mixed_documents(table).groupBy("source").count().collect()} == wanted
