"""The pipeline, stage by stage, against plain versions, and the schedule of the mix against a plain queue."""

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL
from pyspark.sql import functions as F
from test_near_dedup import brute as plain_components

import corpus_pipeline
from utterscope.llm import toxicity
from utterscope.llm.common import BATCH_ROWS, BATCH_SETTING, released, slices
from utterscope.llm.mixing import MAX_EPOCHS, SEED, WEIGHTS, mix
from utterscope.llm.toxicity import score_documents

BLANKS = " \t\n\x0b\x0c\r"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return [w for w in (text or "").translate(str.maketrans(BLANKS, " " * 6)).split(" ") if w]


def plain_lines(texts):
    """Texts without the lines of at least 20 characters that three documents hold and a larger id holds too."""
    holders = defaultdict(set)
    lines = {i: (t or "").split("\n") for i, t in texts.items()}
    key = lambda line: line.strip(BLANKS).translate(FOLD)
    for i, own in lines.items():
        for line in own:
            if len(key(line)) >= 20:
                holders[key(line)].add(i)
    goes = lambda i, line: len(holders[key(line)]) >= 3 and max(holders[key(line)]) != i if len(key(line)) >= 20 else False
    out = {}
    for i, own in lines.items():
        kept = [line for line in own if not goes(i, line)]
        out[i] = texts[i] if len(kept) == len(own) else "\n".join(kept)
    return out


def plain_targets(sizes):
    total = sum(sizes.values())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: WEIGHTS[i % len(WEIGHTS)] for i, s in enumerate(order)}
    fixed = set()
    while True:
        left = total - sum(MAX_EPOCHS * sizes[s] for s in fixed)
        free = sum(w for s, w in weights.items() if s not in fixed)
        targets = {s: MAX_EPOCHS * sizes[s] if s in fixed else left * weights[s] / free for s in sizes}
        over = {s for s in targets if targets[s] > MAX_EPOCHS * sizes[s]}
        if not over:
            return targets
        fixed |= over


def plain_mix(rows):
    """Copies taken of each (doc_id, source, size, draw): all queues served by one loop in order of finish times."""
    sizes = Counter()
    for _, source, size, _ in rows:
        sizes[source] += size
    targets = plain_targets(sizes)
    copies = []
    for source in sizes:
        served = 0
        queue = sorted((r for r in rows if r[1] == source), key=lambda r: (r[3], r[0]))
        for epoch in range(MAX_EPOCHS):
            for i, _, size, draw in queue:
                served += size
                if size:
                    copies.append(((served - size / 2) / targets[source], draw, i, size))
    taken, used, budget = Counter(), 0, sum(sizes.values())
    for _, _, i, size in sorted(copies):
        used += size
        if used > budget:
            break
        taken[i] += 1
    return taken


def drawn(documents):
    """(doc_id, source, size, draw) with the random order of the mix."""
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "source", "doc_id", F.xxhash64("text")), 1)
    found = documents.select("doc_id", "source", "text", draw.alias("draw")).collect()
    return [(r.doc_id, r.source, len(words(r.text)), r.draw) for r in found]


@pytest.mark.parametrize("ranges,parts", [(2000, 500_000), (7, 13)])
def test_the_schedule_is_that_of_a_plain_queue(spark, ranges, parts):
    documents = spark.read.parquet(f"{SMALL}/documents.parquet")
    schedule, stream = mix(documents, rows_per_range=ranges, copies_per_partition=parts)
    expected = plain_mix(drawn(documents))
    got = {r.doc_id: r.epochs for r in schedule.collect()}
    assert {i: n for i, n in got.items() if n} == dict(expected)
    assert Counter(r.doc_id for r in stream.collect()) == expected


def test_the_pipeline_is_that_of_plain_stages(spark):
    documents = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    (_, toxic), (_, lines), (_, near), (_, mixed), (_, packed) = corpus_pipeline.STAGES

    # The classifier has no plain version; its decisions are taken over.
    rejected = {r.doc_id for r in score_documents(documents, labels).where("predicted = 1").collect()}
    docs = toxic(spark, documents, SMALL)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert set(texts) == {r.doc_id for r in documents.collect()} - rejected

    docs = lines(spark, docs, SMALL)
    expected = plain_lines(texts)
    texts = {r.doc_id: (r.text, r.n_chars) for r in docs.collect()}
    assert {i: t for i, (t, _) in texts.items()} == expected
    assert all(n == len(t) for i, (t, n) in texts.items())

    docs = near(spark, docs, SMALL)
    components = plain_components(expected, corpus_pipeline.NEAR_PERCENT)
    keepers = {i for i, (_, component) in components.items() if component == i}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert texts == {i: expected[i] for i in keepers}

    taken = plain_mix(drawn(docs))
    docs = mixed(spark, docs, SMALL)
    assert Counter(r.doc_id for r in docs.collect()) == taken

    pieces = packed(spark, docs, SMALL).collect()
    held, bins = Counter(), defaultdict(list)
    for r in pieces:
        held[r.doc_id] += r.words
        bins[r.bin].append(r)
    assert held == {i: n * len(words(texts[i])) for i, n in taken.items()}
    source = {r.doc_id: r.source for r in documents.collect()}
    for own in bins.values():
        assert sum(r.words for r in own) <= 2048 and len({r.doc_id for r in own}) == len(own)
        assert max(Counter(source[r.doc_id] for r in own).values()) <= 4
    whole = corpus_pipeline.run(spark, SMALL)
    assert Counter((r.doc_id, r.piece, r.words) for r in whole.collect()) == Counter((r.doc_id, r.piece, r.words) for r in pieces)


def test_toxic_texts_are_scored_in_small_batches(spark, monkeypatch):
    limit = BATCH_ROWS

    class Limited:
        def scores(self, texts):
            assert len(texts) <= limit
            return np.zeros(len(texts))

    monkeypatch.setattr(toxicity, "train", lambda *args, **options: Limited())
    before = spark.conf.get(BATCH_SETTING)
    docs = spark.range(0, 2 * limit + 1, 1, 1).selectExpr("id as doc_id", "concat('a w', id) as text")
    kept = corpus_pipeline.drop_toxic(spark, docs, SMALL)
    assert kept.columns == docs.columns and kept.count() == 2 * limit + 1
    assert kept.exceptAll(docs).isEmpty()
    assert spark.conf.get(BATCH_SETTING) == before


def test_tasks_work_on_bounded_texts_and_return_memory(monkeypatch):
    texts = pa.array(["x" * 1000] * 2000 + ["y" * 3_000_000, None, ""])
    parts = [texts[part] for part in slices(texts)]
    assert pa.concat_arrays(parts).equals(texts)
    assert all(len(part) == 1 or sum(len(t or "") for t in part.to_pylist()) <= 512 * 1024 for part in parts)
    calls = []

    class Pool:
        def release_unused(self):
            calls.append(1)

    monkeypatch.setattr(pa, "default_memory_pool", Pool)
    assert list(released(iter)([1, 2])) == [1, 2] and calls == [1]
