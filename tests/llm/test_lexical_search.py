"""Lexical search against a plain loop over all documents, and SQL."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL

from check import TABLES, normal
from utterscope.llm import lexical_search as ls
from utterscope.llm.queries import ORACLE, QUERIES

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(documents, items, k=20):
    bags = [(i, Counter(terms(t))) for i, t in documents]
    n = [b.total() for _, b in bags]
    docs, total = sum(x > 0 for x in n), sum(n)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for (i, bag), size in zip(bags, n):
            m = 75 + (25 * size * docs) // total if total else 75
            score = 0
            for t in terms(text):
                if bag[t]:
                    w = math.floor(1000 * math.log((2 * docs + 2) / (2 * df[t] + 1)))
                    score += w * ((1000000000 * bag[t]) // (1000 * bag[t] + 12 * m))
            if score > 0:
                scored.append((-score, i is None, i))
        scored.sort()
        out += [(item, rank, i, -score) for rank, (score, _, i) in enumerate(scored[:k], 1)]
    return sorted(out, key=repr)


def test_terms():
    texts = ["Don't, É1_x２ a-B", "", None, "ÀÉ日本 語", "\x7fZ\x00z", "  "]
    owner, found = ls.terms_of(pa.array(texts).slice(0))
    got = [[] for _ in texts]
    for i, term in zip(owner, found.to_pylist()):
        got[i].append(term)
    assert got == [terms(t) for t in texts]
    owner, found = ls.terms_of(pa.array(texts).slice(3, 2))
    assert found.to_pylist() == terms(texts[3]) + terms(texts[4])


def random_text(draw, most):
    # A few words are in nearly every text, many in few.
    return " ".join(f"w{int(draw.paretovariate(0.35))}" for _ in range(draw.randrange(most)))


@pytest.mark.parametrize("window,share", [(8, 1 / 16), (8192, 1 / 16), (64, 0.0), (64, 100.0)])
def test_blocks_find_the_best(monkeypatch, window, share):
    monkeypatch.setattr(ls, "WINDOW", window)
    monkeypatch.setattr(ls, "SHORT_SHARE", share)
    draw = random.Random(1)
    documents = [(draw.randrange(10**6) if i else None, random_text(draw, 40)) for i in range(500)]
    items = [(i, random_text(draw, 30)) for i in range(40)]
    names = sorted({t for _, text in items for t in terms(text)})
    numbers = {t: i for i, t in enumerate(names)}
    bags = [Counter(terms(t)) for _, t in documents]
    n = np.array([b.total() for b in bags])
    df = np.array([sum(t in b for b in bags) for t in names])
    weights = np.floor(1000 * np.log((2.0 * (n > 0).sum() + 2) / (2 * df + 1))).astype(np.int64)
    statistics = ls.Statistics(int((n > 0).sum()), int(n.sum()), weights)
    known = [sorted((numbers[t], c) for t, c in b.items() if t in numbers) for b in bags]
    blocks = [
        ls.Block(
            pa.array([i for i, _ in documents[part]], pa.int64()),
            n[part],
            pa.array([[t for t, _ in d] for d in known[part]], pa.list_(pa.int32())),
            pa.array([[c for _, c in d] for d in known[part]], pa.list_(pa.int64())),
            statistics,
        )
        for part in (slice(0, 300), slice(300, 301), slice(301, 500))
    ]
    got = []
    for item, text in items:
        best = []
        weighted = [(numbers[t], int(weights[numbers[t]]) * c) for t, c in Counter(terms(text)).items()]
        for block in blocks:
            best = ls.search_block(block, weighted, 20, best)
        got += [(item, rank, None if none else i, -score) for rank, (score, none, i) in enumerate(best, 1)]
    assert sorted(got, key=repr) == brute(documents, items)


ODD = [
    (1, None), (2, ""), (3, "one two two"), (3, "one two two"), (None, "One, TWO two."), (4, "two " * 60_000), (5, " \t."),
    (6, "three one"), (9, "one two two"), (8, "é É"), (7, "two one two"),
]
ITEMS = [(1, "Two one"), (1, "three"), (2, None), (None, "two two é"), (3, "..."), (4, "unknown"), (5, "x " * 5000 + "one")]


@pytest.mark.parametrize("lot_bytes,entries,documents", [(1 << 24, 1 << 20, 1 << 17), (4, 3, 2)])
def test_odd_rows(spark, lot_bytes, entries, documents):
    docs = spark.createDataFrame([(i, t, 1, "t") for i, t in ODD], "doc_id long, text string, n int, terms string")
    items = spark.createDataFrame([(i, t, 0) for i, t in ITEMS], "item_id long, text string, item int")
    limits = {"lot_bytes": lot_bytes, "block_entries": entries, "block_documents": documents}
    got = ls.search(docs.coalesce(2), items, k=4, **limits)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and dict(got.dtypes)["rank"] == "int"
    assert sorted(map(tuple, got.collect()), key=repr) == brute(ODD, ITEMS, 4)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "one")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert ls.search(docs.limit(0), items).collect() == []
    assert ls.search(docs, items.limit(0)).collect() == []
    # ln(4 / 3) is above 0: a term that every document holds still counts.
    assert ls.search(docs, items).count() == 1


def test_query_matches_sql(spark):
    duck = duckdb.connect()
    for table in TABLES:
        duck.execute(f"create view {table} as select * from '{SMALL}/{table}.parquet'")
    result = duck.execute(ORACLE["op12_lexical_search"])
    names = [d[0] for d in result.description]
    got = QUERIES["op12_lexical_search"](spark, SMALL)
    assert sorted(got.columns) == sorted(names)
    assert normal([tuple(r) for r in got.collect()], got.columns) == normal(result.fetchall(), names)
