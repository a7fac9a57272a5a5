import random
import re
from collections import defaultdict

import pytest

from utterscope.llm.components import components
from utterscope.llm.near_dedup import keep_one_of_each, near_dedup
from utterscope.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    if 0 < len(words) < 5:
        return {tuple(words)}
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(texts, percent):
    """doc_id -> (set size, smallest reachable id), over all pairs that share a shingle."""
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    seen = {(a, b) for ids in holders.values() for a in ids for b in ids if a < b}
    for a, b in seen:
        common = len(sets[a] & sets[b])
        if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in texts}


def check(result, expected):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in result}
    assert got == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in result)


def test_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    check(QUERIES["op9_minhash_near_dedup"](spark, SMALL).collect(), brute(texts, 85))


@pytest.mark.parametrize("percent", [80, 85])
def test_groups_around_a_hidden_centre(spark, percent):
    """Variants of one text that are linked with it, but often not with each other, and chains."""
    draw = random.Random(percent)
    word = lambda: f"w{draw.randrange(10**6)}"
    texts, number = {}, 0
    for _ in range(3):
        base = [word() for _ in range(150)]
        texts[number] = " ".join(base)
        number += 1
        for _ in range(330):
            variant = list(base)
            for _ in range(draw.choice([1, 1, 2, 3])):
                variant[draw.randrange(150)] = word()
            texts[number] = " ".join(variant)
            number += 1
        for _ in range(12):  # a chain: each text differs from the one before
            base[draw.randrange(150)] = word()
            texts[number] = " ".join(base)
            number += 1
    order = list(texts)
    draw.shuffle(order)
    texts = {new: texts[old] for new, old in enumerate(order)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    check(near_dedup(frame, percent=percent).collect(), brute(texts, percent))


def test_odd_rows(spark):
    long = " ".join(str(i % 5000) for i in range(60000))
    data = [
        (1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE  two"), (6, "two one"), (7, long), (8, long + " end"),
        (9, "a b c d e"), (9, "a b c d e"), (None, "a b c d e"), (None, None),
    ]
    frame = spark.createDataFrame(
        [(i, t, 0, "k") for i, t in data], "doc_id long, text string, rep int, key string"
    )
    got = near_dedup(frame, percent=85).collect()
    assert len(got) == len(data)
    named = {r.doc_id: r.component_id for r in got if r.n_shingles}
    assert named == {4: 4, 5: 4, 6: 6, 7: 7, 8: 7, 9: 9, None: 9}
    assert all(r.component_id == r.doc_id for r in got if not r.n_shingles)
    assert sum(r.keeper for r in got if r.component_id == 9) == 1
    left = keep_one_of_each(frame, percent=85)
    assert left.columns == frame.columns
    assert {r.doc_id for r in left.collect()} == {1, 2, 3, 4, 6, 7, 9, None}
    assert near_dedup(frame.limit(0)).count() == 0


def test_one_row_of_each_component_stays_whatever_the_ids(spark):
    words = [f"w{i}" for i in range(60)]
    near, nearer, other = " ".join(words), " ".join([*words, "z"]), " ".join(f"v{i}" for i in range(60))
    data = [
        (None, near), (None, nearer), (None, near),
        (5, other), (5, other), (6, other),
        (8, " ".join(f"u{i}" for i in range(60))), (9, " ".join([*(f"u{i}" for i in range(60)), "z"])), (9, "a unique text under a repeated id"),
        (10, ""), (10, ""), (None, None), (None, None),
    ]
    left = keep_one_of_each(spark.createDataFrame(data, "doc_id long, text string"), percent=85).collect()
    ids = lambda start: [r.doc_id for r in left if (r.text or "").startswith(start)]
    assert ids("w0") == [None]
    assert ids("v0") == [5]
    assert ids("u0") == [8]
    assert ids("a unique") == [9]
    assert sum(r.text == "" for r in left) == 2
    assert sum(r.text is None for r in left) == 2
    assert len(left) == 8


def test_components(spark):
    draw = random.Random(1)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(500, i) for i in range(501, 560)]
    noise = [(draw.randrange(1000, 1100), draw.randrange(1000, 1100)) for _ in range(60)]
    links = chain + star + noise + [(7, 7), (101, 100)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {x: x for pair in links for x in pair}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    assert got == {k: v for k, v in root.items() if k != 7}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
