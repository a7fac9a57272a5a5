"""Conversation repair against all possible edits of short conversations, a plain walk, and SQL."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest
from conftest import SMALL

from check import normal
from utterscope.llm import conversation_repair as cr
from utterscope.llm.queries import ORACLE, QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"
WHOLE = re.compile(r"(s?(ua)+)?")


def faults_of(rows):
    """(role, text, fault) of the sorted rows of one conversation."""
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def repaired(rows, audit):
    """(cost, lines) of an audit, or None where it is not allowed."""
    cost, lines, at, initials = 0, [], 0, ""
    for letter in audit:
        wanted = "assistant" if initials.endswith("u") else "user"
        if letter == "I":
            cost, initials = cost + 5, initials + wanted[0]
            lines.append(f"{wanted}:")
            continue
        role, text, fault = rows[at]
        at += 1
        if letter == "D":
            cost += 2
        elif fault in ("blank", "duplicate"):
            return None
        else:
            cost += (letter == "R") + 5 * (fault == "truncated")
            role = wanted if letter == "R" else role
            initials += role[:1] or "?"
            lines.append(f"{role}:{text}")
    return (cost, lines) if WHOLE.fullmatch(initials) else None


def every_audit(n, inserts=3):
    for edits in itertools.product("KRD", repeat=n):
        for gaps in itertools.product(range(inserts), repeat=n + 1):
            if sum(gaps) < inserts:
                yield "I" * gaps[0] + "".join(e + "I" * g for e, g in zip(edits, gaps[1:]))


def exhaustive(rows):
    found = ((repaired(rows, a), a) for a in every_audit(len(rows)))
    return min((r[0], a) for r, a in found if r)


def walked(rows):
    """The same by one walk over the rows, for long conversations."""

    def closed(best):
        for _ in range(2):
            for (p, c), q in cr.NEXT.items():
                if c != "s" and p in best:
                    option = (best[p][0] + 5, best[p][1] + "I")
                    best[q] = min(best.get(q, option), option)
        return best

    best = closed({0: (0, "")})
    for role, _, fault in rows:
        after = defaultdict(list)
        for p, (cost, audit) in best.items():
            after[p].append((cost + 2, audit + "D"))
            if fault not in ("blank", "duplicate"):
                late = 5 * (fault == "truncated")
                if (p, role[:1]) in cr.NEXT:
                    after[cr.NEXT[p, role[:1]]].append((cost + late, audit + "K"))
                for c in "ua":
                    if (p, c) in cr.NEXT:
                        after[cr.NEXT[p, c]].append((cost + late + 1, audit + "R"))
        best = closed({p: min(options) for p, options in after.items()})
    return min(best[p] for p in (0, 3) if p in best)


def brute(rows):
    """Rows of the operator for (conv_id, turn, role, text) rows whose turns are distinct but for equal rows."""
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn, " " if role is None else role, " " if text is None else text))
    out = []
    for conv, found in groups.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))
        judged = faults_of(found)
        turns = [t for t, _, _ in found if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[:1] for r, _, _ in judged]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        cost, audit = walked(judged)
        lines = repaired(judged, audit)[1]
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        counts = [sum(f == kind for _, _, f in judged) for kind in ("blank", "duplicate", "truncated")]
        out.append((conv, gaps, *counts, illegal, cost, audit, digest))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0))


def random_row(draw):
    role = draw.choice(["user", "assistant", "system", "tool", "u", "", "User"])
    return role, draw.choice(["Hi.", "ok", "", " \t", "What?", "so…", "Done!"])


def test_the_walk_is_the_cheapest_of_all_edits():
    draw = random.Random(11)
    for _ in range(150):
        rows = faults_of([(t, *random_row(draw)) for t in range(draw.randrange(5))])
        assert walked(rows) == exhaustive(rows), rows


def test_cells_do_not_depend_on_the_split():
    draw = random.Random(12)
    for _ in range(60):
        rows = faults_of([(t, *random_row(draw)) for t in range(draw.randrange(1, 12))])
        cells = [cr.row_cell(r[:1], f) for r, _, f in rows]
        table = {(i, i + 1): {c} for i, c in enumerate(cells)}
        for length in range(2, len(cells) + 1):
            for i in range(len(cells) - length + 1):
                splits = ((table[i, k], table[k, i + length]) for k in range(i + 1, i + length))
                table[i, i + length] = {cr.join(a, b) for left, right in splits for a in left for b in right}
        assert all(len(found) == 1 for found in table.values())
        assert cr.best_repair(next(iter(table[0, len(cells)]))) == walked(rows)


ODD = [
    (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (2, None, "user", None), (2, 5, None, "x"), (2, 9, "", "y."),
    (None, 1, "system", "S."), (None, 3, "user", "Q?"), (None, 4, "assistant", "A"), (3, 7, "system", "only."),
    (4, 1, "user", "same."), (4, 1, "user", "same."), (4, 2, "assistant", "z" * 200_000 + "."), (4, -3, "bot", "b!"),
]


@pytest.mark.parametrize("span_rows,at_once", [(4096, 64), (2, 2)])
def test_repairs_match_the_walk(spark, span_rows, at_once):
    draw = random.Random(13)
    rows = [*ODD, *((9, t, *random_row(draw)) for t in draw.sample(range(900), 600))]
    rows += [(c, t, *random_row(draw)) for c in range(20, 60) for t in draw.sample(range(12), draw.randrange(1, 9))]
    frame = spark.createDataFrame([(*r, 1, "h", 2) for r in rows], SCHEMA + ", row int, hash string, part int")
    expected = brute(rows)
    got = cr.repairs(frame, span_rows, at_once).collect()
    assert sorted(map(tuple, got), key=lambda r: (r[0] is not None, r[0] or 0)) == [r[:-1][:1] + r[1:-1] for r in expected]
    if at_once == 64:
        known = frame.unionByName(spark.createDataFrame([(-1, 0, "", "", 0, "", 0)], frame.schema))
        digests = sorted(map(tuple, cr.repair_digests(frame, known).collect()), key=lambda r: (r[0] is not None, r[0] or 0))
        empty = (-1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
        assert digests == sorted([empty, *expected], key=lambda r: (r[0] is not None, r[0] or 0))


def test_repaired_turns(spark):
    frame = spark.createDataFrame(ODD, SCHEMA)
    turns = cr.repaired_turns(frame).where("conv_id = 4 or conv_id is null or conv_id = 1").collect()
    by_conv = defaultdict(list)
    for r in sorted(turns, key=lambda r: r.position):
        by_conv[r.conv_id].append((r.edit, r.role, r.text[:5]))
    assert by_conv[1] == [("K", "user", "Hi."), ("K", "assistant", "Yes.")]
    assert by_conv[4] == [("K", "user", "same."), ("K", "assistant", "zzzzz")]
    assert by_conv[None] == [("R", "user", "S."), ("R", "assistant", "Q?")]


def test_empty_table(spark):
    assert cr.repairs(spark.createDataFrame([], SCHEMA)).collect() == []
    assert cr.repaired_turns(spark.createDataFrame([], SCHEMA)).collect() == []


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in range(12) for t in range(9)] + [(None, None, None, None), (None, 4, None, "a.")]
    got = sorted(map(tuple, cr.damaged(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    expected = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        draw = zlib.crc32(key.encode()) % 20
        role, text = role or " ", text or " "
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        expected += [(conv, turn, "user" if draw == 4 else role, text)] * (0 if draw == 0 else 2 if draw == 3 else 1)
    assert got == sorted(expected, key=repr)


def test_query_matches_sql(spark):
    duck = duckdb.connect()
    duck.execute(f"create view conversations as select * from '{SMALL}/conversations.parquet'")
    result = duck.execute(ORACLE["op11_conversation_repair"])
    names = [d[0] for d in result.description]
    got = QUERIES["op11_conversation_repair"](spark, SMALL)
    assert sorted(got.columns) == sorted(names)
    assert normal([tuple(r) for r in got.collect()], got.columns) == normal(result.fetchall(), names)
