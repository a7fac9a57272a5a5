import random

import pytest
from conftest import MEDIUM, rows

from utterscope.operators import intent
from utterscope.plans import views

SCHEMA = "report string, expected string, matched string, result_type string"


def naive_counts(data):
    """Literal masks, one scan per intent."""
    found = {}
    total = len(data)
    lower = [(e and e.lower(), m and m.lower(), t) for _, e, m, t in data]
    for name in {e for e, _, _ in lower if e}:
        plain = (
            sum(e == name and t == "TP" for e, m, t in lower),
            sum(m == name and e != name and t == "FP" for e, m, t in lower),
            sum(e == name and t == "FN" for e, m, t in lower),
        )
        if name == "none":
            tp = sum(e == "none" and t == "TN" for e, m, t in lower)
            fp = sum(e != "none" and m == "none" and t == "FN" for e, m, t in lower)
            fn = sum(e == "none" and t == "FP" for e, m, t in lower)
            tn = sum(e != "none" and m != "none" and t != "FN" for e, m, t in lower)
        else:
            tp, fp, fn = plain
            tn = total - tp - fp - fn
        found[name] = (tp, fp, fn, tn, *plain, total)
    return found


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA)


EDGE_CASES = [
    ("r", "Balance", "balance", "TP"),
    ("r", "BALANCE", "balance", "TP"),
    ("r", "balance", None, "FN"),
    ("r", None, "balance", "FP"),
    ("r", "none", "balance", "FP"),
    ("r", "NONE", None, "TN"),
    ("r", "none", "none", "TN"),
    ("r", "Fees", "none", "FN"),
    ("r", "Fees", "Other", "FP"),
    ("r", "Fees", "fees", None),
    ("r", "Never matched", "Fees", "FP"),
    ("r", "", "Fees", "FP"),
    ("r", "Fees", "fees", "FP"),
    ("r", None, None, "TN"),
]


def test_edge_cases_follow_the_masks(spark):
    found = {r[1]: r[3:] for r in rows(intent.counts(frame(spark, EDGE_CASES)))}
    assert found == naive_counts(EDGE_CASES)
    assert "other" not in found  # matched but never expected
    assert found["none"][:3] == (2, 1, 1)


def test_display_name_is_the_greatest_spelling(spark):
    names = {r[1]: r[2] for r in rows(intent.display_names(frame(spark, EDGE_CASES)))}
    assert names["balance"] == "balance"
    assert names["none"] == "none"
    assert "" not in names


@pytest.mark.parametrize("seed", range(3))
def test_random_reports_follow_the_masks(spark, seed):
    draw = random.Random(seed)
    names = [None, "", "none", "None", "A", "a", "B", "c d"]
    kinds = ["TP", "TN", "FP", "FN", None]
    data = [
        (report, draw.choice(names), draw.choice(names), draw.choice(kinds))
        for report in ("one", "two")
        for _ in range(150)
    ]
    got = rows(intent.counts(frame(spark, data)).repartition(3))
    for report in ("one", "two"):
        expected = naive_counts([r for r in data if r[0] == report])
        assert {r[1]: r[3:] for r in got if r[0] == report} == expected
    for r in got:
        if r[1] != "none":
            assert sum(r[3:7]) == 150


def test_averages(spark):
    data = intent.metrics(frame(spark, EDGE_CASES))
    by_name = {r["intent"]: r for r in data.collect()}
    naive = naive_counts(EDGE_CASES)
    tp, fp, fn = (sum(v[i] for v in naive.values()) for i in (4, 5, 6))
    total = len(EDGE_CASES)
    micro = by_name["micro"]
    assert micro["precision"] == pytest.approx(tp / (tp + fp))
    assert micro["recall"] == pytest.approx(tp / (tp + fn))
    assert micro["support"] == tp + fn
    assert micro["accuracy"] == pytest.approx((total - fp - fn) / total)
    plain = [r for name, r in by_name.items() if not r["is_average"]]
    for column in intent.METRICS:
        assert by_name["macro"][column] == pytest.approx(
            sum(r[column] for r in plain) / len(plain)
        )
    assert by_name["Never matched"]["precision"] == 0.0
    assert by_name["Never matched"]["f1"] == 0.0


def test_no_intents_gives_an_empty_table(spark):
    empty = frame(spark, [("r", None, "a", "FP")])
    assert intent.metrics(empty).count() == 0
    assert intent.metrics(frame(spark, []).limit(0)).columns == [
        "report", "intent", *intent.METRICS, "is_average",
    ]


def test_order_puts_averages_last(spark):
    ordered = intent.in_report_order(intent.metrics(frame(spark, EDGE_CASES)))
    names = [r["intent"] for r in ordered.collect()]
    assert names[-2:] == ["micro", "macro"]
    assert [n.lower() for n in names[:-2]] == sorted(n.lower() for n in names[:-2])


# A published evaluation of one report with 1,000 utterances: tp, fp, fn per intent, and the
# resulting metrics. Fixed values.
PUBLISHED_COUNTS = {
    "Comisiones cuenta": (41, 4, 5),
    "Consulta transferencias cuenta": (88, 5, 7),
    "Consultar movimientos cuenta": (94, 15, 4),
    "Consultar SWIFT/BIC": (123, 3, 0),
    "Contratar cuenta": (133, 8, 2),
    "Justificante transferencia": (108, 4, 0),
    "Saldo de cuenta": (117, 10, 1),
    "Titulares cuenta": (98, 7, 11),
}
PUBLISHED_METRICS = {
    "Comisiones cuenta": (0.9111111111111111, 0.8913043478260869, 0.9010989010989011, 46.0, 0.991),
    "none": (0.7029702970297029, 0.7717391304347826, 0.7357512953367875, 92.0, 0.949),
    "Titulares cuenta": (0.9333333333333333, 0.8990825688073395, 0.9158878504672897, 109.0, 0.982),
    "micro": (0.9347319347319347, 0.9639423076923077, 0.9491124260355029, 832.0, 0.914),
    "macro": (0.9067816740064715, 0.9360373465472532, 0.9206401073178735, 102.66666666666667, 0.9847777777777778),
}


def test_published_report(spark):
    data = []
    for name, (tp, fp, fn) in PUBLISHED_COUNTS.items():
        data += [("p", name, name, "TP")] * tp + [("p", name, "none", "FN")] * fn
        # The wrong matches of an intent come from rows expected to have none, as far as they go.
        data += [("p", None, name, "FP")] * fp
    # none: tp 71 (type TN), fp 30 (the FN rows above), fn 21 (type FP with an unknown match).
    data += [("p", "none", "none", "TN")] * 71 + [("p", "none", "elsewhere", "FP")] * 21
    data += [("p", None, None, None)] * (1000 - len(data))
    got = {r["intent"]: r for r in intent.metrics(frame(spark, data)).collect()}
    for name, values in PUBLISHED_METRICS.items():
        assert [got[name][c] for c in intent.METRICS] == pytest.approx(values, abs=1e-12), name


def test_counts_on_the_order_table(spark):
    summed = (
        intent.counts(views.batch(spark, MEDIUM))
        .groupBy("intent")
        .agg({"tp": "sum", "fp": "sum", "fn": "sum", "tn": "sum"})
        .select("intent", "sum(tp)", "sum(fp)", "sum(fn)", "sum(tn)")
    )
    assert rows(summed, "intent") == [
        ("1-urgent", 2368, 1195, 581, 10856),
        ("2-high", 2098, 25, 573, 12304),
        ("3-medium", 2103, 20, 564, 12313),
        ("5-low", 2110, 17, 587, 12286),
        ("none", 2703, 1211, 281, 9655),
    ]


def test_rows_are_read_once(spark):
    frame_ = intent.metrics(views.batch(spark, MEDIUM))
    frame_.collect()
    plan = frame_._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert "CartesianProduct" not in final and "NestedLoop" not in final
    assert final.count("FileScan") == 1
