import pytest
from conftest import MEDIUM, rows
from pyspark.sql import functions as F

from utterscope.operators import entity
from utterscope.plans import views

SCHEMA = "report string, utterance string, entity string, correct boolean, engine string, method string"

DATA = [
    ("r", "u1", "Amount", True, "ML Engine", "NER"),
    ("r", "u1", "Amount", False, "ML Engine", "NER"),
    ("r", "u2", "Amount", True, "FM Engine", "Full Match - synonym"),
    ("r", "u2", "Amount", True, "FM Engine", "Full Match"),
    ("r", "u3", "Amount", None, "FM Engine", "Partial Match: x"),
    ("r", "u3", "Amount", True, "FM Engine", None),
    ("r", "u4", "Amount", True, None, "NER"),
    ("r", "u5", "Type", True, "ML Engine", None),
    ("r", None, "Type", False, "ML Engine", "systemEntity"),
    ("r", "u6", None, None, None, None),
    ("r", "u6", "", True, None, None),
    ("s", "u7", None, None, None, None),
]


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame(DATA, SCHEMA)


def test_metrics(spark, data):
    got = rows(entity.metrics(data), "report", "entity")
    assert got == [
        ("r", "", 1.0, 2, True),
        ("r", "Amount", 5 / 7, 7, False),
        ("r", "Type", 0.5, 2, False),
        ("r", "micro", 6 / 9, 11, True),
        ("s", "", 1.0, 1, True),
        ("s", "micro", 0.0, 1, True),
    ]


def test_metrics_of_an_empty_report(spark, data):
    known = spark.createDataFrame([("r",), ("s",), ("t",)], "report string")
    got = rows(entity.metrics(data, known).where("report = 't'"))
    assert got == [("t", "", 1.0, 0, True), ("t", "micro", 0.0, 0, True)]
    success = {r["report"]: r["value"] for r in entity.utterance_success(data, known).collect()}
    assert success == {"r": pytest.approx(3 / 5), "s": 0.0, "t": 0.0}


def test_identification(data):
    got = rows(entity.identification(data), "entity", "method", "category", "sub_method")
    third = pytest.approx(100 / 3)
    assert got == [
        ("r", "Amount", "FM Engine", 4, pytest.approx(400 / 6), "EntityIdentifiedBy", "Total"),
        ("r", "Amount", "FM Engine", 2, pytest.approx(200 / 3), "entityIdentifiedUsing", "Full Match"),
        ("r", "Amount", "FM Engine", 1, third, "entityIdentifiedUsing", "Partial Match"),
        ("r", "Amount", "ML Engine", 2, third, "EntityIdentifiedBy", "Total"),
        ("r", "Amount", "ML Engine", 2, 100.0, "entityIdentifiedUsing", "NER"),
        ("r", "Type", "ML Engine", 2, 100.0, "EntityIdentifiedBy", "Total"),
        ("r", "Type", "ML Engine", 1, 100.0, "entityIdentifiedUsing", "systemEntity"),
    ]


def test_summary_and_methods_split_the_identification(data):
    identified = entity.identification(data)
    summary, methods = entity.engine_summary(identified), entity.methods(identified)
    assert summary.columns == ["report", "entity", "engine", "count", "percentage"]
    assert methods.columns == ["report", "entity", "engine", "method", "count", "percentage"]
    assert summary.count() + methods.count() == identified.count()
    for frame, keys in ((summary, ["report", "entity"]), (methods, ["report", "entity", "engine"])):
        for r in frame.groupBy(*keys).agg(F.sum("percentage").alias("p")).collect():
            assert r["p"] == pytest.approx(100.0)


def test_breakdown_order(data):
    ordered = entity.breakdown_in_report_order(entity.identification(data)).collect()
    first = [(r["method"], r["sub_method"]) for r in ordered if r["entity"] == "Amount"]
    assert first == [
        ("FM Engine", "Total"), ("FM Engine", "Full Match"), ("FM Engine", "Partial Match"),
        ("ML Engine", "Total"), ("ML Engine", "NER"),
    ]


def test_utterance_success(data):
    got = rows(entity.utterance_success(data))
    # u1 and u3 fail, u2, u4 and u5 succeed; the null utterance does not count.
    assert got == [
        ("r", "utterance_level_success", pytest.approx(3 / 5)),
        ("s", "utterance_level_success", 0.0),
    ]


def test_event_table(spark):
    ent = views.ent(spark, MEDIUM)
    both = ent.withColumn("report", F.lit("all"))
    metrics = {r["entity"]: r for r in entity.metrics(both).collect()}
    assert metrics["click"]["accuracy"] == pytest.approx(0.61565, abs=1e-5)
    assert metrics["click"]["support"] == 1738
    identified = entity.identification(both)
    assert identified.count() == 30
    total = identified.where("entity = 'click' and method = 'FM Engine' and sub_method = 'Total'").first()
    assert (total["count"], round(total["percentage"], 6)) == (669, 48.373102)
    success = entity.utterance_success(both).first()["value"]
    assert success == pytest.approx(0.287642, abs=1e-6)


# Published breakdown of one report. Fixed values.
PUBLISHED = [
    ("BalanceType", "FM Engine", "Full Match", 13, 34.21052631578947),
    ("BalanceType", "FM Engine", "systemEntity", 25, 65.78947368421053),
    ("BalanceType", "ML Engine", "NER", 61, 100.0),
    ("TransferType", "FM Engine", "Full Match", 5, 35.714285714285715),
    ("TransferType", "FM Engine", "Partial Match", 7, 50.0),
    ("TransferType", "FM Engine", "systemEntity", 2, 14.285714285714285),
    ("TransferType", "ML Engine", "NER", 6, 100.0),
]
PUBLISHED_ENGINES = [
    ("BalanceType", "FM Engine", 38, 38.38383838383838),
    ("BalanceType", "ML Engine", 61, 61.61616161616161),
    ("TransferType", "FM Engine", 14, 70.0),
    ("TransferType", "ML Engine", 6, 30.0),
]


def test_published_breakdown(spark):
    data = [
        ("p", f"u{i}", name, True, engine, method)
        for name, engine, method, n, _ in PUBLISHED
        for i in range(n)
    ]
    identified = entity.identification(spark.createDataFrame(data, SCHEMA))
    methods = [r[1:] for r in rows(entity.methods(identified), "entity", "engine", "method")]
    engines = [r[1:] for r in rows(entity.engine_summary(identified), "entity", "engine")]
    assert methods == [(*r[:4], pytest.approx(r[4])) for r in PUBLISHED]
    assert engines == [(*r[:3], pytest.approx(r[3])) for r in PUBLISHED_ENGINES]
