import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from utterscope.functions import text as functions
from utterscope.functions.numeric import ratio
from pyspark.sql import functions as F


def naive_tokens(text):
    return re.sub(r"[^\w\s]", "", text.lower()).split()


SAMPLES = [
    "¿Cuánto dinero tengo, en mi cuenta?",
    "don't  stop\tnow\n\nplease\r\nok",
    "{AccountIban} 1.234,50 € a_b __ ½ ²",
    "...!?",
    "",
    "   ",
    "a b c　d\u0085e f\x1cg",
    "ÜBER straße ñandú É",
    "你好 世界 مرحبا 123",
    "emoji \U0001f600\U0001f4a9 x",
]


def test_tokens_match_python(spark):
    frame = spark.createDataFrame([(i, s) for i, s in enumerate(SAMPLES)], "i int, text string")
    got = {r.i: r.t for r in frame.select("i", functions.tokens(F.col("text")).alias("t")).collect()}
    assert got == {i: naive_tokens(s) for i, s in enumerate(SAMPLES)}


OLD = unicodedata.ucd_3_2_0
SAFE = st.characters(
    exclude_categories=("Cs", "Cn"),
    max_codepoint=0x3000,
)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(SAFE, max_size=40), min_size=20, max_size=60))
def test_any_text_matches_python(spark, texts):
    # Lower-casing differs between libraries for a few capitals, and newer characters may be
    # letters for one and unassigned for the other; compare what lower-casing leaves alone.
    texts = [
        "".join(c for c in s if c.lower() == c and OLD.category(c) not in ("Co", "Cn")) for s in texts
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: r.t for r in frame.select("i", functions.tokens(F.col("text")).alias("t")).collect()}
    assert got == {i: naive_tokens(s) for i, s in enumerate(texts)}


@pytest.mark.parametrize("length,expected", [(100, "x" * 100), (101, "x" * 100 + "..."), (3, "xxx")])
def test_preview(spark, length, expected):
    frame = spark.createDataFrame([("x" * length,)], "text string")
    assert frame.select(functions.preview(F.col("text"))).first()[0] == expected


def test_unquote(spark):
    cases = {' "a b" \t': "a b", '"': "", '""x""': "x", "plain": "plain", ' "é,"\n': "é,"}
    frame = spark.createDataFrame([(c,) for c in cases], "c string")
    got = {r.c: r.u for r in frame.select("c", functions.unquote(F.col("c")).alias("u")).collect()}
    assert got == cases


def test_ratio_is_zero_without_denominator(spark):
    frame = spark.createDataFrame([(1, 0), (0, 0), (1, 4)], "a long, b long")
    assert [r[0] for r in frame.select(ratio(F.col("a"), F.col("b"))).collect()] == [0.0, 0.0, 0.25]
