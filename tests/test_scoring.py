import math

import pytest
from conftest import rows
from pyspark.sql import functions as F

from utterscope.functions.activations import ACTIVATIONS, activate
from utterscope.operators import scoring

NAIVE = {
    "step": lambda z: 1.0 if z >= 0 else 0.0,
    "sigmoid": lambda z: 1 / (1 + math.exp(-z)),
    "tanh": math.tanh,
    "relu": lambda z: max(0.0, z),
    "leaky_relu": lambda z: z if z > 0 else 0.1 * z,
    "leaky_relu_max": lambda z: max(0.01 * z, z),
    "elu": lambda z: z if z > 0 else math.exp(z) - 1,
    "swish": lambda z: z / (1 + math.exp(-z)),
}


@pytest.mark.parametrize("name", list(ACTIVATIONS))
def test_activations(spark, name):
    values = [-30.0, -2.0, -0.5, 0.0, 0.5, 3.0]
    frame = spark.createDataFrame([(v,) for v in values], "z double")
    got = [r[0] for r in frame.select(activate(name, F.col("z"))).collect()]
    assert got == pytest.approx([NAIVE[name](v) for v in values])


def test_parameters_and_unknown_names(spark):
    frame = spark.createDataFrame([(-1.0,)], "z double")
    assert frame.select(activate("leaky_relu", F.col("z"), alpha=0.5)).first()[0] == -0.5
    assert frame.select(activate("leaky_relu_max", F.col("z"), alpha=2.0)).first()[0] == -1.0
    assert frame.select(activate("leaky_relu", F.col("z"), alpha=2.0)).first()[0] == -2.0
    with pytest.raises(ValueError):
        activate("softmax", F.col("z"))


def test_perceptron_and_summary(spark):
    frame = spark.createDataFrame(
        [("a", 1.0, 2.0, [1.0, 2.0]), ("a", -1.0, 0.0, [-1.0, 0.0]), ("b", 0.0, 0.0, [0.0, 0.0])],
        "g string, p double, q double, v array<double>",
    )
    named = scoring.perceptron(frame, scoring.linear({"p": 2.0, "q": 1.0}, -1.0), "relu")
    vector = scoring.perceptron(frame, scoring.linear_vector(F.col("v"), [2.0, 1.0], -1.0), "relu")
    assert rows(named.select("g", "z", "y")) == [("a", -3.0, 0.0), ("a", 3.0, 3.0), ("b", -1.0, 0.0)]
    assert rows(named) == rows(vector)
    assert rows(scoring.activation_summary(named, ["g"])) == [
        ("a", 2, 1.5, 0.0, 3.0, 0.5),
        ("b", 1, 0.0, 0.0, 0.0, 0.0),
    ]
