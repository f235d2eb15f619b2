from fractions import Fraction

import pytest
from pyspark.sql import types as T

from wayloom.functions.quantity import QuantityReader
from wayloom.operators.units import normalize_quantities

READ = [
    ("30 mph", "speed", None, [(30, "mph")]),
    ("30mph", "speed", None, [(30, "mph")]),
    ("50", "speed", "km/h", [(50, "km/h")]),
    ("50", "speed", None, []),
    ("13½  miles/hour", "speed", None, [(Fraction(27, 2), "mph")]),
    ("4 1/2 mph", "speed", None, [(Fraction(9, 2), "mph")]),
    ("１３.９１kilometres per hour", "speed", None, [(Fraction("13.91"), "km/h")]),
    ("forty km/h", "speed", None, [(40, "km/h")]),
    ("twenty-five mph", "speed", None, [(25, "mph")]),
    ("12,340 lb", "weight", None, [(12340, "lb")]),
    ("12,34 t", "weight", None, [(Fraction("12.34"), "t")]),
    ("0,335 t", "weight", None, [(Fraction("0.335"), "t")]),
    ("2 760", "length", "cm", [(2760, "cm")]),
    ("5' 7\"", "length", None, [(5, "ft"), (7, "in")]),
    ("2 m 61 cm", "length", None, [(2, "m"), (61, "cm")]),
    ("8′1″", "length", None, [(8, "ft"), (1, "in")]),
    (".67m.", "length", None, [(Fraction("0.67"), "m")]),
    ("~3.19  m", "length", None, [(Fraction("3.19"), "m")]),
    ("4.60 short tons at narrowest point", "weight", None, [(Fraction("4.60"), "st")]),
    ("30 mph", "length", "m", []),
    ("3 axles", "weight", "t", []),
    ("posted 2021-04-03", "speed", "mph", []),
    ("06:00-22:00", "speed", "mph", []),
    ("ft?", "length", "m", []),
    ("#14", "length", "m", []),
    ("", "length", "m", []),
    ("x" * 100_000, "length", "m", []),
    (None, "length", "m", []),
]


@pytest.mark.parametrize("text,quantity,default,expected", READ)
def test_reading(text, quantity, default, expected):
    assert QuantityReader().read(text, quantity, default) == expected


def test_operator(spark):
    tags = spark.createDataFrame(
        [(1, "maxspeed", "30 mph", "s", "x"), (1, "maxspeed", "30 mph", "s", "y"), (2, "width", "5' 6\"", None, "x"), (3, "width", "10", "s", "x"), (4, "width", None, "s", "x"), (5, "other", "10 m", "s", "x"), (6, "width", "10", None, "x"), (7, "maxweight", "2", "s", "x")],
        "tag_id bigint, key string, value string, source string, unit string",
    )
    keys = spark.createDataFrame([("maxspeed", "speed", "tenth of a km/h"), ("width", "length", "cm"), ("maxweight", "weight", "kg")], "key string, quantity string, common_unit string")
    sources = spark.createDataFrame([("s", "ft", "mph", "st")], "source string, length_unit string, speed_unit string, weight_unit string")
    got = sorted(map(tuple, normalize_quantities(tags, keys, sources).collect()))
    assert got == [(1, "speed", 483), (2, "length", 168), (3, "length", 305), (7, "weight", 1814)]
    nothing = spark.createDataFrame([], tags.schema)
    assert normalize_quantities(nothing, keys, sources).count() == 0
    assert isinstance(normalize_quantities(nothing, keys, sources).schema["amount"].dataType, T.LongType)
