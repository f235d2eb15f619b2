from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayloom.functions.unpack import MARK, unpack
from wayloom.operators.unpack import unpack_values

CASES = {
    "a": ["a"],
    "": [],
    "   ": [],
    ";|,": [],
    " a ; b ": ["a", "b"],
    '"a;b";c': ["a;b", "c"],
    "['a', 'b']": ["a", "b"],
    '["a","b"]': ["a", "b"],
    "{a,b}": ["a", "b"],
    "a\\;x;b": ["a;x", "b"],
    '"no, ""soft"" edge", lane': ['no, "soft" edge', "lane"],
    "'no' 'x' 'lane'": ["no", "x", "lane"],
    "a and b": ["a", "b"],
    "sandy": ["sandy"],
    "a||b| ": ["a", "b"],
    "'it''s';b": ["it's", "b"],
    "driver's;b": ["driver's", "b"],
    '"a;b': ['"a', "b"],
    'a + "x / y" / z': ["a", "x / y", "z"],
    f"a{MARK}b;c": [f"a{MARK}b", "c"],
    f'{MARK}0{MARK};"x"': [f"{MARK}0{MARK}", "x"],
    "a\tb\nc": ["a", "b", "c"],
    "x;" * 3000 + "y": ["x"] * 3000 + ["y"],
}


def test_strings(spark):
    df = spark.createDataFrame([(k,) for k in CASES], "t string")
    got = {r.t: r.u for r in df.select("t", unpack(F.col("t")).alias("u")).collect()}
    assert got == CASES
    null = spark.createDataFrame([(None,)], "t string").select(unpack(F.col("t")).alias("u")).first()
    assert null.u is None


def test_positions_repeats_and_empty(spark):
    schema = "ord bigint, highway array<string>, cycleway string, field string"
    rows = [
        (1, ["a", "b;c"], "x", "kept out"),
        (1, ["a", "b;c"], "x", "kept out"),
        (2, None, "p|q", None),
        (3, ["m", None, "", "n"], None, None),
        (None, ["u,v"], "  ", None),
    ]
    df = spark.createDataFrame(rows, schema)
    got = sorted(map(tuple, unpack_values(df, "ord", ["highway", "cycleway"], only_packed=True).collect()), key=str)
    assert got == sorted(
        [(1, "highway", 1, "a"), (1, "highway", 2, "b"), (1, "highway", 3, "c"), (2, "cycleway", 1, "p"), (2, "cycleway", 2, "q"), (None, "highway", 1, "u"), (None, "highway", 2, "v")],
        key=str,
    )
    every = unpack_values(df, "ord", ["highway", "cycleway"])
    assert every.where("ord = 3").count() == 2
    empty = unpack_values(spark.createDataFrame([], T._parse_datatype_string(schema)), "ord", ["highway"])
    assert empty.count() == 0
