import pyarrow as pa
from pyspark.sql import functions as F

from wayloom.operators import routing


def test_an_origin_is_searched_once_however_many_batches_hold_it():
    rows = [("a", str(k)) for k in range(5)] + [("b", "x")] + [("c", str(k)) for k in range(4)]
    batches = [pa.RecordBatch.from_pylist([{"origin": o, "destination": d} for o, d in rows[k : k + 2]]) for k in range(0, len(rows), 2)]
    assert list(routing.by_origin(batches)) == [("a", [str(k) for k in range(5)]), ("b", ["x"]), ("c", [str(k) for k in range(4)])]
    assert list(routing.by_origin([])) == []


def test_steps_without_routes(spark):
    grid = [(x * 20 + y, (x + dx) * 20 + y + dy, 1.0 + (x * y) % 3) for x in range(20) for y in range(19) for dx, dy in ((0, 1), (1, 0)) if x + dx < 20]
    edges = spark.createDataFrame([(str(u), str(v), w) for u, v, w in grid], "u string, v string, length double")
    pairs = spark.range(400).select(F.explode(F.array(F.lit("0"), F.lit("25"), F.lit("no such"))).alias("origin"), F.col("id").cast("string").alias("destination"))
    ordered = lambda df: sorted(map(tuple, df.collect()))
    key = ("origin", "destination", F.coalesce("cost", F.lit(-1.0)))
    want = ordered(routing.shortest_paths(pairs, edges).select(*key, F.coalesce(F.when(F.col("route").isNotNull(), F.size("route")), F.lit(0))))
    assert len(want) == 1200
    for limit in (routing.MAX_BROADCAST_BYTES, 0):
        assert ordered(routing.shortest_paths(pairs, edges, max_broadcast=limit, routes=False).select(*key, F.coalesce("steps", F.lit(0)))) == want
