"""Quantities in mixed units and notations to one common unit."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.functions.quantity import COMMON_UNITS, QuantityReader, size_of, unit_table

#: Rows of the key and source tables that may be broadcast; beyond that the join shuffles.
MAX_LOOKUP_ROWS = 100_000


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``parts`` (number, unit) to batches of (..., _value, _quantity, _default)."""
    reader, known = QuantityReader(), {}
    part = pa.struct([("n", pa.float64()), ("unit", pa.string())])
    for batch in batches:
        table = pa.Table.from_batches([batch])
        parts = []
        for key in zip(*(table.column(c).to_pylist() for c in ("_value", "_quantity", "_default"))):
            got = known.get(key)
            if got is None:
                if len(known) > 200_000:  # memory of a worker is bounded; the values come back anyway
                    known.clear()
                got = known[key] = [{"n": float(n), "unit": u} for n, u in reader.read(*key)]
            parts.append(got)
        names = [n for n in batch.schema.names if n not in ("_value", "_default")]
        out = table.select(names).append_column("_parts", pa.array(parts, pa.list_(part)))
        yield from out.combine_chunks().to_batches()


def _small(df: DataFrame) -> DataFrame:
    """A broadcast hint only for a table whose row count was looked at."""
    return F.broadcast(df) if df.limit(MAX_LOOKUP_ROWS + 1).count() <= MAX_LOOKUP_ROWS else df


def normalize_quantities(
    tags: DataFrame, keys: DataFrame, sources: DataFrame, id_column: str = "tag_id"
) -> DataFrame:
    """``id_column, quantity, amount`` of each record whose value states an amount.

    ``tags`` has the id, ``key, value, source``; ``keys`` has ``key, quantity,
    common_unit``; ``sources`` has ``source, length_unit, speed_unit,
    weight_unit``, the units that a source means when it names none. Units are
    found by an automaton over all their names, the longest at a place wins, and
    a name with several meanings takes the one of the field's quantity; conversion
    factors are joined from a broadcast table. ``amount`` is rounded half to even.
    The only shuffle carries the results, not the texts.

    Null, empty or wordy values, values in units of another quantity, and bare
    numbers whose source is null or unknown give no row. Rows equal in id, key,
    value and source count once. Extra columns are not carried.
    """
    base = {unit: float(size_of(size)) for unit, size in COMMON_UNITS.items()}
    factors = tags.sparkSession.createDataFrame(
        [(c, q, {u: s / size for u, of, s in unit_table() if of == q}) for c, size in base.items() for q in ("length", "speed", "weight")],
        "_common string, _quantity string, _factor map<string, double>",
    )
    wanted = (
        keys.select("key", F.col("quantity").alias("_quantity"), F.col("common_unit").alias("_common"))
        .dropDuplicates(["key"])
        .join(F.broadcast(factors), ["_common", "_quantity"])
    )
    means = sources.select(
        F.col("source").alias("_source"),
        F.inline(
            F.array(
                F.struct(F.lit("length").alias("_of"), F.col("length_unit").alias("_default")),
                F.struct(F.lit("speed").alias("_of"), F.col("speed_unit").alias("_default")),
                F.struct(F.lit("weight").alias("_of"), F.col("weight_unit").alias("_default")),
            )
        ),
    ).dropDuplicates(["_source", "_of"])
    wanted, means = _small(wanted), _small(means)
    rows = (
        tags.select(F.col(id_column).alias("_id"), "key", F.col("value").alias("_value"), F.col("source").alias("_from"))
        .where(F.col("_value").isNotNull() & F.col("key").isNotNull())
        .join(wanted.select("key", "_quantity", "_common"), "key")
        .join(means, (F.col("_from") == F.col("_source")) & (F.col("_quantity") == F.col("_of")), "left")
        .select("_id", "_quantity", "_common", "_value", "_default")
    )
    kind = rows.schema["_id"].dataType.simpleString()
    read = rows.mapInArrow(_read_batches, f"_id {kind}, _quantity string, _common string, _parts array<struct<n: double, unit: string>>")
    total = F.aggregate("_parts", F.lit(0.0), lambda acc, p: acc + p["n"] * F.col("_factor")[p["unit"]])
    return (
        read.where(F.size("_parts") > 0)
        .join(F.broadcast(factors), ["_common", "_quantity"])
        .select(F.col("_id").alias(id_column), F.col("_quantity").alias("quantity"), F.bround(F.round(total, 6), 0).cast("bigint").alias("amount"))
        .distinct()
    )
