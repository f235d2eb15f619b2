"""Packed fields to one row per value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayloom.functions.unpack import unpack_each


def _as_array(df: DataFrame, field: str) -> Column:
    kind = dict(df.dtypes)[field]
    if kind == "array<string>":
        return F.col(field)
    if kind == "string":
        return F.array(F.col(field))
    raise TypeError(f"{field} is {kind}; string or array<string> is needed")


def unpack_values(df: DataFrame, key: str | Sequence[str], fields: Sequence[str], only_packed: bool = False) -> DataFrame:
    """One row per value: the key columns, ``field``, ``pos`` (from 1, through the whole field) and ``item``.

    Rows that are equal in the key and in the field count once; they are
    collapsed before the values are exploded, and with ``only_packed`` after the
    records without packed strings are gone, so little is shuffled. Null fields,
    empty arrays and blank strings give no row. ``only_packed`` keeps the fields
    of which at least one string holds more than one value. Extra columns are
    not carried; the key may hold nulls.
    """
    keys = [key] if isinstance(key, str) else list(key)
    clash = {"field", "pos", "item", "_values"} & set(keys)
    if clash:
        raise ValueError(f"key columns can't be named {sorted(clash)}")
    made = F.array(
        *[F.struct(F.lit(f).alias("field"), unpack_each(_as_array(df, f)).alias("strings")) for f in fields]
    )
    per_field = df.select(*keys, F.inline(made))
    if only_packed:
        per_field = per_field.where(F.exists("strings", lambda s: F.size(s) > 1))
    # equal records collapse: grouping by all columns needs no aggregate buffer, so it stays a hash aggregate
    flat = per_field.select(*keys, "field", F.flatten("strings").alias("_values")).where(F.size("_values") > 0).distinct()
    return flat.select(*keys, "field", F.posexplode("_values").alias("p", "item")).select(
        *keys, "field", (F.col("p") + 1).alias("pos"), "item"
    )
