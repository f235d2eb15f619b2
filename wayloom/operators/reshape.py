"""Reshaping tables: columns picked, renamed, spread and unfolded."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Categories that one_hot turns into columns at most.
MAX_CATEGORIES = 10_000


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def move_column(df: DataFrame, column: str, position: int) -> DataFrame:
    """The column moved to a position; negative ones count from the end."""
    rest = [c for c in df.columns if c != column]
    at = position if position >= 0 else len(rest) + 1 + position
    return df.select(*[_quoted(c) for c in [*rest[:at], column, *rest[at:]]])


def first_column(df: DataFrame, column: str) -> DataFrame:
    return move_column(df, column, 0)


def last_column(df: DataFrame, column: str) -> DataFrame:
    return move_column(df, column, -1)


def select_columns(df: DataFrame, columns: Sequence[str], prefix: str = "", suffix: str = "") -> DataFrame:
    """The columns that exist, in the order asked for, renamed with prefix and suffix."""
    return df.select(*[_quoted(c).alias(prefix + c + suffix) for c in columns if c in df.columns])


def no_space_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.replace(" ", "_") for c in df.columns])


def flatten_struct_names(df: DataFrame, delimiter: str = "_") -> DataFrame:
    """Struct columns as one column for each field, named by the path."""
    def paths(prefix: list[str], kind: T.DataType):
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                yield from paths([*prefix, f.name], f.dataType)
        else:
            yield prefix

    return df.select(*[F.col(".".join(f"`{p}`" for p in path)).alias(delimiter.join(path)) for path in paths([], df.schema)])


def map_columns(df: DataFrame, f: Callable[[Column], Column], columns: Sequence[str] | None = None, kinds: Sequence[str] | None = None) -> DataFrame:
    """``f`` over the columns named, or those of the types named, or all numeric ones."""
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    chosen = columns if columns is not None else [c for c, k in df.dtypes if (k in kinds if kinds is not None else k in numeric or k.startswith("decimal"))]
    return df.withColumns({c: f(_quoted(c)) for c in chosen})


def one_hot(df: DataFrame, column: str, prefix: str = "", zero: int = 0, drop: bool = True) -> DataFrame:
    """A 0/1 column for each category in order, where the column stood; null is zero in all.
    Names that exist already are skipped. The categories are counted before they become columns."""
    found = [r[0] for r in df.select(_quoted(column)).where(_quoted(column).isNotNull()).distinct().limit(MAX_CATEGORIES + 1).collect()]
    if len(found) > MAX_CATEGORIES:
        raise ValueError(f"{column} has more than {MAX_CATEGORIES} categories")
    made = [F.when(_quoted(column) == v, 1).otherwise(zero).alias(f"{prefix}{v}") for v in sorted(found) if f"{prefix}{v}" not in df.columns]
    at = df.columns.index(column)
    kept = [] if drop else [_quoted(column)]
    return df.select(*[_quoted(c) for c in df.columns[:at]], *kept, *made, *[_quoted(c) for c in df.columns[at + 1 :]])


def explode_list(df: DataFrame, column: str, keep: Sequence[str], position: str | None = None) -> DataFrame:
    """One row for each item that isn't null; null lists give none. ``position`` counts from 0."""
    out = df.select(*[_quoted(k) for k in keep], F.posexplode(_quoted(column)).alias("_pos", column)).where(_quoted(column).isNotNull())
    return out.withColumnRenamed("_pos", position) if position else out.drop("_pos")


def explode_parallel(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Several lists unfolded side by side; shorter ones are filled with null."""
    rest = [_quoted(c) for c in df.columns if c not in columns]
    return df.select(*rest, F.inline(F.arrays_zip(*[_quoted(c) for c in columns])))


def spread_list(df: DataFrame, column: str, names: Sequence[str], drop: bool = True) -> DataFrame:
    """The items of a list as columns; missing ones are null."""
    out = df.withColumns({n: F.get(_quoted(column), F.lit(i)) for i, n in enumerate(names)})
    return out.drop(column) if drop else out


def single_parts(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """One row for each part of a multi-part geometry, with ``part`` from 0."""
    rest = [_quoted(c) for c in df.columns if c != geometry]
    return df.select(*rest, F.posexplode(_quoted(geometry)).alias("part", geometry))


def multi_parts(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    return df.withColumn(geometry, F.array(_quoted(geometry)))


def valid_geometries(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """Without null and empty geometries."""
    return df.where(F.size(_quoted(geometry)) > 0)


def without_z(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """Lines of (x, y[, z]) as lines of (x, y)."""
    return df.withColumn(geometry, F.transform(_quoted(geometry), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))))
