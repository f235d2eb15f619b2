"""Lists, intervals and maps in Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayloom.functions.let import let


def listify(value: Column) -> Column:
    return F.array(value)


def unlistify(values: Column) -> Column:
    """The only item, or null for none or several."""
    return F.when(F.size(values) == 1, F.get(values, F.lit(0)))


def flatten(values: Column, levels: int = 1) -> Column:
    return reduce(lambda v, _: F.flatten(v), range(levels), values)


def drop_repeats(values: Column) -> Column:
    """Each value where it first occurs."""
    return F.array_distinct(values)


def first(values: Column) -> Column:
    return F.get(values, F.lit(0))


def last(values: Column) -> Column:
    return F.get(values, F.size(values) - 1)


def middle(values: Column) -> Column:
    return F.get(values, F.floor(F.size(values) / 2).cast("int"))


def concatenate(values: Column, separator: str = ", ") -> Column:
    return F.array_join(F.transform(values, lambda v: v.cast("string")), separator)


def merge_maps(*maps: Column) -> Column:
    """key -> all its values in the order of the maps; a map without the key adds nothing."""
    keys = F.array_distinct(F.concat(*[F.coalesce(F.map_keys(m), F.array().cast("array<string>")) for m in maps]))
    return F.map_from_arrays(
        keys, F.transform(keys, lambda k: F.filter(F.array(*[F.try_element_at(m, k) for m in maps]), lambda v: v.isNotNull()))
    )


def any_true(values: Column) -> Column:
    """Whether any number is neither null, NaN nor zero."""
    return F.exists(values, lambda v: F.coalesce(F.nanvl(v.cast("double"), F.lit(0.0)), F.lit(0.0)) != 0)


def merge_intervals(intervals: Column) -> Column:
    """``array<struct<lo,hi>>`` as disjoint closed intervals in order; touching ones merge."""
    def grow(so_far: Column, nxt: Column) -> Column:
        tail = F.element_at(so_far, -1)
        joined = F.concat(F.slice(so_far, 1, F.size(so_far) - 1), F.array(F.struct(tail["lo"].alias("lo"), F.greatest(tail["hi"], nxt["hi"]).alias("hi"))))
        return F.when(nxt["lo"] <= tail["hi"], joined).otherwise(F.concat(so_far, F.array(nxt)))

    ordered = F.array_sort(F.transform(intervals, lambda i: F.struct(i["lo"].alias("lo"), i["hi"].alias("hi"))))
    return let(ordered, lambda o: F.when(F.size(o) > 0, F.aggregate(F.slice(o, 2, F.greatest(F.size(o), F.lit(1))), F.slice(o, 1, 1), grow)).otherwise(o))
