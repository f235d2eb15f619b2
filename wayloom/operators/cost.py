"""Levels and travel times of edges by what they are tagged."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayloom.functions import line as L

# Tag patterns by level, the lowest level first.
LEVEL_TAGS = [
    ["cycleway", "footway", "path", "pedestrian", "service", "steps"],
    ["track"],
    ["residential", "unclassified"],
    ["tertiary", "tertiary_link"],
    ["secondary", "secondary_link"],
    ["primary", "primary_link"],
    ["trunk"],
    ["motorway", "motorway_link"],
]
LEVELS = {tag: level for level, tags in enumerate(LEVEL_TAGS) for tag in tags}


def key_lookup(values: Column, lookup: Sequence[tuple], regex: bool = True) -> Column:
    """The weight of the first entry that any of ``values`` (an array) meets, else null.

    Entries are (key, weight) in order: a text key is searched as a pattern, or
    must be equal without ``regex``; a ``range`` holds whole numbers from its
    start up to its stop; another key must be equal as a number.
    """
    out = None
    for key, weight in lookup:
        hit = F.coalesce(F.exists(values, _meets(key, regex)), F.lit(False))
        out = F.when(hit, F.lit(float(weight))) if out is None else out.when(hit, F.lit(float(weight)))
    return out if out is not None else F.lit(None).cast("double")


def _meets(key, regex: bool) -> Callable[[Column], Column]:
    """Whether a value meets an entry's key."""
    if isinstance(key, str):
        return lambda v: v.cast("string").rlike(key) if regex else v.cast("string") == key
    if isinstance(key, range):
        def inside(v: Column) -> Column:
            x = v.cast("double")
            return (x >= key.start) & (x < key.stop) & (x == F.floor(x)) & (F.pmod(x - key.start, F.lit(float(key.step))) == 0)

        return inside
    return lambda v: v.cast("double") == float(key)


def edge_level(tags: Column, levels: Mapping[str, int] | None = None, default: int = 0) -> Column:
    """The highest level among patterns found anywhere in any of the tags (an array)."""
    found = [F.when(F.coalesce(F.exists(tags, _meets(p, True)), F.lit(False)), v) for p, v in (levels or LEVELS).items()]
    return F.coalesce(F.greatest(*found) if len(found) > 1 else found[0], F.lit(default))


def edge_seconds(
    geometry: Column,
    speed: float = 4.5,
    weights: Column | None = None,
    weight_lookup: Sequence[tuple] | None = None,
    constants: Column | None = None,
    constant_lookup: Sequence[tuple] | None = None,
    custom: Callable[[Column], Column] | None = None,
    regex: bool = True,
) -> Column:
    """Travel time of an edge: length / speed, times a weight, plus a constant, through ``custom``.

    ``weights`` and ``constants`` are arrays looked up in (key, weight) entries;
    without a lookup the first of ``weights`` is the weight itself. No entry and
    a weight of 0 change nothing. An edge without geometry has no length.
    """
    seconds = F.coalesce(L.length(geometry), F.lit(0.0)) / speed
    if weights is not None:
        weight = key_lookup(weights, weight_lookup, regex) if weight_lookup else F.get(weights, F.lit(0)).cast("double")
        seconds = seconds * F.coalesce(F.nullif(weight, F.lit(0.0)), F.lit(1.0))
    if constants is not None and constant_lookup:
        seconds = seconds + F.coalesce(key_lookup(constants, constant_lookup, regex), F.lit(0.0))
    return custom(seconds) if custom else seconds
