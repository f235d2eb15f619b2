"""Map tags (``map<string,string>``) to typed street attributes, in Column expressions.

Always the raw tags are read; nothing is written back among them. A null map
gives null attributes.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How units are written, and their size in metres, kilometres and km/h.
LENGTH_UNITS = {"km": 1000.0, "kilometre": 1000.0, "kilometres": 1000.0, "kilometer": 1000.0, "kilometers": 1000.0, "ft": 0.3048, "feet": 0.3048, "in": 0.0254, "inch": 0.0254, "inches": 0.0254, "mi": 1609.34, "mile": 1609.34, "miles": 1609.34}
DISTANCE_UNITS = {"m": 0.001, "metre": 0.001, "metres": 0.001, "meter": 0.001, "meters": 0.001, "ft": 0.0003048, "feet": 0.0003048, "in": 2.54e-5, "inch": 2.54e-5, "inches": 2.54e-5, "mi": 1.60934, "mile": 1.60934, "miles": 1.60934}
SPEED_UNITS = {"mph": 1.60934}
UNITS = {"length": LENGTH_UNITS, "distance": DISTANCE_UNITS, "speed": SPEED_UNITS, None: {}}
FEET_PER_METRE, MILES_PER_KM = 3.28084, 0.621371

# The keys and values that variables are read from.
CYCLE_KEYS = ["cycleway", "cycleway:backward", "cycleway:right", "cycleway:left", "cycleway:both"]
PARKING_KEYS = ["parking:lane:right", "parking:lane:left", "parking:lane:both"]
TURN_KEYS = ["turn:lanes", "turn:lanes:forward", "turn:lanes:backward"]
SPEED_KEYS = ["maxspeed", "maxspeed:forward", "maxspeed:backward"]
ROUTE_HIGHWAYS = ["primary", "primary_link", "secondary", "secondary_link", "tertiary", "tertiary_link", "unclassified", "residential"]
PATH_RULES = {
    "track": (["designated", "official"], True),
    "path": (["yes", "designated", "official"], False),
    "pedestrian": (["yes", "official"], False),
    "footway": (["yes", "official"], False),
}
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def key_matches(key: Column, keys: Iterable[str], regex: bool = False) -> Column:
    """Whether a key is listed, or begins like one of the patterns."""
    if regex:
        return key.rlike("^(?:" + "|".join(k.removeprefix("^") for k in keys) + ")")
    return key.isin(*keys)


def parse_number(value: Column, kind: str | None = None) -> Column:
    """A bare number, or 'number unit' turned into metres ('length'), kilometres
    ('distance') or km/h ('speed'); an unknown unit leaves the number, anything else is null."""
    text = F.trim(F.regexp_replace(value, r"[\s ]+", " "))
    parts = F.split(text, " ")
    number = F.when(parts[0].rlike(NUMBER), parts[0].cast("double"))
    factor = F.lit(1.0)
    if UNITS[kind]:
        table = F.create_map(*[F.lit(x) for pair in UNITS[kind].items() for x in pair])
        factor = F.coalesce(F.try_element_at(table, F.get(parts, F.lit(1))), F.lit(1.0))
    return F.when(F.size(parts) == 1, number).when(F.size(parts) == 2, number * factor)


def any_value(tags: Column, keys: Iterable[str], values: Iterable[str], false_values: Iterable[str] = ()) -> Column:
    """True where any key has one of the values; else false where one has a false value; else null."""
    keys, values, false_values = list(keys), list(values), list(false_values)
    at = [F.try_element_at(tags, F.lit(k)) for k in keys]
    hit = F.coalesce(F.array_contains(F.array(*[F.coalesce(v.isin(*values), F.lit(False)) for v in at]), True), F.lit(False))
    out = F.when(hit, True)
    if false_values:
        no = F.array_contains(F.array(*[F.coalesce(v.isin(*false_values), F.lit(False)) for v in at]), True)
        out = out.when(no, False)
    return out


def combination(tags: Column, wanted: Mapping[str, str]) -> Column:
    """True where all keys have their values, else null."""
    hit = F.lit(True)
    for key, value in wanted.items():
        hit = hit & F.coalesce(F.try_element_at(tags, F.lit(key)) == value, F.lit(False))
    return F.when(hit, True)


def numbers(tags: Column, keys: Iterable[str], kind: str | None = None, regex: bool = False) -> Column:
    """The parsed numbers of all matching keys, without those that state none."""
    keys = list(keys)
    own = F.map_values(F.map_filter(tags, lambda k, _: key_matches(k, keys, regex)))
    return F.filter(F.transform(own, lambda v: parse_number(v, kind)), lambda x: x.isNotNull())


def count_values(tags: Column, keys: Iterable[str], values: Iterable[str], full_match: bool = True) -> Column:
    """How often values occur under keys, as whole values or as parts of them; null for never.
    A part is counted for each value that contains it."""
    total = F.lit(0)
    for key in keys:
        at = F.try_element_at(tags, F.lit(key))
        for value in values:
            one = (at == value).cast("int") if full_match else F.regexp_count(at, F.lit(value))
            total = total + F.coalesce(one, F.lit(0))
    return F.when(total > 0, total)


def _either(tags: Column, highway: str, values: list[str], closed: bool) -> Column:
    road = F.coalesce(F.try_element_at(tags, F.lit("highway")) == highway, F.lit(False))
    for_bikes = F.lit(False)
    for key in ("bicycle", "bike"):
        for_bikes = for_bikes | F.coalesce(F.try_element_at(tags, F.lit(key)).isin(*values), F.lit(False))
    hit = road & for_bikes
    return hit & F.coalesce(F.try_element_at(tags, F.lit("motor_vehicle")) == "no", F.lit(False)) if closed else hit


def way_variables(tags: Column, imperial: bool = False) -> dict[str, Column]:
    """The variables of ways by name."""
    def scaled(value: Column, factor: float) -> Column:
        return F.bround(value * factor, 0) if imperial else value

    path = F.coalesce(F.try_element_at(tags, F.lit("highway")) == "cycleway", F.lit(False))
    for highway, (values, closed) in PATH_RULES.items():
        path = path | _either(tags, highway, values, closed)
    route = F.coalesce(F.try_element_at(tags, F.lit("highway")).isin(*ROUTE_HIGHWAYS) & (F.try_element_at(tags, F.lit("bicycle")) == "designated"), F.lit(False))
    return {
        "bike_lane": any_value(tags, CYCLE_KEYS, ["lane", "opposite_lane"]),
        "separated_bike_lane": any_value(tags, CYCLE_KEYS, ["track", "opposite_track", "buffered_lane"]),
        "sharrow": any_value(tags, CYCLE_KEYS, ["shared_lane", "shared_busway"]),
        "shoulder": any_value(tags, CYCLE_KEYS, ["shoulder"]),
        "bike_route": F.when(route, True),
        "bike_blvd": any_value(tags, ["highway"], ["living_street"]),
        "off_street_path": F.when(path, True),
        "bike_facility_width": scaled(F.array_min(numbers(tags, ["cycleway.*width$"], "length", regex=True)), FEET_PER_METRE),
        "bike_facility_buffer_width": scaled(F.array_min(numbers(tags, [r"cycleway:buffer(:\w+)?$"], "length", regex=True)), FEET_PER_METRE),
        "parallel_parking": any_value(tags, PARKING_KEYS, ["marked", "parallel", "inline"]),
        "perpendicular_parking": any_value(tags, PARKING_KEYS, ["perpendicular", "orthogonal", "diagonal"]),
        "oneway": any_value(tags, ["oneway"], ["yes", "-1"], ["no"]),
        "curb_to_curb_width": scaled(F.array_min(numbers(tags, ["width", "est_width"], "length")), FEET_PER_METRE),
        "lanes": F.array_max(numbers(tags, ["lanes"])),
        "center_turn_lane": any_value(tags, ["turn:lanes:both_ways"], ["left"]),
        "speed_limit": scaled(F.array_max(numbers(tags, SPEED_KEYS, "speed")), MILES_PER_KM),
        "right_turn_lanes": count_values(tags, TURN_KEYS, ["right", "slight_right"], full_match=False),
        "left_turn_lanes": count_values(tags, TURN_KEYS, ["left", "slight_left"], full_match=False),
    }


def node_variables(tags: Column) -> dict[str, Column]:
    """The variables of nodes by name."""
    return {
        "traffic_signal": any_value(tags, ["highway"], ["traffic_signals", "traffic_signals;crossing", "crossing;traffic_signals"]),
        "stop_sign": any_value(tags, ["highway"], ["stop", "stop;crossing"]),
    }


def parse_tags(elements: DataFrame, variables: Iterable[str] | Mapping[str, str], imperial: bool = False) -> DataFrame:
    """``elements`` (with ``type`` and ``tags``) plus a column for each variable, under its own or
    a given name; variables of ways are null on nodes and the other way round. No shuffle."""
    names = dict(variables) if isinstance(variables, Mapping) else {v: v for v in variables}
    ways, nodes = way_variables(F.col("tags"), imperial), node_variables(F.col("tags"))
    unknown = set(names) - set(ways) - set(nodes)
    if unknown:
        raise ValueError(f"no such variables: {sorted(unknown)}")
    return elements.withColumns(
        {name: F.when(F.col("type") == ("way" if v in ways else "node"), (ways | nodes)[v]) for v, name in names.items()}
    )
