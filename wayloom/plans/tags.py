"""Queries of tag variables, street names and table reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayloom.functions import lists, names, tags
from wayloom.operators import intervals, reshape
from wayloom.operators.staged import staged
from wayloom.plans.tables import r, table
from wayloom.sources.overpass import elements_from_tags, examine_tags

QUERIES, SQL = {}, {}
c = F.col

SQL_TAGS = """t AS (SELECT element_id, element_type, key, value FROM (SELECT *, row_number() OVER (PARTITION BY element_id, element_type, key ORDER BY edited_at DESC, tag_id DESC, value DESC) n
 FROM tags_dict WHERE key IS NOT NULL AND value IS NOT NULL) WHERE n = 1)"""


def _elements(spark, sf_dir):
    return elements_from_tags(table(spark, sf_dir, "tags_dict"))


def _edge_elements(spark, sf_dir):
    """Each edge record as a way with its access fields and first highway value as tags."""
    e = table(spark, sf_dir, "edges").select("ord", "highway", "bicycle", "cycleway", "motor_vehicle").distinct()
    pairs = [("highway", F.get("highway", F.lit(0))), ("bicycle", c("bicycle")), ("cycleway", c("cycleway")), ("motor_vehicle", c("motor_vehicle"))]
    entries = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in pairs]), lambda x: x["v"].isNotNull())
    return e.select(c("ord").alias("id"), F.lit("way").alias("type"), F.map_from_entries(entries).alias("tags"))


def _part_elements(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    parking = F.element_at(F.array(*[F.lit(x) for x in ("parallel", "diagonal", "marked", "no", "orthogonal")]), (c("p_size") % 5 + 1).cast("int"))
    tag = F.create_map(F.lit("parking:lane:right"), parking, F.lit("turn:lanes:both_ways"), F.when(c("p_size") % 3 == 0, "left").otherwise("none"))
    return p.select(c("p_partkey").alias("id"), F.lit("way").alias("type"), tag.alias("tags"))


def _variable(name, elements, sql):
    QUERIES[f"osm_{name}"] = lambda spark, sf_dir: tags.parse_tags(elements(spark, sf_dir), [name]).select("id", name).where(F.col(name).isNotNull())
    SQL[f"osm_{name}"] = sql


_E = "(SELECT DISTINCT ord id, highway[1] highway, bicycle, cycleway, motor_vehicle FROM edges)"
for name, where in {
    "bike_lane": "cycleway IN ('lane','opposite_lane')",
    "separated_bike_lane": "cycleway IN ('track','opposite_track','buffered_lane')",
    "sharrow": "cycleway IN ('shared_lane','shared_busway')",
    "shoulder": "cycleway = 'shoulder'",
    "bike_route": "bicycle = 'designated' AND highway IN ('primary','primary_link','secondary','secondary_link','tertiary','tertiary_link','unclassified','residential')",
    "bike_blvd": "highway = 'living_street'",
    "off_street_path": """highway = 'cycleway' OR (highway = 'track' AND bicycle IN ('designated','official') AND motor_vehicle = 'no')
      OR (highway = 'path' AND bicycle IN ('yes','designated','official')) OR (highway IN ('pedestrian','footway') AND bicycle IN ('yes','official'))""",
}.items():
    _variable(name, _edge_elements, f"SELECT id, true AS {name} FROM {_E} WHERE {where}")
for name, values in {"parallel_parking": "'parallel','marked'", "perpendicular_parking": "'diagonal','orthogonal'"}.items():
    _variable(name, _part_elements, f"SELECT p_partkey id, true AS {name} FROM part WHERE ['parallel','diagonal','marked','no','orthogonal'][p_size%5+1] IN ({values})")
_variable("center_turn_lane", _part_elements, "SELECT p_partkey id, true AS center_turn_lane FROM part WHERE p_size % 3 = 0")


def _sql_number(units):
    text = r"trim(regexp_replace(value, '[\s\x{00a0}]+', ' ', 'g'))"
    parts = f"string_split({text},' ')"
    factor = "CASE " + " ".join(f"WHEN {parts}[2] = '{u}' THEN {f}::DOUBLE" for u, f in units.items()) + " ELSE 1.0::DOUBLE END" if units else "1.0::DOUBLE"
    return rf"CASE WHEN len({parts}) <= 2 AND regexp_full_match({parts}[1], '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?') THEN try_cast({parts}[1] AS DOUBLE) * CASE WHEN len({parts}) = 2 THEN {factor} ELSE 1.0::DOUBLE END END"


def _number_variable(name, how, keys_sql, units, scale=1.0):
    QUERIES[f"osm_{name}"] = lambda spark, sf_dir: tags.parse_tags(_elements(spark, sf_dir), [name]).select("id", r(c(name), name)).where(F.col(name).isNotNull())
    SQL[f"osm_{name}"] = f"WITH {SQL_TAGS} SELECT element_id id, round({how}(v),4)+0.0 AS {name} FROM (SELECT element_id, {_sql_number(units)} v FROM t WHERE element_type='way' AND {keys_sql}) WHERE v IS NOT NULL GROUP BY 1"


_number_variable("bike_facility_width", "min", "regexp_matches(key,'^cycleway.*width$')", tags.LENGTH_UNITS)
_number_variable("bike_facility_buffer_width", "min", r"regexp_matches(key,'^cycleway:buffer(:\w+)?$')", tags.LENGTH_UNITS)
_number_variable("curb_to_curb_width", "min", "key IN ('width','est_width')", tags.LENGTH_UNITS)
_number_variable("lanes", "max", "key = 'lanes'", {})
_number_variable("speed_limit", "max", "key IN ('maxspeed','maxspeed:forward','maxspeed:backward')", tags.SPEED_UNITS)
_variable("oneway", _elements, f"WITH {SQL_TAGS} SELECT element_id id, value IN ('yes','-1') AS oneway FROM t WHERE element_type='way' AND key='oneway' AND value IN ('yes','-1','no')")
for side in ("right", "left"):
    _variable(f"{side}_turn_lanes", _elements, f"""WITH {SQL_TAGS}, n AS (SELECT element_id id, sum(len(regexp_extract_all(value,'{side}')) + len(regexp_extract_all(value,'slight_{side}'))) n
      FROM t WHERE element_type='way' AND key IN ('turn:lanes','turn:lanes:forward','turn:lanes:backward') GROUP BY 1) SELECT id, CAST(n AS INT) AS {side}_turn_lanes FROM n WHERE n > 0""")
for name, values in {"traffic_signal": "'traffic_signals','traffic_signals;crossing','crossing;traffic_signals'", "stop_sign": "'stop','stop;crossing'"}.items():
    _variable(name, _elements, f"WITH {SQL_TAGS} SELECT element_id id, true AS {name} FROM t WHERE element_type='node' AND key='highway' AND value IN ({values})")

QUERIES["osm_number_parse"] = lambda spark, sf_dir: (
    table(spark, sf_dir, "tags_dict").select("tag_id", "value").distinct().select("tag_id", *[r(tags.parse_number(c("value"), k), k or "plain") for k in (None, "length", "distance", "speed")])
)
SQL["osm_number_parse"] = "SELECT tag_id, " + ", ".join(f"round({_sql_number(u)},4)+0.0 AS {k or 'plain'}" for k, u in tags.UNITS.items()) + " FROM (SELECT DISTINCT tag_id, value FROM tags_dict)"
QUERIES["examine_tags"] = lambda spark, sf_dir: examine_tags(_elements(spark, sf_dir), ["highway", "cycleway.*", "oneway"])
SQL["examine_tags"] = f"WITH {SQL_TAGS} SELECT element_type AS type, key, value, count(*) AS elements FROM t WHERE regexp_matches(key, '^(highway|cycleway.*|oneway)') GROUP BY ALL"

_INIT = "list_aggregate(list_transform(string_split(lower({0}),' '), lambda w: upper(w[1:1]) || w[2:]),'string_agg',' ')"
_DIR = "MAP {" + ",".join(f"'{k}':'{v}'" for k, v in (names.DIRECTIONS | {v: v for v in names.DIRECTIONS.values()}).items()) + "}"
_TYP = "MAP {" + ",".join(f"'{k}':'{v}'" for k, v in (names.TYPES | {v: v for v in names.TYPES.values()}).items()) + "}"
QUERIES["street_type_std"] = lambda spark, sf_dir: table(spark, sf_dir, "match_features").select("id", names.standardize_streetname(c("name")).alias("standard")).where("standard is not null")
SQL["street_type_std"] = rf"""WITH w AS (SELECT id, string_split(trim(regexp_replace(name,'\s+',' ','g')),' ') w FROM match_features WHERE name IS NOT NULL)
 SELECT id, list_aggregate(list_transform(w, lambda x, i: CASE WHEN len(w)>1 AND i=1 AND {_DIR}[lower(x)] IS NOT NULL THEN upper({_DIR}[lower(x)])
  WHEN len(w)>2 AND i=len(w) AND {_DIR}[lower(x)] IS NOT NULL AND {_TYP}[lower(w[len(w)-1])] IS NOT NULL THEN upper({_DIR}[lower(x)])
  WHEN len(w)>1 AND (i=len(w) OR (len(w)>2 AND i=len(w)-1 AND {_DIR}[lower(w[len(w)])] IS NOT NULL)) AND {_TYP}[lower(x)] IS NOT NULL THEN upper({_TYP}[lower(x)][1:1]) || {_TYP}[lower(x)][2:] ELSE upper(x[1:1]) || lower(x[2:]) END),'string_agg',' ') AS standard FROM w"""
QUERIES["name_fuzzy"] = lambda spark, sf_dir: (
    table(spark, sf_dir, "edges").select("ord", "name", "u").distinct().where("name is not null").select("ord", r(names.likeness(F.lower("name"), F.lower(F.concat(F.split("name", " ")[0], F.lit(" street")))), "likeness"))
)
SQL["name_fuzzy"] = """SELECT ord, round(1 - levenshtein(a,b)::DOUBLE/greatest(length(a),length(b)),4)+0.0 AS likeness FROM
 (SELECT ord, lower(name) a, lower(string_split(name,' ')[1] || ' street') b FROM (SELECT DISTINCT ord, name, u FROM edges) WHERE name IS NOT NULL)"""
QUERIES["name_token_set"] = lambda spark, sf_dir: (
    staged(table(spark, sf_dir, "match_features").select("id", "name").distinct(), {"standard": names.standardize_streetname(c("name"))})
    .select("id", names.name_score(c("standard"), c("name")).alias("score")).select("id", r(c("score"), "score"))
)

QUERIES["select_prefix"] = lambda spark, sf_dir: reshape.select_columns(table(spark, sf_dir, "nation"), ["n_name", "missing", "n_nationkey"], "a_", "_z")
SQL["select_prefix"] = "SELECT n_name AS a_n_name_z, n_nationkey AS a_n_nationkey_z FROM nation"
QUERIES["one_hot_segment"] = lambda spark, sf_dir: reshape.one_hot(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "seg_")
SQL["one_hot_segment"] = "SELECT c_custkey, " + ", ".join(f"CAST(c_mktsegment = '{s}' AS INT) AS \"seg_{s}\"" for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM customer"
QUERIES["explode_list"] = lambda spark, sf_dir: reshape.explode_list(table(spark, sf_dir, "edges").select("ord", "highway").distinct(), "highway", ["ord"], "i")
SQL["explode_list"] = "SELECT * FROM (SELECT ord, CAST(i-1 AS INT) i, highway[i] highway FROM (SELECT ord, highway, unnest(range(1,len(highway)+1)) i FROM (SELECT DISTINCT ord, highway FROM edges))) WHERE highway IS NOT NULL"
QUERIES["explode_parallel"] = lambda spark, sf_dir: reshape.explode_parallel(table(spark, sf_dir, "edges").select("ord", "highway", F.reverse("highway").alias("turned")).distinct(), ["highway", "turned"])
SQL["explode_parallel"] = "SELECT ord, highway[i] highway, highway[len(highway)+1-i] turned FROM (SELECT ord, highway, unnest(range(1,len(highway)+1)) i FROM (SELECT DISTINCT ord, highway FROM edges))"
QUERIES["spread_list"] = lambda spark, sf_dir: reshape.spread_list(table(spark, sf_dir, "edges").select("ord", "highway").distinct(), "highway", ["h0", "h1"])
SQL["spread_list"] = "SELECT ord, highway[1] h0, highway[2] h1 FROM (SELECT DISTINCT ord, highway FROM edges)"


def _spans(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("id"), c("l_quantity").alias("lo"), (c("l_quantity") + 1 + c("l_linenumber")).alias("hi"))


_SQL_ISLANDS = """i AS (SELECT l_orderkey id, l_quantity lo, l_quantity+1+l_linenumber hi FROM lineitem),
 n AS (SELECT *, CASE WHEN max(hi) OVER (PARTITION BY id ORDER BY lo,hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= lo THEN 0 ELSE 1 END s FROM i),
 g AS (SELECT *, sum(s) OVER (PARTITION BY id ORDER BY lo,hi ROWS UNBOUNDED PRECEDING) g FROM n), m AS (SELECT id, min(lo) lo, max(hi) hi FROM g GROUP BY id, g)"""
QUERIES["merge_intervals"] = lambda spark, sf_dir: intervals.islands(_spans(spark, sf_dir), ["id"])
SQL["merge_intervals"] = f"WITH {_SQL_ISLANDS} SELECT id, lo, hi FROM m"
QUERIES["merge_intervals_array"] = lambda spark, sf_dir: (
    _spans(spark, sf_dir).groupBy("id").agg(lists.merge_intervals(F.collect_list(F.struct("lo", "hi"))).alias("m")).select("id", F.inline("m"))
)
SQL["merge_intervals_array"] = SQL["merge_intervals"]
QUERIES["interval_gaps"] = lambda spark, sf_dir: intervals.gaps(_spans(spark, sf_dir), ["id"])
SQL["interval_gaps"] = f"WITH {_SQL_ISLANDS} SELECT * FROM (SELECT id, hi lo, lead(lo) OVER (PARTITION BY id ORDER BY lo) hi FROM m) WHERE hi IS NOT NULL"
QUERIES["run_groups"] = lambda spark, sf_dir: (
    intervals.runs(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], "event_type")
    .groupBy("user_id", "run").agg(F.count("*").alias("n"), F.min("event_type").alias("event_type"))
)
SQL["run_groups"] = """WITH f AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND row_number() OVER w > 1 THEN 0 ELSE 1 END s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 r AS (SELECT *, CAST(sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) run FROM f)
 SELECT user_id, run, count(*) n, min(event_type) event_type FROM r GROUP BY user_id, run"""
