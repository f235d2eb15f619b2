"""Street names: parts, usual abbreviations and likeness."""

from __future__ import annotations

import difflib
from itertools import combinations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayloom.functions.let import let

# Directions, and the commoner spellings of kinds of streets with their abbreviations, as in the postal service's list (Publication 28, appendix C1).
DIRECTIONS = {"north": "n", "northeast": "ne", "east": "e", "southeast": "se", "south": "s", "southwest": "sw", "west": "w", "northwest": "nw"}
SPELLINGS = {
    "allee": "aly", "alley": "aly", "ally": "aly", "anex": "anx", "annex": "anx", "annx": "anx", "arcade": "arc", "av": "ave", "avenue": "ave",
    "bayoo": "byu", "bayou": "byu", "beach": "bch", "bend": "bnd", "bluf": "blf", "bluff": "blf", "bottom": "btm", "boul": "blvd",
    "boulevard": "blvd", "boulv": "blvd", "branch": "br", "bridge": "brg", "brook": "brk", "burg": "bg", "bypa": "byp", "bypas": "byp",
    "bypass": "byp", "byps": "byp", "camp": "cp", "canyon": "cyn", "cape": "cpe", "causeway": "cswy", "causwa": "cswy", "cen": "ctr", "cent": "ctr",
    "center": "ctr", "centre": "ctr", "circ": "cir", "circle": "cir", "cliff": "clf", "club": "clb", "common": "cmn", "corner": "cor",
    "course": "crse", "court": "ct", "cove": "cv", "creek": "crk", "crescent": "cres", "crest": "crst", "crossing": "xing", "crossroad": "xrd",
    "crsent": "cres", "crt": "ct", "curve": "curv", "dale": "dl", "dam": "dm", "div": "dv", "divide": "dv", "driv": "dr", "drive": "dr", "drv": "dr",
    "estate": "est", "exp": "expy", "expr": "expy", "express": "expy", "expressway": "expy", "expw": "expy", "extension": "ext", "extn": "ext",
    "falls": "fls", "ferry": "fry", "field": "fld", "flat": "flt", "ford": "frd", "forest": "frst", "forg": "frg", "forge": "frg", "fork": "frk",
    "fort": "ft", "freeway": "fwy", "frry": "fry", "frt": "ft", "garden": "gdn", "gateway": "gtwy", "glen": "gln", "green": "grn", "grov": "grv",
    "grove": "grv", "harb": "hbr", "harbor": "hbr", "haven": "hvn", "height": "hts", "heights": "hts", "highway": "hwy", "hill": "hl", "hiway": "hwy",
    "hiwy": "hwy", "hollow": "holw", "ht": "hts", "hway": "hwy", "inlet": "inlt", "island": "is", "jction": "jct", "junction": "jct", "key": "ky",
    "knol": "knl", "knoll": "knl", "la": "ln", "lake": "lk", "landing": "lndg", "lane": "ln", "ldge": "ldg", "light": "lgt", "lock": "lck",
    "lodge": "ldg", "manor": "mnr", "meadow": "mdw", "mill": "ml", "mnt": "mt", "mount": "mt", "mountain": "mtn", "neck": "nck", "orchard": "orch",
    "overpass": "opas", "parkway": "pkwy", "passage": "psge", "pine": "pne", "pk": "park", "pkway": "pkwy", "pky": "pkwy", "place": "pl",
    "plain": "pln", "plaza": "plz", "plza": "plz", "point": "pt", "port": "prt", "prairie": "pr", "prk": "park", "ranch": "rnch", "rapid": "rpd",
    "rdge": "rdg", "rest": "rst", "ridge": "rdg", "river": "riv", "rivr": "riv", "road": "rd", "route": "rte", "rvr": "riv", "shoal": "shl",
    "shoar": "shr", "shore": "shr", "skyway": "skwy", "spring": "spg", "squ": "sq", "square": "sq", "station": "sta", "stn": "sta", "str": "st",
    "stream": "strm", "street": "st", "summit": "smt", "terr": "ter", "terrace": "ter", "tr": "trl", "trace": "trce", "track": "trak", "trail": "trl",
    "trk": "trak", "tunel": "tunl", "tunnel": "tunl", "turnpike": "tpke", "underpass": "upas", "union": "un", "valley": "vly", "viaduct": "via",
    "view": "vw", "vill": "vlg", "village": "vlg", "ville": "vl", "vist": "vis", "vista": "vis", "vst": "vis", "vsta": "vis", "well": "wl",
    "wy": "way",
}
# Kinds whose plural is abbreviated like the singular; all others take an s.
SAME_PLURAL = frozenset("frst holw loop ln park path pike pkwy rnch trak trce trl tunl walk spur isle".split())


def without_vowels(word: str) -> set[str]:
    """A word of six letters or more with one or more of its vowels left out, but for the first letter: how kinds of streets are cut short."""
    at = [k for k in range(1, len(word)) if word[k] in "aeiou"] if len(word) > 5 else []
    cut = {"".join(c for k, c in enumerate(word) if k not in out) for n in range(1, len(at) + 1) for out in combinations(at, n)}
    return {w for w in cut if len(w) > 2}


def spellings() -> dict[str, str]:
    """Every spelling with its abbreviation: SPELLINGS, those cut short by rule, and the plurals of both."""
    cut = {v: a for s, a in sorted(SPELLINGS.items()) for v in without_vowels(s)}
    known = cut | SPELLINGS
    plural = {f"{s}{'es' if s.endswith(('ch', 'sh', 'ss')) else 's'}": a if a in SAME_PLURAL or a.endswith("s") else f"{a}s" for s, a in known.items()}
    short = {f"{a}s": a for a in SAME_PLURAL}
    return plural | short | known


TYPES = spellings()


def _table(entries: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def direction(word: Column) -> Column:
    """A direction as its upper-case abbreviation; another word in upper case."""
    return F.upper(F.coalesce(F.try_element_at(_table(DIRECTIONS), F.lower(word)), word))


def street_type(word: Column, types: dict[str, str] | None = None) -> Column:
    """A kind of street as its title-case abbreviation; another word in title case."""
    return F.initcap(F.coalesce(F.try_element_at(_table(types or TYPES), F.lower(word)), F.lower(word)))


def standardize_streetname(name: Column, types: dict[str, str] | None = None) -> Column:
    """A leading and a trailing direction abbreviated, the kind of street at the end (or before a trailing direction) too, the rest in title case.

    Names of one word are never taken for a direction or a kind; a trailing
    direction is one only after a kind of street (Main Street West, but not
    Little North). A rule-based stand-in for a statistical tagger; ``types``
    replaces the spellings known.
    """
    known = types or TYPES
    leads = [*DIRECTIONS, *DIRECTIONS.values()]
    tails = [*known, *set(known.values())]

    def of(words: Column) -> Column:
        n = F.size(words)
        is_kind = lambda w: F.lower(w).isin(*tails)
        after = (n > 2) & F.lower(F.get(words, n - 1)).isin(*leads) & is_kind(F.get(words, n - 2))
        kind_at = F.when(after, n - 2).otherwise(n - 1)
        return F.array_join(
            F.transform(
                words,
                lambda w, i: F.when((n > 1) & (i == 0) & F.lower(w).isin(*leads), direction(w))
                .when(after & (i == n - 1), direction(w))
                .when((n > 1) & (i == kind_at) & is_kind(w), street_type(w, known))
                .otherwise(F.initcap(F.lower(w))),
            ),
            " ",
        )

    return let(F.split(F.trim(F.regexp_replace(name, r"\s+", " ")), " "), of)


def likeness(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, in the JVM; 1 for two empty names, null for a null one."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def _ratio(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


def token_set_ratio(a: str | None, b: str | None) -> float | None:
    """Likeness of two names as sets of words: the best of common words against each side and side against side."""
    if a is None or b is None:
        return None
    x, y = set(a.lower().split()), set(b.lower().split())
    if not x or not y:
        return 0.0
    common = " ".join(sorted(x & y))
    left, right = (" ".join(filter(None, [common, " ".join(sorted(s))])) for s in (x - y, y - x))
    return max(_ratio(common, left) if common else 0.0, _ratio(common, right) if common else 0.0, _ratio(left, right))


def _score_batch(a: pd.Series, b: pd.Series) -> pd.Series:
    pairs = list(zip(a, b))
    known = {pair: token_set_ratio(*pair) for pair in set(pairs)}
    return pd.Series([known[pair] for pair in pairs], dtype="float64")


def name_score(a: Column, b: Column) -> Column:
    """``token_set_ratio`` of two columns; an Arrow UDF, each distinct pair once a batch.
    Its arguments should be plain columns: stage computed names first."""
    return F.pandas_udf(_score_batch, T.DoubleType())(a, b)
