import random

from pyspark.sql import types as T

from wayloom.llm import canonical
from wayloom.llm.canonical import BKTree, Mapper, distance, free_entries, map_to_canonical, unmatched_report

REFERENCE = [
    (1, "bicycle", "yes", ["y", "allowed"]),
    (2, "bicycle", "no", ["n", "forbidden"]),
    (3, "bicycle", "use_sidepath", ["compulsory sidepath"]),
    (4, "bicycle", "designated", []),
    (9, "other", "lane", ["painted strip"]),
]


def _slow(a, b):
    """Unrestricted Damerau-Levenshtein by the textbook recurrence over all earlier swaps."""
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            best = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            for k in range(1, i):
                for m in range(1, j):
                    if a[k - 1] == b[j - 1] and a[i - 1] == b[m - 1]:
                        best = min(best, d[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1))
            d[i, j] = best
    return d[len(a), len(b)]


def test_distance_and_tree_like_brute_force():
    r = random.Random(5)
    words = sorted({"".join(r.choice("abc") for _ in range(r.randint(1, 7))) for _ in range(150)})
    for _ in range(200):
        a, b = r.choice(words), r.choice(words)
        assert distance(a, b) == _slow(a, b)
    tree = BKTree((w, i) for i, w in enumerate(words))
    for _ in range(60):
        q, most = "".join(r.choice("abc") for _ in range(r.randint(1, 8))), r.randint(0, 3)
        assert tree.within(q, most) == sorted((distance(q, w), w, i) for i, w in enumerate(words) if distance(q, w) <= most)


def test_readings():
    m = Mapper([(w, i) for i, f, c, aliases in REFERENCE if f == "bicycle" for w in [c, *aliases]], leads=["now", "was signed as"], tails=["so far"])
    for text, entry in [("YES", 1), ("yês!!", 1), ("  yess ", 1), ("now Allowed", 1), ("ALLWOED", 1), ("N *", 2), ("forbid..", 2), ("use_sidepat.. ", 3), ("compuqsoyr sidepath", 3), ("usesidepath", 3), ("D3S1GNATED", 4), ("was signed as designated (north side)", 4), ("desig", 4), ("now forbiden so far", 2)]:
        assert m.find(text)[2] == entry, text
    for text in ["so far", "gravel", "photo 1234", "???", "12", "HFGBWK", "", "x" * 5000]:
        assert m.find(text) is None, text


def test_operator_broadcast_and_sharded(spark):
    reference = spark.createDataFrame(REFERENCE, "ref_id int, field string, canonical string, aliases array<string>")
    rows = [(1, "yess", "z", 5), (1, "yess", "z", 6), (2, "yes", None, 5), (3, "  ", "lane;no", 5), (4, None, "LANE", 5), (5, "a stone", "['lane']", 5), (None, "frobidden", "lane", 5)]
    df = spark.createDataFrame(rows, "ord bigint, bicycle string, other string, ref_id int")
    entries = free_entries(df, "ord", ["bicycle", "other"], reference)
    expected = sorted([(1, "bicycle", 1), (1, "other", 0), (4, "other", 9), (5, "bicycle", 0), (5, "other", 9), (None, "bicycle", 2)], key=str)
    for limit in (1000, 2):
        mapped = map_to_canonical(entries, reference, max_broadcast=limit)
        assert sorted((tuple(r) for r in mapped.select("ord", "field", "ref_id").collect()), key=str) == expected
    report = {tuple(r) for r in unmatched_report(mapped).collect()}
    assert report == {("other", "z", 1), ("bicycle", "a stone", 1)}
    empty = free_entries(spark.createDataFrame([], T._parse_datatype_string("ord bigint, bicycle string, other string, ref_id int")), "ord", ["bicycle"], reference)
    assert map_to_canonical(empty, reference).count() == 0


def test_phrases_are_learned_from_the_values(spark):
    reference = spark.createDataFrame(REFERENCE, "ref_id int, field string, canonical string, aliases array<string>")
    typed = ["rumoured yes", "Rumoured NO", "rumoured designated", "yes as of may", "no as of may", "designated as of may", "rumoured forbiden as of may", "hardly yes", "hardly no", "rumoured gravel", "rumoured"]
    entries = spark.createDataFrame([("bicycle", v) for v in typed], "field string, value string")
    expected = dict(zip(typed, [1, 2, 4, 1, 2, 4, 2, 0, 0, 0, 0]))  # hardly stands before two entries only
    for limit in (1000, 2):
        assert {x.value: x.ref_id for x in map_to_canonical(entries, reference, max_broadcast=limit, shard_wordings=2).collect()} == expected


def test_shards_answer_like_the_whole_tree(spark):
    listed = [(9, "f", "abcde", []), (2, "f", "xbcdx", []), (4, "f", "gravel road", []), (3, "f", "pavement", []), (6, "f", "lane", ["lanes only"]), (5, "f", "lame", []), (11, "f", "permissive", []), (12, "f", "permisive no truck", [])]
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randint(2, 8)))
    listed += [(20 + k, "f", word(), [word()]) for k in range(40)]
    reference = spark.createDataFrame(listed, "ref_id int, field string, canonical string, aliases array<string>")
    typed = ["abcdx", "pavemen, gravel roac", "gravle road; pavemet", "lanee", "lahe", "laxe", "gravel.. (pavement)", "nothing like it", "permisive (no trucs)"]
    typed += [" ".join(word() for _ in range(r.randint(1, 2))) + r.choice(["", "..", " (east)"]) for _ in range(150)] + [f"maybe {x[2]}" for x in listed[:12]] + ["maybe abcdd"]
    entries = spark.createDataFrame([("f", v) for v in sorted(set(typed))], "field string, value string")
    near, shards = ({x.value: (x.ref_id, x["rank"], x.cost) for x in map_to_canonical(entries, reference, max_broadcast=limit, shard_wordings=18).collect()} for limit in (1000, 2))
    assert near == shards and near["abcdx"] == (9, 3, 1) and near["maybe gravel road"][0] == 4


def test_more_phrases_than_are_broadcast(spark, monkeypatch):
    reference = spark.createDataFrame(REFERENCE, "ref_id int, field string, canonical string, aliases array<string>")
    leads = ["rumoured", "by all accounts", "was signed as", "as far as anybody round here knows"]
    tails = ["as of may", "so far", "on the sign that stands there", "weather permitting", "then"]
    typed = {f"{lead} {w}": k for lead in leads for w, k in (("yes", 1), ("no", 2), ("designated", 4))}
    typed |= {f"{w} {tail}": k for tail in tails for w, k in (("yes", 1), ("no", 2), ("designated", 4))}
    typed |= {f"{lead} forbiden {tail}": 2 for lead in leads for tail in tails}
    typed |= {f"rumoured by all accounts {w} so far, then (north) as of may - see sign": k for w, k in (("allowed", 1), ("frobidden", 2))}
    typed |= {f"reportedly\u00a0{w}": k for w, k in (("yes", 1), ("no", 2), ("designated", 4), ("forbiden", 2))}  # no blank
    typed |= {"forbidden (north side) (by day) (in winter) (as typed) (on foot) (says the map)": 2, "hardly forbidden": 0, "rumoured gravel": 0, "so far": 0, "": 0}
    entries = spark.createDataFrame([("bicycle", v) for v in typed] + [("elsewhere", "rumoured yes"), (None, "rumoured yes")], "field string, value string")
    for most in (1, 20_000):
        monkeypatch.setattr(canonical, "MOST_PHRASES", most)
        for limit in (1000, 2):
            rows = map_to_canonical(entries, reference, max_broadcast=limit, shard_wordings=2).collect()
            assert {r.value: r.ref_id for r in rows if r.field == "bicycle"} == typed and len(rows) == len(typed) + 2
            assert [r.ref_id for r in rows if r.field != "bicycle"] == [0, 0]


def test_values_hold_all_phrases_that_readings_ask_for():
    r = random.Random(11)
    parts = ["a", "b", "c.", "d,e", "(f)", "-", "g;", "/", "(h", "--i", "|j k", "l)", ",", "É"]
    for _ in range(3000):
        value = "".join(r.choice(parts) + r.choice([" ", " ", " ", "", "  "]) for _ in range(r.randint(1, 9)))
        asked = set()

        class Asked(canonical.Phrases):
            def off(self, text):
                words = text.split(" ")
                asked.update((leads, " ".join(words[:k] if leads else words[-k:])) for k in range(1, min(3, len(words) - 1) + 1) for leads in (True, False))
                k = r.randint(0, min(3, len(words) - 1))
                return " ".join(r.choice((words[k:], words[: len(words) - k])))

        Mapper([]).readings(value, Asked())
        assert asked <= canonical.held(value, 3), value
