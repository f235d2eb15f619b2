import random
from collections import Counter
from functools import partial

from wayloom.llm import terms
from wayloom.llm.terms import BurstTrie, field_terms, learn_routes, mark_terms, term_frequencies


def test_trie_keeps_counts_through_bursts():
    r = random.Random(2)
    trie, occurrences, records = BurstTrie(burst=3), Counter(), Counter()
    for _ in range(4000):
        term = "".join(r.choice("ab") for _ in range(r.randint(0, 8)))
        trie.add(term, 2, 1)
        occurrences[term] += 2
        records[term] += 1
    got = {p + s: (o, n) for p, rests, os, ns in trie.subtrees() for s, o, n in zip(rests, os, ns)}
    assert got == {t: (occurrences[t], records[t]) for t in occurrences}


def test_like_counter(spark):
    r = random.Random(4)
    words = ["w%d" % i for i in range(60)] + ["", "ü" * 4000]
    rows = [(r.choice("xy"), [r.choice(words) for _ in range(r.randint(1, 5))]) for _ in range(900)]
    df = spark.createDataFrame(rows + [("x", None), ("x", []), ("y", [None]), (None, ["a"])], "field string, terms array<string>").repartition(5)
    merged, counted = term_frequencies(df, route_terms=r.choice([5, 20_000]))
    occurrences, records = Counter(), Counter()
    for f, own in rows:
        occurrences.update((f, w) for w in own)
        records.update((f, w) for w in set(own))
    assert {(x.field, x.term): (x.occurrences, x.records) for x in merged.collect()} == {k: (occurrences[k], records[k]) for k in occurrences}
    assert dict(map(tuple, counted.collect())) == Counter(f for f, _ in rows)


def test_routes_are_adaptive_and_bounded(spark):
    """Deep, crowded prefixes get routes of their own, and every route's share is bounded; the counts don't depend on it."""
    r = random.Random(9)
    rows = [("x", ["http://a.b/" + "".join(r.choice("abcd") for _ in range(6)) for _ in range(4)] + [r.choice("pqrst"), ""]) for _ in range(400)]
    df = spark.createDataFrame(rows, "field string, terms array<string>").repartition(4)
    clean = df.select("field", "terms")
    subtrees = clean.mapInArrow(partial(terms._count_batches, burst=4), terms._SUBTREES)
    routes = learn_routes(subtrees, 60)["x"]
    assert "" in routes and any(p.startswith("http://a.b/a") for p in routes)
    cut = subtrees.where("prefix is not null").mapInArrow(terms._cut_at_routes({"x": routes}), terms._ROUTED)
    assert max(x["sum(n)"] for x in cut.selectExpr("route", "hand", "size(rests) n").groupBy("route", "hand").sum("n").collect()) <= 180
    flat = terms.learn_routes(clean.mapInArrow(terms._count_batches, terms._SUBTREES), 60)["x"]
    assert list(flat) == [""] and flat[""] > 5  # nothing has burst, so the one route is dealt out
    expected = Counter(w for _, own in rows for w in own)
    for size, burst in ((60, 4), (60, 512), (10**6, 4)):
        assert {x.term: x.occurrences for x in term_frequencies(df, route_terms=size, burst=burst)[0].collect()} == expected


def test_marks_and_repeated_rows(spark):
    rows = [(i, ["Road" if i < 30 else "'path'"], "a;B" if i == 0 else None, "extra") for i in range(33)]
    df = spark.createDataFrame(rows + rows[:20] + [(99, None, " ", "extra")], "ord bigint, highway array<string>, cycleway string, term string")
    got = {(x.field, x.term): (x.records, x.mark) for x in mark_terms(*term_frequencies(field_terms(df, "ord", ["highway", "cycleway"]))).collect()}
    assert got == {("highway", "road"): (30, "common"), ("highway", "path"): (3, None), ("cycleway", "a"): (1, "rare"), ("cycleway", "b"): (1, "rare")}
    assert mark_terms(*term_frequencies(field_terms(df.limit(0), "ord", ["highway"]))).count() == 0
