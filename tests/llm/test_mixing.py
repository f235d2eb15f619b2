import numpy as np
import pytest

from wayloom.llm.mixing import BUCKETS, LEAST_BUCKETS, MODEL_SIZE, Diffusion, _evidence, buckets_for, mix_sources, posteriors, share_report, solve_prices

TARGETS = "source string, target_share double, max_repeats int"


MEMBERS = "source string, tokens bigint, cap double, at array<int>, p array<double>"


def test_prices(spark):
    rows = [("a", 10, 1.0, [0], [1.0])] * 100 + [("b", 10, 4.0, [1], [1.0])] * 10 + [(None, 10, 1.0, [0, 1], [0.5, 0.5])] * 10
    members = spark.createDataFrame(rows, MEMBERS).repartition(3)
    wanted = np.array([480.0, 320.0, 0.0])
    price = solve_prices(members, wanted, np.array([1.0, 4.0, 2.0]))
    rate = [min(cap, sum(price[k] * w for k, w in zip(at, p))) for _, _, cap, at, p in rows]
    given = [sum(10 * x * (p[at.index(k)] if k in at else 0) for x, (*_, at, p) in zip(rate, rows)) for k in (0, 1)]
    assert given == pytest.approx([480, 320], rel=2e-3)
    # what can't be met is met as far as it goes, and nothing else suffers
    short = solve_prices(members, np.array([480.0, 4000.0, 0.0]), np.array([1.0, 4.0, 2.0]))
    assert short[1] == pytest.approx(4.0) and 0 < short[0] < 1


def test_many_sources_fit_the_model():
    assert buckets_for(9) == BUCKETS and buckets_for(60_000) * 60_000 <= MODEL_SIZE and buckets_for(10**6) == LEAST_BUCKETS


def test_copies_and_posteriors():
    d = Diffusion(0)
    got = [d.copies("a", 1.3, 10, 2) for _ in range(1000)]
    assert abs(sum(got) - 1300) <= 2 and set(got) <= {1, 2}
    assert d.copies("a", 2.0, 10, 2) == 2 and d.copies("a", 0.7, 0, 2) == 0
    model = np.log(np.array([[0.9, 0.1, 0.5], [0.1, 0.9, 0.5]])).astype(np.float32)
    evidence = _evidence(model, 1, np.array([0]), np.array([0]), np.array([8]))
    p, weak, told = (posteriors(model, evidence, power, np.array([label]))[0] for power, label in ((1.0, -1), (0.01, -1), (0.01, 1)))
    assert p[0] > 0.9 and abs(p.sum() - 1) < 1e-9 and 0.5 < weak[0] < 0.6 and told[1] > 0.99
    assert np.allclose(_evidence(model, 3, np.array([0, 0, 2]), np.array([0, 1, 1]), np.array([2, 1, 3]))[:, 0], [np.log(0.9) * 2 + np.log(0.1), 0, np.log(0.1) * 3], atol=1e-5)


def test_shares(spark):
    words = {"big": "river stone", "small": "engine wheel", "tiny": "quartz"}
    rows, n = [], 0
    for source, count in (("big", 400), ("small", 120), ("tiny", 6)):
        for k in range(count):
            rows.append((n, f"{words[source]} {k} " * (1 + k % 7), source, "x"))
            n += 1
    rows += [(n + k, "engine wheel 7", None if k % 2 else " ", "x") for k in range(20)] + [(n + 50, None, "big", "x"), (n + 51, "", "big", "x"), (n + 52, "other", "unlisted", "x")]
    df = spark.createDataFrame(rows + rows[:30], "doc_id bigint, text string, source string, copies string").repartition(5)
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 3), ("tiny", 0.05, 6), ("missing", 0.05, 2)], TARGETS)
    mixed = mix_sources(df, targets)
    used = mixed.collect()
    assert len({x.doc_id for x in used}) == len(used)
    cap = {"big": 1, "small": 3, "tiny": 6, None: 1}
    assert all(1 <= x.copies <= cap[x.source] for x in used)
    report = {x.source: x for x in share_report(mixed, targets).collect()}
    for source, share in (("big", 0.5), ("small", 0.4), ("tiny", 0.05)):
        assert report[source].expected_share == pytest.approx(share / 0.95, abs=0.03), source
    assert report["missing"].share == 0 and None in report
    soft = [x for x in used if x.source is None]
    assert all(x.at[int(np.argmax(x.p))] == 2 for x in soft)  # in the order big, missing, small, tiny
    assert mix_sources(df.limit(0), targets).count() == 0
    assert mix_sources(df, targets.limit(0)).count() == 0


def test_size_and_falling_short(spark):
    rows = [(k, f"river stone {k % 7}", "big") for k in range(400)] + [(1000, "quartz vein seven", "tiny")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("tiny", 0.5, 2)], TARGETS)
    kept = mix_sources(df, targets)
    short = mix_sources(df, targets, keep_shares=False)
    sizes = []
    for mixed in (kept, short):
        report = share_report(mixed, targets).collect()
        sizes.append(sum(x.tokens * x.copies for x in mixed.collect()))
        assert {x["size"] for x in report} == {sizes[-1]}
    assert sizes[1] > 20 * sizes[0]
    assert {x.source: x for x in report}["tiny"].share < 0.1 and {x.source: x for x in report}["tiny"].most_copies == 2


def test_texts_of_one_id(spark):
    rows = [(None, "stone gate", "a"), (None, "river lamp", "a"), (3, "stone gate", "b"), (3, "river lamp", "b"), (4, "stone gate", None), (4, "river lamp", None)]
    df = spark.createDataFrame(rows + rows, "doc_id bigint, text string, source string").coalesce(1)
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], TARGETS)
    used = mix_sources(df, targets, total_tokens=10_000).collect()
    assert sorted((str(x.doc_id), str(x.source), x.copies) for x in used) == [("3", "b", 1), ("4", "None", 1)] + [("None", "a", 1)] * 2
