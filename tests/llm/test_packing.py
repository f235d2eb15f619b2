import random
from collections import Counter, defaultdict

from wayloom.llm.packing import OpenWindows, best_fit_decreasing, fill_report, pack_documents, token_counts


def test_windows_bounded_and_never_overfull():
    r = random.Random(1)
    state, fill = OpenWindows(100, 5, 0), Counter()
    for _ in range(2000):
        size = r.randint(1, 100)
        fill[state.place(size)] += size
        assert len(state.open) <= 5
    assert max(fill.values()) <= 100
    bins, fills = best_fit_decreasing([60, 50, 50, 40, 1, 0], 100)
    assert len(fills) == 3 and sum(fills) == 201 and max(fills) <= 100 and len(bins) == 6


def test_every_token_once(spark):
    r = random.Random(3)
    sizes = [(i, r.choice([0, 3, 40, 700, 2048, 2049, 5000])) for i in range(900)] + [(None, 5)]
    df = spark.createDataFrame(sizes + sizes[:50], "doc_id bigint, tokens bigint").repartition(7)
    rows = pack_documents(df, windows=4, sizes=df).collect()
    fill, pieces = Counter(), defaultdict(list)
    for x in rows:
        pieces[x.doc_id].append(x)
        if x.container is None:
            assert x.tokens == 0
        else:
            fill[x.container] += x.tokens
    assert max(fill.values()) <= 2048
    for doc, total in sizes:
        own = sorted(pieces[doc], key=lambda x: x.piece)
        assert sum(x.tokens for x in own) == total and len(own) == max(1, -(-total // 2048))
        assert [x.start for x in own] == [2048 * k for k in range(len(own))]
    total = sum(n for _, n in sizes)
    assert len(fill) <= 1.05 * total / 2048 + 4
    report = fill_report(pack_documents(df, sizes=df)).first()
    assert report.tokens == total and report.fullest <= 2048 and report.containers >= report.fewest


def test_texts(spark):
    df = spark.createDataFrame([(1, "The gate.", "x"), (2, None, "x"), (3, "", "x"), (4, "gate " * 30_000, "x"), (5, "<|endoftext|>", "x")], "doc_id bigint, text string, container string")
    n = dict(map(tuple, token_counts(df).collect()))
    assert n[2] == n[3] == 0 and n[1] == 3 and n[4] >= 30_000 and n[5] > 1
    packed = pack_documents(df).collect()
    assert sum(x.tokens for x in packed) == sum(n.values())
    assert pack_documents(df.limit(0)).count() == 0


def test_texts_of_one_id(spark):
    texts = [(None, "The gate."), (None, "The lamp."), (7, "The gate."), (7, "The lamp."), (7, None), (7, "")]
    df = spark.createDataFrame(texts + texts[:3], "doc_id bigint, text string")
    assert sorted((str(x.doc_id), x.tokens) for x in pack_documents(df).collect()) == [("7", 0), ("7", 3), ("7", 3), ("None", 3), ("None", 3)]
