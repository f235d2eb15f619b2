import random

import pytest

from wayloom.llm.quality import NAMED, TAILS, common_words, score_texts, text_statistics

PROSE = "The old clerk needed the lamp near the harbour. After {} days the young teacher painted the cart, and the road crew was wet. "
COMMON = {"en": ["after", "and", "in", "of", "old", "the", "was"], "de": ["der", "die", "und"]}


def measured(spark, *rows, common=COMMON):
    df = spark.createDataFrame([(i, t, code) for i, (t, code) in enumerate(rows)], "doc_id bigint, text string, lang string")
    return [r for r in text_statistics(df, common).orderBy("doc_id").collect()]


def test_statistics(spark):
    cat, none, blank, items, german, wild, other, long = measured(
        spark, ("The cat sat.\nIt was wet!", "EN"), (None, None), ("   ", "de"), ("- lamp\n- gate\n- well", "en"), ("Die Katze und der Hund", None), ("Lampe", "deu-AT"), ("was the", "xx"), ("word " * 100_000, "en")
    )
    assert cat.language == "en" and cat.words == 6 and cat.lines == 2 and cat.punctuated_lines == 1.0
    assert abs(cat.mean_word_length - 17 / 6) < 1e-9 and cat.item_breaks == 0 and cat.common_share == (2 + 3) / (6 + 6)
    assert none.words == 0 and none.language == "und" and blank.lines == 0 and blank.language == "de"
    assert items.item_breaks > 0.6 and long.words == 100_000
    assert german.language == "de" and wild.language == "de" and other.language == "en"
    assert [r.language for r in measured(spark, ("was the", "en"), common={})] == ["und"]


def test_common_words_are_learned(spark):
    own = lambda i: chr(97 + i // 26) + chr(97 + i % 26)
    rows = [(f"the lamp{own(i)} and the gate{own(i)}" if i % 2 else f"the well{own(i)}", "en") for i in range(60)] + [(f"der turm{own(i)}", "de") for i in range(40)] + [("rare", "fr"), (None, "en"), ("the", None), ("the", "no code")]
    got = common_words(spark.createDataFrame(rows, "text string, lang string"))
    assert got == {"de": ["der"], "en": ["and", "the"]}
    assert common_words(spark.createDataFrame([], "text string, lang string")) == {}


def test_flags(spark):
    r = random.Random(5)
    told = [PROSE.format(7), "Who has seen the map? ", "\"We need the bell,\" said the young clerk once again. ", "The baker was late and the miller was glad.\n", "Nobody knew that the old guard had the keys of the tower. ", "– It was the end of the road.\n"]
    prose = [(i, "".join(r.sample(told, r.randint(1, 6)))[: r.choice([14, 60, 4000])], "en") for i in range(300)]
    odd = [
        (1001, "Lamp\nGate (5)\nWell x7\nRoof", "en"),
        (1002, "lamp;12.5;-;9\ngate;;7;8\nwell;1;2;3", "en"),
        (1003, "#$%^ &*@ =+=+ #$%^ &*@", "en"),
        (1004, "went went went went went went went went went went went went went went went", None),
        (1005, "lamp x5, gate (3), well, roof x9, cart", "zz"),
    ]
    fine = [(2001, "The old cl", "en"), (2002, "– The old clerk was wet.\n– The young teacher was glad.", None), (2003, None, "en"), (2004, "", None), (2005, PROSE.format(1).upper(), "en")]
    df = spark.createDataFrame([(*r, "x") for r in prose + odd + fine + odd[:2]], "doc_id bigint, text string, lang string, language string")
    rows = score_texts(df).collect()
    assert len(rows) == len(prose + odd + fine)
    flagged = {r.doc_id for r in rows if r.tails}
    assert flagged & {r[0] for r in odd + fine} == {r[0] for r in odd} and len(flagged) <= len(odd) + 9
    assert score_texts(df.limit(0)).count() == 0


def test_far_out_is_named(spark):
    df = spark.createDataFrame([(i, PROSE.format(i) * (1 + i % 5) + "and, so, on " * (i % 3), "en") for i in range(60)], "doc_id bigint, text string, lang string")
    rows = score_texts(df, fence=0.0).collect()
    mild = [r for r in rows if r.far_out > r.limit and max(r[f"z_{s}"] for s in TAILS) <= NAMED]
    assert mild and all(r.tails for r in mild)
    assert all(not r.tails for r in rows if r.far_out <= r.limit)


def test_all_statistics_are_scored(spark):
    df = spark.createDataFrame([(i, PROSE.format(i) * (1 + i % 5), "en") for i in range(60)] + [(99, PROSE.format(1) * 400, "en")], "doc_id bigint, text string, lang string")
    last = {r.doc_id: r for r in score_texts(df).collect()}[99]
    assert last.z_words > 50 and abs(last.z_mean_word_length) < 1 and last.z_punctuated_lines == 0 and not {"words", "lines"} & set(last.tails)


def test_variety_sees_the_last_words(spark):
    varied = " ".join("abcdefghijklmnopqrstuvwx")
    one, spoilt, twice, repeated = measured(spark, (varied, "en"), (varied + " word" * 23, "en"), (varied + " " + varied, "en"), ("went " * 40, "en"))
    assert spoilt.word_variety < one.word_variety - 0.3 and twice.word_variety == one.word_variety == 1.0
    assert repeated.word_variety == pytest.approx(1 / 24)
