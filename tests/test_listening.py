"""Phrases, timelines and marks against literal cases and plain restatements."""

import random

import pytest

from glyphflow.operators import listening as L


def spans(text, **how):
    return [text[a:b] for a, b in L.phrases(text, **how)]


def test_sentences_keep_their_closers():
    text = "  “好。」！他说。 走吧"
    assert [text[a:b] for a, b in L.sentences(text)] == ["“好。」！", "他说。", "走吧"]
    assert L.sentences(" \n") == [] and L.sentences("a. ") == [(0, 2)]


def test_long_sentences_are_packed_and_short_ones_merged():
    assert spans("一二三四五，六七八九，十。", longest=6, shortest=0) == ["一二三四五，", "六七八九，十。"]
    assert spans("一二三四。五。", longest=6, shortest=2) == ["一二三四。五。"]
    assert spans("一二三四。五。", longest=4, shortest=2) == ["一二三四。", "五。"]


def test_phrases_tile_what_counts():
    r = random.Random(5)
    for _ in range(400):
        text = "".join(r.choice("一二a1，。！」 x𠀀") for _ in range(r.randrange(60)))
        got = L.phrases(text, 7, 2)
        assert all(a < b for a, b in got) and all(x[1] <= y[0] for x, y in zip(got, got[1:]))
        covered = {k for a, b in got for k in range(a, b)}
        assert all(k in covered for k, c in enumerate(text) if L.counts(c))


def test_limits_follow_the_rate():
    assert L.limits(609, 147.0) == (29, 4)
    assert L.limits(0, 10.0) == (29, 4) and L.limits(1, 100.0) == (1, 0)


def test_cut_points_lie_inside():
    text = "一，二。」三：四。"
    assert L.cut_points(text, (0, len(text))) == [2, 5, 7]


def test_tidy_keeps_order_and_minimum():
    r = random.Random(1)
    for _ in range(300):
        raw = [(r.uniform(-1, 12), r.uniform(-1, 12)) for _ in range(r.randrange(1, 8))]
        got = L.tidy(raw, 10.0)
        assert all(0 <= a <= b <= 10 for a, b in got) and all(x[1] <= y[0] + 1e-9 for x, y in zip(got, got[1:]))
    assert L.tidy([(0, 0), (3, 4)], 10.0) == [(0, 3), (3, 4)]


def test_alignment_places_phrases_by_their_anchors():
    text = "你好。世界。"
    got = L.force_align(text, [(0, 3), (3, 6)], [("你好世界", 0.0, 4.0)], 5.0)
    assert [x[2:] for x in got] == [(0.0, 2.0, 1.0), (2.0, 4.0, 1.0)]
    assert L.force_align(text, [(0, 3), (3, 6)], [], 6.0) == [(0, 3, 0.0, 3.0, 0.0), (3, 6, 3.0, 6.0, 0.0)]
    # the last character was not heard: the phrase reaches to the next anchor
    got = L.force_align("你好。世界。", [(0, 3), (3, 6)], [("你世界", 0.0, 3.0)], 5.0)
    assert got[0][2:] == (0.0, 1.0, 0.5) and got[1][2:] == (1.0, 3.0, 1.0)


def test_long_phrases_are_cut_at_punctuation():
    text = "一二，三四，五六。"
    got = L.force_align(text, [(0, 9)], [("一二三四五六", 0.0, 12.0)], 12.0, 5.0)
    assert [(a, b) for a, b, *_ in got] == [(0, 3), (3, 6), (6, 9)]


@pytest.mark.parametrize(("expected", "typed", "kind"), [("他", "她", "homophone"), ("妈", "马", "tone_slip"), ("好", "坏", "misheard")])
def test_substitutions_by_their_readings(expected, typed, kind):
    readings = {"他": ["ta1"], "她": ["Ta1"], "妈": ["ma1"], "马": ["ma3"], "好": ["hao3"]}
    m = L.marks(expected + "，一", typed + "一", readings)
    assert m[kind] == 1 and m["correct"] == 1 and L.accuracy(m) == 0.5 and L.accuracy(m, True) == (1.0 if kind == "homophone" else 0.5)
    assert L.accuracy(L.marks("。", "", {})) == 1.0


def test_marks_and_phrases_as_columns(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("他来。", "她来了", {"他": ["ta1"], "她": ["ta1"]}), (None, None, None)], "e string, t string, r map<string, array<string>>")
    rows = df.select(L.dictation_marks(F.col("e"), F.col("t"), F.col("r")).alias("m"), L.phrase_spans(F.col("e")).alias("p")).collect()
    assert rows[0].m.asDict() == {"correct": 1, "homophone": 1, "tone_slip": 0, "misheard": 0, "missing": 0, "extra": 1}
    assert [tuple(x) for x in rows[0].p] == [(0, 3, 2)] and rows[1].p == []
