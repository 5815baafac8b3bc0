"""Line layout against a plain restatement."""

import random

from glyphflow.operators.layout import glued, lay_out, may_end, measure


def test_marks_stay_with_their_words():
    assert glued("。") and not glued("。。") and not may_end("（") and may_end("a") and measure("中a") == 3.0
    text = ["一", "二", "。", "（", "三", "）"]
    items = [(1.0, glued(t), may_end(t), False) for t in text]
    assert [(a, b) for a, b, _ in lay_out(items, 2.0)] == [(0, 1), (1, 3), (3, 6)]


def test_every_line_is_full_or_cannot_break():
    r = random.Random(2)
    for _ in range(300):
        items = [(float(r.randrange(1, 6)), r.random() < 0.2, r.random() < 0.8, r.random() < 0.2) for _ in range(r.randrange(1, 41))]
        got = lay_out(items, 12.0)
        assert [a for a, _, _ in got] == [0, *(b for _, b, _ in got[:-1])] and got[-1][1] == len(items)
        legal = lambda k: k == len(items) or not items[k][1] and items[k - 1][2]
        for a, b, w in got:
            assert legal(b)
            if w > 12.0:  # no break inside
                assert not any(legal(k) for k in range(a + 1, b) if sum(0 if items[j][3] and j == a else items[j][0] for j in range(a, k)) <= 12.0)
    assert lay_out([], 5.0) == []
