"""Operators against literal expectations and independent methods."""

import random

import pytest

from glyphflow.operators.align import align
from glyphflow.operators.segment import merge_tokens, split_words, weight
from glyphflow.sources.encodings import detect


def distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        d, before = [i], d
        for j, y in enumerate(b, 1):
            d.append(min(before[j] + 1, d[-1] + 1, before[j - 1] + (x != y)))
    return d[-1]


def test_alignment_covers_both_sides_at_the_least_cost():
    r = random.Random(5)
    for _ in range(200):
        a, b = ("".join(r.choice("abc") for _ in range(r.randrange(12))) for _ in range(2))
        steps = align(list(a), list(b), slack=12)
        assert [i for _, i, _ in steps if i is not None] == list(range(len(a)))
        assert [j for _, _, j in steps if j is not None] == list(range(len(b)))
        assert sum(s[0] != "match" for s in steps) == distance(a, b)


def test_alignment_beyond_the_budget_deletes_and_inserts():
    steps = align(["a"] * 5000, ["a"], slack=4096)
    assert [s[0] for s in steps] == ["delete"] * 5000 + ["insert"]


def test_split_is_lossless_and_uses_weights():
    lexicon = {w: weight(len(w)) for w in ("cold", "old", "ring", "small")}
    assert split_words("coldring", lexicon) == ["c", "old", "ring"]
    assert split_words("", lexicon) == []
    r = random.Random(1)
    for _ in range(100):
        t = "".join(r.choice("coldringsma") for _ in range(r.randrange(30)))
        assert "".join(split_words(t, lexicon)) == t


def test_merge_takes_the_heaviest_run():
    assert merge_tokens(["a", "b", "c"], {"ab": 0.5, "abc": 0.9}) == ["abc"]
    assert merge_tokens(["a", "b", "c"], {}) == ["a", "b", "c"]


@pytest.mark.parametrize(("data", "encoding"), [(b"", "utf-8"), (b"\xff\xfeh\0", "utf-16-le"), (b"\xff\xfe\0\0", None), ("é".encode(), "utf-8"), ("你好世界".encode("gb18030"), "gb18030")])
def test_detection(data, encoding):
    assert detect(data)[1] == encoding


def test_import_is_exactly_once(spark, tmp_path):
    from glyphflow.streaming.imports import import_lines

    src = tmp_path / "in"
    src.mkdir()
    (src / "a.u8").write_text("你好 你好 [ni3 hao3] /hello/\nbad\n")
    args = str(src), str(tmp_path / "out"), str(tmp_path / "cp")
    import_lines(spark, *args).awaitTermination()
    (src / "b.u8").write_text("國 国 [guo2] /country/\n")
    import_lines(spark, *args).awaitTermination()
    import_lines(spark, *args).awaitTermination()
    assert sorted(r.simplified for r in spark.read.parquet(args[1]).collect()) == ["你好", "国"]
