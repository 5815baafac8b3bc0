"""Queries against brute force on fixtures where a cut, a cap or a filter would show."""

from collections import Counter

from glyphflow.operators import align as A

LONG = "the tale of a small river that runs to the sea. "
TURNS = [(1, 0, "user", LONG * 3 + "one"), (1, 1, "assistant", LONG * 3 + "another"), (1, 2, "user", "é" + LONG * 2), (1, 3, "assistant", "e" + LONG), (2, 0, "user", "alone"), (3, 0, "user", ""), (3, 1, "assistant", "你好 and 𠀀"), (3, 2, "user", "你们好 and x")]
PAIRS = [(x, y) for x, y in zip(TURNS, TURNS[1:]) if x[0] == y[0]]


def table(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))


def counts(a, b):
    """matched, substituted, missing, extra by the whole matrix; ties prefer diagonal, delete, insert."""
    d = [[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j - 1] + (a[i - 1] != b[j - 1]), d[i - 1][j] + 1, d[i][j - 1] + 1)
    n, i, j = Counter(), len(a), len(b)
    while i or j:
        if i and j and d[i][j] == d[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            i, j = i - 1, j - 1
            n["match" if a[i] == b[j] else "substitute"] += 1
        elif i and d[i][j] == d[i - 1][j] + 1:
            i -= 1
            n["delete"] += 1
        else:
            j -= 1
            n["insert"] += 1
    return tuple(n[k] for k in ("match", "substitute", "delete", "insert"))


def distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        d, before = [i], d
        for j, y in enumerate(b, 1):
            d.append(min(before[j] + 1, d[-1] + 1, before[j - 1] + (x != y)))
    return d[-1]


def test_edit_distance_covers_whole_turns_of_all_pairs(spark, tmp_path):
    from glyphflow.plans.texts import edit_distance

    table(spark, tmp_path, "conversations", TURNS, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r.distance for r in edit_distance(spark, str(tmp_path)).collect()}
    assert got == {x[:2]: distance(x[3], y[3]) for x, y in PAIRS}


def test_alignment_marks_cover_whole_turns(spark, tmp_path):
    from glyphflow.plans.texts import alignment_marks

    table(spark, tmp_path, "conversations", TURNS, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): (r.matched, r.substituted, r.missing, r.extra) for r in alignment_marks(spark, str(tmp_path)).collect()}
    assert got == {x[:2]: counts(x[3], y[3]) for x, y in PAIRS}


def test_alignment_leaves_the_band_only_where_it_must():
    a, b = list("abcdefghijklmnopqrstuvwyz" + "x" * 9), list("x" * 9 + "abcdefghijklmnopqrstuvwyz")
    assert A._whole(a, b, 1) is None
    assert A._whole(a, b, 40) == A._banded(a, b, 40)
    assert A.align(a, b, slack=1) == A._banded(a, b, 1)


def test_lists_have_every_row(spark):
    from glyphflow.plans.lexicon import reading_rank
    from glyphflow.plans.library import language_order, library_list

    data = "/root/testdata/sf0.001"
    ids = sorted(r.doc_id for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id").collect())
    for whole in (library_list, language_order):
        assert sorted(r.doc_id for r in whole(spark, data).collect()) == ids
    n = Counter((w, r.p_brand) for r in spark.read.parquet(f"{data}/part.parquet").collect() for w in r.p_name.split(" "))
    want = {}
    for (w, b), k in sorted(n.items(), key=lambda x: (x[0][0], -x[1], x[0][1])):
        want.setdefault(w, []).append((b, k))
    got = {}
    for r in sorted(reading_rank(spark, data).collect(), key=lambda r: (r.word, r["rank"])):
        got.setdefault(r.word, []).append((r.p_brand, r.n))
    assert got == want and max(map(len, want.values())) > 5
