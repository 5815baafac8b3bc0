"""The corpus operators against brute force, on small tables with the odd cases in them:
nulls, empty and long texts, ties, repeated rows, clashing column names, empty tables."""

import hashlib
import math
import random
import re
import zlib
from array import array
from collections import Counter

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def corpus():
    r = random.Random(11)
    vocab = ["".join(r.choice("aeinorst") for _ in range(r.randint(2, 6))) for _ in range(400)]
    base = [" ".join(r.choice(vocab) for _ in range(r.randint(12, 80))) for _ in range(25)]
    texts = list(base)
    for t in base[:12]:
        w = t.split()
        for _ in range(3):
            v = list(w)
            v[r.randrange(len(v))] = "zz"
            texts.append(" ".join(v))
    texts += [base[0], base[0], base[1], None, "", " \n ", "One", "one", "a b c", "A B C", "x " * 3000, "line of some thirty characters\nline of some thirty charactres\nok", "É. b, c.\n\n+1 (974) 555-3436 and a.b@c.example.org 10.0.0.256; 4111 1111 1111 1111"]
    return [(k, t, "n", 5) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), "doc_id long, text string, n string, count int").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("doc_id < 0")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_quality(docs, empty):
    from glyphflow.llm.quality import score_quality

    got = by_id(score_quality(docs))
    for i, t, *_ in corpus():
        t = t or ""
        w = WORD.findall(t)
        c = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        hit = {k + j for k in range(len(w) - 4) if c[tuple(w[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w))
        g = got[i]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed) == want
        assert not (g.base_failed and g.kept)
    assert score_quality(empty).count() == 0


@pytest.mark.parametrize("weak", [False, True])
def test_exact_copies(docs, empty, weak):
    from pyspark.sql import functions as F

    from glyphflow.llm.exact_dedup import drop_copies, find_copies

    got = by_id(find_copies(docs, fp=lambda c: F.length(c).cast("long")) if weak else find_copies(docs))
    groups = {}
    for i, t, *_ in corpus():
        groups.setdefault(t or "", []).append(i)
    for i, t, *_ in corpus():
        g = groups[t or ""]
        assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (max(g), len(g), i == max(g), hashlib.sha256((t or "").encode()).hexdigest())
    if not weak:
        kept = drop_copies(docs)
        assert kept.columns == docs.columns and kept.count() == len(groups)
        assert find_copies(empty).count() == 0


def test_near_duplicates(docs, empty):
    from glyphflow.llm.minhash_join import drop_near_duplicates, near_duplicates

    sets = {}
    for i, t, *_ in corpus():
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = by_id(near_duplicates(docs))
    for i in sets:
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), find(i), find(i) == i)
    assert drop_near_duplicates(docs).count() == len({find(i) for i in sets})
    assert near_duplicates(empty).count() == 0


def test_blocks_agree_with_plain_join(docs, monkeypatch):
    from glyphflow.llm import minhash_join as M

    want = {i: r.component_id for i, r in by_id(M.near_duplicates(docs)).items()}
    monkeypatch.setattr(M, "SMALL", 0)
    monkeypatch.setattr(M, "ROUNDS", 1)
    monkeypatch.setattr(M, "BLOCK", 2)
    assert {i: r.component_id for i, r in by_id(M.near_duplicates(docs)).items()} == want


@pytest.fixture(scope="module")
def ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return {i: [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x, *_ in corpus()}


def test_token_files_round_trip(docs, empty, ids):
    from glyphflow.llm.token_files import token_files

    got, at = by_id(token_files(docs)), 0
    for i in sorted(ids):
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids[i]), zlib.crc32(array("I", ids[i]).tobytes()))
        at += len(ids[i])
    assert token_files(empty).count() == 0

def test_ids_are_the_library_s_on_odd_texts():
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    from glyphflow.llm.tokens import Encoder

    library, ours, r = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Encoder(), random.Random(3)
    bits = ["the", "The", "don't", "'s", " ", "\n", "\t", "é", "é", "É", "ß", "İ", "Σ", "ΑΣ", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "\x01", "12", "½", "...", "!?", "''", "&'s", "̸", "ª", "µ", "×", "你好", "かな", "가", "𠀀", "😀", "\r", "\x85", " ", "_", "A-B", "ÿ", "ſ", "ﬁ"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 9))) for _ in range(5000)] + [None, "", "a" * 100_000, "b " * 50_000]
    for at in range(0, len(texts), 1000):
        part = texts[at : at + 1000]
        ids, bounds = ours.encode(pa.array(part, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [[*x.ids, 1] for x in library.encode_batch([t or "" for t in part], add_special_tokens=False)]


def test_ids_of_a_large_vocabulary_take_four_bytes(spark, tmp_path):
    import json

    from glyphflow.llm.token_files import Shard, Store, id_width, token_files, write_token_files
    from glyphflow.llm.tokens import encoder

    words = {f"w{k}": k for k in range(70_000)}
    path = tmp_path / "many.json"
    path.write_text(json.dumps({"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "Whitespace"}, "post_processor": None, "decoder": None, "model": {"type": "WordLevel", "vocab": words, "unk_token": "w0"}}))
    assert id_width(str(path), None) == 4 and not encoder(str(path)).by_piece
    with pytest.raises(ValueError):
        id_width(str(path), 2)
    docs = spark.createDataFrame([(1, "w69999 w3"), (2, None), (2, "w5")], "doc_id long, text string")
    manifest = write_token_files(docs, str(tmp_path / "out"), str(path))
    found = [Shard(Store(str(tmp_path / "out")), r.shard) for r in manifest.collect()]
    assert sorted((int(s.index["doc_id"][k]), s.ids(k).tolist()) for s in found for k in range(len(s.index))) == [(1, [69999, 3, 1]), (2, [1]), (2, [5, 1])]
    again = [sorted((r.doc_id, r.start, r.n_tokens) for r in token_files(docs.repartition(n)).collect()) for n in (1, 3)]
    assert again[0] == again[1] and len(again[0]) == 3


def test_packing_covers_every_id_once(docs, empty, ids):
    from glyphflow.llm.packing import pack

    rows = pack(docs).collect()
    cover, seqs = {}, {}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(array("I", ids[r.doc_id][r.start : r.start + r.length]).tobytes())
        cover.setdefault(r.doc_id, []).append((r.start, r.length))
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans, totals in ((cover, {i: len(x) for i, x in ids.items()}), (seqs, None)):
        for k, v in spans.items():
            at = 0
            for start, n in sorted(v):
                assert start == at
                at += n
            assert at <= 2048 if totals is None else at == totals[k]
    assert sorted(seqs) == list(range(len(seqs))) and set(cover) == set(ids)
    assert pack(empty).count() == 0


def test_fill_uses_every_length_once():
    from glyphflow.llm.packing import fill

    r = random.Random(2)
    counts = {r.randrange(1, 60): r.randrange(1, 9) for _ in range(25)}
    used = Counter()
    for times, pick in fill(dict(counts), 60):
        assert times >= 1 and sum(k * n for k, n in pick.items()) <= 60
        used.update({k: n * times for k, n in pick.items()})
    assert used == counts


def test_class_model(docs, empty):
    from glyphflow.llm.brown_lm import score_texts

    words = {i: [*WORD.findall((t or "").translate(LOWER)), "\n"] for i, t, *_ in corpus()}
    out = {i for i in words if zlib.crc32(str(i).encode()) % 5 == 1}
    c = Counter(w for i, x in words.items() if i not in out for w in x)
    n, v = sum(c.values()), len(c)
    got = by_id(score_texts(docs))
    for i, x in words.items():
        g = got[i]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (i in out, len(x), sum(c[w] > 0 for w in x), n)
        assert math.isclose(g.base_score, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x), rel_tol=1e-9)
        assert math.isfinite(g.score) and g.score < 0
    assert score_texts(empty).count() == 0


def test_class_scores_by_direct_computation(spark):
    """Two kinds of words that take turns: the classes find them, also for words known by their own contexts only."""
    from glyphflow.llm import brown_lm as B

    r = random.Random(7)
    one, two = ([f"{x}{k:03d}end" for k in range(40)] for x in ("m", "n"))
    rows = [(k, " ".join(w for _ in range(30) for w in (r.choice(one), r.choice(two))) + (f" once{k}" if k % 3 else "")) for k in range(120)] + [(None, "m n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    d = docs.select("doc_id", "text")
    counts = d.mapInArrow(B._count, "word binary, c long").groupBy("word").agg({"c": "sum"}).withColumnRenamed("sum(c)", "c").cache()
    few = B.fit(d, counts, 6)
    cls = lambda w: int(few["known_class"][few["index"][w]])
    m = B.fit(d, counts)
    train = Counter(w for i, t in rows if not B.held_out(i) for w in [*t.encode().split(), B.END])
    assert {w: m["counts"][k] for w, k in m["index"].items()} == train and m["total"] == sum(train.values())
    assert few["own"].sum() == 80 - 6 and min(train[w.encode()] for w in one + two) >= B.OWN
    # words that share a class with more words of the other kind: by their endings, and after the exchange by their contexts
    mixed = []
    for of in (lambda w: int(few["of"][few["kinds"][w]]), cls):
        first, second = (Counter(of(w.encode()) for w in x) for x in (one, two))
        mixed.append(sum(min(n, second[k]) for k, n in first.items()))
    assert mixed[0] > 30 and mixed[1] <= 8, mixed
    cls = lambda w: int(m["known_class"][m["index"][w]]) if w in m["index"] else int(m["of"][m["kinds"][w]])
    steps = Counter((cls(a), cls(b)) for i, t in rows if not B.held_out(i) for w in [[B.END, *t.encode().split(), B.END]] for a, b in zip(w, w[1:]))
    before, tokens, kinds = Counter(), Counter(), Counter()
    for (a, _), n in steps.items():
        before[a] += n
    for w, n in train.items():
        tokens[cls(w)] += n
        kinds[cls(w)] += 1
    for g in B.score_texts(docs).collect():
        want, last = 0.0, B.END
        for w in [*dict(rows)[g.doc_id].encode().split(), B.END]:
            a, b = cls(last), cls(w)
            want += math.log10((steps[a, b] + 0.5) / (before[a] + 0.5 * B.CLASSES)) + math.log10((train[w] + 0.5) / (tokens[b] + 0.5 * (kinds[b] + 1)))
            last = w
        assert math.isclose(g.score, want, rel_tol=1e-9)
        assert g.score > g.base_score or g.doc_id is None


def test_the_most_frequent_words_by_a_histogram(spark):
    from glyphflow.llm.brown_lm import most_frequent

    r = random.Random(1)
    rows = [(f"w{k:04d}".encode(), r.choice((1, 2, 2, 3, 70_000, 70_001 + k))) for k in range(500)]
    counts = spark.createDataFrame(rows, "word binary, c long")
    for most in (0, 1, 50, 120, 300, 499, 500, 900):
        words, c = most_frequent(counts, most)
        assert list(zip(words, c.tolist())) == sorted(rows, key=lambda x: (-x[1], x[0]))[:most]


def test_mixing_meets_targets(spark, docs, empty):
    from glyphflow.llm.mixing import apply_mix, mix

    labels = spark.createDataFrame([(k, "a" if k % 2 else "b") for k in range(30)] + [(None, "a"), (3, None), (5, "a")], "doc_id long, domain string")
    got = mix(docs, labels, keep={"a": 0.5, "b": 1.5}).collect()
    assert len(got) == len(corpus()) and all(r.rate >= 0 for r in got)
    for name, share in (("a", 0.5), ("b", 1.5)):
        now = sum(r[f"p_{name}"] * r.n_tokens for r in got)
        assert math.isclose(sum(r[f"p_{name}"] * r.n_tokens * r.rate for r in got), share * now, rel_tol=1e-4)
    assert apply_mix(docs, labels).columns == docs.columns
    assert mix(empty, labels).count() == 0


def test_personal_data(docs, empty):
    from glyphflow.llm.pii import emails, find_personal_data, find_spans

    got = by_id(find_personal_data(docs))
    last = got[max(got)]
    assert (last.n_email, last.n_ip, last.n_card, last.n_phone) == (1, 0, 1, 1)
    assert got[0].spans == "" and got[0].base_sha256 == hashlib.sha256(b"").hexdigest()
    pattern = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    r = random.Random(4)
    for _ in range(3000):
        t = "".join(r.choice("ab@. é") for _ in range(25))
        assert list(emails(t)) == [m.span() for m in pattern.finditer(t)]
    assert find_spans("a" * 200_000 + "1" * 200_000, {}) == ([], [])
    assert find_personal_data(empty).count() == 0


def test_page_text(spark):
    from glyphflow.llm.html_text import extract_main_text, main_text

    page = """<head><title>T</title></head><header><h1>Site</h1></header><div id=cookie-notice>we use</div><main><div class="post"><h1>A&amp;B</h1><p>one <i>two</i>
 three<p>five<table><tr><td>x<td>y</table></div><div class="comments"><p>bad</div></main><aside>s</aside><script>var t="</p>";</script>"""
    assert main_text(page) == "A&B\none two three\nfive\nx\ny"
    rows = [(k, f"http://h.example/{k}", f"<body><div><b>Welcome to our site</b></div><div><p>text number {k} of this page is long enough</p></div>") for k in range(8)] + [(8, None, None), (9, "x", "")]
    got = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"text number {k} of this page is long enough" for k in range(8)} | {8: "", 9: ""}


def test_banded_edit_distance(spark):
    from pyspark.sql import functions as F

    from glyphflow.llm.line_dedup import within_edits

    r = random.Random(3)
    pairs = []
    for _ in range(500):
        a = [r.choice("abé") for _ in range(r.randint(0, 40))]
        b = list(a)
        for _ in range(r.randint(0, 3)):
            b.insert(r.randrange(len(b) + 1), r.choice("ab"))
            if r.random() < 0.5:
                b.pop(r.randrange(len(b)))
        pairs.append(("".join(a), "".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string")
    assert df.where(within_edits(F.col("a"), F.col("b")) != (F.levenshtein("a", "b") <= 2)).count() == 0


def lines_by_force(rows):
    """doc_id -> (n_lines, n_removed, n_near_removed, n_linked, n_kept_chars)."""
    lines = [(i, p, x) for i, t in rows for p, x in enumerate((t or "").split("\n"))]
    texts = sorted({x for _, _, x in lines if len(x) >= 24})

    def near(a, b):
        if abs(len(a) - len(b)) > 2:
            return False
        d = {j: j for j in range(min(2, len(b)) + 1)}
        for i, x in enumerate(a, 1):
            before, d = d, {}
            for j in range(max(0, i - 2), min(len(b), i + 2) + 1):
                d[j] = min(before.get(j, 3) + 1, d.get(j - 1, 3) + 1, before.get(j - 1, 3) + (j == 0 or x != b[j - 1]) if j else 3)
            if min(d.values()) > 2:
                return False
        return d.get(len(b), 3) <= 2

    root = {x: x for _, _, x in lines}
    linked = set()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(texts):
        for b in texts[k + 1 :]:
            if (a in linked and b in linked and find(a) == find(b)) or not near(a, b):
                continue
            linked |= {a, b}
            root[find(b)] = find(a)
    first, out = {}, {}
    for i, _, x in sorted(lines, key=lambda r: r[:2]):
        n = out.setdefault(i, [0, 0, 0, 0, 0])
        again = bool(WORD.search(x)) and find(x) in first
        n[0] += 1
        n[1] += again
        n[2] += again and first[find(x)] != x
        n[3] += x in linked
        n[4] += 0 if again else len(x)
        if WORD.search(x):
            first.setdefault(find(x), x)
    return {i: tuple(n) for i, n in out.items()}


def line_figures(df):
    return {r.doc_id: (r.n_lines, r.n_removed, r.n_near_removed, r.n_linked, r.n_kept_chars) for r in df.collect()}


def test_line_dedup(docs, empty):
    from glyphflow.llm.line_dedup import dedup_lines

    assert line_figures(dedup_lines(docs)) == lines_by_force([r[:2] for r in corpus()])
    assert dedup_lines(empty).count() == 0


def crowd(n, seed=9):
    """Lines of one origin: most within two edits of it, some further off, and some that share a third of it only."""
    r = random.Random(seed)
    base = "".join(r.choice("abcdefgh ") for _ in range(60))
    out = []
    for k in range(n):
        x = list(base)
        for _ in range(r.choice((0, 1, 1, 2, 2, 3, 6))):
            at = r.randrange(len(x))
            x[at : at + r.randrange(2)] = r.choice(("", "x", "y", "é"))
        out.append("".join(x) if k % 5 else base[:20] + "".join(r.choice("abcdefgh") for _ in range(40)))
    return [(k, x) for k, x in enumerate(out)]


def test_a_large_group_of_near_copies(spark):
    from glyphflow.llm.line_dedup import dedup_lines

    rows = crowd(500)
    assert line_figures(dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))) == lines_by_force(rows)


@pytest.mark.parametrize("sizes", [{"SMALL": 1, "LEVELS": 0, "BLOCK": 3}, {"SMALL": 1, "LEVELS": 3}])
def test_cuts_and_blocks_lose_no_component(spark, monkeypatch, sizes):
    from glyphflow.llm import line_dedup as L

    for k, v in sizes.items():
        monkeypatch.setattr(L, k, v)
    rows = crowd(80, 4) + [(k, None) for k in (100, 101)] + [(102, "  \n"), (103, "short"), (104, "short")]
    assert line_figures(L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))) == lines_by_force(rows)


def test_pipeline_stages(spark):
    import corpus_pipeline as C

    docs = spark.createDataFrame(corpus(), "doc_id long, text string, n string, count int").where("doc_id >= 0")
    labels = spark.createDataFrame([(k, 1, int(k == 3)) for k in range(20)], "doc_id long, quality int, toxic int")
    from glyphflow.plans.staging import Workspace

    ws = Workspace(spark, "test")
    root = f"{ws.root}/in"
    labels.write.parquet(f"{root}/labels.parquet")
    n = docs.count()
    for name, stage in C.STAGES[:-1]:
        out = ws.keep(stage(spark, docs, root))
        assert out.columns == docs.columns and 0 < out.count() <= n, name
        docs = out
    assert [x for x, _ in C.STAGES] == ["quality_rules", "exact_dedup", "minhash_near_dedup", "target_mixing", "packing"]


def test_words_beyond_the_shared_ones_have_their_own_classes(spark, monkeypatch):
    """How many words are shared with all workers does not change a score (F1)."""
    from glyphflow.llm import brown_lm as B

    r = random.Random(5)
    one, two = ([f"{x}{k:03d}end" for k in range(60)] + [f"{x}{k}" for k in range(5)] for x in ("m", "n"))
    rows = [(k, " ".join(w for _ in range(30) for w in (r.choice(one), r.choice(two))) + (f" once{k} twice{k // 2} z" if k % 3 else "")) for k in range(120)] + [(None, "m n"), (500, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    whole = by_id(B.score_texts(docs, 6))
    for known in (8, 40, 100):
        monkeypatch.setattr(B, "KNOWN", known)
        got = by_id(B.score_texts(docs, 6))
        for i, g in got.items():
            assert g[:5] == whole[i][:5] and math.isclose(g.base_score, whole[i].base_score, rel_tol=1e-9)
            assert math.isclose(g.score, whole[i].score, rel_tol=1e-9), (known, i, g.score, whole[i].score)


def test_few_edges_are_put_together_as_many_are(spark):
    from glyphflow.llm.graph import components
    from glyphflow.plans.staging import Workspace

    r = random.Random(2)
    edges = spark.createDataFrame([(r.randrange(-60, 60), r.randrange(-60, 60)) for _ in range(70)] + [(9, 9), (1 << 62, -(1 << 62))], "a long, b long")
    ws = Workspace(spark, "few")
    assert sorted(components(ws, edges, 1000).collect()) == sorted(components(ws, edges).collect()) == sorted(components(ws, edges, 5).collect())
    assert components(ws, edges.limit(0), 1000).count() == 0


def test_only_pairs_that_letters_allow_are_verified(spark, monkeypatch):
    """Lines that share all but a word once made a row of the join for each pair that meets (op8 on check_h)."""
    from glyphflow.llm import line_dedup as L

    r = random.Random(4)
    word = lambda: "".join(r.choice("aeinorstlu") for _ in range(7))
    base = [word() for _ in range(24)]
    lines = [" ".join(base[:k] + [word()] + base[k + 1 :]) for k in range(24) for _ in range(3)]
    lines += [x[:-1] for x in lines[:5]]
    given, verified = [], L._verified

    def watch(ws, pairs, text):
        letters = {x.id: x.letters for x in text.collect()}
        given.extend((letters[p.a] ^ letters[p.b]).bit_count() for p in pairs.collect())
        return verified(ws, pairs, text)

    monkeypatch.setattr(L, "_verified", watch)
    monkeypatch.setattr(L, "LEVELS", 1)
    got = by_id(L.dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")))
    assert given and max(given) <= 2 * L.EDITS
    assert sum(g.n_linked for g in got.values()) >= 10 and all(got[72 + k].n_near_removed == 1 for k in range(5))


def test_spark_s_bounded_distance_agrees_with_the_band(spark):
    from pyspark.sql import functions as F

    from glyphflow.llm.line_dedup import within_edits

    r = random.Random(6)
    rows = []
    for _ in range(400):
        a = [r.choice("abé中😀 ") for _ in range(r.randint(0, 14))]
        b = list(a)
        for _ in range(r.randint(0, 4)):
            k = r.randrange(len(b) + 1)
            b[k : k + r.randint(0, 1)] = r.choice(["", "x", "é", "😀"])
        rows.append(("".join(a), "".join(b)))
    df = spark.createDataFrame(rows, "a string, b string")
    assert df.where((F.levenshtein("a", "b", 2) >= 0) != within_edits(F.col("a"), F.col("b"))).count() == 0


def test_words_that_are_not_shared_make_no_rows_for_their_neighbours(spark, monkeypatch):
    """What is staged grows with texts and words, not with pairs of neighbours, however few words are shared (F1)."""
    from glyphflow.llm import brown_lm as B
    from glyphflow.plans.staging import Workspace

    r = random.Random(9)
    texts = [" ".join(f"w{r.randrange(400)}" for _ in range(300)) for _ in range(100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    keep, staged = Workspace.keep, []

    def counted(self, df):
        staged.append((out := keep(self, df)).count())
        return out

    monkeypatch.setattr(Workspace, "keep", counted)
    monkeypatch.setattr(B, "KNOWN", 30)
    assert B.score_texts(docs, 6).count() == 100
    assert max(staged) <= len(texts) + 1 + len({w for t in texts for w in t.split()}), staged


def test_classes_of_many_words_at_once():
    """As one by one, each from a table without the word; also where a word stands beside its own class or itself."""
    import numpy as np

    from glyphflow.llm import brown_lm as B

    def best(big, now, right, left):
        rest = big.copy()
        rest[now] = np.maximum(rest[now] - right, 0)
        rest[:, now] = np.maximum(rest[:, now] - left, 0)
        gain = np.where(big.sum(1) > 0, B.gains(rest, right, left), -np.inf)
        b = int(np.argmax(gain))
        return b if gain[b] > gain[now] + 1e-9 else now

    r = np.random.default_rng(3)
    for share in (0.05, 0.5):
        near = r.poisson(share, (90, 2, B.CLASSES)).astype(float)
        near[0] = 0
        now = r.integers(1, B.CLASSES - 3, 90)
        near[np.arange(90), :, now] += r.integers(0, 4, (90, 2))
        big = r.poisson(3.0, (B.CLASSES, B.CLASSES)).astype(float)
        big[-2:] = big[:, -2:] = near[..., -2:] = 0
        np.add.at(big, now, near[:, 0])
        np.add.at(big.T, now, near[:, 1])
        big[now[5], now[5]] = 1  # less than the word's neighbours of its class on both sides
        got = B.best_classes(big, now, near[:, 0], near[:, 1])
        assert got.tolist() == [best(big, k, x, y) for k, (x, y) in zip(now.tolist(), near)]
        assert (got != now).any()


def test_words_of_whole_batches():
    """Hashes, places, endings and the sequence with ends, against words one by one."""
    import numpy as np
    import pyarrow as pa

    from glyphflow.llm import brown_lm as B

    texts = ["", None, "a Bb ccc DDDD É x\x0by\x00z", " \t\n", "éé ÀÀ a" * 3, "a", "漢字 abc"]
    flat, split = B.Flat(pa.array(["skipped", *texts], pa.string()).slice(1)), [B._words((t or "").encode()) for t in texts]
    every = [w for t in split for w in t]
    assert flat.hash.tolist() == B.hashes(every).tolist() and len(set(flat.hash.tolist())) == len(set(every))
    kinds = B.TypeOf([b"a", b"ccc"], 6)
    assert flat.types(B.Places(B.hashes([b"a", b"ccc"])), 6).tolist() == [kinds[w] for w in every]
    assert flat.spread(np.arange(len(every)), -1).tolist() == [-1, *(x for t, k in zip(split, np.cumsum([0, *map(len, split)])) for x in [*range(k, k + len(t)), -1])]
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 64, 5000, np.uint64) & np.uint64(0xFFFFFFFFFF00000F))  # many in few slots
    places, there = B.Places(keys[::2]), dict(zip(keys[::2].tolist(), range(len(keys))))
    assert places.find(keys).tolist() == [there.get(k, -1) for k in keys.tolist()]
    assert B.Places(keys[:0]).find(keys).max() == -1 and B.Places(keys[:0]).find(keys[:0]).size == 0


def test_scores_do_not_depend_on_how_texts_and_words_are_cut(spark, monkeypatch):
    """Blocks, pieces and flushes of any size, no training text, only empty texts."""
    from glyphflow.llm import brown_lm as B

    r = random.Random(12)
    rows = [(k, " ".join(f"{r.choice('Mn')}{int(r.paretovariate(0.6)) % 500}é" for _ in range(60))) for k in range(60)] + [(60, "n1 " * 90_000), (61, ""), (None, "M1é")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    whole = by_id(B.score_texts(docs, 6))
    for name, n in (("BLOCK", 500), ("PIECE", 50), ("HELD", 300), ("AT_ONCE", 3)):
        monkeypatch.setattr(B, name, n)
    got = by_id(B.score_texts(docs, 6))
    assert all(g[:5] == whole[i][:5] and math.isclose(g.score, whole[i].score, rel_tol=1e-9) for i, g in got.items())
    out = [k for k in range(50) if B.held_out(k)]
    for rows in ([(k, "a b a") for k in out], [(k, None) for k in range(5)]):
        got = B.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert len(got) == len(rows) and all(math.isfinite(g.score) and math.isfinite(g.base_score) for g in got)
