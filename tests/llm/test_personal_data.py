"""Personal data against plain regular expressions, and what the learned classifier adds."""

import hashlib
import random
import re

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(x) * (1 + k % 2), 10)) for k, x in enumerate(reversed(d))) % 10 == 0


def base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if good:
                out.append((m.start(), KINDS.index(kind), m.end()))
    return sorted(out)


def test_base_columns_by_force(spark):
    from glyphflow.llm.pii import find_personal_data

    r = random.Random(8)
    bits = ["1", "2", "255", "256", ".", "-", " ", "+", "(", ")", "@", "a", "b.c", "4111111111111111", "4111 1111 1111 1111", "+1 (555) 010-9999", "10.0.0.1", "x@y.z", "é", "\n", "%", "_"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 14))) for _ in range(4000)] + [None, ""]
    docs = spark.createDataFrame([(k, t, "x", "y") for k, t in enumerate(texts)], "doc_id long, text string, spans string, kind string")
    for row in find_personal_data(docs).collect():
        want = base(texts[row.doc_id])
        assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == tuple(sum(k == x for _, k, _ in want) for x in range(4)), texts[row.doc_id]
        joined = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert row.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(row.spans.split(","))


def test_learned_labelers_add_true_spans_and_refuse_false_ones(spark):
    from glyphflow.llm.pii import find_personal_data

    r = random.Random(6)
    texts, added = [], {}
    for k in range(120):
        word = "".join(r.choice("aeinost") for _ in range(6))
        if k % 4 == 0:
            texts.append(f'{word} token = "{r.randbytes(20).hex()}" {word}')
            added[k] = "secret"
        elif k % 4 == 1:
            texts.append(f"{word} call phone {r.randrange(200, 999)}-{r.randrange(200, 999)}-{r.randrange(1000, 9999)} now")
            added[k] = "phone"
        elif k % 4 == 2:
            texts.append(f"see chapter-{r.randrange(10, 99)}-of-the-{word}-report-{word} and 4111 1111 1111 {r.randrange(1000, 9999)}")
        else:
            texts.append(f"{word} plain {word}")
    got = find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for row in got:
        kinds = [x.split(":")[0] for x in row.spans.split(",") if x]
        extra = [x for x in kinds if x != "card" or not row.n_card]
        assert extra == ([added[row.doc_id]] if row.doc_id in added else []), texts[row.doc_id]
    for row in got:
        for kind, a, b in (x.split(":") for x in row.spans.split(",") if x):
            if kind == "secret":
                assert re.fullmatch("[0-9a-f]{40}", texts[row.doc_id][int(a) : int(b)])
