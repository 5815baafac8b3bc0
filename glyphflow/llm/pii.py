"""Personal data spans by weak supervision.

Every text is searched for the base patterns (email, ip, card, phone), whose valid
matches always stay, and for looser candidates: phone numbers without the plus sign,
addresses written with "at" and "dot", digit groups and dotted numbers that fail a check,
and, as a fifth kind, secrets: long runs of letters and digits such as access tokens.
Labelers vote on each candidate: the strict regular expression, checks of
value (Luhn, ranges), a gazetteer of cue words near the span, and its context. The votes
are counted over all documents by pattern, expectation-maximisation estimates each
labeler's reliability, and a logistic classifier is trained on the span features with the
estimated probabilities as soft labels. A candidate that is not a base match is added if
the classifier gives at least ACCEPT.

The votes and features of a candidate take few values, so what reaches the driver is the
table of their distinct combinations with counts: at most 2**(labelers + features) rows
for any corpus, in practice some dozens.

Defined cases: a null or empty text has no spans; repeated rows are searched each by
itself; texts of any length are searched whole in linear time; an empty table gives an
empty table; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphflow.plans.staging import Workspace

KINDS = ("email", "ip", "card", "phone", "secret")
ACCEPT = 0.9
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOOSE_MAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]{2,63}){1,4}")
_LOOSE_PHONE = re.compile(r"(?<![0-9+.-])(?<!\+[0-9] )(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?![A-Za-z0-9+/_-])")
_HEX = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)\Z")
#: Cue words by kind, fixed values.
GAZETTEER = {
    "email": ("mail", "email", "contact", "write", "courriel", "correo"),
    "ip": ("ip", "host", "server", "address", "addr", "login"),
    "card": ("card", "visa", "mastercard", "credit", "carte", "tarjeta", "karte"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "telefono"),
    "secret": ("token", "key", "secret", "password", "passwd", "apikey", "api_key", "auth", "bearer", "credential"),
}
_CUE = {k: re.compile(rf"(?i)\b(?:{'|'.join(v)})\b") for k, v in GAZETTEER.items()}
LABELERS = ("regex", "value", "gazetteer", "context")
FEATURES = ("loose", "value", "cue", "bounded", "many_digits", "grouped")


def luhn(digits: str) -> bool:
    total = 0
    for k, x in enumerate(reversed(digits)):
        n = int(x) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(x for x in text if "0" <= x <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from their @ so that long words cost no more."""
    last = at = 0
    while (at := text.find("@", at)) >= 0:
        low = at
        while low > last and (c := text[low - 1]) < "\x7f" and (c.isalnum() or c in "._%+-"):
            low -= 1
        m = _DOMAIN.match(text, at) if low < at else None
        if m:
            yield low, m.end()
            last = at = m.end()
        else:
            at += 1


def _looks_random(run: str) -> bool:
    """Letters and digits change often: hexadecimal digits only, or both cases; words joined by signs do not."""
    changes = sum((a in "0123456789") != (b in "0123456789") for a, b in zip(run, run[1:]))
    return changes * 6 >= len(run) and (bool(_HEX.match(run)) or run.lower() != run != run.upper())


def candidates(text: str) -> list[tuple[int, int, int, bool, bool]]:
    """(start, end, kind, loose, valid) of all candidates; base matches are those not loose and valid."""
    out = []
    if "@" in text:
        out += [(a, b, 0, False, True) for a, b in emails(text)]
    if re.search("[0-9]", text):
        out += [(m.start(), m.end(), 1, False, all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))) for m in _IP.finditer(text)]
        for m in _CARD.finditer(text):
            d = _digits(m[0])
            if 14 <= len(d) <= 19:
                out.append((m.start(), m.end(), 2, False, luhn(d)))
        if "+" in text:
            out += [(m.start(), m.end(), 3, False, 10 <= len(_digits(m[0])) <= 15) for m in _PHONE.finditer(text)]
        out += [(m.start(), m.end(), 3, True, True) for m in _LOOSE_PHONE.finditer(text)]
        out += [(m.start(), m.end(), 4, True, _looks_random(m[0])) for m in _SECRET.finditer(text) if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])]
    if "dot" in text and "at" in text:
        out += [(m.start(), m.end(), 0, True, True) for m in _LOOSE_MAIL.finditer(text)]
    return out


def votes_and_features(text: str, span: tuple[int, int, int, bool, bool]) -> tuple[int, int]:
    """Bit sets of LABELERS (1: personal data) and of FEATURES."""
    a, b, kind, loose, valid = span
    before = text[max(0, a - 40) : a]
    cue = bool(_CUE[KINDS[kind]].search(before))
    bounded = (a == 0 or not text[a - 1].isalnum()) and (b == len(text) or not text[b].isalnum())
    inner = text[a:b]
    many, grouped = len(_digits(inner)) >= 10, bool(re.search(r"[ ().-]", inner))
    if kind == 4:  # a fixed length as a pattern, a value assigned or in quotes as context
        assigned = bool(re.search(r"[=:][ \"']{0,3}\Z|[\"'`]\Z", before))
        vote = (len(inner) in (20, 32, 40, 64)) | valid << 1 | cue << 2 | assigned << 3
    else:
        vote = (not loose and valid) | valid << 1 | cue << 2 | (bounded and (cue or not loose)) << 3
    return vote, loose | valid << 1 | cue << 2 | bounded << 3 | many << 4 | grouped << 5


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count: dict = {}
    for batch in batches:
        for text in batch.column(0).to_pylist():
            for span in candidates(text):
                key = (span[2], *votes_and_features(text, span))
                count[key] = count.get(key, 0) + 1
    rows = [(*k, n) for k, n in count.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], ["kind", "vote", "feature", "n"])


def reliabilities(votes: np.ndarray, n: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """(P(vote = 1 | class) as labelers x 2, posterior of each vote pattern) by EM.

    Votes are independent given the class. It starts from the majority of the votes and
    keeps each labeler better than chance, so that class 1 means personal data.
    """
    p = votes.mean(1) * 0.9 + 0.05
    rate = np.zeros((votes.shape[1], 2))
    for _ in range(rounds):
        w = np.stack(((1 - p) * n, p * n))
        rate = ((w @ votes + 1) / (w.sum(1, keepdims=True) + 2)).T
        rate[:, 1] = np.maximum(rate[:, 1], rate[:, 0])
        prior = (w.sum(1) + 1) / (n.sum() + 2)
        log = np.log(prior) + votes @ np.log(rate) + (1 - votes) @ np.log(1 - rate)
        new = 1 / (1 + np.exp(log[:, 0] - log[:, 1]))
        if np.abs(new - p).max() < 1e-9:
            break
        p = new
    return rate, p


def train(x: np.ndarray, p: np.ndarray, n: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Weights of a logistic classifier on soft labels p with counts n, by Newton steps."""
    x = np.hstack((x, np.ones((len(x), 1))))
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (q - p)) + 0.1 * w
        step = np.linalg.solve((x * (n * q * (1 - q))[:, None]).T @ x + 0.1 * np.eye(len(w)), grad)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return w


def _bits(x: np.ndarray, n: int) -> np.ndarray:
    return (x[:, None] >> np.arange(n) & 1).astype(float)


def fit(patterns: list[tuple[int, int, int, int]]) -> dict[tuple[int, int], float]:
    """Probability by (kind, features), from rows (kind, vote, feature, count)."""
    out = {}
    for kind, rows in groupby(sorted(patterns), key=lambda r: r[0]):
        r = np.array(list(rows), np.int64)
        _, p = reliabilities(_bits(r[:, 1], len(LABELERS)), r[:, 3].astype(float))
        x = _bits(r[:, 2], len(FEATURES))
        w = train(x, p, r[:, 3].astype(float))
        for f, q in zip(r[:, 2], 1 / (1 + np.exp(-np.clip(np.hstack((x, np.ones((len(x), 1)))) @ w, -30, 30)))):
            out[kind, int(f)] = float(q)
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def find_spans(text: str | None, model: dict[tuple[int, int], float]) -> tuple[list, list]:
    """(base spans, all spans), each (start, kind, end)."""
    text = text or ""
    found = candidates(text)
    base = [(a, k, b) for a, b, k, loose, valid in found if valid and not loose]
    more = []
    for span in found:
        a, b, k, loose, valid = span
        # a span that fails its value check is no personal data of its kind; one inside a base span is known
        if loose and valid and model.get((k, votes_and_features(text, span)[1]), 0.0) >= ACCEPT and not any(x < b and a < y for x, _, y in base):
            more.append((a, k, b))
    return base, base + more


def _extract(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for text in batch.column(1).to_pylist():
                base, every = find_spans(text, model)
                n = [0] * len(KINDS)
                for _, k, _ in base:
                    n[k] += 1
                for x, v in zip(cols, (*n[:4], hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every))):
                    x.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in cols[:4]), *(pa.array(x, pa.string()) for x in cols[4:])], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return run


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for each row of docs.

    spans may hold secrets, which are in no base pattern.
    """
    ws = Workspace(docs.sparkSession, "pii")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # the JVM passes by texts that cannot hold a candidate, so that they never reach Python here
    some = d.where(F.col("text").rlike(r"[0-9@]") | (F.col("text").contains("dot") & F.col("text").contains("at"))).select("text")
    counted = some.mapInArrow(_patterns, "kind long, vote long, feature long, n long").groupBy("kind", "vote", "feature").agg(F.sum("n").alias("n")).collect()
    model = fit([tuple(r) for r in counted])
    return ws.finish(d.mapInArrow(_extract(model), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"))
