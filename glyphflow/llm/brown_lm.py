"""Language-model scoring with class-based n-grams.

Words of the training documents are counted over the whole corpus. Exchange clustering puts
words into classes in two stages. First the FREQUENT most frequent words, and types that
join rarer words by their ending, are exchanged one by one over their bigram counts. Then
every further word that was seen OWN times or more is exchanged by its own contexts: a pass
over the corpus sends out the classes before and after it, and each word takes the class
with the largest gain in likelihood, all words against the same class bigrams, in parallel.
Only rarer words keep the class of their ending. Class bigrams and sizes are then counted
anew.

A word's probability is P(class | class before) * P(word | class), both smoothed by
additive counts, and a text's score is the sum of log10 over its tokens.

What grows with the corpus stays distributed. Contexts leave the pass as one row for each
block of words (a range of hashes), in which a word stands once with all its neighbours'
classes; a block's rows meet in one call, which gives the count and class of each of its
words. Bounded by parameters, and so shared with all workers: the KNOWN most frequent words
with their counts and classes (found by a histogram of counts), and the types' bigram
matrix. KNOWN says only where a word is looked up and changes no result: texts are encoded
once, one byte of class for each token; words that are not shared leave with their place in
the text, meet their counts and classes in one join, and come back to the text's row. Class
bigrams and scores are then read from the bytes. Such words are rare by their rank, so that
the join has no hot key.

Words are counted by their bytes; those in the passes are compared by 64-bit hashes.

Training documents are those with crc32 of the id as text mod 5 other than 1.

Defined cases: a null or empty text has the end token only; without training documents all
counts are 0; repeated rows are scored each by itself (and counted each); a null id counts
as the text "None" and is no held-out one; an empty table gives an empty table; further
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphflow.llm.kernels import _LOWER, Bytes, slices, span_hash
from glyphflow.plans.staging import Workspace

END = b"\n"
FREQUENT, ENDINGS = 384, 127
CLASSES, SWEEPS = 64, 6
KNOWN, OWN = 1 << 18, 5
FLUSH, HELD, PIECE, AT_ONCE, BLOCK = 400_000, 2_000_000, 1 << 20, 1024, 1 << 19


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 1


def _words(text: bytes | None) -> list[bytes]:
    """bytes.lower and bytes.split know A-Z and the six ASCII spaces only, as is asked."""
    return (text or b"").lower().split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["word", "c"])
        total.clear()
        return out

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            if not held_out(doc_id):
                total.update(_words(text))
                total[END] += 1
            if len(total) > FLUSH:
                yield flush()
    if total:
        yield flush()


class TypeOf(dict):
    """word -> type: room for the frequent ones, then types of endings (the last three bytes), then the end token."""

    def __init__(self, frequent: list[bytes], room: int = FREQUENT):
        super().__init__({w: k for k, w in enumerate(frequent)})
        self.room = room
        self[END] = self.size - 1

    @property
    def size(self) -> int:
        return self.room + ENDINGS + 1

    def ending(self, word: bytes) -> int:
        return self.room + zlib.crc32(word[-3:]) % ENDINGS

    __missing__ = ending


def hashes(words: list[bytes]) -> np.ndarray:
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    return span_hash(np.frombuffer(b"".join(words), np.uint8), np.append(0, ends)[:-1], ends)


class Places:
    """Where a hash stands in an array of distinct hashes, by open addressing over whole arrays."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(keys, np.uint64(0))  # for slots that are free; no slot points to it
        self.mask = np.uint64((1 << max(4, (4 * len(keys)).bit_length())) - 1)
        self.slots = np.full(int(self.mask) + 1, -1, np.int32)
        left, at = np.arange(len(keys), dtype=np.int32), keys & self.mask
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            out = self.slots[at] != left
            left, at = left[out], (at[out] + np.uint64(1)) & self.mask

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places, or -1."""
        at = h & self.mask
        k = self.slots[at]
        again = np.flatnonzero((k >= 0) & (self.keys[k] != h))
        while len(again):
            at[again] = (at[again] + np.uint64(1)) & self.mask
            k[again] = self.slots[at[again]]
            again = again[(k[again] >= 0) & (self.keys[k[again]] != h[again])]
        return k


_CRC = np.arange(256, dtype=np.uint32)  # the table of zlib's crc32
for _ in range(8):
    _CRC = (_CRC >> 1) ^ (_CRC & 1) * np.uint32(0xEDB88320)


class Flat:
    """Words of texts in one sequence, with an end after each text; ``at``: each word's place in it."""

    def __init__(self, col: pa.Array):
        source = Bytes(col)
        self.rows, self.data, self.words = source.rows, source.data, source.words()
        self.hash = self.words.hash
        self.at = np.arange(len(self.words)) + self.words.row
        self.starts = self.words.first + np.arange(self.rows + 1)  # of each text, and the end

    def endings(self, which: np.ndarray) -> np.ndarray:
        """As TypeOf.ending has them, without the room before: crc32 of each word's last three bytes."""
        starts, ends = self.words.starts[which], self.words.ends[which]
        c = np.full(len(which), 0xFFFFFFFF, np.uint32)
        for k in (3, 2, 1):
            at = ends - k
            c = np.where(at >= starts, _CRC[(c ^ _LOWER[self.data[np.maximum(at, 0)]]) & 255] ^ (c >> 8), c)
        return (c ^ np.uint32(0xFFFFFFFF)) % ENDINGS

    def types(self, top: Places, room: int) -> np.ndarray:
        """TypeOf of each word."""
        k = top.find(self.hash)
        far = np.flatnonzero(k < 0)
        k[far] = room + self.endings(far)
        return k

    def spread(self, of_words: np.ndarray, of_end: int) -> np.ndarray:
        """Values of the sequence, an end before it."""
        out = np.full(1 + int(self.starts[-1]), of_end, of_words.dtype)
        out[1 + self.at] = of_words
        return out


def _training(batches: Iterator[pa.RecordBatch]) -> Iterator[Flat]:
    for batch in batches:
        part = batch.filter(pa.array([not held_out(k) for k in batch.column(0).to_pylist()], pa.bool_()))
        if part.num_rows:
            yield from (Flat(x.column(1)) for x in slices(part))


def _bigrams(top: Places, room: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = room + ENDINGS + 1
        total = np.zeros(size * size, np.int64)
        for flat in _training(batches):
            ids = flat.spread(flat.types(top, room), size - 1).astype(np.int64)
            total += np.bincount(ids[:-1] * size + ids[1:], minlength=size * size)
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], ["k", "n"])

    return run


def _contexts(top: Places, room: int, of: np.ndarray, blocks: int):
    """The classes after and before each word that is not a type of its own; one row for each block of words."""

    def rows(held: list[tuple]) -> pa.RecordBatch:
        h, ending, near = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(h)
        h, near = h[order], near[order]
        at = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        word, ending, n = h[at], ending[order[at]], np.diff(np.append(at, len(h))).astype(np.int32)
        block = ((word >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)
        there, cut = np.unique(block, return_index=True)
        cut, near_cut = np.append(cut, len(word)), np.append(at[cut], len(h))
        parts = lambda x, bounds: pa.array([x[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), parts(word, cut), parts(ending, cut), parts(n, cut), parts(near, near_cut)], ["block", "words", "endings", "n", "near"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for flat in _training(batches):
            kind = flat.types(top, room)
            cls = flat.spread(of[kind].astype(np.uint8), 0)
            own = np.flatnonzero(kind >= room)
            at = 1 + flat.at[own]
            held.append((flat.hash[own], (kind[own] - room).astype(np.uint8), np.stack((cls[at + 1], cls[at - 1]), 1)))
            size += len(own)
            if size > HELD:
                yield rows(held)
                held, size = [], 0
        if size:
            yield rows(held)

    return run


def _exchanged(model, big: np.ndarray, room: int, of: np.ndarray):
    """Count and class of each word of a block; word: its place among the known, or -1."""

    def run(block: pa.Table) -> pa.Table:
        read = lambda name, kind: np.frombuffer(b"".join(block.column(name).to_pylist()), kind)
        n, near = read("n", np.int32), read("near", np.uint8).reshape(-1, 2)
        h, at = np.unique(read("words", np.uint64), return_inverse=True)
        c = np.bincount(at, n, len(h)).astype(np.int64)
        ending = np.zeros(len(h), np.int64)
        ending[at] = read("endings", np.uint8)
        old = of[room + ending]
        new = old.copy()
        own = np.flatnonzero(c >= OWN)
        row = np.full(len(h), -1)
        row[own] = np.arange(len(own))
        cells, ends, k = np.zeros(len(own) * 2 * CLASSES, np.int64), np.append(0, np.cumsum(n)), 0
        while k < len(n):  # a common word may be seen far more often than its block has words
            to = max(k + 1, int(np.searchsorted(ends, ends[k] + PIECE, "right")) - 1)
            at_row = np.repeat(row[at[k:to]], n[k:to])
            known, at_row = at_row >= 0, at_row[at_row >= 0] * 2 * CLASSES
            for side, x in enumerate(near[ends[k] : ends[to]][known].T):
                cells += np.bincount(at_row + side * CLASSES + x, minlength=len(cells))
            k = to
        cells = cells.reshape(-1, 2, CLASSES)
        for k in range(0, len(own), AT_ONCE):
            some, beside = own[k : k + AT_ONCE], cells[k : k + AT_ONCE].astype(float)
            new[some] = best_classes(big, old[some], beside[:, 0], beside[:, 1])
        return pa.table({"word": model.value.find(h), "h": h.view(np.int64), "c": c, "old": old.astype(np.int32), "class": new.astype(np.int32)})

    return run


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))  # counts: 0 or 1 at least


def gains(big: np.ndarray, right: np.ndarray, left: np.ndarray, self_: float = 0.0) -> np.ndarray:
    """What each class gains in likelihood by a word with such classes after and before it; class 0 is the end's alone."""
    rows, cols = big.sum(1), big.sum(0)
    gain = (_xlogx(big + right) - _xlogx(big)).sum(1) + (_xlogx(big + left[:, None]) - _xlogx(big)).sum(0)
    d = np.diag(big)
    gain += _xlogx(d + right + left + self_) - _xlogx(d + right) - _xlogx(d + left) + _xlogx(d)
    # counts of the word before and after itself go to each class's own cell
    gain -= _xlogx(rows + right.sum() + self_) - _xlogx(rows) + _xlogx(cols + left.sum() + self_) - _xlogx(cols)
    gain[0] = -np.inf
    return gain


def best_classes(big: np.ndarray, now: np.ndarray, right: np.ndarray, left: np.ndarray) -> np.ndarray:
    """For each word (a row) the class of the largest gain, the word taken out of the one it is in.

    right, left: counts of the classes after and before it. No empty class is taken, which many
    words would choose at once. Classes that are not beside a word change no cell, so only
    the others are looked at.
    """
    all_, away = np.arange(len(now)), np.ascontiguousarray(big.T)
    d = np.tile(np.diag(big), (len(now), 1))
    d[all_, now] = np.maximum(big[now, now] - right[all_, now] - left[all_, now], 0)
    gain = _xlogx(d + right + left) - _xlogx(d + right) - _xlogx(d + left) + _xlogx(d)
    for near, other, cells in ((right, left, away), (left, right, big)):
        logs = _xlogx(cells)
        w, k = np.nonzero(near)
        n, own, e = near[w, k], now[w], np.arange(len(w))
        rest, was = cells[k], logs[k]
        rest[e, own] = np.maximum(rest[e, own] - n, 0)
        was[e, own] = _xlogx(rest[e, own])
        same = np.flatnonzero(k == own)
        rest[same] = np.maximum(rest[same] - other[w[same]], 0)
        was[same] = _xlogx(rest[same])
        rest += n[:, None]
        if len(w):
            first = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
            gain[w[first]] += np.add.reduceat(_xlogx(rest) - was, first)
        # sums of this side's cells, without the word
        out = np.maximum(away[now] - left if cells is away else big[now] - right, 0)
        sums = cells.sum(0) - (away[now] if cells is away else big[now]) + out
        mine = np.maximum(big[now] - right if cells is away else away[now] - left, 0)
        sums[all_, now] = mine.sum(1) - mine[all_, now] + d[all_, now]
        gain -= _xlogx(sums + near.sum(1, keepdims=True)) - _xlogx(sums)
    gain[:, big.sum(1) <= 0] = -np.inf
    gain[:, 0] = -np.inf
    best = gain.argmax(1)
    return np.where(gain[all_, best] > gain[all_, now] + 1e-9, best, now)


def exchange(n: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each type: moves single types while the class bigrams' likelihood grows.

    n: bigram counts of types; the last type is the end token and stays alone in class 0.
    """
    m = len(n)
    of = 1 + np.arange(m) % (classes - 1)
    of[-1] = 0
    order = np.argsort(-(n.sum(0) + n.sum(1)), kind="stable")
    one = np.zeros((m, classes))
    one[np.arange(m), of] = 1
    big = one.T @ n @ one
    for _ in range(sweeps):
        moved = 0
        for w in order:
            if w == m - 1 or not (n[w].any() or n[:, w].any()):
                continue
            a, self_ = of[w], n[w, w]
            one[w, a] = 0
            right, left = n[w] @ one, n[:, w] @ one
            big[a] -= right
            big[:, a] -= left
            big[a, a] -= self_
            gain = gains(big, right, left, self_)
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            one[w, b] = 1
            big[b] += right
            big[:, b] += left
            big[b, b] += self_
            of[w] = b
            moved += a != b
        if not moved:
            break
    return of


def _encoded(model):
    """A row for each text: a byte of class for each token, sums over the known words, and the others with their places.

    A word that is not known has its ending's class and count 0 here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        m, row = model.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch) if batch.num_rows else ():
                flat = Flat(part.column(1))
                words, ids = flat.words, part.column(0).to_pylist()
                place = m["known"].find(flat.hash)
                far = np.flatnonzero(place < 0)
                cls = m["class"][place]
                cls[far] = m["of"][m["room"] + flat.endings(far)]
                at = (flat.at - flat.starts[words.row])[far]
                bounds = np.searchsorted(far, words.first).astype(np.int32)
                sums = [np.bincount(words.row, m[x][place], flat.rows) + m[x][m["end"]] for x in ("seen", "base", "emit")]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row + np.arange(flat.rows)),
                        pa.array(ids, pa.int64()),
                        pa.array([not held_out(k) for k in ids], pa.bool_()),
                        pa.array(np.diff(flat.starts)),
                        pa.array(sums[0].astype(np.int64)),
                        *map(pa.array, sums[1:]),
                        pa.Array.from_buffers(pa.binary(), flat.rows, [None, pa.py_buffer(flat.starts.astype(np.int32)), pa.py_buffer(flat.spread(cls, 0)[1:].copy())]),
                        pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat.hash[far].view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(bounds), pa.array(at.astype(np.int32))),
                    ],
                    ["row", "doc_id", "training", "n", "n_known", "base", "emit", "cls", "far", "at"],
                )
                row += flat.rows

    return run


def _classes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the tokens of all texts, an end before them, and the texts' bounds; moved words have their own class."""
    source, moved = Bytes(batch.column(0)), batch.column(1)
    cls = np.append(np.uint8(0), source.data)
    n = moved.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    x = moved.flatten().to_numpy(zero_copy_only=False)
    cls[1 + np.repeat(source.bounds[:-1], n) + x // CLASSES] = x % CLASSES
    return cls.astype(np.int64), source.bounds


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of class bigrams."""
    total = np.zeros(CLASSES * CLASSES, np.int64)
    for batch in batches:
        if batch.num_rows:
            cls, _ = _classes(batch)
            total += np.bincount(cls[:-1] * CLASSES + cls[1:], minlength=CLASSES * CLASSES)
    k = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], ["k", "n"])


def _score(step: np.ndarray, rare: np.ndarray):
    """log10 of class steps and of the class's part in emissions, added to the counts' part; the columns after it go along."""
    both = (step + rare).ravel()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cls, bounds = _classes(batch)
                s = np.add.reduceat(both[cls[:-1] * CLASSES + cls[1:]], bounds[:-1])  # each text has its end
                yield pa.RecordBatch.from_arrays([pa.array(s + batch.column(2).to_numpy()), *batch.columns[3:]], ["score", "doc_id", "n", "n_known", "base"])

    return run


def most_frequent(counts: DataFrame, most: int) -> tuple[list[bytes], np.ndarray]:
    """The most frequent words with their counts, those of equal count by their bytes.

    A histogram of counts says which count the last one has; only words of that count are
    put in order, the others are taken as they are.
    """
    found, least = 0, 0
    bins = counts.groupBy(F.least("c", F.lit(1 << 16)).alias("c")).agg(F.count("*").alias("n")).collect()  # at most 65,536 rows
    for c, n in sorted(((r.c, r.n) for r in bins), reverse=True):
        if found + n > most:
            least = c
            break
        found += n
    take = counts.where(F.col("c") > least) if least < 1 << 16 else counts.where("false")
    if least:
        take = take.union(counts.where(F.least("c", F.lit(1 << 16)) == least).orderBy(F.desc("c"), "word").limit(most - found)) if most > found else take
    top = take.toArrow()
    words, c = [bytes(x) for x in top.column("word").to_pylist()], top.column("c").to_numpy().astype(np.int64)
    order = sorted(range(len(words)), key=lambda k: (-c[k], words[k]))
    return [words[k] for k in order], c[order]


def _cells(df: DataFrame, size: int) -> np.ndarray:
    """The sums of n by k, as an array."""
    got, out = df.groupBy("k").agg(F.sum("n").alias("n")).toArrow(), np.zeros(size)
    out[got.column("k").to_numpy()] = got.column("n").to_numpy()
    return out


def fit(d: DataFrame, counts: DataFrame, room: int = FREQUENT, ws: Workspace | None = None) -> dict:
    """The classes of words, and the base's parts.

    found: a staged table (word, h, c, old, class) of all words that are no types of their own:
    place among the known or -1, hash, count, ending's class and class.
    """
    share, ws = d.sparkSession.sparkContext.broadcast, ws or Workspace(d.sparkSession, "brown")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    words, c = most_frequent(counts, KNOWN)
    if END not in words:  # always among the known, even without training documents
        rare_end = counts.where(F.col("word") == F.lit(END)).first()
        words, c = [*words, END], np.append(c, rare_end.c if rare_end else 0)
    frequent = [w for w in words if w != END][:room]
    kinds, top = TypeOf(frequent, room), Places(hashes(frequent))
    grams = _cells(d.mapInArrow(_bigrams(top, room), "k long, n long"), kinds.size**2).reshape(kinds.size, kinds.size)
    of = exchange(grams)
    known_class = of[np.fromiter(map(kinds.__getitem__, words), np.int64, len(words))]
    own = c >= OWN
    own[[k for k, w in enumerate(words) if w in kinds]] = False
    one = np.zeros((kinds.size, CLASSES))
    one[np.arange(kinds.size), of] = 1
    known = Places(hashes(words))
    shared = share(known)
    near = d.mapInArrow(_contexts(top, room, of, 64 + n // BLOCK), "block int, words binary, endings binary, n binary, near binary")
    found = ws.keep(near.groupBy("block").applyInArrow(_exchanged(shared, one.T @ grams @ one, room, of), "word int, h long, c long, old int, class int"))
    shared.unpersist()
    moved = found.where("word >= 0 AND old <> class").select("word", "class").toArrow()
    known_class[moved.column("word").to_numpy()] = moved.column("class").to_numpy()
    scale = np.log10(n + 0.5 * (v + 1))
    return {"index": {w: k for k, w in enumerate(words)}, "kinds": kinds, "of": of, "known": known, "known_class": known_class, "own": own, "counts": c, "scale": scale, "total": int(n), "found": found}


def _sizes(m: dict) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and words of each class."""
    n, v = np.zeros(CLASSES), np.zeros(CLASSES)
    at = np.array([m["index"][w] for w in m["kinds"]], np.int64)
    at = at[m["counts"][at] > 0]
    np.add.at(n, m["known_class"][at], m["counts"][at])
    np.add.at(v, m["known_class"][at], 1)
    for r in m["found"].groupBy("class").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():  # at most CLASSES
        n[r["class"]] += r.n
        v[r["class"]] += r.v
    return n, v


def score_texts(docs: DataFrame, room: int = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row."""
    spark = docs.sparkSession
    ws = Workspace(spark, "brown")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    counts = ws.keep(d.mapInArrow(_count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")))
    m = fit(d, counts, room, ws)
    ws.drop(counts)
    logs = np.log10(np.append(m["counts"], 0) + 0.5)  # the last is for words that are not known
    model = spark.sparkContext.broadcast({"known": m["known"], "class": np.append(m["known_class"], 0).astype(np.uint8), "of": m["of"].astype(np.uint8), "room": room, "end": m["index"][END], "seen": np.append(m["counts"] > 0, False).astype(float), "base": logs - m["scale"], "emit": logs})
    rows = ws.keep(d.mapInArrow(_encoded(model), "row long, doc_id long, training boolean, n long, n_known long, base double, emit double, cls binary, far array<long>, at array<int>"))
    far = rows.select("row", F.explode(F.arrays_zip("far", "at")).alias("x")).select("row", F.col("x.far").alias("far"), F.col("x.at").alias("at"))
    seen = m["found"].where("word < 0").select("h", "c", F.when(F.col("old") != F.col("class"), F.col("class")).alias("class"))
    late = far.join(seen, F.col("far") == F.col("h")).groupBy("row").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("c") + 0.5) - F.log10(F.lit(0.5))).alias("add"), F.collect_list(F.col("at") * CLASSES + F.col("class")).alias("moved"))
    more, add = F.coalesce("more", F.lit(0)), F.coalesce("add", F.lit(0.0))
    ready = ws.keep(rows.join(late.withColumnRenamed("row", "of"), F.col("row") == F.col("of"), "left").select("cls", "moved", (F.col("emit") + add).alias("emit"), "doc_id", "n", (F.col("n_known") + more).alias("n_known"), (F.col("base") + add).alias("base"), "training"))
    ws.drop(rows)
    big = _cells(ready.where("training").select("cls", "moved").mapInArrow(_steps, "k long, n long"), CLASSES * CLASSES).reshape(CLASSES, CLASSES)
    step = np.log10((big + 0.5) / (big.sum(1, keepdims=True) + 0.5 * CLASSES))
    cn, cv = _sizes(m)
    out = ready.drop("training").mapInArrow(_score(step, -np.log10(cn + 0.5 * (cv + 1))), "score double, doc_id long, n long, n_known long, base double").select(
        "doc_id",
        (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 1).alias("held_out"),
        F.col("n").alias("n_tokens"),
        "n_known",
        F.lit(int(m["total"])).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        "score",
    )
    return ws.finish(out)
