"""Token ids of whole texts by a public word-level BPE, with each different piece encoded once.

The vocabulary's rules drop white space between words, so the ids of a text are those of its
space-separated pieces in order. A column is split and its pieces are dictionary-encoded by
Arrow; only different pieces are looked up, and ids are gathered by numpy from one buffer.
Each Python worker keeps the pieces it has met lately; others go to the library together.

A vocabulary file with other rules than those is encoded text by text.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from glyphflow.llm.kernels import slices

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
CACHE_PIECES = 500_000
SLICE_BYTES = 4 << 20
MARK = "\x01"
_SUFFIX = "</w>"
_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Symbols other than the apostrophe: beside a run of Latin letters a run of them is a word of its own.
_ENDS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Pieces:
    """The ids of pieces, one after the other in a buffer."""

    def __init__(self):
        self.at: dict[str, int] = {}
        self.bounds, self.ids = np.zeros(1 << 12, np.int64), np.zeros(1 << 14, "<u4")
        self.add([""], np.zeros(0, "<u4"), np.zeros(1, np.int64))

    def add(self, pieces: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        n = len(self.at)
        low = int(self.bounds[n])
        for name, need in (("bounds", n + len(pieces) + 1), ("ids", low + len(ids))):
            have = getattr(self, name)
            if need > len(have):
                more = np.zeros(max(need, 2 * len(have)), have.dtype)
                more[: len(have)] = have
                setattr(self, name, more)
        self.ids[low : low + len(ids)] = ids
        self.bounds[n + 1 : n + 1 + len(pieces)] = low + np.cumsum(lengths)
        self.at.update(zip(pieces, range(n, n + len(pieces))))


def _gather(ids: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ids[low:high] of all pairs one after the other, and the bounds of each."""
    size = high - low
    total = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=total[1:])
    return ids[np.arange(total[-1]) + np.repeat(low - total[:-1], size)], total


def _strings(col: pa.Array) -> list[str]:
    return col.to_numpy(zero_copy_only=False).tolist()


def _sizes(col: pa.Array) -> np.ndarray:
    return pc.binary_length(col).to_numpy(zero_copy_only=False)


class Encoder:
    """Encodes columns of texts to unsigned 32-bit ids, END_ID last in each text.

    Pieces met lately are kept in two generations of CACHE_PIECES; when the younger one is
    full it becomes the older one, so frequent pieces stay and memory is bounded.
    """

    def __init__(self, path: str | None = None, end_id: int = END_ID):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks take the cores
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        path = path or vocabulary_path()
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        self.size = max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1
        kinds = [x["type"] for x in (rules["normalizer"] or {}).get("normalizers", ())], [x["type"] for x in (rules["pre_tokenizer"] or {}).get("pretokenizers", ())]
        self.by_piece = rules["model"].get("end_of_word_suffix") == _SUFFIX and kinds == (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"])
        if self.by_piece:
            # lower-case Latin letters pass the rules unchanged, so that words of them need the merges only
            self.merges = Tokenizer.from_file(path)
            self.merges.normalizer = normalizers.Sequence([])
            self.merges.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.ends = np.zeros(self.size, bool)
            self.ends[[k for w, k in self.tokenizer.get_vocab(with_added_tokens=False).items() if w.endswith(_SUFFIX)]] = True
            mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
            self.mark = mark[0] if len(mark) == 1 else None
            self.young, self.old = _Pieces(), _Pieces()

    @staticmethod
    def _ids(tokenizer, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, "<u4") for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _add_each(self, pieces: list[str]) -> None:
        got = self._ids(self.tokenizer, pieces)
        self.young.add(pieces, np.concatenate([np.zeros(0, "<u4"), *got]), np.array([len(x) for x in got], np.int64))

    def _add_words(self, words: list[str]) -> None:
        """Words of lower-case Latin letters: each ends at its only token with the suffix."""
        ids = self._ids(self.merges, [" ".join(words)])[0]
        last = np.flatnonzero(self.ends[ids]) + 1
        if len(last) == len(words):
            self.young.add(words, ids, np.diff(last, prepend=0))
        else:
            self._add_each(words)

    def _add_marked(self, pieces: list[str]) -> None:
        """Any pieces, in one text with marks between them."""
        ids = self._ids(self.tokenizer, [f" {MARK} ".join(pieces)])[0] if self.mark is not None else np.zeros(0, "<u4")
        cut = np.flatnonzero(ids == self.mark)
        if len(cut) == len(pieces) - 1:
            self.young.add(pieces, np.delete(ids, cut), np.diff(np.concatenate(([-1], cut, [len(ids)]))) - 1)
        else:
            self._add_each(pieces)

    def _places(self, pieces: list[str], add) -> np.ndarray:
        """Where the pieces are in the younger generation; those not there yet are added."""
        at = self.young.at
        todo = list(dict.fromkeys(p for p in pieces if p not in at))
        if todo:
            again = [p for p in todo if p in self.old.at]
            if again:
                k = np.fromiter(map(self.old.at.__getitem__, again), np.int64, len(again))
                ids, bounds = _gather(self.old.ids, self.old.bounds[k], self.old.bounds[k + 1])
                self.young.add(again, ids, np.diff(bounds))
                todo = [p for p in todo if p not in at]
            for low in range(0, len(todo), 2000):
                add(todo[low : low + 2000])
        return np.fromiter(map(at.__getitem__, pieces), np.int64, len(pieces))

    def _names(self, names: pa.Array, special: bool) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of different pieces: symbols before, a word or what else there is, symbols after."""
        core = pc.ascii_trim(names, _ENDS)
        plain = pc.match_substring_regex(core, f"^[{_LATIN}]+$")
        if special:
            plain = pc.and_(plain, pc.invert(pc.match_substring(names, "<|")))
        plain = plain.to_numpy(zero_copy_only=False)
        place = np.zeros((len(names), 3), np.int64)
        words = pc.utf8_lower(core.filter(pa.array(plain))).dictionary_encode()
        place[plain, 1] = self._places(_strings(words.dictionary), self._add_words)[words.indices.to_numpy(zero_copy_only=False)] if len(words) else 0
        whole = _sizes(names)
        after = np.where(plain, whole - _sizes(pc.ascii_rtrim(names, _ENDS)), 0)
        before = np.where(plain, whole - after - _sizes(core), 0)
        for column, size, part in ((0, before, lambda p, n: p[:n]), (2, after, lambda p, n: p[-n:])):
            rows = np.flatnonzero(size)
            if len(rows):
                place[rows, column] = self._places([part(p, n) for p, n in zip(_strings(names.take(pa.array(rows))), size[rows].tolist())], self._add_marked)
        rest = np.flatnonzero(~plain)
        others = _strings(names.take(pa.array(rest)))
        odd = np.array(["<|" in p or MARK in p for p in others], bool)
        for mask, add in ((odd, self._add_each), (~odd, self._add_marked)):
            place[rest[mask], 1] = self._places([p for p, x in zip(others, mask.tolist()) if x], add)
        place = place.ravel()
        ids, bounds = _gather(self.young.ids, self.young.bounds[place], self.young.bounds[place + 1])
        return ids, bounds[::3]

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, bounds of the rows in them). A null text has the end id alone."""
        col = pc.fill_null(col, "")
        if not self.by_piece:
            each = [np.append(x, np.uint32(self.end_id)) for x in self._ids(self.tokenizer, col.to_pylist())]
            return np.concatenate([np.zeros(0, "<u4"), *each]), np.concatenate(([0], np.cumsum([len(x) for x in each], dtype=np.int64)))
        if len(self.young.at) > CACHE_PIECES:
            self.young, self.old = _Pieces(), self.young
        # capitals may keep a text from being a special token, so they stay where there may be one
        special = bool(pc.any(pc.match_substring(col, "<|")).as_py())
        lists = pc.split_pattern(pc.replace_substring(col if special else pc.ascii_lower(col), "\n", " "), " ")
        pieces = lists.flatten().dictionary_encode()
        ids, at = self._names(pieces.dictionary, special)
        which = pieces.indices.to_numpy(zero_copy_only=False)
        offsets = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        found, total = _gather(ids, at[which], at[which + 1])
        # an end id for each text
        bounds = total[offsets - offsets[0]] + np.arange(len(offsets))
        out = np.full(bounds[-1], self.end_id, "<u4")
        inside = np.ones(len(out), bool)
        inside[bounds[1:] - 1] = False
        out[inside] = found
        return out, bounds

    def batches(self, batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        """Slices of whole rows with their ids and bounds."""
        for part in slices(batch, column, SLICE_BYTES):
            yield part, *self.encode(part.column(part.schema.get_field_index(column)))


@lru_cache(maxsize=2)
def encoder(path: str | None = None, end_id: int = END_ID) -> Encoder:
    return Encoder(path, end_id)
