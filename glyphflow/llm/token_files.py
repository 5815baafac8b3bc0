"""Token files with a shared zstandard dictionary.

A shard holds documents of one range of ids in ascending order. Each document's ids are
serialized and compressed alone with a dictionary that was trained on serialized id
arrays, so a short document is read without its neighbours. Layout of a shard::

    magic "GFTK" | version u16 | bytes per id u16 | 32-byte sha256 of the dictionary
    frames, one per document
    index: rows of doc_id i64, offset u64 (of the frame), size u32, n_tokens u32
    rows u64 | offset of the index u64 | magic "GFTK"

The dictionary lies beside the shards under the name of its sha256. A manifest row per
shard has the number of documents and ids and the number of ids in all shards before it.

The dictionary is fitted on a bounded sample: of SAMPLE_DOCS documents with the smallest
hashes of id and text, all ids are cut into records of RECORD_IDS, and the SAMPLE_DOCS
records with the smallest hashes are taken. Only the compression ratio depends on it. Every
document is written.

Shards follow from the counted rows and bytes, so that a shard and its index stay small
however large the table is. Ranges are over (id, hash of the text), so that rows of one id
may lie in several shards.

Ids take two bytes, or four where the vocabulary has more than 65,536.

Defined cases: a null or empty text has the end id only; rows with the same id follow each
other by the hash of their text, then by the text; an empty table writes no shard; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import struct
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphflow.llm.tokens import encoder
from glyphflow.plans.staging import Workspace

MAGIC, VERSION = b"GFTK", 1
HEAD, ROW, FOOT = struct.Struct("<4sHH32s"), np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("size", "<u4"), ("n_tokens", "<u4")]), struct.Struct("<QQ4s")
SAMPLE_DOCS, RECORD_IDS = 2000, 4000
DICT_BYTES = 32 << 10
LEVEL = 3
#: A shard has about so many documents and bytes of text at most; small tables are cut finer, for all cores.
SHARD_DOCS, SHARD_BYTES = 200_000, 256 << 20


class Store:
    """Files in the shared folder: a local mount, or any store that pyarrow reaches."""

    def __init__(self, root: str):
        url = urlparse(root)
        if url.scheme in ("", "file"):
            from pyarrow.fs import LocalFileSystem

            self.fs, self.root = LocalFileSystem(), url.path
        else:
            from pyarrow.fs import FileSystem

            self.fs, self.root = FileSystem.from_uri(root)

    def write(self, name: str, parts: Iterator[bytes]) -> None:
        """Writes under another name and moves, so that a task run again does no harm."""
        self.fs.create_dir(self.root, recursive=True)
        part = f"{self.root}/.{name}.{os.getpid()}.{os.urandom(4).hex()}"
        with self.fs.open_output_stream(part) as out:
            for x in parts:
                out.write(x)
        self.fs.move(part, f"{self.root}/{name}")

    def open(self, name: str):
        return self.fs.open_input_file(f"{self.root}/{name}")

    def read(self, name: str) -> bytes:
        with self.open(name) as f:
            return f.read()


def train_dictionary(samples: list[bytes]) -> bytes:
    """A zstandard dictionary; without enough samples an empty one, which is none."""
    import zstandard

    try:
        return zstandard.train_dictionary(min(DICT_BYTES, max(512, sum(map(len, samples)) // 8)), samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _zdict(data: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(data) if data else None


def shard_bytes(docs: Iterator[tuple[int, np.ndarray]], dictionary: bytes, width: int, into: list) -> Iterator[bytes]:
    """The bytes of one shard; into gets (documents, ids)."""
    import zstandard

    shared = _zdict(dictionary)
    if shared is not None:
        shared.precompute_compress(level=LEVEL)  # else each document would digest it anew
    zip_ = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_checksum=False, write_content_size=True)
    yield HEAD.pack(MAGIC, VERSION, width, hashlib.sha256(dictionary).digest())
    at, rows, total = HEAD.size, [], 0
    for doc_id, ids in docs:
        frame = zip_.compress(ids.astype(f"<u{width}").tobytes())
        rows.append((doc_id, at, len(frame), len(ids)))
        at += len(frame)
        total += len(ids)
        yield frame
    yield np.array(rows, ROW).tobytes()
    yield FOOT.pack(len(rows), at, MAGIC)
    into.append((len(rows), total))


class Shard:
    """Random access to a shard's documents."""

    def __init__(self, store: Store, name: str):
        import zstandard

        self.file = store.open(name)
        self.file.seek(self.file.size() - FOOT.size)
        n, at, magic = FOOT.unpack(self.file.read(FOOT.size))
        self.file.seek(0)
        head, version, self.width, digest = HEAD.unpack(self.file.read(HEAD.size))
        if (head, magic, version) != (MAGIC, MAGIC, VERSION):
            raise ValueError(f"{name} is not a token file")
        self.file.seek(at)
        self.index = np.frombuffer(self.file.read(n * ROW.itemsize), ROW)
        dictionary = store.read(f"{digest.hex()}.dict")
        if hashlib.sha256(dictionary).digest() != digest:
            raise ValueError(f"the dictionary of {name} has changed")
        self.unzip = zstandard.ZstdDecompressor(dict_data=_zdict(dictionary))

    def ids(self, k: int) -> np.ndarray:
        row = self.index[k]
        self.file.seek(int(row["offset"]))
        return np.frombuffer(self.unzip.decompress(self.file.read(int(row["size"]))), f"<u{self.width}")

    def find(self, doc_id: int) -> list[np.ndarray]:
        lo, hi = np.searchsorted(self.index["doc_id"], [doc_id, doc_id], "left")[0], np.searchsorted(self.index["doc_id"], doc_id, "right")
        return [self.ids(k) for k in range(lo, hi)]


def id_width(path: str | None, width: int | None) -> int:
    """Bytes per id; an explicit width too small for the vocabulary is refused."""
    need = 2 if max(encoder(path).size, encoder(path).end_id + 1) <= 1 << 16 else 4
    if width is not None and width < need:
        raise ValueError(f"ids of this vocabulary need {need} bytes, not {width}")
    return width or need


def write_token_files(docs: DataFrame, root: str, path: str | None = None, width: int | None = None) -> DataFrame:
    """Writes shards of docs (doc_id, text) under root; returns the manifest.

    Manifest: shard, n_docs, n_ids, before (ids in all earlier shards). It has one row per
    shard and is the only thing that is summed in one place.
    """
    spark, width = docs.sparkSession, id_width(path, width)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("of_text", F.xxhash64("text"))
    first = docs.select("doc_id", "of_text").distinct().orderBy(F.xxhash64("doc_id", "of_text"), "doc_id", "of_text").limit(SAMPLE_DOCS)
    records = docs.join(F.broadcast(first), ["doc_id", "of_text"]).dropDuplicates(["doc_id", "of_text"]).select("text").mapInArrow(_records(path, width), "ids binary")
    dictionary = train_dictionary(sorted(bytes(r.ids) for r in records.orderBy(F.xxhash64("ids"), "ids").limit(SAMPLE_DOCS).collect()))
    store = Store(root)
    store.write(f"{hashlib.sha256(dictionary).hexdigest()}.dict", iter([dictionary]))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out = Store(root)
        name, into = f"shard-{TaskContext.get().partitionId():06d}.gftk", []

        def ids():
            for batch in batches:
                for part, flat, bounds in encoder(path).batches(batch):
                    for k, doc_id in enumerate(part.column(0).to_pylist()):
                        yield doc_id, flat[bounds[k] : bounds[k + 1]]

        found = ids()
        head = next(found, None)
        if head is not None:
            from itertools import chain

            out.write(name, shard_bytes(chain([head], found), dictionary, width, into))
            yield pa.RecordBatch.from_pydict({"shard": [name], "n_docs": [into[0][0]], "n_ids": [into[0][1]]})

    n, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // SHARD_DOCS), -(-size // SHARD_BYTES))
    dealt = docs.repartitionByRange(max(1, min(parts, n)), "doc_id", "of_text").sortWithinPartitions("doc_id", "of_text", "text").select("doc_id", "text")
    wrote = dealt.mapInArrow(write, "shard string, n_docs long, n_ids long").collect()
    rows, before = [], 0
    for r in sorted(wrote, key=lambda r: r.shard):
        rows.append((r.shard, r.n_docs, r.n_ids, before))
        before += r.n_ids
    return spark.createDataFrame(rows, "shard string, n_docs long, n_ids long, before long")


def _records(path: str | None, width: int):
    def run(batches):
        for batch in batches:
            for _, flat, bounds in encoder(path).batches(batch):
                flat = flat.astype(f"<u{width}")
                got = [flat[at : min(at + RECORD_IDS, high)].tobytes() for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()) for at in range(low, high, RECORD_IDS)]
                yield pa.RecordBatch.from_pydict({"ids": pa.array(got, pa.binary())})

    return run


def read_token_files(manifest: DataFrame, root: str) -> DataFrame:
    """Reads every document back: doc_id, start, n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(root)
        for batch in batches:
            for name, before in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                shard = Shard(store, name)
                n = shard.index["n_tokens"].astype(np.int64)
                start = before + np.concatenate(([0], np.cumsum(n)[:-1]))
                crc = [zlib.crc32(shard.ids(k).astype("<u4").tobytes()) for k in range(len(n))]
                for at in range(0, len(n), 10_000):
                    to = slice(at, at + 10_000)
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(shard.index["doc_id"][to]), "start": pa.array(start[to]), "n_tokens": pa.array(n[to]), "ids_crc32": pa.array(crc[to], pa.int64())})

    n = max(1, min(manifest.count(), 10_000))
    return manifest.repartitionByRange(n, "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame) -> DataFrame:
    """Writes the token files in the shared folder and returns what they hold."""
    spark: SparkSession = docs.sparkSession
    ws = Workspace(spark, "tokens")
    return ws.finish(read_token_files(write_token_files(docs, f"{ws.root}/files"), f"{ws.root}/files"))
