"""Parts that a user may replace: registered by kind and name, and taken by name.

Kinds and what they are called with::

    tokenizer    Column of texts          -> Column of arrays of tokens
    splitter     a run of ideographs      -> its words
    dictionary   SparkSession             -> DataFrame of entries
    decoder      bytes                    -> (text, encoding, plausibility)
    codec        (pack, unpack)           of senses
    measure      a token                  -> its width
    readings     SparkSession             -> DataFrame of character, numeric, rank
    bytes        a Python DataSource      registered with the session
"""

from __future__ import annotations

import io
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

KINDS = ("tokenizer", "splitter", "dictionary", "decoder", "codec", "measure", "readings", "bytes")
_parts: dict[tuple[str, str], object] = {}


def register(kind: str, name: str, part: object) -> None:
    if kind not in KINDS:
        raise ValueError(f"no kind {kind}")
    _parts[kind, name] = part


def take(kind: str, name: str):
    if (kind, name) not in _parts:
        raise KeyError(f"no {kind} {name}; there are {sorted(n for k, n in _parts if k == kind)}")
    return _parts[kind, name]


class BoundedCache:
    """The values asked for lately; an absent value (None) is kept as well."""

    def __init__(self, most: int):
        self.most, self.held = max(1, most), OrderedDict()

    def get(self, key, make: Callable):
        if key in self.held:
            self.held.move_to_end(key)
            return self.held[key]
        value = self.held[key] = make(key)
        if len(self.held) > self.most:
            self.held.popitem(last=False)
        return value


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class _ByteReader(DataSourceReader):
    """Each partition reads the lines that begin in its range of bytes."""

    def __init__(self, options):
        self.path, self.size = options["path"], int(options.get("rangeBytes", 1 << 26))

    def _fs(self):
        from pyarrow.fs import FileSystem, LocalFileSystem

        return FileSystem.from_uri(self.path) if "://" in self.path else (LocalFileSystem(), self.path)

    def partitions(self):
        fs, path = self._fs()
        total = fs.get_file_info(path).size
        return [_Range(path, at, min(at + self.size, total)) for at in range(0, total, self.size)] or [_Range(path, 0, 0)]

    def read(self, part):
        fs, _ = self._fs()
        with io.BufferedReader(fs.open_input_file(part.path)) as f:
            at = part.start
            if at:  # a line that began before goes to the range it began in
                f.seek(at - 1)
                at += len(f.readline()) - 1
            f.seek(at)
            while at < part.end:
                line = f.readline()
                if not line:
                    break
                yield (at, line.rstrip(b"\n").rstrip(b"\r").decode("utf-8", "replace"))
                at += len(line)


class ByteLines(DataSource):
    """Format "byte_lines": offset and line of a UTF-8 file, split into ranges of bytes."""

    @classmethod
    def name(cls) -> str:
        return "byte_lines"

    def schema(self) -> str:
        return "offset long, line string"

    def reader(self, schema):
        return _ByteReader(self.options)


def _defaults() -> None:
    from glyphflow.functions import text as X
    from glyphflow.operators.layout import measure
    from glyphflow.sources import codec, encodings

    register("tokenizer", "script", X.runs)
    register("splitter", "characters", list)
    register("decoder", "detect", encodings.detect)
    register("codec", "compact-v1", (codec.pack, codec.unpack))
    register("measure", "cells", measure)
    register("bytes", "byte_lines", ByteLines)


_defaults()
