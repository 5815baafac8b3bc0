"""Encoding detection over binary files: byte order mark, else the first plausible decoder."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORDER = ("utf-8", "gb18030", "big5")
EVERY = ("utf-8", "utf-16-le", "utf-16-be", "gb18030", "big5")
LEAST = 0.9


def by_mark(data: bytes) -> tuple[str | None, int]:
    """Encoding and length of a byte order mark; UTF-32 marks are refused."""
    if data[:4] in (b"\xff\xfe\0\0", b"\0\0\xfe\xff"):
        return None, 0
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            return name, len(mark)
    return None, 0


def score(text: str) -> float:
    if not text:
        return 1.0
    good = bad = 0
    for c in text:
        k = unicodedata.category(c)
        if c == "�":
            bad += 8
        elif k in ("Cn", "Co", "Cs") or k == "Cc" and c not in "\t\n\r":
            bad += 1
        else:
            good += 1
    return good / (good + bad)


def detect(data: bytes) -> tuple[str | None, str | None, float]:
    """(text, encoding, plausibility); nothing if no decoder gives plausible text."""
    name, n = by_mark(data)
    for enc in (name,) if name else ORDER:
        try:
            text = data[n:].decode(enc)
        except UnicodeDecodeError:
            continue
        if name or score(text) >= LEAST:
            return text, enc, score(text)
    return None, None, 0.0


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("encoding", T.StringType()), T.StructField("plausibility", T.DoubleType())]))
def detected(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([detect(bytes(x) if x is not None else b"") for x in content], columns=["text", "encoding", "plausibility"])


PREVIEW_BYTES, PREVIEW_CHARS = 8192, 400


def forced(data: bytes, encoding: str) -> str | None:
    """The text in a named encoding, its byte order mark taken off; None if the bytes are not that."""
    if encoding not in EVERY:
        raise ValueError(f"no encoding {encoding}")
    name, n = by_mark(data)
    try:
        return data[n if name == encoding else 0 :].decode(encoding)
    except UnicodeDecodeError:
        return None


def previews(data: bytes) -> list[tuple[str, str, float]]:
    """(encoding, first characters, plausibility) of every encoding that can read the beginning, cut where a character ends."""
    out = []
    for encoding in EVERY:
        head = data[:PREVIEW_BYTES]
        for less in range(4):
            text = forced(head[: len(head) - less], encoding) if less <= len(head) else None
            if text is not None:
                out.append((encoding, text[:PREVIEW_CHARS], score(text)))
                break
    return out


def sniff(data: bytes) -> str:
    """The encoding of a card file: its mark, else the places of zero bytes near its beginning, else UTF-8."""
    name, _ = by_mark(data)
    if name:
        return name
    head = data[:64]
    odd, even = head[1::2].count(0), head[0::2].count(0)
    return "utf-16-le" if odd > even else "utf-16-be" if even > odd else "utf-8"


def byte_lines(data: bytes, start: int = 0) -> list[tuple[int, str]]:
    """(offset, line) from an offset on, in bytes of the file; a line's carriage return goes, lone surrogates become U+FFFD."""
    encoding = sniff(data)
    width = 1 if encoding == "utf-8" else 2
    if not 0 <= start <= len(data) or start % width or len(data) % width:
        raise ValueError(f"no character begins at {start} of {len(data)} bytes")
    at = max(start, by_mark(data)[1])
    end = "\n".encode(encoding)
    out = []
    while at < len(data):
        to = data.find(end, at)
        while to >= 0 and (to - at) % width:
            to = data.find(end, to + 1)
        line = data[at : to if to >= 0 else len(data)].decode(encoding, "replace")
        out.append((at, line.removesuffix("\r")))
        at = to + width if to >= 0 else len(data)
    return out


def _column(schema: str, f):
    @F.pandas_udf(schema)
    def run(content: pd.Series) -> pd.Series:
        return pd.Series([f(bytes(x) if x is not None else b"") for x in content])

    return run


def forced_text(content, encoding: str):
    return _column("string", lambda x: forced(x, encoding))(content)


def preview_rows(content):
    """array of (encoding, text, plausibility)."""
    return _column("array<struct<encoding:string,text:string,plausibility:double>>", previews)(content)


def line_rows(content):
    """array of (offset, line)."""
    return _column("array<struct<offset:bigint,line:string>>", byte_lines)(content)


def read_text_files(spark, path: str, encoding: str | None = None):
    """path, text, encoding, plausibility; where no text is found, previews say what each encoding would give."""
    files = spark.read.format("binaryFile").load(path)
    if encoding is not None:
        text = forced_text(F.col("content"), encoding)
        return files.select("path", text.alias("text")).withColumn("failed", F.col("text").isNull())
    x = files.select("path", "content", detected("content").alias("d"))
    return x.select("path", "d.*", F.when(F.col("d.text").isNull(), preview_rows(F.col("content"))).alias("previews"))
