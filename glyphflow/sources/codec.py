"""Senses as JSON, or as a compact binary payload, by the name that a container gives."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SIMPLE = "array<struct<id:int,kind:string,text:string,level:int>>"
VERSION, KINDS = 1, ("definition", "reference", "label")


def _number(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def pack(senses) -> bytes:
    """Version, count, and of each sense a byte of kind and presence bits, then what is there."""
    out = [bytes([VERSION]), _number(len(senses))]
    for k, s in enumerate(senses):
        text = (s["text"] or "").encode()
        out.append(bytes([KINDS.index(s["kind"]) | bool(text) << 2 | (s["level"] > 0) << 3 | (s["id"] != k) << 4]))
        out += [_number(len(text)), text] if text else []
        out += [_number(s["level"])] if s["level"] > 0 else []
        out += [_number(s["id"])] if s["id"] != k else []
    return b"".join(out)


def unpack(data: bytes) -> list[dict]:
    """The senses; a payload that is cut off or of another version is an error."""
    at = 0

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(data):
            raise ValueError("the payload is cut off")
        at += n
        return data[at - n : at]

    def number() -> int:
        n = shift = 0
        while True:
            b = take(1)[0]
            n |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return n

    if take(1)[0] != VERSION:
        raise ValueError("the payload has another version")
    out = []
    for k in range(number()):
        bits = take(1)[0]
        if bits & 3 >= len(KINDS):
            raise ValueError("the payload has an unknown kind")
        text = take(number()).decode() if bits & 4 else ""
        level = number() if bits & 8 else 0
        out.append({"id": number() if bits & 16 else k, "kind": KINDS[bits & 3], "text": text, "level": level})
    return out


def encode(senses: Column, codec: str | None) -> Column:
    """The payload by codec: None or json, or compact-v1."""
    if codec in (None, "json"):
        return F.encode(F.to_json(senses), "UTF-8")
    if codec != "compact-v1":
        raise ValueError(f"no codec {codec}")

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: pack(list(x)))

    return run(senses)


def decode(payload: Column, codec: str | None) -> Column:
    if codec in (None, "json"):
        return F.from_json(F.decode(payload, "UTF-8"), SIMPLE)
    if codec != "compact-v1":
        raise ValueError(f"no codec {codec}")

    @F.pandas_udf(SIMPLE)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: unpack(bytes(x)))

    return run(payload)
