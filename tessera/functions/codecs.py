"""Compression of ascending id lists: gaps, VarByte and Simple9, as Arrow UDFs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Simple9 selectors 1 to 9 stand for these bit widths; a word of 32 bits has 28 for values.
WIDTHS = (28, 14, 9, 7, 5, 4, 3, 2, 1)


def gaps(ids: list[int]) -> list[int]:
    return [b - a for a, b in zip([0, *ids[:-1]], ids)]


def sums(values: list[int]) -> list[int]:
    out, total = [], 0
    for v in values:
        total += v
        out.append(total)
    return out


#: Each group of seven bits mirrored into the upper bits of a byte, and back.
_MIRROR = np.array([sum((g >> k & 1) << 7 - k for k in range(7)) for g in range(128)], dtype=np.uint8)
_GROUP = np.zeros(256, dtype=np.int64)
_GROUP[_MIRROR] = np.arange(128)
_GROUP[_MIRROR | 1] = np.arange(128)


def varbyte_bytes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all values one after another, number of bytes of each).

    Each value in groups of seven bits, lowest first, mirrored into the byte's upper bits; the last bit marks the last group.
    """
    if len(values) and values.min() < 1:
        raise ValueError("gaps must be positive")
    n = np.ones(len(values), dtype=np.int64)
    for bits in range(7, 63, 7):
        n += values >= 1 << bits
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    out = _MIRROR[np.repeat(values, n) >> 7 * at & 127]
    out[np.cumsum(n) - 1] |= 1
    return out, n


def varbyte_values(data: np.ndarray) -> np.ndarray:
    """The values of encoded bytes."""
    last = data & 1 == 1
    ends = np.flatnonzero(last)
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = ends - starts + 1
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return np.add.reduceat(_GROUP[data[: len(at)]] << 7 * at, starts) if len(ends) else np.empty(0, dtype=np.int64)


def varbyte_encode(values: list[int]) -> bytes:
    return varbyte_bytes(np.asarray(values, dtype=np.int64))[0].tobytes() if len(values) else b""


def varbyte_decode(data: bytes) -> list[int]:
    return varbyte_values(np.frombuffer(data, dtype=np.uint8)).tolist()


def simple9_encode(values: list[int]) -> bytes:
    """Runs of values that need the same width share words; a change of width closes the word. A gap of 2^28 or more fails."""
    out, run, current = bytearray(), [], None

    def close():
        if run:
            word = current + 1
            for k, v in enumerate(run):
                word |= v << 4 + k * WIDTHS[current]
            out.extend(word.to_bytes(4, "little"))
            run.clear()

    for v in map(int, values):
        if not 0 < v < 1 << 28:
            raise ValueError("gaps must be from 1 to 2^28 - 1")
        need = max(k for k, w in enumerate(WIDTHS) if v < 1 << w)
        if need != current or len(run) == 28 // WIDTHS[need]:
            close()
            current = need
        run.append(v)
    close()
    return bytes(out)


def simple9_decode(data: bytes) -> list[int]:
    out = []
    for at in range(0, len(data), 4):
        word = int.from_bytes(data[at : at + 4], "little")
        width = WIDTHS[(word & 15) - 1]
        word >>= 4
        out += [v for k in range(28 // width) if (v := word >> k * width & (1 << width) - 1)]
    return out


CODECS = {"varbyte": (varbyte_encode, varbyte_decode), "simple9": (simple9_encode, simple9_decode)}


def encoder(codec: str):
    """UDF: ascending positive ids to bytes; null stays null."""
    encode = CODECS[codec][0]

    @F.pandas_udf(T.BinaryType())
    def run(lists: pd.Series) -> pd.Series:
        return lists.map(lambda ids: None if ids is None else encode(np.diff(np.asarray(ids, dtype=np.int64), prepend=0)))

    return run


def decoder(codec: str):
    """UDF: bytes back to ids."""
    decode = CODECS[codec][1]

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def run(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda b: None if b is None else np.cumsum(np.asarray(decode(bytes(b)), dtype=np.int64)))

    return run
