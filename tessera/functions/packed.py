"""Decoding of super-block codecs by bit tables.

A block is a string of bits; a layout says which bits, lowest first, make up each value, each sub-block's scale
and its least value. Decoding gathers those bits for all blocks at once, so a new kind is a new table, not new code."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Bits = list[tuple[int, int]]


@dataclass(frozen=True)
class Layout:
    """size in bytes; values per block and per sub-block; value(e), scale(s) and least(s) as lists of (byte, bit);
    what is subtracted from a value and a scale; where the block's float16 scales stand; a table that values index."""

    size: int
    values: int
    sub: int
    value: Callable[[int], Bits]
    scale: Callable[[int], Bits] | None
    d: int | None
    least: Callable[[int], Bits] | None = None
    dmin: int | None = None
    minus: int = 0
    scale_minus: int = 0
    table: tuple | None = None
    scale_table: tuple | None = None


def run(byte: int, bit: int, n: int) -> Bits:
    return [(byte, bit + i) for i in range(n)]


def _six(base: int, high: int, shift: int):
    """Eight 6-bit numbers in 12 bytes: four whole ones, and four whose low halves are shared bytes and whose top bits lie over the whole ones."""
    return lambda s: run(base + s, 0, 6) if s < 4 else run(high + s - 4, shift, 4) + run(base + s - 4, 6, 2)


def _e4m3() -> tuple:
    """Unsigned floats of 4 exponent and 3 fraction bits, halved, as the 4-bit table counts in halves; 0 for 0x7F."""
    return tuple(0.0 if (x & 127) == 127 else ((x & 7) * 2.0**-9 if (x >> 3 & 15) == 0 else (1 + (x & 7) / 8) * 2.0 ** ((x >> 3 & 15) - 7)) / 2 for x in range(256))


# Tables that 4-bit values index.
FP4 = (0, 1, 2, 3, 4, 6, 8, 12, 0, -1, -2, -3, -4, -6, -8, -12)
NONLINEAR = (-127, -104, -83, -65, -49, -35, -22, -10, 1, 13, 25, 38, 53, 69, 89, 113)


def _byte(signed_at: int):
    return lambda s: run(signed_at + s, 0, 8)


LAYOUTS = {
    "q2_k": Layout(84, 256, 16, lambda e: run(16 + e // 128 * 32 + e % 32, e % 128 // 32 * 2, 2), lambda s: run(s, 0, 4), 80, lambda s: run(s, 4, 4), 82),
    "q3_k": Layout(110, 256, 16, lambda e: run(32 + e // 128 * 32 + e % 32, e % 128 // 32 * 2, 2) + [(e % 32, e // 32)], lambda s: run(96 + s % 8, s // 8 * 4, 4) + run(104 + s % 4, s // 4 * 2, 2), 108, minus=4, scale_minus=32),
    "q4_k": Layout(144, 256, 32, lambda e: run(16 + e // 64 * 32 + e % 32, e // 32 % 2 * 4, 4), _six(4, 12, 0), 0, _six(8, 12, 4), 2),
    "q5_k": Layout(176, 256, 32, lambda e: run(48 + e // 64 * 32 + e % 32, e // 32 % 2 * 4, 4) + [(16 + e % 32, e // 32)], _six(4, 12, 0), 0, _six(8, 12, 4), 2),
    "q6_k": Layout(210, 256, 16, lambda e: run(e // 128 * 64 + e % 64, e % 128 // 64 * 4, 4) + run(128 + e // 128 * 32 + e % 32, e % 128 // 32 * 2, 2), _byte(192), 208, minus=32, scale_minus=256),
    "iq4_nl": Layout(18, 32, 32, lambda e: run(2 + e % 16, e // 16 * 4, 4), None, 0, table=NONLINEAR),
    "iq4_xs": Layout(136, 256, 32, lambda e: run(8 + e // 32 * 16 + e % 16, e % 32 // 16 * 4, 4), lambda s: run(4 + s // 2, s % 2 * 4, 4) + run(2 + s // 4, s % 4 * 2, 2), 0, scale_minus=32, table=NONLINEAR),
    "nvfp4": Layout(36, 64, 16, lambda e: run(4 + e // 16 * 8 + e % 8, e % 16 // 8 * 4, 4), lambda s: run(s, 0, 8), None, table=FP4, scale_table=_e4m3()),
}


def _gather(bits: np.ndarray, fields: list[Bits]) -> np.ndarray:
    at = np.array([[byte * 8 + bit for byte, bit in f] for f in fields])
    return bits[:, at].astype(np.int32) @ (1 << np.arange(at.shape[1]))


def decode(kind: str, raw: np.ndarray) -> np.ndarray:
    """raw: blocks by bytes. Gives blocks by values, float32."""
    k = LAYOUTS[kind]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    half = lambda at: raw[:, at : at + 2].copy().view("<f2").astype(np.float32)
    q = _gather(bits, [k.value(e) for e in range(k.values)]) - k.minus
    x = (np.array(k.table, np.float32)[q] if k.table else q.astype(np.float32)).reshape(len(raw), -1, k.sub)
    scale = np.ones((len(raw), 1), np.float32)
    if k.scale:
        s = _gather(bits, [k.scale(i) for i in range(k.values // k.sub)])
        if k.scale_table:
            scale = np.array(k.scale_table, np.float32)[s]
        elif k.scale_minus == 256:  # a signed byte
            scale = np.where(s > 127, s - 256, s).astype(np.float32)
        else:
            scale = (s - k.scale_minus).astype(np.float32)
    if k.d is not None:
        scale = scale * half(k.d)
    x = x * scale[:, :, None]
    if k.least:
        x = x - (_gather(bits, [k.least(i) for i in range(k.values // k.sub)]).astype(np.float32) * half(k.dmin))[:, :, None]
    return x.reshape(len(raw), k.values)


def dequantised(c, kind: str) -> Column:
    """Bytes of whole blocks to their values."""
    size = LAYOUTS[kind].size

    @F.pandas_udf("array<float>")
    def go(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else decode(kind, np.frombuffer(b, np.uint8).reshape(-1, size)).ravel())

    return go(c)
