"""Block codecs of tensor files: 32 (or 256) values with a shared scale, as bytes. Arrow UDFs over numpy.

One description per kind says how a block's fields lie; encoding and decoding are the same code for all of them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    """bits per value; minimum: whether a block has its own least value, else values are signed around 0."""

    bits: int
    minimum: bool
    block: int = 32


# Scale as float16, least value as float16, fifth bits as 32-bit word, then nibbles (first half low).
KINDS = {"q4_0": Kind(4, False), "q4_1": Kind(4, True), "q5_0": Kind(5, False), "q5_1": Kind(5, True), "q8_0": Kind(8, False)}
E2M1 = np.array([0, 1, 2, 3, 4, 6, 8, 12, 0, -1, -2, -3, -4, -6, -8, -12], np.float32)


def _half(x):
    return x.astype("<f2").view(np.uint8).reshape(len(x), 2)


def _round_away(x):
    return np.sign(x) * np.floor(np.abs(x) + 0.5)


def encode(kind: str, x: np.ndarray) -> np.ndarray:
    """x: blocks by values. Gives blocks by bytes."""
    x = np.ascontiguousarray(x, np.float32)
    n = len(x)
    if kind == "bf16":
        kept, lost = x.view("<u2")[:, 1::2], x.view("<u2")[:, ::2]  # the upper and the lower halves of the floats
        up = (lost > 0x8000) | ((lost == 0x8000) & (kept % 2 == 1))  # to the nearest, halves to even
        return np.where(np.isnan(x), kept | 0x40, kept + up).astype("<u2").view(np.uint8).reshape(n, -1)
    if kind == "f16":
        return x.astype("<f2").view(np.uint8).reshape(n, -1)
    if kind == "mxfp4":
        top = np.abs(x).max(axis=1, keepdims=True)
        with np.errstate(divide="ignore"):
            e = np.where(top > 0, np.clip(np.floor(np.log2(top)) - 2 + 127, 0, 254), 0).astype(np.uint8)
        scale = np.exp2(e.astype(np.float32) - 128)
        q = np.abs((x / scale)[:, :, None] - E2M1).argmin(axis=2).astype(np.uint8)
        return np.concatenate([e, q[:, :16] | q[:, 16:] << 4], axis=1)
    if kind in ("tq1_0", "tq2_0"):
        top = np.abs(x).max(axis=1, keepdims=True)
        q = np.where(top > 0, _round_away(x / np.where(top > 0, top, 1)), 0).astype(np.int8) + 1
        return np.concatenate([_ternary(kind, q.astype(np.uint16)), _half(top)], axis=1)
    k = KINDS[kind]
    if k.minimum:
        low = x.min(axis=1, keepdims=True)
        scale = (x.max(axis=1, keepdims=True) - low) / (2**k.bits - 1)
    elif k.bits == 8:
        scale = np.abs(x).max(axis=1, keepdims=True) / 127
    else:
        scale = np.take_along_axis(x, np.abs(x).argmax(axis=1)[:, None], 1) / -(2 ** (k.bits - 1))
    inverse = np.divide(1, scale, out=np.zeros_like(scale), where=scale != 0)
    if k.bits == 8:
        return np.concatenate([_half(scale), _round_away(x * inverse).astype(np.int8).view(np.uint8)], axis=1)
    q = ((x - low) * inverse + 0.5) if k.minimum else x * inverse + (2 ** (k.bits - 1) + 0.5)
    q = np.clip(np.trunc(q), 0, 2**k.bits - 1).astype(np.uint8)
    parts = [_half(scale)] + ([_half(low)] if k.minimum else [])
    if k.bits == 5:
        parts.append(np.packbits(q >> 4, axis=1, bitorder="little"))
    low4 = q & 15
    return np.concatenate([*parts, low4[:, :16] | low4[:, 16:] << 4], axis=1)


def _ternary(kind, q):
    """256 values 0, 1, 2 as bytes: four of two bits each, or five of base 3 (the last 16 four to a byte)."""
    n = len(q)
    if kind == "tq2_0":
        g = q.reshape(n, 2, 4, 32)
        return (g[:, :, 0] | g[:, :, 1] << 2 | g[:, :, 2] << 4 | g[:, :, 3] << 6).reshape(n, 64).astype(np.uint8)
    out = []
    for lo, wide, digits in ((0, 32, 5), (160, 16, 5), (240, 4, 4)):
        g = q[:, lo : lo + wide * digits].reshape(n, digits, wide)
        v = np.zeros((n, wide), np.uint16)
        for d in range(digits):
            v = v * 3 + g[:, d]
        v *= 3 if digits == 4 else 1
        out.append(((v * 256 + 242) // 243).astype(np.uint8))
    return np.concatenate(out, axis=1)


def decode(kind: str, raw: np.ndarray, n: int) -> np.ndarray:
    """raw: blocks by bytes. Gives blocks by n values."""
    if kind == "bf16":
        return (raw.view("<u2").astype(np.uint32) << 16).view(np.float32).reshape(len(raw), n)
    if kind == "f16":
        return raw.view("<f2").astype(np.float32).reshape(len(raw), n)
    if kind == "mxfp4":
        q = np.concatenate([raw[:, 1:] & 15, raw[:, 1:] >> 4], axis=1)
        return E2M1[q] * np.exp2(raw[:, :1].astype(np.float32) - 128)
    if kind in ("tq1_0", "tq2_0"):
        scale = raw[:, -2:].copy().view("<f2").astype(np.float32)
        body = raw[:, :-2]
        if kind == "tq2_0":
            g = body.reshape(len(raw), 2, 1, 32) >> np.array([0, 2, 4, 6], np.uint8).reshape(1, 1, 4, 1) & 3
            return (g.reshape(len(raw), 256).astype(np.float32) - 1) * scale
        out = []
        for lo, wide, digits in ((0, 32, 5), (32, 16, 5), (48, 4, 4)):
            b = body[:, lo : lo + wide].astype(np.uint16)
            out += [((b * 3**d & 255) * 3 >> 8) for d in range(digits)]
        return (np.concatenate(out, axis=1).astype(np.float32) - 1) * scale
    k = KINDS[kind]
    scale = raw[:, :2].copy().view("<f2").astype(np.float32)
    if k.bits == 8:
        return raw[:, 2:].view(np.int8).astype(np.float32) * scale
    at = 4 if k.minimum else 2
    high = 0
    if k.bits == 5:
        high = np.unpackbits(raw[:, at : at + 4], axis=1, bitorder="little") << 4
        at += 4
    q = np.concatenate([raw[:, at:] & 15, raw[:, at:] >> 4], axis=1) | high
    if k.minimum:
        return q.astype(np.float32) * scale + raw[:, 2:4].copy().view("<f2").astype(np.float32)
    return (q.astype(np.float32) - 2 ** (k.bits - 1)) * scale


def block_size(kind: str) -> int:
    return 256 if kind in ("tq1_0", "tq2_0") else 32


def quantised(c, kind: str) -> Column:
    """An array of floats, its length a multiple of the block, as bytes."""

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda a: None if a is None else encode(kind, np.asarray(a, np.float32).reshape(-1, block_size(kind))).tobytes())

    return run(c)


def dequantised(c, kind: str) -> Column:
    width = {"bf16": 64, "f16": 64, "mxfp4": 17, "tq1_0": 54, "tq2_0": 66, "q4_0": 18, "q4_1": 20, "q5_0": 22, "q5_1": 24, "q8_0": 34}[kind]

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else decode(kind, np.frombuffer(b, np.uint8).reshape(-1, width), block_size(kind)).ravel())

    return run(c)
