import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import packed as P
from tessera.functions import tokenise as Y
from tessera.functions import vector as V
from tessera.operators import sampling as M

RAW = np.random.default_rng(5).integers(0, 256, (6, 256), dtype=np.uint8)


def blocks(kind):
    k = P.LAYOUTS[kind]
    raw = RAW[:, : k.size].copy()
    for at in (k.d, k.dmin):
        if at is not None:
            raw[:, at : at + 2] = np.frombuffer(struct.pack("<e", 0.5), np.uint8)
    return raw


def nibble(b, e):
    return b[e % 16] >> 4 if e >= 16 else b[e % 16] & 15


def by_hand(kind, b):
    """One block, one value at a time, as the formats are described."""
    out = []
    if kind == "iq4_nl":
        return [0.5 * P.NONLINEAR[nibble(b[2:], e)] for e in range(32)]
    if kind in ("q4_k", "q5_k"):
        sc = b[4:16]
        for g in range(8):
            if g < 4:
                scale, least = sc[g] & 63, sc[g + 4] & 63
            else:
                scale, least = (sc[g + 4] & 15) | (sc[g - 4] >> 6 << 4), (sc[g + 4] >> 4) | (sc[g] >> 6 << 4)
            for i in range(32):
                at = (16 if kind == "q4_k" else 48) + g // 2 * 32 + i
                q = b[at] >> 4 if g % 2 else b[at] & 15
                if kind == "q5_k":
                    q += 16 * (b[16 + i] >> g & 1)
                out.append(0.5 * scale * q - 0.5 * least)
        return out
    if kind == "q2_k":
        for e in range(256):
            q = b[16 + e // 128 * 32 + e % 32] >> (e % 128 // 32 * 2) & 3
            out.append(0.5 * (b[e // 16] & 15) * q - 0.5 * (b[e // 16] >> 4))
        return out
    if kind == "q3_k":
        for e in range(256):
            q = (b[32 + e // 128 * 32 + e % 32] >> (e % 128 // 32 * 2) & 3) - (0 if b[e % 32] >> (e // 32) & 1 else 4)
            s = e // 16
            scale = (b[96 + s % 8] >> (4 * (s // 8)) & 15) | (b[104 + s % 4] >> (2 * (s // 4)) & 3) << 4
            out.append(0.5 * (scale - 32) * q)
        return out
    if kind == "q6_k":
        for e in range(256):
            half, r = divmod(e, 128)
            low = b[half * 64 + r % 64] >> 4 if r >= 64 else b[half * 64 + r]  & 15
            high = b[128 + half * 32 + r % 32] >> (r // 32 * 2) & 3
            out.append(0.5 * struct.unpack("b", bytes([b[192 + e // 16]]))[0] * ((low | high << 4) - 32))
        return out
    if kind == "iq4_xs":
        for e in range(256):
            s = e // 32
            scale = (b[4 + s // 2] >> (4 * (s % 2)) & 15) | ((b[2] | b[3] << 8) >> 2 * s & 3) << 4
            out.append(0.5 * (scale - 32) * P.NONLINEAR[nibble(b[8 + 16 * s :], e % 32)])
        return out
    for e in range(64):  # nvfp4
        s = e // 16
        q = b[4 + 8 * s + e % 8] >> 4 if e % 16 >= 8 else b[4 + 8 * s + e % 8] & 15
        x = b[s] & 127
        scale = 0 if x in (0, 127) else (x & 7) / 512 if x < 8 else (1 + (x & 7) / 8) * 2.0 ** ((x >> 3) - 7)
        out.append(scale / 2 * P.FP4[q])
    return out


@pytest.mark.parametrize("kind", sorted(P.LAYOUTS))
def test_layouts(kind):
    raw = blocks(kind)
    assert np.allclose(P.decode(kind, raw), [by_hand(kind, [int(x) for x in b]) for b in raw])


def test_subwords(spark):
    ranks = {p: i for i, p in enumerate([("l", "o"), ("lo", "w"), ("e", "r"), ("low", "er")])}
    assert Y.merged("lower", ranks) == ["lower"] and Y.merged("slowly", ranks) == ["s", "low", "l", "y"] and Y.merged("", ranks) == []
    assert Y.merged("aaaa", {("a", "a"): 0}) == ["aa", "aa"]
    assert Y.longest_match("unaffable", {"un", "##aff", "##able", "##a"}) == ["un", "##aff", "##able"] and Y.longest_match("xyz", {"x"}) == ["[UNK]"]
    assert Y.best_path("abc", {"a": -1.0, "b": -1.0, "c": -1.0, "ab": -1.5, "bc": -3.0}) == ["ab", "c"]
    got = spark.createDataFrame([("low lower", None), (None, None)], "s string, x string").select(Y.encode("s", "merges", ranks).alias("p")).collect()
    assert [r.p for r in got] == [["low", "lower"], None]


def test_mirostat_nears_its_target(spark):
    rng = np.random.default_rng(1)
    rows = [(0, s, i, float(x)) for s in range(300) for i, x in enumerate(rng.normal(size=60) * 2)]
    for version in (1, 2):
        got = M.mirostat(spark.createDataFrame(rows, "stream long, step long, id long, logit double"), version, 2.5).toPandas()
        p = {s: np.exp([x for _, t, _, x in rows[s * 60 : s * 60 + 60]]) for s in range(300)}
        assert len(got) == 300 and (got["mu"].iloc[-1] != 5.0)
    again = M.mirostat(spark.createDataFrame(rows, "stream long, step long, id long, logit double"), 2, 2.5).toPandas()
    assert (again["id"].to_numpy() == got["id"].to_numpy()).all() and p


def test_solve(spark):
    a = np.tril(np.random.default_rng(0).normal(size=(6, 6))) + np.eye(6) * 3
    b = np.arange(6.0)
    row = spark.createDataFrame([(a.tolist(), b.tolist())], "a array<array<double>>, b array<double>").select(V.solve_lower(F.col("a"), F.col("b")).alias("x")).first()
    assert np.allclose(a @ np.array(row.x), b)


def test_brain_floats_round_to_the_nearest():
    """All upper halves with every kind of lower half: halves go to even, NaN stays NaN."""
    from tessera.functions import codecs as Q

    upper = np.arange(65_536, dtype=np.uint32) << 16
    for lower in (0, 1, 0x7FFF, 0x8000, 0x8001, 0xFFFF):
        x = (upper | lower).view(np.float32).reshape(-1, 32)
        back = Q.decode("bf16", Q.encode("bf16", x), 32).ravel()
        for bits, got in zip((upper | lower).tolist(), back.view(np.uint32).tolist(), strict=True):
            top, rest = bits >> 16, bits & 0xFFFF
            if top & 0x7F80 == 0x7F80 and (top & 0x7F or rest):
                assert got >> 16 & 0x7F80 == 0x7F80 and got >> 16 & 0x7F
            else:
                assert got == (top + (rest > 0x8000 or (rest == 0x8000 and top & 1))) << 16
