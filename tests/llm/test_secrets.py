import base64
import gzip
import hashlib
import random
import re
import urllib.parse
import zlib

from pyspark.sql import functions as F

from tessera.llm import secrets
from tests.llm.helpers import documents, rows

KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
VALUE = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")


def plain(text):
    """The base rules, character by character."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    out, i = [], 0
    while i < len(text):
        key = next((k for k in KEYS if low.startswith(k, i)), None)
        hit = None
        if key:
            for j in ([i + len(key) + 1] if text[i + len(key) : i + len(key) + 1] in ('"', "'") and text[i + len(key) : i + len(key) + 1] else []) + [i + len(key)]:
                k = j
                while text[k : k + 1] == " ":
                    k += 1
                if text[k : k + 1] not in (":", "=") or not text[k : k + 1]:
                    continue
                k += 1
                while text[k : k + 1] == " ":
                    k += 1
                if text[k : k + 1] and text[k] in "\"'":
                    k += 1
                e = k
                while e < len(text) and text[e] in VALUE:
                    e += 1
                if e > k:
                    hit = (k, e)
                    break
        if hit:
            if hit[1] - hit[0] >= 6:
                out.append((i, 0, hit[1]))
            i = hit[1]
        else:
            i += 1
    for kind, start, chars, least in ((1, "AKIA", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 20), (2, "", "0123456789abcdef", 24)):
        i = 0
        while i < len(text):
            e = i + len(start)
            if text.startswith(start, i):
                while e < len(text) and text[e] in chars:
                    e += 1
                if e > i + len(start):
                    if e - i >= least:
                        out.append((i, kind, e))
                    i = e
                    continue
            i += 1
    return sorted(out)


def test_base_against_brute_force(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = rows(secrets.op9_secret_scan(spark, sf_dir))
    some = 0
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        want = plain(r.text or "")
        some += bool(want)
        text = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in want)
        g = got[r.doc_id]
        assert g.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [g.n_assign, g.n_access, g.n_hex] == [sum(w[1] == k for w in want) for k in range(3)]
        assert {x for x in text.split(",") if x} <= set(g.spans.split(","))
    assert some > 10


def test_random_texts_against_brute_force():
    rnd = random.Random(3)
    parts = [*KEYS, "Token", "\u017fecret", "=", ":", " ", '"', "'", "abc", "AKIA", "A1B2C3D4E5F6G7H8", "deadbeef", "0123456789ab", "é", "\n", "-", "x.y/z", ","]
    for _ in range(3000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randrange(25)))
        assert secrets.base_spans(text) == plain(text), text


def test_layers():
    key = "password=hunter2hunter2"
    b64 = lambda s: base64.b64encode(s if isinstance(s, bytes) else s.encode()).decode()
    cases = {
        urllib.parse.quote(key, safe="").replace("p", "%70", 1): "url",
        "".join(f"\\u{ord(c):04x}" for c in key): "unicode",
        b64(key): "base64",
        b64(b64(key)): "base64>base64",
        b64(zlib.compress(key.encode() * 3)): "base64+deflate",
        b64(gzip.compress(b64(key).encode())): "base64+deflate>base64",
        urllib.parse.quote(urllib.parse.quote(b64(key + "??"), safe=""), safe=""): None,
    }
    for wrapped, path in cases.items():
        text = f"Some words, é and ü: {wrapped} and more."
        at = text.index(wrapped)
        got = [s for s in secrets.all_spans(text) if s[3]]
        assert got, wrapped
        assert all(at <= a < b <= at + len(wrapped) for a, _, b, _ in got)
        if path:
            assert path in {s[3] for s in got}
        assert "hunter2" not in secrets.redacted(text, secrets.all_spans(text))
    text = "%70assword=hunter2hunter2 tail"
    assert (0, 0, 25, "url") in secrets.all_spans(text) and text[:25].endswith("hunter2")


def test_url_safe_base64():
    words = "some text \u00ff\u00fe\u00ff ok ok ok \u00ff\u00ff\u00ff\u00fe~~~??? "
    run = base64.urlsafe_b64encode((words + "password=hunter2hunter2 " + words).encode()).decode()
    assert "-" in run[16:] and "_" in run[16:]
    plain_run = base64.b64encode(b"some text, token=hunter2hunter2 and more").decode()
    squeezed = base64.urlsafe_b64encode(zlib.compress(" ".join(map(str, range(300))).encode() + b" password=hunter2hunter2")).decode()
    assert "-" in squeezed and "_" in squeezed
    folded = "\n".join(base64.urlsafe_b64encode((words * 9 + "password=hunter2hunter2").encode()).decode()[i : i + 64] for i in range(0, 600, 64)).strip()
    for wrapped, path in ((run, "base64"), (squeezed, "base64+deflate"), (f"file-name_{plain_run}", "base64"), (f"dir/{run}", "base64"), (folded, "base64")):
        got = [s for s in secrets.all_spans(f"See {wrapped} there") if s[3]]
        assert got and {s[3] for s in got} == {path}, wrapped
        assert all(4 <= a < b <= 4 + len(wrapped) and kind == 0 for a, kind, b, _ in got)


def test_layers_of_any_bytes():
    key = "password=hunter2hunter2"
    for odd in ("\u00a0", "\u3000", "\u200b", "\ufeff", "\f", "\0", b"\xff", b"\xe2\x82", b"\xed\xa0\x80"):
        odd = odd if isinstance(odd, bytes) else odd.encode()
        raw = b"mot " + odd + b" : " + key.encode() + b" " + odd + b"."
        run, escapes = base64.b64encode(raw).decode().rstrip("="), urllib.parse.quote_from_bytes(raw, safe="")
        for wrapped, path in ((run, "base64"), (run + "A" * (len(run) % 4 == 0), "base64"), (escapes, "url"), (base64.b64encode(zlib.compress(raw)).decode(), "base64+deflate")):
            got = [s for s in secrets.all_spans(f"é {wrapped} end") if s[3]]
            assert [(kind, p) for _, kind, _, p in got] == [(0, path)], (odd, wrapped)
            a, _, b, _ = got[0]
            if path == "url":
                assert urllib.parse.unquote_to_bytes(f"é {wrapped} end"[a:b]) == key.encode()
            if path == "base64":
                at = raw.index(key.encode())
                assert (a - 2, b - 2) == (at * 4 // 3, -(-(at + len(key)) * 4 // 3))


def test_compressed_streams():
    key = b"some words and password=hunter2hunter2 and more of them"

    def squeezed(raw, bits):
        c = zlib.compressobj(9, zlib.DEFLATED, bits)
        return c.compress(raw) + c.flush()

    long = " ".join(map(str, range(9000))).encode()
    cases = [squeezed(key, bits) for bits in (-15, -9, 9, 10, 11, 12, 13, 14, 15, 31)]
    cases += [squeezed(long + key, -15), squeezed(b"first", 31) + squeezed(key, 31), squeezed(b"first", 31) + b"\0" * 9 + squeezed(key, 31)]
    cases += [squeezed(long, 31) + squeezed(key[:20], 31) + squeezed(key[20:], 31), squeezed(b"first", 15) + squeezed(b"next", -15) + squeezed(key, 15)]
    cases += [squeezed(key, 31)[:-8] + b"badcheck", squeezed(key, 15)[:-4], squeezed(long + key, 15)[:-1] + b"?"]
    for raw in cases:
        run = base64.b64encode(raw).decode()
        assert [s for s in secrets.all_spans(f"See {run} there") if s[3]] == [(4, 0, 4 + len(run.rstrip("=")) + run.count("="), "base64+deflate")], raw[:20]
    rnd = random.Random(8)
    for _ in range(2000):
        assert secrets.all_spans(base64.b64encode(rnd.randbytes(rnd.randrange(12, 200))).decode() + " end") == []


def test_long_streams_in_chunks(monkeypatch):
    far = zlib.compress(" ".join(map(str, range(2_700_000))).encode() + b" password=hunter2hunter2", 1)  # behind 19 MiB
    got = secrets.all_spans(base64.b64encode(far).decode())
    assert [(kind, path) for _, kind, _, path in got] == [(0, "base64+deflate")]
    rnd = random.Random(4)
    inner = base64.b64encode(b"words before " * 9 + b"token=abcdefgh" + b" and after" * 9).decode()
    parts = ["password", "token", " ", "=", ":", '"', "hunter2", "AKIA", "A1B2C3D4E5F6G7H8", "deadbeef" * 2, ",", "\n", "%70", "%2C", "\\u0061", "é", "\udcff", inner, "\n".join(inner[i : i + 60] for i in range(0, 300, 60)).strip()]
    found = 0
    for _ in range(400):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randrange(60)))
        run = base64.b64encode(zlib.compress(text.encode("utf-8", "surrogateescape"))).decode()
        both = []
        for chunk, piece in ((1 << 30, 4096), (20, 7)):
            monkeypatch.setattr(secrets, "CHUNK", chunk)
            monkeypatch.setattr(secrets, "PIECE", piece)
            both.append({(a, kind, b, path.count(">")) for a, kind, b, path in secrets.all_spans(run)})
        assert both[0] == both[1], text
        found += len(both[0])
    assert found > 300


def test_folded_base64():
    key = "some words before it\npassword=hunter2hunter2 " + "and many more words " * 10
    for end in ("\n", "\r\n"):
        folded = end.join(base64.b64encode(key.encode()).decode()[i : i + 64] for i in range(0, 400, 64)).strip()
        text = f"Attached:\n{folded}\nthe end"
        got = [s for s in secrets.all_spans(text) if s[3] == "base64"]
        assert len(got) == 1 and got[0][1] == 0
        a, _, b, _ = got[0]
        at = text.index(folded)
        assert at <= a < b <= at + len(folded)
        plain_run = "".join(folded.split())
        lo, hi = len("".join(text[at:a].split())), len("".join(text[at:b].split()))
        found = base64.b64decode(plain_run[lo // 4 * 4 : -(-hi // 4) * 4]).decode()
        assert "password=hunter2hunter2" in found and len(found) < len("password=hunter2hunter2") + 6


def test_cycles_and_bombs_end():
    deep = "token=abcdefgh"
    for _ in range(12):
        deep = base64.b64encode(deep.encode()).decode()
    assert any(s[3].count("base64") == 12 for s in secrets.all_spans(deep))
    bomb = base64.b64encode(zlib.compress(b"\0" * (1 << 25))).decode()
    assert secrets.all_spans(bomb) == []
    assert secrets.all_spans("%25" * 2000) == []
    assert secrets.all_spans("word " * 200_000) == []


def test_edge_cases(spark):
    docs = documents(spark, [(1, None), (2, ""), (3, "token: abcdef"), (3, "token: abcdef"), (None, "secret=abcdef"), (4, "x" * 300_000 + " AKIA" + "A" * 20)])
    got = secrets.scan(docs.withColumn("findings", F.lit(1)).withColumn("n_hex", F.lit("clash"))).collect()
    none = hashlib.sha256(b"").hexdigest()
    assert sorted((r.doc_id or 0, r.n_assign, r.n_access, r.n_hex, r.base_sha256 == none) for r in got) == [(0, 1, 0, 0, False), (1, 0, 0, 0, True), (2, 0, 0, 0, True), (3, 1, 0, 0, False), (3, 1, 0, 0, False), (4, 0, 1, 0, False)]
    assert secrets.scan(docs.limit(0)).count() == 0
    out = secrets.stage(spark, docs, "")
    assert out.columns == docs.columns and out.count() == 6
    clean = {r.text for r in out.collect()}
    assert None in clean and "[REDACTED]" in clean and not any(re.search("abcdef", t or "") for t in clean)


def _wrappers(rnd):
    """Encodings by name: each takes a text and gives one; what is around the secret may not end in its alphabet."""
    chars = lambda t, f: "".join(f(c) if rnd.random() < 0.7 else c for c in t)
    b64 = lambda raw: rnd.choice((base64.b64encode, base64.urlsafe_b64encode))(raw).decode().rstrip("=" if rnd.random() < 0.3 else "")
    raw_deflate = lambda t: (lambda d: d.compress(t.encode()) + d.flush())(zlib.compressobj(wbits=-15))
    return {
        "percent": lambda t: chars(t, lambda c: "".join(f"%{x:02X}" for x in c.encode())).replace("=", "%3D"),
        "unicode": lambda t: chars(t, lambda c: f"\\u{ord(c):04x}" if ord(c) < 0x10000 else f"\\U{ord(c):08x}").replace("=", "\\x3d"),
        "base64": lambda t: b64(t.encode()),
        "gzip": lambda t: b64(gzip.compress(t.encode())),
        "members": lambda t: b64(gzip.compress(b"first member, nothing here. ") + gzip.compress(t.encode())),
        "zlib": lambda t: b64(zlib.compress(t.encode(), rnd.choice((1, 6, 9)))),
        "deflate": lambda t: b64(raw_deflate(t)),
        "glued": lambda t: rnd.choice(("path/", "x", "ab", "abc", "dir/sub/")) + b64((t + " ").encode()),
    }


def test_random_nests(spark):
    """A secret under one to three random encodings is found at a place inside what was wrapped."""
    rnd = random.Random(11)
    for _ in range(300):
        secret = rnd.choice(("password=hunter2hunter2", "AKIA" + "".join(rnd.choice("ABCDEFGH234567") for _ in range(16)), "token: " + "".join(rnd.choice("abcdefgh0123") for _ in range(20))))
        inner, names = f"{rnd.choice(('', 'é ', 'some words before '))}{secret} {rnd.choice(('', 'and after', '\u00a0x'))}", []
        for _ in range(rnd.randrange(1, 4)):
            wrap = _wrappers(rnd)
            name = rnd.choice(list(wrap))
            inner = wrap[name](inner)
            names.append(name)
        before, after = rnd.choice(("", "text before ", "é: ")), rnd.choice(("", " text after", "\nx"))
        found = secrets.all_spans(before + inner + after)
        assert any(len(before) <= a and b <= len(before) + len(inner) for a, _, b, _ in found), (names, before + inner + after)
        clean = secrets.redacted(before + inner + after, found)
        assert not secrets.all_spans(clean), names


def test_positions_of_escapes_against_brute_force():
    rnd = random.Random(5)
    for unwrap, pieces in ((secrets._percent, ["a", "é", "%", "%4", "%41", "%C3%A9", "%FF", "%F0%9F%8E%89"]), (secrets._unicode, ["a", "é", "\\u", "\\u0041", "\\x41", "\\u{1F389}", "\\U0001F389", "\\ud83c\\udf89", "\\ud83c", "\\udf89", "\\U99999999"])):
        for _ in range(200):
            text = "".join(rnd.choice(pieces) for _ in range(rnd.randrange(12)))
            inner, lo, hi = unwrap(text)
            assert len(inner) == len(lo) == len(hi)
            assert [0, *hi[:-1]] == list(lo) if len(lo) else not text
            assert not len(hi) or hi[-1] == len(text)
            for c, a, b in zip(inner, lo, hi):
                assert unwrap(text[a:b])[0] == c or b - a == 1 and c == text[a] or c >= "\udc80"


def test_a_long_line_of_escapes_is_cheap():
    import resource

    line = "%41b" * (1 << 20) + " password=hunter2hunter2"
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert any(k == 0 for _, k, _, _ in secrets.all_spans(line))
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 700_000


def test_streams_in_streams_and_in_escapes():
    key = b"some words and password=hunter2hunter2 and more"
    b64 = lambda raw: base64.b64encode(raw).decode()
    packed = lambda raw, bits: (lambda c: c.compress(raw) + c.flush())(zlib.compressobj(9, zlib.DEFLATED, bits))
    long = " ".join(map(str, range(9000))).encode()
    cases = []
    for bits in (31, 15, -15):
        raw = packed(key, bits)
        cases += [b64(packed(raw, 31)), b64(packed(packed(raw, 15), 31)), b64(gzip.compress(packed(long + key, bits))), urllib.parse.quote_from_bytes(raw, safe=""), "".join(f"%{x:02x}" for x in raw), "".join(f"\\x{x:02x}" for x in raw), "".join(f"\\u{x:04x}" for x in raw), repr(raw)[2:-1], urllib.parse.quote_from_bytes(packed(raw, 31))]
        if bits > 0:
            cases += ["path/" + b64(packed(long + key, bits)), b64(b"salt and head " + raw + b" tail")]
    for wrapped in cases:
        for before, after in (("See ", " there"), ("é data=", "&x=1"), ('"', '"')):
            text = before + wrapped + after
            got = [s for s in secrets.all_spans(text) if s[3]]
            assert got and all(len(before) <= a < b <= len(before) + len(wrapped) for a, _, b, _ in got), wrapped[:80]
            assert "hunter2" not in secrets.redacted(text, got)
    quine = gzip.compress(gzip.compress(b"\0" * 9))
    assert secrets.all_spans(b64(quine)) == []


def test_folded_base64_with_escapes():
    key = "some words before it\npassword=hunter2hunter2 ??>>~~ " + "and many more words ??>>~~ " * 10
    for end in ("\n", "\r\n"):
        for shift in range(0, 60, 9):
            run = base64.b64encode(("x" * shift + key).encode()).decode()
            folded = end.join(run[i : i + 64] for i in range(0, len(run), 64))
            for escaped in (folded.replace("+", "%2B").replace("/", "%2F").replace("=", "%3D"), folded.replace("a", "%2561"), folded.replace("b", "\\u0062")):
                assert any(k == 0 for _, k, _, _ in secrets.all_spans(f"Attached:\n{escaped}\nthe end")), (shift, escaped[:99])
                inside = base64.b64encode(zlib.compress(f"Attached:\n{escaped}\nthe end".encode())).decode()
                assert secrets.all_spans(inside)
