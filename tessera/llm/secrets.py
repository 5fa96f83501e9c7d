"""Secret scans with a worklist that unwraps nested encodings.

A text is scanned as it stands. Then each piece of it that looks encoded is unwrapped and put on a
worklist: percent escapes and Unicode escapes by line (by block of lines where base64 may be folded), base64
runs (plain and URL-safe) by run, zlib, gzip and raw deflate streams among the bytes of base64, of escapes and of other streams. Each layer is scanned and unwrapped in turn until
none yields anything new. A digest of each layer seen stops cycles and repeated work. Every layer
carries, for each of its characters, the range of the original text it came from, so what is found
in a layer is reported at its place in the original.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import itertools
import mmap
import re
import tempfile
import urllib.parse
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.shared import packed, table, tidy

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
# A maximal run of 24 or more is what is left of all maximal runs when shorter ones are dropped; so for access.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|\\U([0-9A-Fa-f]{8})")
_ESCAPED = re.compile(r"%[0-9A-Fa-f]{2}|\\[uxU][0-9A-Fa-f{]")
#: Both alphabets at once, the plain one, the URL-safe one.
_ALPHABETS = (r"[A-Za-z0-9+/_-]", r"[A-Za-z0-9+/]", r"[A-Za-z0-9_-]")
_BASE64 = [re.compile(a + "{16,}={0,2}") for a in _ALPHABETS]
#: Base64 folded into lines of 60 to 76 characters.
_FOLDED = [re.compile(rf"(?:{a}{{60,76}}\r?\n)+{a}{{1,76}}={{0,2}}") for a in _ALPHABETS]
#: What a match may go on through: characters of the patterns, of escapes and of base64, and a folded line's end.
_HELD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-\"': %\\{}\r")
_FOLD = re.compile(r".*[A-Za-z0-9+/_%\\{}-]{60}\r?\n\Z", re.S)
#: How a gzip stream begins, and a zlib one.
_MARKS = re.compile(b"\x1f\x8b\x08|" + b"|".join(re.escape(bytes((a, b))) for a in range(8, 128, 16) for b in range(256) if (a << 8 | b) % 31 == 0), re.S)
#: Runs of escaped bytes on a line, by layer; how an escape or a character stands in them; what shows that a run has escapes of bytes.
_BYTE_RUNS = {
    "url": (re.compile(r"(?:%[0-9A-Fa-f]{2}|[!-$&-~])+"), re.compile(r"%([0-9A-Fa-f]{2})|(.)", re.S), "%"),
    "unicode": (re.compile(r"(?:\\(?:x[0-9A-Fa-f]{2}|u00[0-9A-Fa-f]{2}|u\{0*[0-9A-Fa-f]{1,2}\}|[abfnrtv0\\'\"/])|[ -\[\]-~])+"), re.compile(r"\\(?:x|u00|u\{0*)([0-9A-Fa-f]{1,2})\}?|(\\?.)", re.S), "\\"),
}
#: What may stand around a stream of escaped bytes that has no mark.
_AROUND = b" =:,;&?#\"'()[]{}<>|"
#: A compressed stream is scanned in chunks of about so many characters.
CHUNK = 1 << 20
#: Compressed bytes taken at a time.
PIECE = 4096
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("layers", T.StringType())]))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of what the patterns find in a text as it stands, in order."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def _decoded(raw: bytes) -> tuple[str, np.ndarray]:
    """Bytes as text, and how many bytes each character takes. A byte that isn't UTF-8 becomes a lone surrogate, which
    no pattern matches."""
    text = raw.decode("utf-8", "surrogateescape")
    if len(text) == len(raw):
        return text, np.ones(len(raw), np.int64)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return text, np.where((c >= 0xDC80) & (c <= 0xDCFF), 1, 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000))


def _ranges(n: int, at: list[np.ndarray], width: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Where each of n characters came from, (lo, hi), if those at `at` took `width` characters each and the others one."""
    wide = np.ones(n, np.int64)
    if at:
        wide[np.concatenate(at)] = np.concatenate(width)
    hi = np.cumsum(wide)
    return hi - wide, hi


def _percent(text: str):
    """The text with percent escapes decoded, and each character's range in it."""
    out, at, width, done, n = [], [], [], 0, 0
    for m in _PERCENT.finditer(text):
        plain, wide = _decoded(bytes.fromhex(m[0].replace("%", "")))
        n += m.start() - done
        at.append(np.arange(n, n + len(plain)))
        width.append(3 * wide)
        out += [text[done : m.start()], plain]
        n, done = n + len(plain), m.end()
    out.append(text[done:])
    return "".join(out), *_ranges(n + len(text) - done, at, width)


def _unicode(text: str):
    """Likewise for \\uXXXX, \\u{X}, \\UXXXXXXXX and \\xXX; pairs of surrogates make one character, lone ones stay."""
    out, at, width, done, n, high = [], [], [], 0, 0, None

    def put(a: int, b: int, c: int) -> None:
        nonlocal done, n
        out.extend((text[done:a], chr(c)))
        n += a - done
        at.append(n)
        width.append(b - a)
        n, done = n + 1, b

    for m in _UNICODE.finditer(text):
        a, b, c = m.start(), m.end(), int(m[1] or m[2] or m[3] or m[4], 16)
        if high and high[1] == a and 0xDC00 <= c < 0xE000:
            put(high[0], b, 0x10000 + ((high[2] - 0xD800) << 10) + c - 0xDC00)
            high = None
            continue
        high = (a, b, c) if 0xD800 <= c < 0xDC00 else None
        if c <= 0x10FFFF and not 0xD800 <= c < 0xE000:
            put(a, b, c)
    out.append(text[done:])
    return "".join(out), *_ranges(n + len(text) - done, [np.array(at, np.int64)] if at else [], [np.array(width, np.int64)] if at else [])


def _formats(head: bytes):
    """The window bits to try on what starts so: gzip by its mark, zlib by its header checksum, else a raw stream."""
    if head == b"\x1f\x8b":
        yield 31
    elif len(head) == 2 and head[0] & 15 == 8 and head[0] < 128 and int.from_bytes(head) % 31 == 0:
        yield 15
    yield -15


def _stream(raw: bytes, pos: int, bits: int):
    """(bytes, None) for each piece of the stream at pos, then (b"", its end); of a broken one, what comes before the break."""
    d = zlib.decompressobj(bits)
    while pos < len(raw):
        piece, before = raw[pos : pos + PIECE], d.copy()
        try:
            yield d.decompress(piece), None
        except zlib.error:
            for k in range(len(piece)):
                try:
                    yield before.decompress(piece[k : k + 1]), None
                except zlib.error:
                    return
            return
        pos += len(piece) - len(d.unused_data)
        if d.eof:
            yield b"", pos
            return


def _sound(raw: bytes, pos: int, whole: bool) -> bool:
    """Whether a raw stream at pos, which has no mark or checksum, goes to its end or that of the bytes; noise breaks. A run
    inside another, of which binary data has many, must end where the stream does."""
    d = zlib.decompressobj(-15)
    try:
        while pos < len(raw) and not d.eof:
            d.decompress(raw[pos : pos + PIECE])
            pos += PIECE
    except zlib.error:
        return False
    return whole or (d.eof and not d.unused_data and pos >= len(raw))


def _inflated(raw: bytes, whole: bool):
    """The bytes of the compressed streams that stand one after another in raw, piece by piece."""
    pos = 0
    while pos is not None and pos < len(raw):
        some, end = False, None
        for bits in _formats(raw[pos : pos + 2]):
            if bits < 0 and not _sound(raw, pos, whole):
                continue
            for out, end in _stream(raw, pos, bits):
                if out:
                    some = True
                    yield out
            if some or end is not None:
                break
        pos = end
        while pos is not None and raw[pos : pos + 1] == b"\0":  # padding between members
            pos += 1


def _cut(text: str) -> int:
    """The last place where nothing that is looked for can go on: behind a character that no pattern or encoding holds, or
    a line's end that isn't one of folded base64; 0 if there is none."""
    for k in range(len(text), 0, -1):
        c = text[k - 1]
        if c not in _HELD and (c != "\n" or not _FOLD.match(text[max(0, k - 62) : k])):
            return k
    return 0


def _chunks(raw: bytes, whole: bool):
    """The text of the compressed streams in raw, in chunks that can be scanned apart; one without a cut grows."""
    decoder, held, size, least = codecs.getincrementaldecoder("utf-8")("surrogateescape"), [], 0, CHUNK
    for part in _inflated(raw, whole):
        held.append(decoder.decode(part))
        size += len(held[-1])
        if size < least:
            continue
        text = "".join(held)
        cut = _cut(text)
        if cut:
            yield text[:cut]
        held, size = [text[cut:]], len(text) - cut
        least = max(CHUNK, 2 * size)  # looked through again only when it has doubled
    if text := "".join(held) + decoder.decode(b"", True):
        yield text


def _unbase64(run: str) -> bytes:
    """The bytes in a base64 run; a last character alone holds none."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    body = body[: len(body) - (len(body) % 4 == 1)]
    return base64.b64decode(body + "=" * (-len(body) % 4))


def _runs(text: str, patterns) -> list[tuple[int, int, bool]]:
    """Where the first pattern matches, and where the others match inside that, further on; each place once, and whether it is the first's."""
    out = {}
    for m in patterns[0].finditer(text):
        out[*m.span(), True] = None
        for p in patterns[1:]:
            out |= dict.fromkeys((*x.span(), False) for x in p.finditer(text, *m.span()) if x.start() > m.start())
    return list(out)


def _gathered(parts) -> bytes:
    """Bytes in pieces as one; long ones lie in a file that has no name."""
    held, size = [], 0
    for p in parts:
        held.append(p)
        size += len(p)
        if size > 16 * CHUNK:
            with tempfile.TemporaryFile() as f:
                f.writelines(held)
                f.writelines(parts)
                f.flush()
                return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    return b"".join(held)


def _promising(head: bytes) -> bool:
    """Whether a stream may begin so."""
    for bits in _formats(head[:2]):
        try:
            if zlib.decompressobj(bits).decompress(head):
                return True
        except zlib.error:
            pass
    return False


def _unpacked(raw, whole: bool):
    """(layer, text) of the compressed streams in raw, in chunks, and of those that what they hold consists of."""
    name, seen = "deflate", set()
    while raw and (key := hashlib.blake2b(raw, digest_size=16).digest()) not in seen:
        seen.add(key)
        some = False
        for inner in _chunks(raw, whole):
            some = True
            yield name, inner
        parts = _inflated(raw, whole) if some else iter(())
        head = next(parts, b"")
        while 0 < len(head) < 64 and (more := next(parts, b"")):
            head += more
        raw = _gathered(itertools.chain((head,), parts)) if _promising(head) else b""
        name, whole = f"{name}+deflate", False


def _whole(raw: bytes, pos: int, bits: int) -> int | None:
    """The end of a stream at pos that holds something and goes to its end; small pieces first, as noise breaks soon."""
    d, size, step = zlib.decompressobj(bits), 0, 64
    try:
        while pos < len(raw) and not d.eof:
            size += len(d.decompress(raw[pos : pos + step]))
            pos, step = pos + step, PIECE
    except zlib.error:
        return None
    return min(pos, len(raw)) - len(d.unused_data) if size and d.eof else None


def _marked(raw: bytes):
    """Where gzip and zlib streams stand in bytes, (begin, end); a gzip stream may be broken."""
    pos = 0
    while m := _MARKS.search(raw, pos):
        end = _whole(raw, m.start(), 31 if m[0][0] == 31 else 15)
        if end is None and m[0][0] == 31 and any(out for out, _ in _stream(raw, m.start(), 31)):
            end = len(raw)
        if end:
            yield m.start(), end
        pos = end or m.start() + 1


def _unmarked(raw: bytes):
    """Likewise for raw streams, which begin and end at the ends of the bytes or at what may stand around them."""
    for a in [0, *(k + 1 for k in range(len(raw) - 1) if raw[k] in _AROUND)]:
        end = _whole(raw, a, -15)
        if end and (end == len(raw) or raw[end] in _AROUND):
            yield a, end


_SHORT = dict(zip("abfnrtv0", b"\a\b\f\n\r\t\v\0"))


def _escaped_streams(text: str, name: str):
    """(begin, end, bytes) of the compressed streams that stand as escaped bytes in a text."""
    runs, part, mark = _BYTE_RUNS[name]
    for run in runs.finditer(text):
        if mark not in run[0]:
            continue
        value = lambda m: int(m[1], 16) if m[1] else _SHORT.get(m[2][1], ord(m[2][1])) if len(m[2]) > 1 else ord(m[2])
        raw = urllib.parse.unquote_to_bytes(run[0]) if name == "url" else bytes(value(m) for m in part.finditer(run[0]))
        found = [*_marked(raw), *_unmarked(raw)]
        if found:
            at = np.fromiter((m.start() for m in part.finditer(run[0])), np.int64, len(raw))
            at = np.append(at, len(run[0])) + run.start()
            yield from ((int(at[a]), int(at[b]), raw[a:b]) for a, b in found)


def _blocks(text: str):
    """(place, block) of a text's lines; lines between which base64 may be folded stay together."""
    at, held, size = 0, [], 0
    for line in text.split("\n"):
        if held and not (_FOLD.match(held[-1][-61:] + "\n") and line[:1] in _HELD and line[:1] not in " :=\"'\r"):
            yield at, "\n".join(held)
            at, held, size = at + size, [], 0
        held.append(line)
        size += len(line) + 1
    yield at, "\n".join(held)


def _layers(text: str):
    """Each piece of a text that unwraps: (name, inner text, lo, hi), ranges of the inner characters in the text."""
    if "%" in text or "\\" in text:
        for at, block in _blocks(text):
            if _ESCAPED.search(block):
                for name, unwrap in (("url", _percent), ("unicode", _unicode)):
                    inner, lo, hi = unwrap(block)
                    if inner == block:
                        continue
                    yield name, inner, lo + at, hi + at
                    for a, b, raw in _escaped_streams(block, name):
                        for packed_as, inner in _unpacked(raw, True):
                            yield f"{name}+{packed_as}", inner, np.broadcast_to(a + at, len(inner)), np.broadcast_to(b + at, len(inner))
    # A run of one alphabet may be glued to words by the other's characters, so runs of each are read as well.
    runs = [(text[a:b], range(a, b), whole) for a, b, whole in _runs(text, _BASE64)]
    for a, b, whole in _runs(text, _FOLDED) if "\n" in text else ():
        at = [i for i in range(a, b) if text[i] not in "\r\n"]
        runs.append(("".join(text[i] for i in at), at, whole))
    # What stands before a run's begin may be of its alphabet, so a run is read at each of four offsets.
    for run, at, whole in ((run[k:], at[k:], whole and not k) for run, at, whole in runs for k in range(4)):
        if len(run.rstrip("=")) < 2:
            continue
        raw = _unbase64(run)
        inner, width = _decoded(raw)
        where = np.asarray(at)  # where each character of the run stands
        last = np.cumsum(width)
        yield "base64", inner, where[(last - width) * 4 // 3], where[np.minimum(len(where), -(-last * 4 // 3)) - 1] + 1
        some = False
        for packed_as, inner in _unpacked(raw, whole):  # no character has a place of its own in the compressed stream
            some = True
            yield f"base64+{packed_as}", inner, np.broadcast_to(at[0], len(inner)), np.broadcast_to(at[-1] + 1, len(inner))
        for a, b in () if some else _marked(raw):
            for packed_as, inner in _unpacked(raw[a:b], True):
                yield f"base64+{packed_as}", inner, np.broadcast_to(at[a * 4 // 3], len(inner)), np.broadcast_to(at[min(len(at), -(-b * 4 // 3)) - 1] + 1, len(inner))


def all_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, layers) of the text's own spans and those in its layers; layers: how it was wrapped.

    A place that layers find again is listed once, by its shallowest layer."""
    found = {s: "" for s in base_spans(text)}
    seen = {}  # depth by what a layer holds and where
    work = [("", _layers(text), None, None)]  # from the text down to the layer at hand, so chunks are held one at a time
    while work:
        path, layers, lo, hi = work[-1]
        if (got := next(layers, None)) is None:
            work.pop()
            continue
        name, inner, p, q = got
        if not inner:
            continue
        depth = len(work)
        if lo is not None:
            path, p, q = f"{path}>{name}", lo[p], hi[q - 1]
        else:
            path = name
        key = hashlib.blake2b(inner.encode("utf-8", "surrogatepass") + b"\0%d:%d" % (p[0], q[-1]), digest_size=16).digest()
        if seen.get(key, depth + 1) <= depth:
            continue
        seen[key] = depth
        for a, kind, b in base_spans(inner):
            place = (int(p[a]), kind, int(q[b - 1]))
            if place not in found or found[place].count(">") >= depth:
                found[place] = path
        work.append((path, _layers(inner), p, q))
    return sorted((*s, path) for s, path in found.items())


def scan(docs: DataFrame, columns: list[str] | None = None, redact: bool = False) -> DataFrame:
    """docs(doc_id, text, ...) with n_assign, n_access, n_hex, base_sha256 (of what stands in the text itself) and
    findings, an array of (kind, start, end, layers), in code points, end exclusive. With redact, also
    clean_text, where each finding is replaced by [REDACTED]. Null texts count as empty: no findings, the hash
    of an empty string, and clean_text null. Extra columns stay aside; rows that repeat are scanned each, texts of any length whole;
    an empty table gives an empty result."""
    keep = columns or ["doc_id"]
    schema = T.StructType([*docs.select(*keep).schema.fields])
    for name, kind in (("n_assign", "long"), ("n_access", "long"), ("n_hex", "long"), ("base_sha256", "string"), ("findings", SPANS)):
        schema = schema.add(name, kind)
    if redact:
        schema = schema.add("clean_text", "string")

    @tidy
    def op(batches):
        kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("layers", pa.string())]))
        for b in batches:
            counts, digests, spans, clean = [], [], [], []
            for raw in b.column(b.num_columns - 1).to_pylist():
                text = raw or ""
                got = all_spans(text)
                base = [s for s in got if not s[3]]
                counts.append([sum(s[1] == k for s in base) for k in range(3)])
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append([{"kind": KINDS[k], "start": a, "end": e, "layers": path} for a, k, e, path in got])
                if redact:
                    clean.append(None if raw is None else redacted(text, got))
            cols = [*b.columns[:-1], *(pa.array([c[k] for c in counts], pa.int64()) for k in range(3)), pa.array(digests, pa.string()), pa.array(spans, kinds)]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(clean, pa.string())] if redact else []), schema.names)

    return docs.select(*keep, F.col("text").cast("string").alias("_text")).mapInArrow(op, schema)


def joined(spans) -> str:
    return ",".join(f"{KINDS[s[1]]}:{s[0]}:{s[2]}" for s in spans)


def redacted(text: str, spans, mark: str = "[REDACTED]") -> str:
    out, at = [], 0
    for a, _, b, _ in spans:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def op9_secret_scan(spark, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("findings", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", spans.alias("spans"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its secrets are replaced by a mark, and n_chars follows. All other columns are kept, whatever their
    names; a null text stays null; repeated rows are scanned each; an empty table stays empty."""
    out = scan(packed(docs, "text"), ["row"], redact=True)
    new = {"text": F.col("clean_text"), "n_chars": F.char_length("clean_text").cast("long")}
    return out.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))
