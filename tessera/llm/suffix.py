"""Removal of repeated byte strings, by a logarithmic family of suffix arrays.

What is indexed. Every `length`-byte window of every document is dealt to a shard by its content: the
window's minimizer, that one of its 16-byte strings whose hash is least. Neighbouring windows
with one minimizer travel together as a record (their bytes, document and place). Equal windows have
equal minimizers, so all places where a window stands meet in one shard, wherever they start.

How a shard is searched. Records are taken in batches, in the order of doc_id. Each batch gets a suffix array: the places of
its windows in the order of the bytes that follow; an array holds places, never the bytes. It is merge-scanned against each level
of the index: both are sorted, so a linear merge, done in stretches, puts equal windows side by side. Then it becomes a level itself, and a level merges with
the one before it as long as that isn't twice as large, so sizes fall geometrically and there are about log2(batches) levels.

Two uses. remove_repeats() searches a whole table: each shard's family lives in its task, and records whose minimizer stands in one
document only are left out, as they can't repeat. RepeatIndex keeps a family in a shared folder: each batch of documents is searched against
itself and the levels stored before, becomes a stored level, and stored levels merge by size.

Hot strings. Equal records of a block of documents travel once, with their smallest doc_id; the
others are known to be repeats at that point. Records that repeat within a block are remembered for the rest of their task, and
travel again only with a smaller doc_id. So a passage that a third of all documents share costs its shard one record per task, not
one per document.
"""

from __future__ import annotations

import struct
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import shards, stored, table

LENGTH = 50
ANCHOR = 16
#: Bytes of text that are cut into records at a time, bytes of records to a shard, windows to a batch.
BLOCK, SHARD_BYTES, BATCH = 1 << 22, 16 << 20, 1 << 18
#: Repeating records that a task remembers; beyond that the oldest is forgotten, and travels once more when it comes again.
KNOWN = 100_000
_STEP = 1 << 18
#: Places whose bytes are held while two arrays are merged.
STRETCH = 1 << 17


def _hashes(data: np.ndarray) -> np.ndarray:
    """A hash of each 16-byte string of data."""
    x = data.astype(np.uint64)
    b = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for k in (1, 2, 4, 8):
            x = x[:-k] * b + x[k:]
            b = b * b
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _least(h: np.ndarray, wide: int) -> np.ndarray:
    s, k = h, 1
    while 2 * k <= wide:
        s = np.minimum(s[:-k], s[k:])
        k *= 2
    n = len(h) - wide + 1
    return np.minimum(s[:n], s[wide - k :][:n])


def cut(data: np.ndarray, ends: np.ndarray, length: int = LENGTH):
    """Records of documents that stand one after another in data: (start, windows, hash of minimizer, place of it in the record, document number)."""
    wide = length - ANCHOR + 1  # below 256: a hash's last byte gives way to its place, modulo 256
    starts, counts, hashes, places, owners = [], [], [], [], []
    for lo in range(0, max(0, len(data) - length + 1), _STEP):
        h = _hashes(data[lo : lo + _STEP + length - 1])
        h &= np.uint64(0xFFFFFFFFFFFFFF00)
        h |= (np.arange(lo, lo + len(h)) & 255).astype(np.uint64)
        least = _least(h, wide)
        value = least >> np.uint64(8)
        n = len(least)
        one, two = np.searchsorted(ends, [lo, lo + n - 1], side="right")
        edge = np.concatenate(([lo], ends[one:two], [lo + n])) - lo  # where documents begin in this stretch
        new = np.empty(n, bool)
        new[0] = True
        np.not_equal(value[1:], value[:-1], out=new[1:])
        new[edge[:-1]] = True
        inside = np.ones(n, bool)
        for e in ends[one : np.searchsorted(ends, lo + n + length, side="right") + 1] - lo:  # the last windows of a document would leave it
            inside[max(0, e - length + 1) : max(0, min(e, n))] = False
            if 0 <= e - length + 1 < n:
                new[e - length + 1] = True
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, n))
        ok = inside[first]
        first, count = first[ok], count[ok]
        starts.append(first + lo)
        counts.append(count)
        hashes.append(value[first])
        places.append(((least[first] & np.uint64(255)).astype(np.int64) - (first + lo)) & 255)
        owners.append(one + np.searchsorted(edge[1:-1], first, side="right"))
    join = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
    return join(starts, np.int64), join(counts, np.int64), join(hashes, np.uint64), join(places, np.int64), join(owners, np.int64)


def _slices(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of the slices of data, one after another; no slice is empty."""
    offsets = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    kind = np.int32 if max(len(data), offsets[-1]) < 2**31 else np.int64
    step = np.ones(offsets[-1], kind)
    if len(start):
        step[0] = start[0]
        step[offsets[1:-1]] = start[1:] - start[:-1] - size[:-1] + 1
        np.cumsum(step, out=step)
    return offsets, data[step]


def _codes(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """A number for each slice; equal slices, equal numbers."""
    arr = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    return arr.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _word(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 8 bytes at each place as a number whose order is theirs."""
    view = np.lib.stride_tricks.sliding_window_view(data, 8)
    return np.ascontiguousarray(view[at]).view(">u8").ravel().astype(np.uint64)


def _windows(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The bytes at some places, as fixed-length strings, for as long as they are compared."""
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, length)[at]).view(f"S{length}").ravel()


def suffix_order(data: np.ndarray, at: np.ndarray, length: int, kind: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(order, same): the places `at` in the order of the `length` bytes that stand there, and for each but the last in that order whether
    the next has the same bytes."""
    keys = _windows(data, at, length)
    order = np.argsort(keys, kind=kind)
    keys = keys[order]
    return order, keys[1:] == keys[:-1]


def merge_order(data: np.ndarray, a: np.ndarray, b: np.ndarray, word_a: np.ndarray, word_b: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for two sorted arrays of places, a's places being numbered before b's: a linear merge, as a stable sort of two runs
    is, in stretches of about STRETCH places, so that few bytes are held. Stretches end where first words change."""
    edges = word_a[STRETCH::STRETCH] if len(a) >= len(b) else word_b[STRETCH::STRETCH]
    lo_a, lo_b = (np.r_[0, np.searchsorted(w, edges), len(w)] for w in (word_a, word_b))
    orders, sames = [], []
    for i in range(len(lo_a) - 1):
        x, y = slice(lo_a[i], lo_a[i + 1]), slice(lo_b[i], lo_b[i + 1])
        order, same = suffix_order(data, np.concatenate([a[x], b[y]]), length, "stable")
        n = x.stop - x.start
        orders.append(np.where(order < n, order + x.start, order - n + len(a) + y.start))
        sames += [same, np.zeros(1, bool)] if len(order) else []
    return np.concatenate(orders), np.concatenate(sames)[:-1] if sames else np.zeros(0, bool)


def _starts(same: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, ~same])


class Level:
    """A suffix array of distinct windows of data: places in order, first words, and the smallest document that has each."""

    def __init__(self, at: np.ndarray, docs: np.ndarray, word: np.ndarray):
        self.at, self.docs, self.word = at, docs, word

    def __len__(self) -> int:
        return len(self.at)


class SuffixIndex:
    """A family of suffix arrays over data, which holds the text of all windows that are added or loaded."""

    def __init__(self, data: np.ndarray, length: int = LENGTH):
        self.data, self.length = data, length
        self.levels: list[Level] = []
        self.fixed = 0  # so many first levels stay as they are

    def level(self, at: np.ndarray, docs: np.ndarray) -> Level:
        """A level of windows that are distinct and in order."""
        return Level(at, docs, _word(self.data, at))

    def add(self, at: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """For each window, the smallest document up to now that has it, itself included. Batches with ascending documents give the
        smallest of all."""
        if not len(at):
            return docs[:0]
        order, same = suffix_order(self.data, at, self.length)  # the batch's suffix array
        first = _starts(same)
        group = np.cumsum(np.r_[True, ~same]) - 1
        own = self.level(at[order[first]], np.minimum.reduceat(docs[order], first))
        least = own.docs.copy()
        for level in self.levels:
            mine, theirs = self.matches(level, own)
            least[mine] = np.minimum(least[mine], level.docs[theirs])
        out = np.empty(len(at), docs.dtype)
        out[order] = least[group]
        fresh = least >= own.docs  # what a level has already, with a smaller document, needn't be held again
        self.push(Level(own.at[fresh], own.docs[fresh], own.word[fresh]))
        return out

    def matches(self, level: Level, own: Level) -> tuple[np.ndarray, np.ndarray]:
        """Merge scan: (which windows of own, which of level) are the same."""
        order, same = merge_order(self.data, level.at, own.at, level.word, own.word, self.length)
        hit = np.flatnonzero(same)
        return order[hit + 1] - len(level), order[hit]

    def merged(self, a: Level, b: Level) -> Level:
        if not len(a) or not len(b):
            return a if len(a) else b
        order, same = merge_order(self.data, a.at, b.at, a.word, b.word, self.length)
        at, docs, word = (np.concatenate(x) for x in ((a.at, b.at), (a.docs, b.docs), (a.word, b.word)))
        first = _starts(same)
        return Level(at[order[first]], np.minimum.reduceat(docs[order], first), word[order[first]])

    def push(self, new: Level) -> None:
        """Levels merge as long as the last one isn't twice as large as the new one."""
        while len(self.levels) > self.fixed and len(self.levels[-1]) < 2 * len(new):
            new = self.merged(self.levels.pop(), new)
        if len(new):
            self.levels.append(new)


#: A payload: how many records, bytes of text; then documents, places, windows, variants, minimizers' places; then the text.
_HEAD = struct.Struct("<qq")
_FIELDS = (np.int64, np.int64, np.int32, np.int64, np.int16)


def _planes(x: np.ndarray, kind) -> bytes:
    """Differences of neighbours, first bytes first, then second ones, and so on: mostly zeros, which compress."""
    d = np.diff(x.astype(kind), prepend=kind(0))
    return np.ascontiguousarray(d.view(np.uint8).reshape(-1, d.itemsize).T).tobytes()


def _pack(doc, variant, pos, count, place, data) -> bytes:
    raw = b"".join((_HEAD.pack(len(doc), len(data)), *(_planes(x, k) for x, k in zip((doc, pos, count, variant, place), _FIELDS, strict=True)), data.tobytes()))
    return zstandard.ZstdCompressor(level=3).compress(raw)


def _unpack(payload: bytes):
    raw = zstandard.ZstdDecompressor().decompress(payload)
    n, m = _HEAD.unpack_from(raw)
    got, at = [], _HEAD.size
    for kind in _FIELDS:
        wide = np.dtype(kind).itemsize
        d = np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * wide, at).reshape(wide, n).T).view(kind).ravel()
        got.append(np.cumsum(d, dtype=kind))
        at += n * wide
    doc, pos, count, variant, place = got
    return doc, variant, pos, count, place, np.frombuffer(raw, np.uint8, m, at)


def _block(texts: list[bytes], docs: np.ndarray, variants: np.ndarray, parts: int, length: int, known: dict[bytes, int]):
    """Rows (shard, kind, payload) of a block of documents: kind 0 records, kind 1 places known to repeat.

    known: records that repeated within earlier blocks of the task, with the smallest document that they have been sent with."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    start, count, minimizer, place, owner = cut(data, ends, length)
    if not len(start):
        return
    part = ((minimizer >> np.uint64(3)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")  # so that a shard's records lie together
    part, start, count, place, owner = part[order], start[order], count[order], place[order], owner[order]
    pos, size = start - np.r_[0, ends][owner], count + length - 1
    offset, text = _slices(data, start, size)
    code = _codes(offset, text)
    doc, variant = docs[owner], variants[owner]
    least = np.full(code.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, code, doc)
    again = doc > least[code]
    one = np.full(len(least), -1)
    one[code[again]] = np.flatnonzero(again)  # a record for each code that repeats here
    for c in np.flatnonzero(one >= 0).tolist():
        r = one[c]
        name = text[offset[r] : offset[r + 1]].tobytes()
        sent = known.get(name)
        if sent is not None and sent <= least[c]:
            least[c] = sent
        else:
            known[name] = int(least[c])
            if len(known) > KNOWN:
                known.pop(next(iter(known)))
    again = doc > least[code]
    for to, rows in _dealt((doc[again] & 0x7FFFFFFF) % parts, np.flatnonzero(again)):
        yield to, 1, _pack(doc[rows], variant[rows], pos[rows], count[rows], place[rows], text[:0])
    for to, rows in _dealt(part, np.arange(len(part))):
        lo, hi, kept = rows[0], rows[-1] + 1, ~again[rows]
        own = text[offset[lo] : offset[hi]]
        if not kept.all():
            own, rows = own[np.repeat(kept, size[rows])], rows[kept]
        yield to, 0, _pack(doc[rows], variant[rows], pos[rows], count[rows], place[rows], own)


def _dealt(part: np.ndarray, rows: np.ndarray):
    order = np.argsort(part, kind="stable")
    part, rows = part[order], rows[order]
    bounds = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else []
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        yield int(part[lo]), rows[lo:hi]


def shared_records(doc, count, place, data, length: int = LENGTH) -> np.ndarray:
    """Which of a shard's records have a minimizer that stands in several documents; others can't repeat."""
    size = count + length - 1
    offset = np.cumsum(size) - size
    # The minimizer itself, 16 bytes, as two numbers; what follows needs equal ones to meet, so a mixed number is enough.
    view = np.lib.stride_tricks.sliding_window_view(data, ANCHOR)
    anchor = np.ascontiguousarray(view[offset + place]).view("<u8").reshape(-1, 2)
    with np.errstate(over="ignore"):
        mixed = (anchor[:, 0] ^ (anchor[:, 1] * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    order = np.argsort(mixed, kind="stable")
    first = np.flatnonzero(np.r_[True, mixed[order][1:] != mixed[order][:-1]])
    alike = np.minimum.reduceat(doc[order], first) != np.maximum.reduceat(doc[order], first)
    return order[np.repeat(alike, np.diff(np.r_[first, len(order)]))]


def search(index: SuffixIndex, rows, doc, variant, pos, count, start, batch: int = BATCH):
    """The places that repeat, (doc, variant, start, end), of the records `rows`, which stand at `start` in the index's data; adds them to the index."""
    data, length, size, offset = index.data, index.length, count + index.length - 1, start
    rows = rows[np.argsort(doc[rows], kind="stable")]  # ascending documents
    cuts = np.searchsorted(np.cumsum(count[rows]), np.arange(batch, count[rows].sum() + batch, batch))
    for own in np.split(rows, np.unique(np.minimum(cuts + 1, len(rows)))):
        if not len(own):
            continue
        code = _codes(*_slices(data, offset[own], size[own]))
        distinct, one = np.unique(code, return_index=True)  # the first of equal records has the smallest document
        held = own[one]
        wins = count[held]
        at = np.repeat(offset[held] - (np.cumsum(wins) - wins), wins) + np.arange(wins.sum())
        least = index.add(at, np.repeat(doc[held], wins))
        # Every record against the answers for the record that it equals.
        slot = np.searchsorted(distinct, code)
        first_win = np.cumsum(wins) - wins
        at = np.repeat(first_win[slot] - (np.cumsum(count[own]) - count[own]), count[own]) + np.arange(count[own].sum())
        rec = np.repeat(np.arange(len(own)), count[own])
        covered = least[at] < doc[own][rec]
        k = np.arange(len(covered)) - np.repeat(np.cumsum(count[own]) - count[own], count[own])
        edge_on = covered & ~np.r_[False, covered[:-1] & (rec[1:] == rec[:-1])]
        edge_off = covered & ~np.r_[covered[1:] & (rec[1:] == rec[:-1]), False]
        lo, hi = np.flatnonzero(edge_on), np.flatnonzero(edge_off)
        mine = own[rec[lo]]
        yield doc[mine], variant[mine], pos[mine] + k[lo], pos[mine] + k[hi] + length


def _records(docs: DataFrame, parts: int, length: int) -> DataFrame:
    """(part, kind, payload) of docs(doc_id, variant, text), as _block() makes them."""

    def split(batches):
        known: dict[bytes, int] = {}
        for b in batches:
            ids, variants = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            texts = [t or b"" for t in b.column(2).cast(pa.binary()).to_pylist()]
            lo = 0
            while lo < len(texts):
                hi, got = lo, 0
                while hi < len(texts) and (hi == lo or got + len(texts[hi]) <= BLOCK):
                    got += len(texts[hi])
                    hi += 1
                rows = list(_block(texts[lo:hi], ids[lo:hi], variants[lo:hi], parts, length, known))
                if rows:
                    p, k, x = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(k, pa.int32()), pa.array(x, pa.binary())], ["part", "kind", "payload"])
                lo = hi

    return docs.where("doc_id is not null").mapInArrow(split, "part int, kind int, payload binary")


def _places(doc, variant, start, end):
    return [pa.array(doc.astype(np.int64)), pa.array(variant.astype(np.int64)), pa.array(start.astype(np.int64)), pa.array(end.astype(np.int64))]


_PLACES = ["doc_id", "variant", "start", "end"]


def repeated_places(docs: DataFrame, parts: int, length: int = LENGTH) -> DataFrame:
    """(doc_id, variant, start, end) of places in docs(doc_id, variant, text), in bytes, that may overlap."""

    def searched(batches):
        held = []
        for b in batches:
            for kind, payload in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                got = _unpack(payload)
                if kind:
                    doc, variant, pos, count = got[:4]
                    yield pa.RecordBatch.from_arrays(_places(doc, variant, pos, pos + count + length - 1), _PLACES)
                else:
                    held.append(got)
        if held:
            doc, variant, pos, count, place, data = (np.concatenate(c) for c in zip(*held, strict=True))
            held = None
            size = count + length - 1
            for got in search(SuffixIndex(data, length), shared_records(doc, count, place, data, length), doc, variant, pos, count, np.cumsum(size) - size):
                yield pa.RecordBatch.from_arrays(_places(*got), _PLACES)

    return _records(docs, parts, length).repartitionById(parts, F.col("part")).mapInArrow(searched, "doc_id long, variant long, start long, end long")


def _numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(docs with `variant`, its rows to search): 0, or where rows repeat a doc_id, a hash that tells their texts apart; should two
    texts of an id have one hash, another is taken. Rows that repeat in full are searched once."""
    known = docs.where("doc_id is not null")
    row = known.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("ids")).first()
    salt = 0
    while row["n"] > row["ids"]:
        variant = F.xxhash64(F.coalesce("text", F.lit("")), F.lit(salt))
        texts = known.groupBy("doc_id", F.sha2("text", 256).alias("sha"), variant.alias("v")).agg(F.lit(1).alias("one"))
        if texts.groupBy("doc_id", "v").count().where("count > 1").isEmpty():
            own = docs.withColumn("variant", variant)
            return own, own.dropDuplicates(["doc_id", "variant"])
        salt += 1
    own = docs.withColumn("variant", F.lit(0).cast("long"))
    return own, own


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, spans array of (start, end), kept binary) for each row of docs(doc_id, text).

    Each byte goes that a `length`-byte string covers which also starts in a document with a smaller doc_id;
    spans are the maximal runs of such bytes. Null texts count as empty. Rows that repeat a doc_id are judged each by
    its own text, and never against each other. A row without a doc_id has no smaller one, and is smaller than none: it stays
    whole. Extra columns are left aside; an empty table gives an empty result."""
    if not ANCHOR + 8 <= length < 256:
        raise ValueError(f"length must be from {ANCHOR + 8} to 255")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own, texts = _numbered(own)
    return _without(own, repeated_places(texts.select("doc_id", "variant", "text"), shards_for(docs.sparkSession, own, length), length))


def shards_for(spark, docs: DataFrame, length: int = LENGTH) -> int:
    """How many shards hold SHARD_BYTES of records each."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    spread = (length - 1 + (length - ANCHOR + 2) / 2) / ((length - ANCHOR + 2) / 2)  # bytes of records per byte of text
    return shards(spark, int(total * spread), SHARD_BYTES)


def _without(own: DataFrame, places: DataFrame) -> DataFrame:
    """own(doc_id, variant, text) without the places, as remove_repeats() gives it."""
    found = stored(places.groupBy("doc_id", "variant").agg(F.collect_list(F.struct("start", "end")).alias("places")), "places")

    def op(batches):
        spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            n, spans, kept = [], [], []
            for text, places in zip(b.column(1).cast(pa.binary()).to_pylist(), _place_lists(b.column(2)), strict=True):
                text = text or b""
                merged = _merged(places)
                n.append(len(text))
                spans.append([{"start": int(a), "end": int(e)} for a, e in merged])
                at, parts = 0, []
                for a, e in merged:
                    parts.append(text[at:a])
                    at = e
                kept.append(b"".join([*parts, text[at:]]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(spans, spans_type), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    both = own.join(found, ["doc_id", "variant"], "left").select("doc_id", "text", "places")
    return both.mapInArrow(op, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def _place_lists(column):
    offsets = column.offsets.to_numpy()
    flat = column.values
    start, end = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    for i in range(len(column)):
        yield start[offsets[i] : offsets[i + 1]], end[offsets[i] : offsets[i + 1]]


def _merged(places) -> list[tuple[int, int]]:
    start, end = places
    if not len(start):
        return []
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    first = np.flatnonzero(np.r_[True, start[1:] > end[:-1]])
    return list(zip(start[first].tolist(), end[np.r_[first[1:] - 1, len(end) - 1]].tolist(), strict=True))


class RepeatIndex:
    """A logarithmic family of suffix arrays in a shared folder, for documents that come in batches.

    add() searches a batch against itself and against all levels, and makes it a level; a level merges with the one
    before as long as that isn't twice as large. Batches of ascending doc_ids give together what remove_repeats() gives
    for all at once; of others, each is judged by what is known when it comes. A level is a table of a row per shard; a list of the
    levels is written after each step, so a job that is lost leaves the index as it was. parts: the number of shards,
    which stays; a shard's levels are held by one task, so take as many as the text to come asks for (shards_for())."""

    def __init__(self, spark, path: str, parts: int, length: int = LENGTH):
        self.spark, self.path, self.parts, self.length = spark, path.rstrip("/"), parts, length
        self.levels: list[tuple[str, int]] = []  # folder, windows
        steps = self._steps()
        if steps:
            row = spark.read.parquet(f"{self.path}/list-{max(steps)}").first()
            if (row["parts"], row["length"]) != (parts, length):
                raise ValueError(f"the index has {row['parts']} shards and windows of {row['length']} bytes")
            self.levels = [tuple(x) for x in row["levels"]]

    def _folder(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _steps(self) -> list[int]:
        p, fs = self._folder()
        names = [f.getPath() for f in fs.listStatus(p)] if fs.exists(p) else []
        done = [n for n in names if n.getName().startswith("list-") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(n, "_SUCCESS"))]
        return [int(n.getName()[5:]) for n in done]

    def _commit(self, levels: list[tuple[str, int]]) -> None:
        step = max(self._steps(), default=0) + 1
        schema = "parts int, length int, levels array<struct<folder: string, windows: long>>"
        self.spark.createDataFrame([(self.parts, self.length, levels)], schema).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/list-{step}")
        gone = [f for f, _ in self.levels if f not in {g for g, _ in levels}]
        self.levels = levels
        p, fs = self._folder()
        for name in [*gone, *(f"list-{k}" for k in self._steps() if k < step)]:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(p, name), True)

    def _stored(self, folders: list[str]) -> DataFrame:
        out = None
        for k, folder in enumerate(folders):
            rows = self.spark.read.schema("part int, payload binary").parquet(f"{self.path}/{folder}").select("part", F.lit(2 + k).alias("kind"), "payload")
            out = rows if out is None else out.unionByName(rows)
        return out

    def add(self, docs: DataFrame) -> DataFrame:
        """As remove_repeats(), for a batch of documents against itself and all batches before."""
        own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        own, texts = _numbered(own)
        length = self.length
        rows = _records(texts.select("doc_id", "variant", "text"), self.parts, length)
        if self.levels:
            rows = rows.unionByName(self._stored([f for f, _ in self.levels]))

        def op(batches):
            held, levels, part, names = [], {}, None, [*_PLACES, "part", "windows", "payload"]
            none = lambda n: [pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())]
            for b in batches:
                for part, kind, payload in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if kind >= 2:
                        levels[kind] = _level_of(payload)
                        continue
                    got = _unpack(payload)
                    if kind:
                        doc, variant, pos, count = got[:4]
                        yield pa.RecordBatch.from_arrays([*_places(doc, variant, pos, pos + count + length - 1), *none(len(doc))], names)
                    else:
                        held.append(got)
            if not held:
                return
            doc, variant, pos, count, _, data = (np.concatenate(c) for c in zip(*held, strict=True))
            index = SuffixIndex(np.concatenate([data, *(x[2] for x in levels.values())]), length)
            base = len(data)
            for at, own_docs, text in (levels[k] for k in sorted(levels)):
                index.levels.append(index.level(at + base, own_docs))
                base += len(text)
            index.fixed = len(index.levels)
            size = count + length - 1
            for got in search(index, np.arange(len(doc)), doc, variant, pos, count, np.cumsum(size) - size):
                yield pa.RecordBatch.from_arrays([*_places(*got), *none(len(got[0]))], names)
            new = index.levels[index.fixed :]
            if new:  # what the batch has brought to the shard
                whole = reduce(index.merged, new)
                yield pa.RecordBatch.from_arrays([*(pa.nulls(1, pa.int64()) for _ in range(4)), pa.array([part], pa.int32()), pa.array([len(whole)], pa.int64()), pa.array([_level_payload(index.data, whole, length)], pa.binary())], names)

        found = stored(rows.repartitionById(self.parts, F.col("part")).mapInArrow(op, "doc_id long, variant long, start long, end long, part int, windows long, payload binary"), "batch")
        fresh = found.where("payload is not null")
        windows = fresh.agg(F.sum("windows")).first()[0] or 0
        if windows:
            name = f"level-{uuid.uuid4().hex}"
            fresh.select("part", "payload").write.parquet(f"{self.path}/{name}")
            self._commit([*self.levels, (name, windows)])
            while len(self.levels) > 1 and self.levels[-2][1] < 2 * self.levels[-1][1]:
                self._merge()
        return _without(own, found.where("payload is null").select(*_PLACES))

    def _merge(self) -> None:
        """The last two levels become one."""
        length = self.length

        def op(batches):
            got, part = [], None
            for b in batches:
                for part, _, payload in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    got.append(_level_of(payload))
            if got:
                index, base, levels = SuffixIndex(np.concatenate([x[2] for x in got]), length), 0, []
                for at, docs, text in got:
                    levels.append(index.level(at + base, docs))
                    base += len(text)
                whole = reduce(index.merged, levels)
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(whole)], pa.int64()), pa.array([_level_payload(index.data, whole, length)], pa.binary())], ["part", "windows", "payload"])

        name = f"level-{uuid.uuid4().hex}"
        self._stored([f for f, _ in self.levels[-2:]]).repartitionById(self.parts, F.col("part")).mapInArrow(op, "part int, windows long, payload binary").write.parquet(f"{self.path}/{name}")
        windows = self.spark.read.parquet(f"{self.path}/{name}").agg(F.sum("windows")).first()[0]
        self._commit([*self.levels[:-2], (name, windows)])


def _level_payload(data: np.ndarray, level: Level, length: int) -> bytes:
    """A level with just the text that its windows need."""
    edge = np.zeros(len(data) + 1, np.int32)
    np.add.at(edge, level.at, 1)
    np.add.at(edge, level.at + length, -1)
    used = np.cumsum(edge[:-1]) > 0
    at = (np.cumsum(used) - 1)[level.at]
    text = data[used]
    raw = b"".join((_HEAD.pack(len(at), len(text)), _planes(at, np.int64), _planes(level.docs, np.int64), text.tobytes()))
    return zstandard.ZstdCompressor(level=3).compress(raw)


def _level_of(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places in order, documents, text)."""
    raw = zstandard.ZstdDecompressor().decompress(payload)
    n, m = _HEAD.unpack_from(raw)
    at, docs = (np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, _HEAD.size + k * 8 * n).reshape(8, n).T).view(np.int64).ravel()) for k in (0, 1))
    return at, docs, np.frombuffer(raw, np.uint8, m, _HEAD.size + 16 * n)


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.col("n_bytes") - F.octet_length("kept")
    return out.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP4_SQL = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
w AS (SELECT doc_id, i, substring(h, 2 * i + 1, {2 * LENGTH}) AS g FROM (SELECT doc_id, h, unnest(range(0, n - {LENGTH - 1})) AS i FROM d)),
m AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first FROM w) WHERE first < doc_id),
s AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER o + {LENGTH} THEN 0 ELSE 1 END AS new FROM m WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, min(i) AS a, max(i) + {LENGTH} AS b FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM s) GROUP BY doc_id, run),
p AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM r),
k AS (SELECT p.doc_id, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed, string_agg(substring(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substring(any_value(h), 2 * max(b) + 1) AS kept FROM p JOIN d ON p.doc_id = d.doc_id GROUP BY p.doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
