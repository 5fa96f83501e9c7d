"""SimHash near-duplicates, with pivot distance tables to discard pairs.

A table holds each distinct fingerprint with its Hamming distances to fixed reference fingerprints, the pivots, worked out once. Pairs meet
under block keys; by the triangle inequality a pair whose distances to any pivot differ by more than the radius
can't be within it and is discarded; survivors are verified bit by bit. Instead of all linked pairs, each group emits a forest over
its rows, so output grows with rows, not with pairs.

near_duplicates() links fingerprints of 64 bits within `bits` differing bits: of 5 blocks, 3 differing bits leave 2 untouched, so
two linked fingerprints meet under one of the 10 pairs of blocks, and nothing is missed.

similar_documents() links documents whose sets of word shingles have a Jaccard similarity of at least a bound. Fingerprints
have 256 bits and the radius is wide; keys are samples of bits, as many as find a pair at the bound with a stated chance; what
survives the fingerprints is verified exactly, shingle by shingle.
"""

from __future__ import annotations

import math
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.shared import dropped, hex64, shards, stored, table, tidy

BITS = 3
WIDTH = 3
SEED = 42
PIVOTS = 16
BLOCKS = (13, 13, 13, 13, 12)
#: Groups up to this size are compared in one go; larger ones are first split by further blocks.
DIRECT = 1024
SALTS = 16


def _pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints, from the splitmix64 rule."""
    out, state, mask = [], 0x5EED, (1 << 64) - 1
    for _ in range(n):
        state = (state + 0x9E3779B97F4A7C15) & mask
        z = state
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & mask
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & mask
        out.append(z ^ (z >> 31))
    return np.array(out, np.uint64)


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The pivot table: for each fingerprint, its Hamming distance to each pivot."""
    return np.bitwise_count(x[:, None] ^ pivots[None, :]).astype(np.int8)


def fingerprint(text: bytes | None, width: int = WIDTH) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles; zero where there are no words."""
    words = (text or b"").lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    parts = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    n = max(1, len(words) - width + 1)
    h = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), parts), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 4096):
        block = h[at : at + 4096]
        ones += np.unpackbits(block.view(np.uint8).reshape(len(block), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, fp bigint) for each row of docs(doc_id, text)."""

    @tidy
    def op(batches):
        for b in batches:
            fps = np.fromiter((fingerprint(t, width) for t in b.column(1).cast(pa.binary()).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(op, "doc_id long, fp long")


def _unite(lab: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """lab: each row's smallest known mate, flat. Joins the components of i and j."""
    while True:
        a, b = lab[i], lab[j]
        on = a != b
        if not on.any():
            return lab
        i, j, a, b = i[on], j[on], a[on], b[on]
        np.minimum.at(lab, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := lab[lab], lab):
            lab = up


def _near(x: np.ndarray, dist: np.ndarray, i: np.ndarray, j: np.ndarray, bits: int) -> np.ndarray:
    """Which of the pairs (i, j) are within bits: by pivot coordinates, then by the bits themselves."""
    left = np.arange(len(i))
    for c in range(0, dist.shape[1], 8):
        ok = (np.abs(dist[i[left], c : c + 8] - dist[j[left], c : c + 8]) <= bits).all(axis=1)
        left = left[ok]
    return left[np.bitwise_count(x[i[left]] ^ x[j[left]]) <= bits]


def _direct(x, dist, end, lab, bits):
    """Compare all pairs within groups; end: for each row, where its group ends. Rows of a group are neighbours."""
    at, d = np.arange(len(x)), 1
    while len(at := at[at + d < end[at]]):
        hit = at[_near(x, dist, at, at + d, bits)]
        if len(hit):
            lab = _unite(lab, hit, hit + d)
        d += 1
    return lab


def _ends(key: np.ndarray) -> np.ndarray:
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return np.repeat(np.r_[starts[1:], len(key)], np.diff(np.r_[starts, len(key)]))


def _split(x, dist, rows, lab, bits):
    """A large group: rows within bits agree on one of bits + 1 parts of the positions that vary here."""
    vary = [b for b in range(64) if 0 < int(((x[rows] >> np.uint64(b)) & np.uint64(1)).sum()) < len(rows)]
    if len(vary) <= bits:
        return _unite(lab, rows[:-1], rows[1:])
    for k in range(bits + 1):
        mask = np.uint64(sum(1 << b for b in vary[k :: bits + 1]))
        key = x[rows] & mask
        order = np.argsort(key, kind="stable")
        part, end = rows[order], _ends(key[order])
        for lo in np.flatnonzero(np.r_[True, end[1:] != end[:-1]]):
            own = part[lo : end[lo]]
            if len(own) > DIRECT and len(own) < len(rows):
                lab = _split(x, dist, own, lab, bits)
            elif len(own) > 1:
                sub = _direct(x[own], dist[own], np.full(len(own), len(own)), np.arange(len(own)), bits)
                lab = _unite(lab, own, own[sub])
    return lab


def links_within(key: np.ndarray, x: np.ndarray, dist: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (row, mate) of stars that connect just the rows linked under equal keys; key is sorted, dist has the rows' distances to the pivots."""
    end = _ends(key)
    size = end - np.flatnonzero(np.r_[True, key[1:] != key[:-1]])[np.cumsum(np.r_[0, key[1:] != key[:-1]])]
    lab = _direct(x, dist, np.where(size <= DIRECT, end, 0), np.arange(len(x)), bits)
    for lo in np.unique(end[size > DIRECT] - size[size > DIRECT]):
        lab = _split(x, dist, np.arange(lo, end[lo]), lab, bits)
    rows = np.flatnonzero(lab != np.arange(len(x)))
    return rows, lab[rows]


def _keys(fp: str):
    """The keys of the 10 pairs of blocks: pair number and both blocks' bits in one bigint."""
    at, blocks = 0, []
    for w in BLOCKS:
        blocks.append(f"(shiftrightunsigned({fp}, {at}) & {(1 << w) - 1}L)")
        at += w
    return F.expr("array(" + ", ".join(f"{n}L * {1 << 26}L + {blocks[a]} * {1 << 13}L + {blocks[b]}" for n, (a, b) in enumerate(combinations(range(len(BLOCKS)), 2))) + ")")


def pivot_table(nodes: DataFrame) -> DataFrame:
    """nodes(node, fp) with d0 and d1: the distances to the 16 pivots, a byte each."""
    pivots = _pivots()

    @tidy
    def op(batches):
        for b in batches:
            d = np.ascontiguousarray(distances(b.column(1).to_numpy(zero_copy_only=False).view(np.uint64), pivots)).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(d[:, 0]), pa.array(d[:, 1])], ["node", "fp", "d0", "d1"])

    return nodes.select("node", "fp").mapInArrow(op, "node long, fp long, d0 long, d1 long")


def _bytes_of_rows(column: pa.Array, kind) -> np.ndarray:
    """A column of bytes, every row of the same width, as a table of numbers."""
    wide = len(column[0].as_py()) if len(column) else np.dtype(kind).itemsize
    return np.frombuffer(column.cast(pa.binary(wide)).buffers()[1], kind, len(column) * (wide // np.dtype(kind).itemsize), column.cast(pa.binary(wide)).offset * wide).reshape(len(column), -1)


def links(nodes: DataFrame, partitions: int, bits: int = BITS) -> DataFrame:
    """Edges (a, b) of nodes(node, fp, d0, d1), fp distinct, that connect what is within bits of each other."""
    if bits > BITS:
        raise ValueError(f"the blocks guarantee {BITS} bits at most")

    @tidy
    def op(batches):
        held = None
        for b in batches:
            got = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            held = got if held is None else [np.concatenate(p) for p in zip(held, got, strict=True)]
            cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0  # the last key may go on
            if cut:
                yield found([h[:cut] for h in held])
                held = [h[cut:] for h in held]
        if held is not None and len(held[0]):
            yield found(held)

    def found(cols):
        key, node, x, *dist = cols
        rows, mates = links_within(key, x.view(np.uint64), np.stack(dist, axis=1).view(np.int8), bits)
        return pa.RecordBatch.from_arrays([pa.array(node[rows]), pa.array(node[mates])], ["a", "b"])

    keyed = nodes.select(F.explode(_keys("fp")).alias("key"), "node", "fp", "d0", "d1")
    return keyed.repartition(partitions, "key").sortWithinPartitions("key", "fp").mapInArrow(op, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = WIDTH, bits: int = BITS) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs(doc_id, text), extra columns ignored.

    Null and empty texts have fingerprint zero and are linked like any other. Rows that repeat a
    doc_id are rows of their own. A null doc_id never names a component that has another; its row
    keeps its fingerprint. An empty table gives an empty result."""
    spark = docs.sparkSession
    fps = stored(fingerprints(docs, width), "fingerprints")
    nodes = stored(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("id")).select(F.monotonically_increasing_id().alias("node"), "fp", "id"), "nodes")
    n = nodes.count()
    pivoted = stored(pivot_table(nodes), "pivots")
    comp = components(links(pivoted, shards(spark, 10 * n, 500_000), bits))
    dropped(pivoted)
    # Nodes are numbered apart from documents, as rows with one doc_id may have several fingerprints.
    named = nodes.join(comp, "node", "left").select("fp", "id", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    known = named.join(least, "component").select("fp", "component_id")
    # A fingerprint that a third of the documents have must not meet in one task: both sides are salted.
    dealt = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = fps.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return salted.join(dealt, ["fp", "salt"], "left").select("doc_id", "fp", "component_id")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", hex64("fp").alias("fingerprint"), "component_id")


# Similar documents

SIMILAR_WIDTH, SIMILARITY = 5, 0.8
#: Bits of a fingerprint in words of 64, and the radius as a share of them: texts at the bound differ in 15 % of the bits, with a standard deviation of 2.2 %.
WORDS, RADIUS = 4, 0.22
#: A pair at the bound is found under one of the keys with this chance at least; pairs above it with a greater one.
RECALL = 0.99
#: Rows that a key may have at random, as a power of two: keys have so many bits fewer than the number of nodes has.
LOAD = 4
#: Groups up to this size are compared all at once; larger ones row by row, CHUNK rows at a time.
SMALL, CHUNK = 48, 1024
SIMILAR_PIVOTS = 8


def shingles(text: bytes | None, width: int = SIMILAR_WIDTH) -> np.ndarray:
    """The distinct hashes of a text's word shingles, sorted; a text with fewer words has one, a text without words none."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    parts = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    return np.unique(np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), parts), np.uint64, max(1, len(words) - width + 1)))


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Further hashes from hashes: one bijection for each k."""
    with np.errstate(over="ignore"):
        x = h + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def wide_fingerprint(h: np.ndarray) -> np.ndarray:
    """The SimHash of a set of hashes, in WORDS words."""
    out = np.zeros(WORDS, np.uint64)
    for k in range(WORDS if len(h) else 0):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(h), 4096):
            block = h[at : at + 4096] if k == 0 else _mixed(h[at : at + 4096], k)
            ones += np.unpackbits(block.view(np.uint8).reshape(len(block), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0]
    return out


def _digest(h: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(h)


def _sampled(n: int, similarity: float) -> np.ndarray:
    """Which bits make up each key: tables by bits; the number of tables follows from RECALL."""
    bits = max(8, math.ceil(math.log2(max(2, n))) - LOAD)
    agree = 1 - math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi  # of a bit, at the bound
    tables = math.ceil(math.log(1 - RECALL) / math.log(1 - agree**bits))
    rng = np.random.default_rng(SEED)
    return np.stack([rng.permutation(64 * WORDS)[:bits] for _ in range(tables)])


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


def _forest(x: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges of a least spanning forest of the rows, by distance, without edges beyond the radius: from a row to the nearest one left."""
    left, best, mate, now, edges = np.arange(1, len(x)), np.full(len(x) - 1, 1 << 30), np.zeros(len(x) - 1, np.int64), 0, []
    while len(left):
        d = _apart(x[left], x[now])
        nearer = d < best
        best[nearer], mate[nearer] = d[nearer], now
        k = int(best.argmin())
        now = int(left[k])
        if best[k] <= radius:
            edges.append((now, int(mate[k])))
        left, best, mate = np.delete(left, k), np.delete(best, k), np.delete(mate, k)
    return edges


def _root(up: dict[int, int], i: int) -> int:
    while up.setdefault(i, i) != i:
        up[i] = i = up[up[i]]
    return i


def forest_within(key: np.ndarray, x: np.ndarray, dist: np.ndarray, radius: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """(edges, roots): under each key of the sorted keys, edges between rows within the radius that connect all such rows, nearest first;
    of the last key's rows, one for each tree."""
    end = _ends(key)
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.repeat(np.diff(np.r_[first, len(key)]), np.diff(np.r_[first, len(key)]))
    hits, at, d = [], np.flatnonzero(size <= SMALL), 1
    while len(at := at[at + d < end[at]]):
        near = (np.abs(dist[at].astype(np.int16) - dist[at + d]) <= radius).all(axis=1)
        i = at[near]
        n = _apart(x[i], x[i + d])
        i, n = i[n <= radius], n[n <= radius]
        hits.append(np.stack([n, i, i + d], axis=1))
        d += 1
    up: dict[int, int] = {}
    edges = []
    pairs = np.concatenate(hits) if hits else np.zeros((0, 3), np.int64)
    for _, i, j in pairs[np.argsort(pairs[:, 0], kind="stable")].tolist():
        a, b = _root(up, i), _root(up, j)
        if a != b:
            up[max(a, b)] = min(a, b)
            edges.append((i, j))
    for lo in first[size[first] > SMALL].tolist():
        rows = np.arange(lo, end[lo])
        reps = rows[:0]
        for part in range(0, len(rows), CHUNK):  # a chunk, and of each tree before it one row, which finds most links
            own = np.r_[reps, rows[part : part + CHUNK]]
            for i, j in _forest(x[own], radius):
                i, j = int(own[i]), int(own[j])
                edges.append((i, j))
                a, b = _root(up, i), _root(up, j)
                up[max(a, b)] = min(a, b)
            reps = np.array([i for i in own.tolist() if _root(up, i) == i], np.int64)
        # Other rows of a tree may be near rows that this one isn't: of two trees, one isn't the largest, so its rows are held against all.
        tree = np.array([_root(up, i) for i in rows.tolist()])
        for i in rows[tree != rows[np.bincount(tree - lo).argmax()]].tolist() if len(rows) > CHUNK else []:
            d = _apart(x[rows], x[i])
            for k in np.argsort(d, kind="stable")[: int((d <= radius).sum())].tolist():
                a, b = _root(up, i), _root(up, int(rows[k]))
                if a != b:
                    up[max(a, b)] = min(a, b)
                    edges.append((i, int(rows[k])))
    last = range(int(first[-1]), len(key)) if len(first) else []
    return edges, np.array([i for i in last if _root(up, i) == i], np.int64)


def similar_pairs(nodes: DataFrame, n: int, partitions: int, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs (a, b) of nodes(node, fp binary) within the radius, that connect whatever keys bring together."""
    sample = _sampled(n, similarity)
    radius = int(RADIUS * 64 * WORDS)
    pivots = np.stack([_pivots(SIMILAR_PIVOTS * WORDS)[k::SIMILAR_PIVOTS] for k in range(SIMILAR_PIVOTS)])
    power = np.int64(1) << np.arange(sample.shape[1], dtype=np.int64)
    # The fingerprint in words, and the distances to the pivots, four to a number.
    names = ["key", "node", *(f"f{k}" for k in range(WORDS)), *(f"d{k}" for k in range(SIMILAR_PIVOTS // 4))]

    @tidy
    def keyed(batches):
        for b in batches:
            x = _bytes_of_rows(b.column(1), np.uint64)
            dist = np.stack([_apart(x, p) for p in pivots], axis=1).astype(np.int16).view(np.int64)
            own_columns = [pa.array(c) for c in np.concatenate([x.view(np.int64), dist], axis=1).T.copy()]
            bits = np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").astype(np.int64)
            for k, own in enumerate(sample):
                yield pa.RecordBatch.from_arrays([pa.array(bits[:, own] @ power + (np.int64(k) << 40)), b.column(0), *own_columns], names)

    @tidy
    def op(batches):
        held = None
        for b in batches:
            key, node, *numbers = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            got = [key, node, np.stack(numbers[:WORDS], axis=1).view(np.uint64), np.stack(numbers[WORDS:], axis=1).view(np.int16)]
            held = got if held is None else [np.concatenate(p) for p in zip(held, got, strict=True)]
            cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0  # the last key may go on
            if cut:
                yield found([h[:cut] for h in held])
                held = [h[cut:] for h in held]
        if held is not None and len(held[0]):
            yield found(held)

    def found(cols):
        return out(cols[1], forest_within(cols[0], cols[2], cols[3], radius)[0])

    def out(node, edges):
        e = np.array(edges, np.int64).reshape(-1, 2)
        a, b = node[e[:, 0]], node[e[:, 1]]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    rows = nodes.select("node", "fp").mapInArrow(keyed, ", ".join(f"{c} long" for c in names))
    return rows.repartition(partitions, "key").sortWithinPartitions("key", "node").mapInArrow(op, "a long, b long").distinct()


def linked(sets: list[np.ndarray], known: list[tuple[int, int]], similarity: float) -> np.ndarray:
    """For each set of hashes, the first one reachable by links of sets with a Jaccard similarity of at least `similarity`; known: some of these links."""
    m, size = len(sets), np.array([len(h) for h in sets])
    lab = np.arange(m)
    if known:
        lab = _unite(lab, *np.array(known, np.int64).T)
    _, ids, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rows, first, at = np.repeat(np.arange(m), size)[np.argsort(ids, kind="stable")], np.cumsum(count) - count, np.r_[0, np.cumsum(size)]
    # Of two trees, one isn't the largest, so the sets of the others are held against all.
    for i in np.flatnonzero(lab != np.bincount(lab).argmax()).tolist():
        own = ids[at[i] : at[i + 1]]
        n = count[own]
        both = np.bincount(rows[np.repeat(first[own] - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=m)
        mates = np.flatnonzero(both >= similarity * (size[i] + size - both) - 1e-9)
        lab = _unite(lab, np.full(len(mates), i), mates)
    return lab


def similar_documents(docs: DataFrame, width: int = SIMILAR_WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, digest, component_id) for each row of docs(doc_id, text) that has a doc_id: documents are linked whose sets of word
    shingles have a Jaccard similarity of at least `similarity`; component_id is the smallest doc_id reachable.

    ASCII letters count alike in either case. Texts with fewer words than a shingle are one shingle; texts without words (null and empty
    ones too) are alike. Rows that repeat a doc_id are rows of their own, told apart by the digest of their shingles. A pair at the
    bound shares a key with a chance of RECALL, a more similar one with a greater one; each group of a key gives a
    forest of its nearest pairs, whose shingles are then compared exactly. Where a pair of a forest doesn't hold, the sets of all that the
    forests connect come to one task, which finds every link between them. An empty table gives an empty result; extra columns
    are left aside."""
    spark = docs.sparkSession
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    @tidy
    def printed(batches):
        for b in batches:
            sets = [shingles(t, width) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_digest(h) for h in sets], pa.binary()), pa.array([wide_fingerprint(h).tobytes() for h in sets], pa.binary())], ["doc_id", "digest", "fp"])

    prints = stored(texts.mapInArrow(printed, "doc_id long, digest binary, fp binary"), "prints")
    # Numbers in the order of digests, so that groups are gone through alike in every run.
    nodes = stored(prints.groupBy("digest", "fp").agg(F.min("doc_id").alias("id")).orderBy("digest").select(F.monotonically_increasing_id().alias("node"), "digest", "fp", "id"), "nodes")
    n = nodes.count()
    pairs = stored(similar_pairs(nodes, n, shards(spark, n * len(_sampled(n, similarity)), 500_000), similarity), "pairs")
    # The shingles of the documents that some pair names, and then the pairs that hold.
    named = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = nodes.join(named, "node", "left_semi").select("node", F.col("digest").alias("wanted"), F.col("id").alias("wanted_id"))

    @tidy
    def hashed(batches):
        for b in batches:
            sets = [shingles(t, width) for t in b.column(1).cast(pa.binary()).to_pylist()]
            ok = [_digest(h) == w for h, w in zip(sets, b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok, pa.bool_())), pa.array([h.tobytes() for h, o in zip(sets, ok, strict=True) if o], pa.binary())], ["node", "hashes"])

    # The hint keeps texts from being sorted, and the plan the same whether ids are few or many.
    found = texts.join(wanted.hint("shuffle_hash"), texts["doc_id"] == wanted["wanted_id"]).select("node", "text", "wanted").mapInArrow(hashed, "node long, hashes binary")
    sets = stored(found.dropDuplicates(["node"]), "shingles")

    @tidy
    def verified(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                ok.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ok, pa.bool_())], ["a", "b", "ok"])

    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a")
    edges = stored(left.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b").select("a", "b", "x", "y").mapInArrow(verified, "a long, b long, ok boolean"), "links")
    dropped(pairs)
    # Whatever the forests connect, as components; those with a pair that doesn't hold are gone through again, set by set.
    comp = stored(components(edges.select("a", "b")), "near")
    broken = stored(comp.join(edges.where("not ok").select(F.col("a").alias("node")), "node", "left_semi").select("component").distinct(), "broken")

    def again(t: pa.Table) -> pa.Table:
        t = t.sort_by("node")
        node, mates = t.column("node").to_numpy(), t.column("mates").to_pylist()
        known = [(i, int(np.searchsorted(node, b))) for i, own in enumerate(mates) for b in own or ()]
        lab = linked([np.frombuffer(h, np.uint64) for h in t.column("hashes").to_pylist()], known, similarity)
        return pa.table({"node": node, "component": node[lab]})

    mates = edges.where("ok").groupBy(F.col("a").alias("node")).agg(F.collect_list("b").alias("mates"))
    whole = comp.join(broken, "component", "left_semi").join(sets, "node").join(mates, "node", "left")
    mended = stored(whole.groupBy("component").applyInArrow(again, "node long, component long"), "mended")
    for done in (sets, edges):
        dropped(done)
    comp = comp.join(broken, "component", "left_anti").select("node", "component").unionByName(mended)
    named = nodes.join(comp, "node", "left").select("digest", "id", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    known = named.join(least, "component").select("digest", "component_id")
    dealt = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = prints.select("doc_id", "digest").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return salted.join(dealt, ["digest", "salt"]).select("doc_id", "digest", "component_id")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents (five-word shingles, similarity 0.8), the document with the smallest doc_id stays; of rows
    that repeat it, any one.

    Rows without a doc_id can't be named by a component and stay. All columns of docs are kept, whatever their names; an empty table stays empty."""
    found = stored(similar_documents(docs).where("doc_id = component_id").select(F.col("doc_id").alias("kept_id")), "kept")
    again = found.groupBy("kept_id").count().where("count > 1").limit(1).count()
    found = found.unionByName(spark.range(1).select(F.lit(None).cast("long").alias("kept_id")))
    packed = docs.select(F.col("doc_id").cast("long").alias("kept_id"), F.struct(*docs.columns).alias("row"))
    # The hint keeps texts from being sorted, and the plan the same whether ids are few or many.
    out = packed.join(found.distinct().hint("shuffle_hash"), packed["kept_id"].eqNullSafe(found["kept_id"]), "left_semi")
    if again:
        out = out.where("kept_id is not null").dropDuplicates(["kept_id"]).unionByName(out.where("kept_id is null"))
    return out.select("row.*")
