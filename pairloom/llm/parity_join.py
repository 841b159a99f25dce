"""Near-duplicate classes by an exact Jaccard join over word shingles, found through parity sketches.

A document's distinct shingles are hashed to bit positions, and a sketch keeps the parity of each: two sketches differ
in at most as many bits as their sets differ in shingles. Sets of Jaccard at least t differ in at most
(|A|+|B|)(1-t)/(1+t) shingles, so within a band of sizes a sketch cut into more blocks than that has a block on which
both agree. Bands are so wide that partners are in the same or in adjacent ones; a document also enters the next band.

A block is wide: a shingle flips one of 2^64 bits of its block, and what is kept of a block is the XOR of hashes of the
bits that are set, which tells equal blocks from others as the bits would. Narrow blocks would not do: of those with few bits set,
many of strangers are equal by chance, and the more the larger the corpus.

Empty blocks say nothing and would gather strangers. Each sketch has spare blocks for them: while a document has
no more empty blocks than spares, one of the others must agree, so empty blocks stay out; a document with more of them
keys its empty blocks too, and can miss only a partner that is short of empty blocks, whom it meets elsewhere.

Keys travel packed: a task sorts what it has by key range and sends one row for each range, with eleven bytes for a key
and the low bits of its set's signature (a clash of low bits costs a candidate and changes no result). Buckets of the
same members are one bucket, and large ones are cut into slices of ``TILE`` that meet two by two. There check sketches
leave the candidates, of which a tile passes on a spanning forest. A large group of near copies shares hundreds of buckets; so
at first each set takes part in one bucket alone, the first by a hash, and afterwards only buckets count whose members are
not yet in one component. The components of all candidates hold every link; the texts of each component's sets meet in tiles
of bounded size, every pair of different texts is verified, and only sums and spanning links are
written. So links and classes are exact, and pairs are never written out.

Defined cases: null, empty or blank text has no shingle and links with nothing; a text of fewer words than a shingle is
one shingle; rows that repeat a doc_id with the same text are one document, with other texts they are documents each;
rows without a doc_id belong to the class of an equal text that has one, or else to none; an empty table gives an
empty result; other columns are not read. Shingles are held by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import Workspace, maybe_broadcast, mix64, shingle_hashes, sliced, texts, tidied
from pairloom.llm.components import connected_components

SHINGLE_WORDS, THRESHOLD = 5, (8, 10)
TILE, SMALL = 1000, 48
LINK_TILE, LINK_SHINGLES, _COLUMNS = 1000, 1_000_000, 4096
PART_CHARS, RANGES, FLUSH_KEYS = 8 << 20, 4, 1 << 18
_SEEN = 1 << 18
_KEY_BYTES, _NODE_BYTES = 6, 5
_NODE = (1 << 8 * _NODE_BYTES) - 1
_FOUND = "doc_id long, text_id long, n_shingles long, sig long, check binary, bucket long, slice int, slices int, members array<long>"


@lru_cache(maxsize=8)
def bands(p: int, q: int) -> list[int]:
    """Lower ends of the size bands: a partner of a set in band k is in band k-1 or k."""
    ends = [1, 2]
    while ends[-1] < 1 << 40:
        ends.append(max(ends[-1] + 1, ((ends[-1] - 1) * q) // p + 1))
    return ends


@lru_cache(maxsize=4096)
def layout(k: int, p: int, q: int) -> tuple[int, int]:
    """(blocks, spares) of band k's sketch; no blocks where only equal sets reach the threshold."""
    ends = bands(p, q)
    most = 2 * (ends[k + 1] - 1) * (q - p) // (q + p)
    if not most:
        return 0, 0
    least, spare = ends[max(0, k - 1)], 1
    for _ in range(20):  # the empty blocks to be expected depend on the blocks, which depend on them
        blocks = most + 1 + spare
        empty = blocks * math.exp(-least / blocks)
        spare = min(most + 1, 1 + math.ceil(empty + 1.5 * math.sqrt(empty)))
    return most + 1 + spare, spare


def sketch_keys(hashes: np.ndarray, p: int, q: int) -> np.ndarray:
    """The block keys of a set of shingle hashes, for its own band and the next."""
    n, out = len(hashes), [np.empty(0, np.uint64)]
    own = int(np.searchsorted(np.array(bands(p, q)), n, side="right")) - 1
    for k in (own, own + 1):
        blocks, spare = layout(k, p, q)
        if not blocks:
            continue
        bits = mix64(hashes + np.uint64(k))
        block = (bits % np.uint64(blocks)).astype(np.int64)
        by = np.argsort(block, kind="stable")
        first = np.flatnonzero(np.diff(block[by], prepend=-1))
        parity = np.zeros(blocks, np.uint64)
        parity[block[by][first]] = np.bitwise_xor.reduceat(mix64(bits[by] ^ np.uint64(0x5851F42D4C957F2D)), first)
        keys = mix64(mix64(np.arange(blocks, dtype=np.uint64) + np.uint64(k << 32)) + parity)
        some = np.zeros(blocks, bool)
        some[block] = True
        out.append(keys if blocks - some.sum() > spare else keys[some])
    return np.concatenate(out)


def check_sketch(hashes: np.ndarray, p: int, q: int) -> bytes:
    """A parity sketch over a power of two of bits, at least six times the bits in which a partner may differ."""
    most = 2 * len(hashes) * (q - p) // (q + p)
    bits = max(64, 1 << max(0, 6 * most - 1).bit_length())
    spots = (mix64(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(spots, minlength=bits).astype(np.uint8) & 1).tobytes()


def folded(sketch: bytes, width: int) -> bytes:
    """The sketch over fewer bits: positions are taken modulo a power of two, so parts are XORed."""
    if len(sketch) == width:
        return sketch
    return np.bitwise_xor.reduce(np.frombuffer(sketch, np.uint8).reshape(-1, width), axis=0).tobytes()


def forest(sizes: list[int], sketches: list[bytes], sides: list[bool], comps: list[int], p: int, q: int) -> list[tuple[int, int]]:
    """Pairs of places that span all candidates among a tile's members: of sizes and sketches that allow the threshold, and of
    different components. In a tile of two slices only pairs across them count."""
    m, width, two = len(sizes), min(map(len, sketches)), len(set(sides)) > 1
    place: dict[int, int] = {}
    parent, out = [place.setdefault(c, i) for i, c in enumerate(comps)], []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def join(i: int, j: int) -> None:
        a, b = root(i), root(j)
        if a != b:
            parent[b] = a
            out.append((i, j))

    rows = [folded(x, width) for x in sketches]
    if m <= SMALL:
        bits = [int.from_bytes(x, "little") for x in rows]
        for i in range(m - 1):
            for j in range(i + 1, m):
                a, b = sizes[i], sizes[j]
                if comps[i] != comps[j] and (a * q >= b * p if a < b else b * q >= a * p) and not (two and sides[i] == sides[j]) and (bits[i] ^ bits[j]).bit_count() * (q + p) <= (a + b) * (q - p):
                    join(i, j)
        return out
    n, side, comp, bits = np.array(sizes), np.array(sides), np.array(comps), np.frombuffer(b"".join(rows), np.uint64).reshape(m, -1)
    for i in range(m - 1):
        j = np.arange(i + 1, m)
        ok = (comp[j] != comp[i]) & (q * np.minimum(n[j], n[i]) >= p * np.maximum(n[j], n[i]))
        if two:
            ok &= side[j] != side[i]
        j = j[ok]
        apart = np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1, dtype=np.int64)
        for x in j[apart * (q + p) <= (n[j] + n[i]) * (q - p)].tolist():
            join(i, x)
    return out


def signature(hashes: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes()))))


def _routed(docs: DataFrame, ranges: int, n: int, p: int, q: int) -> DataFrame:
    """A row for each document (doc_id, text_id, n_shingles, sig, check), and rows of packed keys for each key range; a task
    gives the keys of each set once."""

    def packed(keys: list[np.ndarray], nodes: list[int]) -> pa.RecordBatch:
        node = np.repeat(np.array(nodes, np.uint64), [len(k) for k in keys])
        key = np.concatenate(keys)
        route = ((key >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
        by = np.argsort(route)
        route = route[by]
        kb = key[by].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_KEY_BYTES]
        nb = node[by].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_NODE_BYTES]
        there = np.flatnonzero(np.concatenate([[True], route[1:] != route[:-1]]))
        ends = [*there[1:].tolist(), len(route)]
        blobs = [kb[a:z].tobytes() + nb[a:z].tobytes() for a, z in zip(there.tolist(), ends, strict=True)]
        none = pa.nulls(len(blobs), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(route[there]), none, none, none, none, pa.nulls(len(blobs), pa.binary()), pa.array(blobs, pa.binary())], names)

    names = ["route", "doc_id", "text_id", "n_shingles", "sig", "check", "keys"]
    flush = min(4 * FLUSH_KEYS, max(FLUSH_KEYS, 64 * ranges))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        keys, nodes, held, at = [], [], 0, TaskContext.get().partitionId() * 7919
        for b in sliced(batches, 500):
            sizes, sigs, checks, routes = [], [], [], []
            for t in texts(b):
                h = shingle_hashes(t, n)
                sizes.append(len(h))
                routes.append((at := at + 1) % ranges)
                if not len(h):
                    sigs.append(None)
                    checks.append(None)
                    continue
                sigs.append(s := signature(h))
                if s in seen:
                    checks.append(None)
                    continue
                if len(seen) >= _SEEN:
                    seen.clear()
                seen.add(s)
                checks.append(check_sketch(h, p, q))
                k = sketch_keys(h, p, q)
                if len(k):
                    keys.append(k)
                    nodes.append(s & _NODE)
                    held += len(k)
                if held > flush:
                    yield packed(keys, nodes)
                    keys, nodes, held = [], [], 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(routes, pa.int64()), b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(sigs, pa.int64()), pa.array(checks, pa.binary()), pa.nulls(b.num_rows, pa.binary())], names
            )
        if held:
            yield packed(keys, nodes)

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(tidied(run), "route long, doc_id long, text_id long, n_shingles long, sig long, check binary, keys binary")


def buckets(keys: np.ndarray, nodes: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct nodes of each key that at least two have."""
    by = np.argsort(keys, kind="stable")
    keys, nodes = keys[by], nodes[by]
    same = keys[1:] == keys[:-1]
    several = np.zeros(len(keys), bool)
    several[1:] |= same
    several[:-1] |= same
    keys, nodes = keys[several], nodes[several]
    by = np.lexsort((nodes, keys))
    keys, nodes = keys[by], nodes[by]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
    keys, nodes = keys[fresh], nodes[fresh]
    cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]) if len(keys) else np.zeros(1, np.int64)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix64(nodes + np.uint64(77)))])
    lengths = np.diff(cuts)
    whole = mix64(sums[cuts[1:]] - sums[cuts[:-1]] + lengths.astype(np.uint64)) if len(lengths) else np.empty(0, np.uint64)
    _, first = np.unique(whole, return_index=True)
    for i in first[lengths[first] > 1].tolist():
        yield int(whole[i].astype(np.int64)), nodes[cuts[i] : cuts[i + 1]].astype(np.int64)


def _met(tile: int):
    """Document rows pass; the packed keys of a range become buckets, each set of members once, in slices of at most ``tile``."""
    names = ["doc_id", "text_id", "n_shingles", "sig", "check", "bucket", "slice", "slices", "members"]
    wide = _KEY_BYTES + _NODE_BYTES

    def listed(out: tuple[list, list, list, list]) -> pa.RecordBatch:
        k = len(out[0])
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in out[3]])]).astype(np.int32)
        members = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(out[3])))
        none = pa.nulls(k, pa.int64())
        return pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(k, pa.binary()), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()), members], names)

    def met(blobs: list[bytes], seen: set[int]) -> Iterator[pa.RecordBatch]:
        many = [len(x) // wide for x in blobs]
        keys, nodes = np.zeros((sum(many), 8), np.uint8), np.zeros((sum(many), 8), np.uint8)
        row = 0
        for x, m in zip(blobs, many, strict=True):
            raw = np.frombuffer(x, np.uint8)
            keys[row : row + m, :_KEY_BYTES] = raw[: m * _KEY_BYTES].reshape(m, _KEY_BYTES)
            nodes[row : row + m, :_NODE_BYTES] = raw[m * _KEY_BYTES :].reshape(m, _NODE_BYTES)
            row += m
        out: tuple[list, list, list, list] = ([], [], [], [])
        for bucket, members in buckets(keys.view("<u8").ravel(), nodes.view("<u8").ravel()):
            if bucket in seen:
                continue
            if len(seen) >= _SEEN:
                seen.clear()
            seen.add(bucket)
            slices = -(-len(members) // tile)
            for s in range(slices):
                for column, x in zip(out, (bucket, s, slices, members[s * tile : (s + 1) * tile]), strict=True):
                    column.append(x)
            if len(out[0]) >= 20_000:
                yield listed(out)
                out = ([], [], [], [])
        if out[0]:
            yield listed(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, blobs, seen = None, [], set()
        for b in batches:
            own = b.filter(b.column(6).is_null())
            if k := own.num_rows:
                yield pa.RecordBatch.from_arrays([*own.columns[1:6], pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.list_(pa.int64()))], names)
            keyed = b.filter(b.column(6).is_valid())
            for route, x in zip(keyed.column(0).to_pylist(), keyed.column(6).to_pylist(), strict=True):
                if route != at:
                    if blobs:
                        yield from met(blobs, seen)
                    blobs, at = [], route
                blobs.append(x)
        if blobs:
            yield from met(blobs, seen)

    return run


def _tiles(dealt: DataFrame, mine: str, blocks: str, *keep: str) -> DataFrame:
    """Each row once for each of the tiles (i, j) in which its block meets another or itself; side tells the two apart."""
    pairs = F.transform(F.sequence(F.lit(0), F.col(blocks) - 1), lambda j: F.struct(F.least(F.col(mine), j).alias("i"), F.greatest(F.col(mine), j).alias("j")))
    spread = dealt.select(*keep, mine, F.explode(pairs).alias("t"))
    return spread.select(*keep, F.col("t.i").alias("i"), F.col("t.j").alias("j"), (F.col(mine) == F.col("t.i")).alias("side"))


def _candidates(members: DataFrame, facts: DataFrame, p: int, q: int) -> DataFrame:
    """Pairs (a, b) of signatures that span the candidates of different components, of members (bucket, slice, slices, sig, comp)."""
    spread = _tiles(members, "slice", "slices", "bucket", "sig", "comp").join(facts.select("sig", "n", "check"), "sig").select("bucket", "i", "j", "side", "sig", "comp", "n", "check")
    spread = spread.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "sig")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        at = None

        def done() -> list[tuple[int, int]]:
            if len(held) < 2:
                return []
            sigs, comps, n, check, side = zip(*held, strict=True)
            return [(sigs[i], sigs[j]) for i, j in forest(n, check, side if at[1] != at[2] else [True] * len(n), comps, p, q)]

        for b in batches:
            found: list[tuple[int, int]] = []
            for bucket, i, j, side, sig, comp, n, check in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (bucket, i, j) != at:
                    found += done()
                    held, at = [], (bucket, i, j)
                held.append((sig, comp, n, check, side))
            if found:
                a, z = zip(*set(found), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64())], ["a", "b"])
        if last := done():
            a, z = zip(*last, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64())], ["a", "b"])

    return spread.mapInArrow(tidied(run), "a long, b long")


def _groups(lists: DataFrame, facts: DataFrame, work: Workspace, p: int, q: int) -> DataFrame:
    """node (a signature), component of all that a candidate touches."""
    rows = lists.select("bucket", "slice", "slices", F.explode("members").alias("node")).join(facts.select("node", "sig"), "node")
    members = work.table(rows.select("bucket", "slice", "slices", "sig"))
    home = members.groupBy("sig").agg(F.min(F.struct(F.xxhash64("bucket").alias("h"), "bucket")).alias("home")).select("home.bucket").distinct()
    first = connected_components(_candidates(members.join(home, "bucket", "left_semi").withColumn("comp", F.col("sig")), facts, p, q), work)
    known = members.join(first.withColumnRenamed("node", "sig"), "sig", "left").withColumn("comp", F.coalesce("component", "sig")).drop("component")
    mixed = known.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("bucket")
    more = work.table(_candidates(known.join(mixed, "bucket", "left_semi"), facts, p, q))
    ends = [first.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "ab"]
    between = more.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    second = connected_components(between, work)
    moved = first.join(second.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    groups = work.table(moved.unionByName(second.join(first.select("node"), "node", "left_anti")))
    work.drop(members, first, more, second)
    return groups


def tally(sets: list[np.ndarray], copies: np.ndarray, sides: np.ndarray, p: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """For each set the copies of the others that it links with, and the first place of those that links connect it with;
    in a tile of two blocks only links across them count."""
    m, n = len(sets), np.array([len(x) for x in sets], np.float32)
    if m == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        near = q * both >= p * (len(sets[0]) + len(sets[1]) - both) and not (sides.any() and not sides.all() and sides[0] == sides[1])
        return (copies[::-1] if near else np.zeros(2, np.int64)), np.array([0, 0 if near else 1])
    owner = np.repeat(np.arange(m), n.astype(np.int64))
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = count[place] > 1
    column, owner = (np.cumsum(count > 1) - 1)[place[often]], owner[often]
    by = np.argsort(column, kind="stable")
    column, owner = column[by], owner[by]
    both, wide = np.zeros((m, m), np.float32), int((count > 1).sum())
    for c in range(0, wide, _COLUMNS):
        a, b = np.searchsorted(column, (c, c + _COLUMNS))
        part = np.zeros((m, min(_COLUMNS, wide - c)), np.float32)
        part[owner[a:b], column[a:b] - c] = 1
        both += part @ part.T
    near = np.empty((m, m), bool)
    for i in range(m):  # whole numbers below 2^24 in all terms, so float32 is exact; larger sets go by float64
        row = both[i].astype(np.float64)
        near[i] = (p + q) * row >= p * (np.float64(n[i]) + n.astype(np.float64))
    np.fill_diagonal(near, False)
    if sides.any() and not sides.all():
        near &= sides[:, None] != sides[None, :]
    root = np.full(m, -1)
    for i in range(m):
        if root[i] < 0:
            edge = np.array([i])
            while len(edge):
                root[edge] = i
                edge = np.flatnonzero(near[edge].any(axis=0) & (root < 0))
    return near @ copies, root


def _verified(docs: DataFrame, each: DataFrame, groups: DataFrame, work: Workspace, n: int, p: int, q: int) -> DataFrame:
    """sig, near, root: for each tile of a group of candidates and each of its texts, the documents of other texts there that it
    links with, and a text of the tile that links connect it with. Every pair of different texts of a group meets in a tile."""
    member = each.filter("id is not null").join(groups.select(F.col("node").alias("sig"), "component"), "sig")
    per = member.groupBy("component").agg(F.count("*").alias("members"), F.sum("n").alias("shingles")).filter("members > 1")
    per = per.select("component", F.ceil(F.greatest(F.col("members") / LINK_TILE, F.col("shingles") / LINK_SHINGLES)).cast("int").alias("blocks"))
    dealt = member.join(per, "component").withColumn("mine", F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int"))
    routes = work.table(_tiles(dealt, "mine", "blocks", "id", "sig", "copies", "component"))
    source = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).filter("id is not null")
    spread = source.join(maybe_broadcast(routes, routes.count(), 64), "id").select("component", "i", "j", "side", "sig", "copies", "text")
    spread = spread.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        at = None
        out: tuple[list[int], list[int], list[int]] = ([], [], [])

        def done() -> None:
            if len(held) < 2:
                return
            sigs = list(held)
            h, copies, side = zip(*held.values(), strict=True)
            near, root = tally(list(h), np.array(copies, np.int64), np.array(side) if at[1] != at[2] else np.zeros(len(held), bool), p, q)
            out[0].extend(sigs)
            out[1].extend(near.tolist())
            out[2].extend(sigs[r] for r in root.tolist())

        for b in sliced(batches, 500):
            for component, i, j, side, sig, copies, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (component, i, j) != at:
                    done()
                    held, at = {}, (component, i, j)
                h = shingle_hashes(text, n)
                if len(h) and signature(h) == sig:  # rows may repeat an id with another text
                    held[sig] = (h, copies, side)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["sig", "near", "root"])
                out = ([], [], [])
        done()
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["sig", "near", "root"])

    return work.table(spread.mapInArrow(tidied(run), "sig long, near long, root long"))


def _joined(docs: DataFrame, n: int, p: int, q: int) -> tuple[Workspace, DataFrame, DataFrame]:
    """The workspace, the documents' rows (doc_id, text_id, n_shingles, sig), and sig, label, component_id, n_links."""
    work = Workspace(docs.sparkSession)
    chars = docs.agg(F.sum(F.length(F.col("text").cast("string")))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-chars // PART_CHARS))
    routed = _routed(docs, RANGES * parts, n, p, q).repartition(parts, "route").sortWithinPartitions("route")
    found = work.table(routed.mapInArrow(tidied(_met(TILE)), _FOUND))
    rows = found.filter("bucket is null").select("doc_id", "text_id", "n_shingles", "sig")
    lists = found.filter("bucket is not null").select("bucket", "slice", "slices", "members").dropDuplicates(["bucket", "slice"])
    alone = F.countDistinct("doc_id") + F.max(F.col("doc_id").isNull().cast("long"))
    sets = found.filter("sig is not null").groupBy("sig")
    each = work.table(sets.agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("check", True).alias("check"), alone.alias("copies")))
    facts = each.select(F.pmod("sig", F.lit(_NODE + 1)).alias("node"), "sig", "n", "check")
    groups = _groups(lists, facts, work, p, q)
    seen = _verified(docs, each, groups, work, n, p, q)
    near = seen.groupBy("sig").agg(F.sum("near").alias("near"))
    labels = connected_components(seen.filter("sig <> root").select(F.col("sig").alias("a"), F.col("root").alias("b")), work)
    full = each.join(labels.withColumnRenamed("node", "sig"), "sig", "left").join(near, "sig", "left")
    full = work.table(full.select("sig", "id", F.coalesce("component", "sig").alias("label"), (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links")))
    least = full.groupBy("label").agg(F.min("id").alias("component_id"))
    result = work.table(full.join(least, "label").select("sig", "label", "component_id", "n_links"))
    work.drop(each, groups, seen, labels, full)
    return work, rows, result


def linked(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links of every row: its class, and with how many other documents its text links."""
    _, rows, full = _joined(docs, shingle_words, *threshold)
    out = rows.join(maybe_broadcast(full, full.count(), 64), "sig", "left")
    mine = F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", mine.alias("component_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def classes(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; the threshold is a fraction p / q."""
    return linked(docs, shingle_words, threshold).drop("n_links")


def one_of_each(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """The documents, all columns kept, without those that another of their class stands for: the one of the smallest id
    (null last), then of the smallest hash of the text. A document that is there several times stays once."""
    work, rows, full = _joined(docs, shingle_words, *threshold)
    same = rows.select("doc_id", "text_id", "sig").distinct().filter("sig is not null").join(full.select("sig", "label"), "sig")
    first = same.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "text_id")).alias("stays"))
    gone = same.join(first, "label").filter(~(F.col("doc_id").eqNullSafe(F.col("stays.doc_id")) & (F.col("text_id") == F.col("stays.text_id"))))
    gone = work.table(gone.select("doc_id", "text_id"))
    text_id = F.xxhash64(F.col("text").cast("string")).alias("text_id")
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_id, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))

    def met(other: DataFrame, how: str) -> DataFrame:
        other = other.select(F.col("doc_id").alias("its_id"), F.col("text_id").alias("its_text"))
        return held.join(maybe_broadcast(other, other.count(), 32), F.col("doc_id").eqNullSafe(F.col("its_id")) & (F.col("text_id") == F.col("its_text")), how)

    twice = work.table(rows.groupBy("doc_id", "text_id").count().filter("count > 1").select("doc_id", "text_id"))
    held = met(gone, "left_anti")
    if not twice.isEmpty():
        held = met(twice, "left_anti").unionByName(met(twice, "left_semi").dropDuplicates(["doc_id", "text_id"]))
    return held.select("row.*")
