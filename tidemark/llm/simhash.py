"""Near-duplicates by SimHash and pigeonhole blocks.

A document's fingerprint has bit b set if b is set in over half of the XXH64 values of its word shingles. Two
fingerprints link at ``radius`` differing bits or fewer. The 64 bits are split into k blocks; such a pair agrees on all
but ``radius`` blocks, so for every choice of k - radius blocks fingerprints are joined on those bits and verified. k
grows with the number of fingerprints, so that chance agreement stays rare; no choice of k loses a pair.

:func:`drop_near_duplicates` works on longer fingerprints and blocks of them, see there.

Only distinct fingerprints are joined. A block value with many of them is dealt into tiles of at most 2 x ``TILE``
fingerprints, each pair of which meets in some tile, so no task holds an unbounded group; a tile emits a spanning forest
of its links, never all pairs. Components come from alternating large-star and small-star steps over these edges; where rows
meet a value of their key, keys of more than a thousandth of the rows (1,000 at most) are broadcast, so no task gets a hub.

Cases: null and empty texts have fingerprint zero and link like any other; fewer words than a shingle: the whole
sequence; equal fingerprints are one class; repeated rows are rows of one class; an empty table gives no row; very long
texts are whole; other columns pass by unread.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow, chunks, numbered, text_buffer, whole_text, written

#: Fingerprints of one block value that a task compares with each other at once; more are dealt into tiles.
TILE = 4096
#: Bits of two fingerprints' first 128 that may differ in a candidate pair: texts at a Jaccard similarity of 0.8 differ in 18,
#: with a standard deviation of 4; unrelated ones in 64, with one of 6.
FAR = 28
#: Blocks of long fingerprints, and the bits of each that are tried both ways: those nearest to half.
BLOCKS, TRIED = 16, 2
#: Texts of one group that a task compares by their shingles at once.
TEXTS = 512
#: Edges whose components one task finds, in 8 MB and what it sorts them with; of more, rounds over all executors leave fewer.
TOGETHER = 1 << 19
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words(raw: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``; bytes.split() splits at exactly these bytes."""
    return raw.split()


def segments_of(h: np.ndarray, s: int) -> np.ndarray:
    """Hash values of segment ``s``: XXH64 itself for the first, for others a mix of it."""
    if not s:
        return h
    x = h + np.uint64(s * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def shingle_hashes(raw: bytes, shingle: int, seed: int = 42, block: int = 1 << 14) -> Iterator[np.ndarray]:
    """XXH64 values of a UTF-8 text's word shingles, ``block`` at a time; nothing for a text without words."""
    found = words(raw.translate(_LOWER))
    if not found:
        return
    n = max(1, len(found) - shingle + 1)
    joined = b" ".join(found)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    starts = np.cumsum(lengths + 1) - lengths - 1
    ends = (starts + lengths)[min(shingle, len(found)) - 1 :]
    digest = xxhash.xxh64_intdigest
    for a in range(0, n, block):
        yield np.array([digest(joined[x:y], seed) for x, y in zip(starts[a : min(n, a + block)].tolist(), ends[a : min(n, a + block)].tolist(), strict=True)], "<u8")


_PLANES, _LANES = np.arange(8, dtype=np.uint64)[:, None, None], np.uint64(0x0101010101010101)


def bit_counts(raw: bytes, shingle: int, segments: int, seed: int = 42, block: int = 1 << 14) -> tuple[np.ndarray, int]:
    """How many hashes have each bit (segments, 64), and how many there are. Bytes of 64-bit words count up to 255 hashes."""
    counts, n = np.zeros((segments, 64), np.int64), 0
    for h in shingle_hashes(raw, shingle, seed, block):
        planes = (np.stack([segments_of(h, s) for s in range(segments)]) >> _PLANES) & _LANES
        sums = np.add.reduceat(planes, np.arange(0, len(h), 255), axis=2)
        counts += sums.view(np.uint8).reshape(8, segments, -1, 8).sum(2, dtype=np.int64).transpose(1, 2, 0).reshape(segments, 64)
        n += len(h)
    return counts, n


def fingerprint(raw: bytes, shingle: int = 3, segments: int = 1, seed: int = 42, block: int = 1 << 14) -> np.ndarray:
    """The unsigned 64-bit segments of a UTF-8 text's fingerprint, ``block`` shingles at a time."""
    counts, n = bit_counts(raw, shingle, segments, seed, block)
    return np.packbits(2 * counts > n, axis=1, bitorder="little").view("<u8")[:, 0]


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp (the 64-bit fingerprint as a signed long) of rows with doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            raw, offsets = text_buffer(b.column(1))
            data = raw.tobytes()
            found = np.concatenate([fingerprint(data[x:y], shingle) for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.transform(arrow, run, "doc_id long, fp long")


def long_blocks(n: int) -> tuple[int, int]:
    """Bits of a block and number of blocks for n texts: chance pairs of a block stay an eighth of n, and more blocks make
    up for longer ones, so that of the pairs at a Jaccard similarity of 0.8 to 0.85 some 93 in 100 share a tried block."""
    width = min(max(n, 2).bit_length() + 2 + 2 * TRIED, 60)
    return width, max(BLOCKS, -int(-BLOCKS * 1.1325 ** (width - 24) // 1))


def block_keys(counts: np.ndarray, n: int, width: int, blocks: int) -> np.ndarray:
    """The values of each block (blocks, 2 ** TRIED): as it is, and with its TRIED bits nearest to half turned, in every
    combination."""
    odds = (2 * counts.ravel() - n)[: width * blocks].reshape(blocks, width)
    weak = np.argsort(np.abs(odds), axis=1, kind="stable")[:, :TRIED].astype(np.uint64)
    own = ((odds > 0).astype(np.uint64) << np.arange(width, dtype=np.uint64)).sum(1, dtype=np.uint64)
    turned = np.uint64(1) << weak
    return np.stack([np.bitwise_xor.reduce([own, *(turned[:, q] for q in range(TRIED) if turn >> q & 1)]) for turn in range(1 << TRIED)], 1)


def long_fingerprints(docs: DataFrame, shingle: int, width: int, blocks: int) -> DataFrame:
    """row_key, doc_id, node (a hash of the whole fingerprint), fp and more (its first 128 bits as signed longs) and keys (the
    values of its blocks, one block after another) of rows with row_key, doc_id, text."""
    segments, names = max(2, -(-width * blocks // 64)), ["row_key", "doc_id", "node", "fp", "more", "keys"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            raw, offsets = text_buffer(b.column(2))
            data, prints, keys = raw.tobytes(), [], []
            for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                counts, n = bit_counts(data[x:y], shingle, segments)
                own = np.packbits(2 * counts > n, axis=1, bitorder="little")
                prints.append((xxhash.xxh64_intdigest(own.tobytes()), *own[:2].view("<u8")[:, 0].tolist()))
                keys.append(block_keys(counts, n, width, blocks).ravel())
            signed = np.array(prints, np.uint64).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * len(keys[0]), pa.int32()), pa.array(np.concatenate(keys).view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(signed[:, k]) for k in range(3)), lists], names=names)

    rows = docs.select("row_key", F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.transform(arrow, run, "row_key long, doc_id long, node long, fp long, more long, keys array<long>")


def block_masks(n: int, radius: int) -> list[int]:
    """Signed masks of the bits to join on: every choice of k - radius of k blocks, k the least whose choices have log2(n)
    bits or more (radius + 2 at least)."""
    k = radius + 2
    while 64 * (k - radius) // k < min(max(n, 2).bit_length(), 48):
        k += 1
    cuts = [round(64 * i / k) for i in range(k + 1)]
    blocks = [(1 << cuts[i + 1]) - (1 << cuts[i]) for i in range(k)]
    masks = [sum(choice) for choice in combinations(blocks, k - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _forest(left: np.ndarray, right: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """Places of the ends of edges that join each component of the links within ``left`` (right None) or between the two, whose
    places follow those of ``left``: from its first place to each other one, so that blocks which hold much the same texts
    give much the same edges. Fingerprints are rows of 64-bit words."""
    others = left if right is None else right
    shift = 0 if right is None else len(left)
    parent = list(range(shift + len(others)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    rows = max(1, (1 << 20) // max(1, len(others)))
    for a in range(0, len(left), rows):
        apart = sum(np.bitwise_count(left[a : a + rows, None, k] ^ others[None, :, k]).astype(np.uint16) for k in range(left.shape[1]))
        for i, j in zip(*(x.tolist() for x in np.nonzero(apart <= radius)), strict=True):
            if (x := find(a + i)) != (y := find(shift + j)):
                parent[max(x, y)] = min(x, y)
    return [(y, x) for x in range(len(parent)) if (y := find(x)) != x]


def _tile_edges(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by block, key, a, b, side: a tile's rows come together. The last tile of a batch waits for the next."""
        rest = np.zeros((8, 0), np.int64)

        def edges(rows: np.ndarray, cuts: np.ndarray) -> pa.RecordBatch:
            prints, nodes, out = rows[5:7].view(np.uint64).T, rows[7], []
            first, size = cuts[:-1], np.diff(cuts)
            two = first[(size == 2)]
            two = two[(rows[4, two] != rows[4, two + 1]) | (rows[2, two] == rows[3, two])]
            two = two[np.bitwise_count(prints[two] ^ prints[two + 1]).sum(1, dtype=np.int64) <= radius]
            out.append(np.stack([nodes[two], nodes[two + 1]]))
            for x, n in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                own = prints[x : x + n]
                if rows[2, x] == rows[3, x]:
                    found = _forest(own, None, radius)
                else:
                    cut = int(np.searchsorted(rows[4, x : x + n], 1))
                    found = _forest(own[:cut], own[cut:], radius) if 0 < cut < n else []
                out.append(nodes[x + np.array(found, np.int64).reshape(-1, 2).T])
            found = np.concatenate(out, 1)
            return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], names=["u", "v"])

        for b in batches:
            rows = np.concatenate([rest, np.stack([c.to_numpy().astype(np.int64) for c in b.columns])], 1)
            starts = np.flatnonzero(np.concatenate([[True], (rows[:4, 1:] != rows[:4, :-1]).any(0)]))
            yield edges(rows, starts)
            rest = rows[:, starts[-1] :]
        if rest.shape[1]:
            yield edges(rest, np.array([0, rest.shape[1]]))

    return run


def met_links(rows: DataFrame, radius: int, tile: int) -> DataFrame:
    """u, v: edges of which the components are those of all pairs of rows (block int, key long, fp, more, node) that share
    block and key and differ in ``radius`` bits of fp and more, or fewer."""
    sizes = rows.groupBy("block", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = rows.join(sizes, ["block", "key"]).withColumn("parts", F.ceil(F.col("n") / F.lit(tile)).cast("int"))
    met = met.withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.select("block", "key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "fp", "more", "node")
    dealt = met.repartition("block", "key", "a", "b").sortWithinPartitions("block", "key", "a", "b", "side", "node")
    return dealt.transform(arrow, _tile_edges(radius), "u long, v long")


def links(distinct: DataFrame, radius: int = 3, tile: int = TILE) -> DataFrame:
    """u, v: edges of which the components are those of all pairs of ``node``, which are fingerprints, at ``radius`` bits or
    fewer."""
    masks = block_masks(distinct.count(), radius)
    rows = distinct.select("node", F.posexplode(F.array(*(F.lit(m).cast("long") for m in masks))).alias("block", "bits"))
    rows = rows.select("block", F.col("node").bitwiseAND(F.col("bits")).alias("key"), F.col("node").alias("fp"), F.lit(0).cast("long").alias("more"), "node")
    return met_links(rows, radius, tile)


def long_links(distinct: DataFrame, tile: int = TILE) -> DataFrame:
    """u, v: edges of which the components are those of all pairs of ``node`` that share a block's value in ``keys`` and
    differ in FAR of the bits of fp and more, or fewer."""
    rows = distinct.select("node", "fp", "more", F.posexplode("keys").alias("at", "key"))
    return met_links(rows.select(F.shiftright("at", TRIED).alias("block"), "key", "fp", "more", "node"), FAR, tile)


def looked_up(rows: DataFrame, values: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined with ``values`` (key, n: its rows, more columns), each key once. Keys of more than a thousandth of
    ``total`` rows, 1,000 at most, are broadcast, so that no task gets all rows of one."""
    floor = max(256, total // 1000)
    hot = F.broadcast(values.filter(F.col("n") > floor).drop("n"))
    rest = rows.join(hot.select(key), key, "left_anti").join(values.filter(F.col("n") <= floor).drop("n"), key)
    return rows.join(hot, key).unionByName(rest)


def _least_reachable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, root of all edges u, v: each end's root goes to the lesser root, then every node to its root's root."""
    ends = [np.stack([c.to_numpy() for c in b.columns]) for b in batches if b.num_rows]
    if not ends:
        return
    nodes, (u, v) = np.unique(np.concatenate(ends, 1), return_inverse=True)
    root = np.arange(len(nodes))
    while (apart := root[u] != root[v]).any():
        x, y = root[u[apart]], root[v[apart]]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (further := root[root] != root).any():
            root[further] = root[root[further]]
    for a in range(0, len(nodes), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[a : a + (1 << 16)]), pa.array(nodes[root[a : a + (1 << 16)]])], names=["node", "root"])


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """node, root (the component's least node) of every node on an edge: by one task from ``TOGETHER`` edges on down, else by
    alternating large-star and small-star until there are no more than that or nothing changes. Each round is a plan of two dozen
    stages, which the driver compiles and keeps, so few edges get none."""

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def star(e: DataFrame, large: bool, total: int) -> DataFrame:
        near = e.union(e.select("v", "u")) if large else e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = near.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("n"))
        out = looked_up(near, least, "u", total)
        if large:
            out = out.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = out.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        return out.filter("u <> v").distinct()

    current = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    before = state(current)
    for _ in range(most):
        if before[0] <= TOGETHER:
            return arrow(current.coalesce(1), _least_reachable, "node long, root long")
        current = written(star(star(current, True, before[0]), False, before[0]), "stars")
        now = state(current)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components: no fixed point after {most} rounds")
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(current.select("v", "v").distinct())


def rooted(distinct: DataFrame, roots: DataFrame) -> DataFrame:
    """``distinct`` with the root of each node, itself where it has no edge."""
    return distinct.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _similar(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Places of the ends of a spanning forest's edges of all pairs of sets with a Jaccard similarity of ``least`` or more."""
    sizes = np.array([len(x) for x in sets])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    owner, starts = np.repeat(np.arange(len(sets)), sizes), np.cumsum(sizes) - sizes
    held, left, edges = np.zeros(len(ids) + 1, bool), np.ones(len(sets), bool), []
    for first in range(len(sets)):
        reached = [first] if left[first] else []
        left[first] = False
        while reached and left.any():
            x = reached.pop()
            own = ids[starts[x] : starts[x] + sizes[x]]
            held[own] = True
            both = np.bincount(owner, held[ids], len(sets))
            held[own] = False
            close = np.flatnonzero(left & (both >= least * (sizes + sizes[x] - both) - 1e-9))
            left[close] = False
            edges += [(x, y) for y in close.tolist()]
            reached += close.tolist()
    return edges


def similar_edges(texts: DataFrame, shingle: int, least: float, tile: int = TEXTS) -> DataFrame:
    """u, v: edges of which the components are those of all pairs of ``node`` of one ``root`` whose texts have a Jaccard
    similarity of word shingles of ``least`` or more. Each node is one row of texts (root, n nodes, node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by root and tile."""
        nodes, sets, last = [], [], None

        def close() -> pa.RecordBatch:
            found = [(nodes[i], nodes[j]) for i, j in (_similar(sets, least) if len(sets) > 1 else [])]
            return pa.RecordBatch.from_arrays([pa.array([e[k] for e in found], pa.int64()) for k in (0, 1)], names=["u", "v"])

        for b in chunks(batches):
            raw, offsets = text_buffer(b.column(4))
            data = raw.tobytes()
            for place, node, x, y in zip(zip(*(b.column(k).to_pylist() for k in range(3)), strict=True), b.column(3).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                if place != last:
                    yield close()
                    nodes, sets, last = [], [], place
                nodes.append(node)
                sets.append(np.unique(np.concatenate([np.zeros(0, "<u8"), *shingle_hashes(data[x:y], shingle)])))
        yield close()

    met = texts.withColumn("parts", F.ceil(F.col("n") / F.lit(tile)).cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    met = met.select("root", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"), "node", "text")
    met = met.select("root", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "node", whole_text().alias("text"))
    return met.repartition("root", "a", "b").sortWithinPartitions("root", "a", "b").transform(arrow, run, "u long, v long")


def near_groups(docs: DataFrame, radius: int = 3, shingle: int = 3, tile: int = TILE) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long), component_id (the smallest doc_id reachable) of every row."""
    rows = written(fingerprints(docs, shingle).withColumnRenamed("fp", "node"), "fingerprints")
    distinct = written(rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct")
    total = rows.count()
    found = written(rooted(distinct, components(links(distinct.select("node"), radius, tile))), "rooted")
    least = found.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    of_node = looked_up(found.select("node", "root", F.col("n").alias("rows")), least, "root", total)
    out = looked_up(rows, of_node.select("node", "component_id", F.col("rows").alias("n")), "node", total)
    return out.select("doc_id", F.col("node").alias("fp"), "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group, the one of the smallest doc_id (null last), with all its columns.

    Texts with a Jaccard similarity of 0.8 of their word shingles differ in about a seventh of the bits of a fingerprint, far
    more than three of 64. So fingerprints are longer here and cut into blocks by :func:`long_blocks`; a block's value is taken
    as it is and with its two bits nearest to half turned, since those are the ones that change between near copies. Texts that
    share a block's value and differ in FAR of 128 bits or fewer are candidates; within each component of candidates all pairs
    of texts are compared by their sets of shingles, and groups are the components of the pairs at ``least`` or more.

    Blocks find a pair by chance, and the number of blocks keeps that chance: by measurement 0.93 for pairs at a similarity of
    0.8 to 0.85, 0.99 at 0.85 to 0.9, 1 beyond. What they miss is the limit of this stage; pairs that they propose in error
    are compared and left alone. Rows of equal fingerprints are one text. ``docs`` is written once, unless it is a bare scan,
    so that its rows have fixed keys.

    Cases: as for the module; ties go by the smallest row key; a null doc_id stays only where no other is in its group."""
    names = docs.columns
    of = {n.lower(): f"c{k}" for k, n in enumerate(names)}
    keyed = numbered(docs, "near-rows")
    rows = keyed.select("row_key", F.col(of["doc_id"]).alias("doc_id"), F.col(of["text"]).alias("text"))
    total = rows.count()
    rows = written(long_fingerprints(rows, shingle, *long_blocks(total)), "fingerprints")
    distinct = written(rows.groupBy("node").agg(F.min("row_key").alias("row_key"), *(F.first(c).alias(c) for c in ("fp", "more", "keys"))), "distinct")
    texts = written(distinct.select("node", "row_key").join(components(long_links(distinct)), "node"), "candidates")
    crowds = texts.groupBy("root").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    texts = looked_up(texts, crowds.withColumn("size", F.col("n")), "root", total).select("root", F.col("size").alias("n"), "node", "row_key")
    texts = texts.join(keyed.select("row_key", F.col(of["text"]).alias("text")), "row_key").select("root", "n", "node", "text")
    roots = components(similar_edges(texts, shingle, least))
    found = rooted(rows.select("row_key", "doc_id", "node"), roots)
    keep = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("best")).select(F.col("best.row_key").alias("row_key"))
    return keyed.join(keep, "row_key", "left_semi").select(*of.values()).toDF(*names)
