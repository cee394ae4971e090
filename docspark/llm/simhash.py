"""SimHash near-duplicates: pigeonhole blocks, verified Hamming links, connected components.

* Fingerprint. A text is read as UTF-8, A-Z are lower-cased, words are runs of bytes other than
  ASCII white space. Each window of three words (repeats included) is joined by spaces and hashed
  by XXH64 with seed 42; a bit of the fingerprint is 1 if it is set in over half the hashes. With
  one or two words the whole sequence is the only window; without words the fingerprint is 0.
* Links. The 64 bits are cut into five blocks. Fingerprints that differ in at most two bits agree
  on at least three blocks, so each distinct fingerprint is dealt to its ten triples of blocks, and
  within a bucket the Hamming distance decides. Equal fingerprints are one class beforehand, so
  copies never meet as pairs, and a bucket gives a spanning forest of its links, not all pairs.
* Components. Alternating large-star and small-star rounds over the forest edges, each round
  checkpointed.

Defined cases: null and empty texts have fingerprint 0 and link like any other. Rows with a null id
get a fingerprint and take part as a document without a number: they take the component of the
smallest id they reach, and null if there is none. A repeated id is one document with several
texts: each row keeps its own fingerprint, and links made by any of them hold for the id's row only
through that fingerprint. Other columns of the input are ignored. An empty table gives no rows.

The pipeline's stage links sets of five-word shingles of a Jaccard similarity of 0.8 or more by the same
steps: SimHash fingerprints (of the distinct shingles, and wider), blocks of their bits, the Hamming
distance within a bucket, then an exact check of the sets, and components (``jaccard_components``).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm._common import broadcast_if_small, fresh, materialize

MAX_BITS = 2
N_BLOCKS = 5
#: Ids that go are broadcast up to this number (8 bytes each), and joined by shuffle beyond.
BROADCAST_ROWS = 500_000
#: The pipeline's stage: five-word shingles, Jaccard similarity 0.8.
STAGE_WORDS, STAGE_SIMILARITY = 5, 0.8
#: Its blocks are so wide that about BUCKET documents agree in one by chance, and so many that a pair of just that
#: similarity agrees in none with a probability of MISS; the bits that may differ leave out such a pair with the same one.
BUCKET, MISS = 4096, 2e-6
#: Words of 64 bits by which the Hamming distance decides.
DISTANCE_WORDS = 3
#: Sets of up to so many shingles are dealt to more blocks: there a bit is tied more often, and one shingle turns it.
FEW = 32
#: In buckets of more than BUCKET fingerprints those within CLOSE bits of one looked at are not compared with each other.
CLOSE = 16
#: Buckets up to this size are compared pair by pair in numpy; larger ones by probing.
PAIRWISE = 2048
#: A side of a tile of exact comparisons holds so many sets, or bytes of them; hashes that more than FEW_PAIRS
#: pairs of a tile share are counted by matrices of TILE_COLUMNS columns.
TILE_ROWS, TILE_BYTES, TILE_COLUMNS, FEW_PAIRS = 1024, 4 << 20, 2048, 16


def fingerprint(text: bytes, n_words: int = 3) -> int:
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    h64 = xxhash.xxh64_intdigest
    if len(words) < n_words:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(n_words)), strict=False))
    h = np.fromiter((h64(g, 42) for g in grams), np.uint64)
    lanes, starts = np.uint64(0x0101010101010101), np.arange(0, len(h), 255)
    out = 0
    for j in range(8):  # eight byte lanes at once; a lane counts at most 255 before it is widened
        sums = np.add.reduceat((h >> np.uint64(j)) & lanes, starts).view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
        for lane in np.flatnonzero(2 * sums > len(h)):
            out |= 1 << (8 * int(lane) + j)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long) for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t or b"") for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "id long, fp long")


def _masks(n_blocks: int, max_bits: int) -> list[int]:
    edges = [round(64 * k / n_blocks) for k in range(n_blocks + 1)]
    blocks = [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(blocks, n_blocks - max_bits)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _links(fp: np.ndarray, free: int, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within ``max_bits``, of fingerprints that agree outside the bits of ``free``."""
    m = len(fp)
    if m <= PAIRWISE:
        left, right = [], []
        for at in range(0, m, 256):
            i, j = np.nonzero(np.bitwise_count(fp[at : at + 256, None] ^ fp[None, :]) <= max_bits)
            keep = i + at < j
            left.append(i[keep] + at)
            right.append(j[keep])
        return np.concatenate(left), np.concatenate(right)
    order = np.argsort(fp)
    sorted_fp, bits = fp[order], [np.uint64(1 << b) for b in range(64) if free >> b & 1]
    flips = [x for k in range(1, max_bits + 1) for x in (np.bitwise_or.reduce(c) for c in combinations(bits, k))]
    left, right = [], []
    for flip in flips:
        probe = sorted_fp ^ flip
        at = np.minimum(np.searchsorted(sorted_fp, probe), m - 1)
        i = np.flatnonzero((sorted_fp[at] == probe) & (sorted_fp < probe))
        left.append(order[i])
        right.append(order[at[i]])
    return np.concatenate(left), np.concatenate(right)


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index of each index's component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _bucket_edges(masks: list[int], max_bits: int):
    def edges(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        c, key, fp, node = (table.column(k).to_numpy() for k in range(4))
        fp = fp.view(np.uint64)
        cut = np.flatnonzero((c[1:] != c[:-1]) | (key[1:] != key[:-1])) + 1
        lo, hi = np.concatenate([[0], cut]), np.concatenate([cut, [len(c)]])
        size = hi - lo
        i, j = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        two = lo[size == 2]
        two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= max_bits]
        i.append(two)
        j.append(two + 1)
        for a, z in zip(lo[size > 2], hi[size > 2], strict=True):
            x, y = _links(fp[a:z], ~masks[c[a]] & (1 << 64) - 1, max_bits)
            root = _forest(z - a, x, y)
            y = np.flatnonzero(root != np.arange(z - a))
            i.append(root[y] + a)
            j.append(y + a)
        return node[np.concatenate(i)], node[np.concatenate(j)]

    return _by_bucket(edges, lambda b: [b.column(0).to_numpy(), b.column(1).to_numpy()])


def _by_bucket(edges: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]], bucket: Callable[[pa.RecordBatch], list[np.ndarray]]):
    """The edges (u, v) of whole buckets; ``bucket`` gives the columns that name a row's bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows come sorted by bucket; the last bucket of a batch waits for the next batch."""
        wait: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            names = bucket(b)
            n = int(np.argmax(np.logical_and.reduce([x == x[-1] for x in names])))
            if n == 0 and wait and [x[0] for x in bucket(wait[0])] == [x[-1] for x in names]:
                wait.append(b)
                continue
            done = pa.Table.from_batches([*wait, b.slice(0, n)])
            wait = [b.slice(n)]
            if done.num_rows:
                u, v = edges(done)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
        if wait:
            u, v = edges(pa.Table.from_batches(wait))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return run


def near_links(classes: DataFrame, max_bits: int = MAX_BITS, n_blocks: int = N_BLOCKS) -> DataFrame:
    """(u, v) edges that connect exactly the classes (node, fp) that links connect."""
    masks = _masks(n_blocks, max_bits)
    keys = F.explode(F.array(*(F.struct(F.lit(k).alias("c"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(masks))))
    dealt = classes.select("fp", "node", keys.alias("k")).select("k.c", "k.key", "fp", "node")
    return dealt.repartition("c", "key").sortWithinPartitions("c", "key").mapInArrow(_bucket_edges(masks, max_bits), "u long, v long").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of the edges (u, v); root is the smallest node of its component.

    Each round replaces the edges by a large-star and a small-star step and is checkpointed, until every edge points
    from a node to its root: no node with an edge of its own has a second one, or is pointed to. This is asked of
    the edges themselves, so no round is spent on it; the driver plans each round anew, so rounds are kept few and short.
    """
    e = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    turned = F.struct(F.col("v").alias("u"), F.col("u").alias("v"))
    for k in range(max_rounds + 1):
        ends = e.select(F.inline(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("own")), F.struct(F.col("v").alias("node"), F.lit(0).alias("own")))))
        if not ends.groupBy("node").agg(F.sum("own").alias("own"), F.count("*").alias("n")).where("own > 0 and n > 1").count():
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        if k == max_rounds:
            break
        low = e.select(F.inline(F.array(F.struct("u", "v"), turned))).groupBy("u").agg(F.min("v").alias("m"))
        large = e.join(low.select(F.col("u").alias("v"), F.least("u", "m").alias("m")), "v").select("u", F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))))
        e = materialize(small.where("u <> v").distinct())
    raise RuntimeError(f"components not stable after {max_rounds} rounds")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, fp, component (smallest id that links reach)."""
    rows = materialize(fingerprints(docs, id_col, text_col))
    # A class without an id needs a node of its own: a number below all ids, by its fingerprint.
    classes = materialize(rows.groupBy("fp").agg(F.min("id").alias("id"), F.count("*").alias("n")))
    nodes = classes.where("id is not null").select("fp", F.col("id").alias("node"))
    lonely = classes.where("id is null").select("fp")
    if lonely.isEmpty():
        roots = connected_components(near_links(nodes))
        known = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component"))
    else:
        # With null ids, nodes are the fingerprints, and each component's smallest id is looked up.
        by_fp = classes.select("fp", F.col("fp").alias("node"))
        roots = connected_components(near_links(by_fp))
        labelled = classes.join(roots, classes.fp == roots.node, "left").select("fp", "id", F.coalesce("root", "fp").alias("root"))
        known = labelled.join(labelled.groupBy("root").agg(F.min("id").alias("component")), "root").select("fp", "component")
    return rows.join(known, "fp", "left").select("id", "fp", "component")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id.

    Rows with a null id link to others but are kept: nothing names them. Of rows that repeat an id,
    one stays.
    """
    return _one_each(docs, simhash_components(docs, id_col, text_col), id_col)


def _one_each(docs: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """``docs`` without the ids of ``found`` that are not the smallest of their component."""
    (gone,) = fresh(docs, "gone")
    removed = found.where("component <> id").select(F.col("id").alias(gone)).distinct()
    removed = broadcast_if_small(removed, BROADCAST_ROWS)
    kept = docs.join(removed, F.col(id_col).cast("long") == F.col(gone), "left_anti")
    repeats = found.where("id is not null").groupBy("id").count().where("count > 1")
    if repeats.isEmpty():
        return kept
    return kept.where(F.col(id_col).isNotNull()).dropDuplicates([id_col]).unionByName(kept.where(F.col(id_col).isNull()))


def shingles(text: bytes, n_words: int) -> np.ndarray:
    """Distinct hashes of the windows of ``n_words`` words, sorted; words and short texts as in ``fingerprint``."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    grams = [b" ".join(words)] if len(words) < n_words else map(b" ".join, zip(*(words[k:] for k in range(n_words)), strict=False))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), np.uint64))


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in parts of few rows, so that what is made of a part stays small."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def _node(sh: np.ndarray) -> int:
    """The class of equal shingle sets."""
    import xxhash

    return _signed(xxhash.xxh64_intdigest(sh.tobytes(), 7))


class Blocks(NamedTuple):
    """Width of a block in bits; then for sets of over ``FEW`` shingles, and of fewer: the number of blocks, and the bits
    that may differ of all that are sent and of their first 64."""

    width: int
    count: tuple[int, int]
    bits: tuple[int, int]
    first: tuple[int, int]

    def words(self, few: bool) -> int:
        return max(DISTANCE_WORDS, -(-self.count[few] * self.width // 64))


@lru_cache
def _flip(similarity: float, few: bool) -> float:
    """The largest probability that a bit of the fingerprints of two sets of ``similarity`` or more differs; in sets of over
    ``FEW`` shingles, or of ``few``. Bits of a hash are taken as independent: sums of binomials for small sets, the
    angle between large ones."""

    def above(n: int, c: int) -> np.ndarray:
        """For each number of votes of ``c`` shared shingles the probability of a 1 with ``n`` more."""
        p = np.array([math.comb(n, k) for k in range(n + 1)]) / 2.0**n
        return np.array([p[max(0, (c + n) // 2 + 1 - k) :].sum() for k in range(c + 1)])

    worst = 0.0 if few else math.acos(2 * similarity / (1 + similarity)) / math.pi
    for c in range(1, FEW + 1 if few else 2 * FEW):
        shared = np.array([math.comb(c, k) for k in range(c + 1)]) / 2.0**c
        most = int(c / similarity + 1e-9) - c
        ones = [above(n, c) for n in range(most + 1)]
        for x in range(most + 1):
            for y in range(x, most - x + 1):
                if (c + y <= FEW) == few:
                    worst = max(worst, float((shared * (ones[x] * (1 - ones[y]) + ones[y] * (1 - ones[x]))).sum()))
    return worst


def _blocks(n: int, similarity: float) -> Blocks:
    """The blocks for ``n`` documents: twice as many documents make them one bit wider, and about a sixth more."""
    width = max(3, math.ceil(math.log2(max(n, 1) / BUCKET)))

    def most(bits: int, flip: float) -> int:
        left = 0.0
        for r in range(bits, -1, -1):
            left += math.comb(bits, r) * flip**r * (1 - flip) ** (bits - r)
            if left > MISS:
                return r
        return 0

    flips = [_flip(similarity, few) for few in (False, True)]
    count = tuple(math.ceil(math.log(MISS) / math.log1p(-((1 - x) ** width))) if x else 1 for x in flips)
    return Blocks(width, count, tuple(most(64 * DISTANCE_WORDS, x) for x in flips), tuple(most(64, x) for x in flips))


def wide_fingerprints(sets: list[np.ndarray], words: int) -> np.ndarray:
    """SimHash fingerprints of ``64 * words`` bits, one row a set of distinct hashes (none empty).

    A bit is 1 if it is set in over half the hashes. The first word takes the hashes as they are, each other
    word mixes them anew; so a wider fingerprint begins with the narrower one.
    """
    out = np.zeros((len(sets), words), np.uint64)
    if not len(sets):
        return out
    h, n = np.concatenate(sets), np.array([len(x) for x in sets])
    ends, runs = np.cumsum(n), -(-n // 255)  # a lane of eight bits counts at most 255
    first = np.cumsum(runs) - runs
    cuts = np.repeat(ends - n, runs) + 255 * (np.arange(runs.sum()) - np.repeat(first, runs))
    lanes, shifts = np.uint64(0x0101010101010101), np.arange(0, 64, 8, dtype=np.uint64)
    for w in range(words):
        z = h
        if w:
            z = (h ^ np.uint64(w * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            z ^= z >> np.uint64(30)
        for j in range(8):
            sums = np.add.reduceat((z >> np.uint64(j)) & lanes, cuts).view(np.uint8).reshape(-1, 8)
            ones = 2 * np.add.reduceat(sums, first, axis=0, dtype=np.int64) > n[:, None]
            out[:, w] |= np.bitwise_or.reduce(ones.astype(np.uint64) << (shifts + np.uint64(j)), axis=1)
    return out


def _near_roots(fp: np.ndarray, size: np.ndarray, blocks: Blocks, similarity: float) -> np.ndarray:
    """Smallest index of each fingerprint's group; rows are sorted by size. All pairs whose distance and sizes fit are in one group.

    Where many fingerprints lie close to one (large groups of near copies), those within ``CLOSE`` bits of it are
    joined to all that lie within their reach, by the triangle inequality, and not looked at again. The
    others are compared pair by pair, each with those of its size up to the ratio that the similarity allows.
    """
    m, rest = len(fp), np.arange(len(fp))
    left, right = [], []
    if m > BUCKET:
        rng, failed = np.random.default_rng(m), 0
        while failed < 16 and len(rest) > BUCKET:
            at = rest[rng.integers(len(rest))]
            far = np.bitwise_count(fp[rest] ^ fp[at]).sum(axis=1, dtype=np.int64)
            close = far <= CLOSE
            if 32 * close.sum() < len(rest):
                failed += 1
                continue
            failed, near = 0, rest[far <= max(blocks.bits) + int(far[close].max())]
            left.append(np.full(len(near), at))
            right.append(near)
            rest = rest[~close]
    own, sizes = fp[rest], size[rest]
    head = np.ascontiguousarray(own[:, 0])
    ends = np.searchsorted(sizes, np.floor(sizes / similarity + 1e-9), side="right")
    for lo in range(0, len(rest), 128):
        hi = min(lo + 128, len(rest))
        few = bool(sizes[lo] <= FEW)
        for at in range(lo, int(ends[hi - 1]), 4096):
            to = min(at + 4096, int(ends[hi - 1]))
            i, j = np.nonzero(np.bitwise_count(head[lo:hi, None] ^ head[None, at:to]) <= blocks.first[few])
            i, j = i + lo, j + at
            i, j = i[i < j], j[i < j]
            fit = np.bitwise_count(own[i] ^ own[j]).sum(axis=1, dtype=np.int64) <= blocks.bits[few]
            left.append(rest[i[fit]])
            right.append(rest[j[fit]])
            if sum(map(len, left)) > 1 << 20:
                root = _forest(m, np.concatenate(left), np.concatenate(right))
                left, right = [root], [np.arange(m)]
    none = np.empty(0, np.int64)
    return _forest(m, np.concatenate([none, *left]), np.concatenate([none, *right]))


def _centre(fp: np.ndarray) -> int:
    """The fingerprint next to the most frequent bits (of some thousand, where there are more)."""
    if len(fp) < 3:
        return 0
    some = np.ascontiguousarray(fp[:: -(-len(fp) // 4096)])
    common = np.packbits(2 * np.unpackbits(some.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64) > len(some)).view(np.uint64)
    return int(np.bitwise_count(fp ^ common).sum(axis=1, dtype=np.int64).argmin())


def _near_groups(blocks: Blocks, similarity: float):
    """Of rows (at, node, words of the fingerprint) sorted by ``at``, the bucket and the size: an edge from the
    centre of each group of ``_near_roots`` in a bucket to each other member."""

    def edges(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        at, node, *words = (c.to_numpy() for c in table.columns)
        bucket, size, fp = at >> 32, at & 0xFFFFFFFF, np.stack([w.view(np.uint64) for w in words], axis=1)
        cut = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
        u, v = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for a, z in zip(np.concatenate([[0], cut]), np.concatenate([cut, [len(at)]]), strict=True):
            if z - a < 2:
                continue
            root = _near_roots(fp[a:z], size[a:z], blocks, similarity)
            order = np.argsort(root, kind="stable")
            starts = np.flatnonzero(np.concatenate([[True], np.diff(root[order]) != 0]))
            for lo, hi in zip(starts, np.append(starts[1:], len(order)), strict=True):
                if hi - lo > 1:
                    group = order[lo:hi] + a
                    centre = _centre(fp[group])
                    u.append(np.full(hi - lo - 1, node[group[centre]]))
                    v.append(node[np.delete(group, centre)])
        return np.concatenate(u), np.concatenate(v)

    return _by_bucket(edges, lambda b: [b.column(0).to_numpy() >> 32])


def _dealt(classes: DataFrame, blocks: Blocks) -> DataFrame:
    """(at, node, words of the fingerprint): a row for each block of each class (node, size, fp)."""
    names = [f"w{k}" for k in range(DISTANCE_WORDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches, 1024):
            node, size, fp = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_pylist()
            for few in (False, True):
                rows = np.flatnonzero((size <= FEW) == few)
                if not len(rows):
                    continue
                n = blocks.count[few]
                words = np.frombuffer(b"".join(fp[k] for k in rows), np.uint64).reshape(len(rows), -1)
                bits = np.unpackbits(words.view(np.uint8), axis=1)[:, : n * blocks.width]
                values = bits.reshape(len(rows), n, blocks.width) @ (1 << np.arange(blocks.width))
                at = (((np.arange(n) << blocks.width) | values) << 32) | size[rows, None]
                sent = [pa.array(np.repeat(words[:, k].view(np.int64), n)) for k in range(DISTANCE_WORDS)]
                yield pa.RecordBatch.from_arrays([pa.array(at.ravel()), pa.array(np.repeat(node[rows], n)), *sent], names=["at", "node", *names])

    return classes.mapInArrow(run, "at long, node long, " + ", ".join(f"{x} long" for x in names))


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose shingle sets have a Jaccard similarity of ``similarity`` or more, exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches):
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield b.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(sets.select(F.col("node").alias("u"), F.col("sh").alias("x")), "u").join(sets.select(F.col("node").alias("v"), F.col("sh").alias("y")), "v")
    return joined.select("u", "v", "x", "y").mapInArrow(run, "u long, v long")


def _similar(left: list[np.ndarray], right: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of sets with a Jaccard similarity of ``similarity`` or more, exactly.

    Hashes on both sides are counted: those that few pairs share pair by pair, the others as products of
    0/1 matrices, some columns at a time.
    """
    n, m = (np.array([len(x) for x in xs], np.int64) for xs in (left, right))
    both = np.zeros((len(n), len(m)), np.float64)
    grams, inverse = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    rows, columns = np.repeat(np.arange(len(n)), n), np.repeat(np.arange(len(m)), m)
    in_left, in_right = inverse[: len(rows)], inverse[len(rows) :]
    n_left, n_right = np.bincount(in_left, minlength=len(grams)), np.bincount(in_right, minlength=len(grams))
    few = (n_left * n_right > 0) & (n_left * n_right <= FEW_PAIRS)
    order = np.argsort(in_right, kind="stable")
    first = np.searchsorted(in_right[order], in_left)
    own = np.flatnonzero(few[in_left])
    times = n_right[in_left[own]]
    at = np.repeat(first[own] - (np.cumsum(times) - times), times) + np.arange(times.sum())
    np.add.at(both, (np.repeat(rows[own], times), columns[order][at]), 1)
    many = np.flatnonzero(n_left * n_right > FEW_PAIRS)
    place = np.full(len(grams), -1)
    for lo in range(0, len(many), TILE_COLUMNS):
        now = many[lo : lo + TILE_COLUMNS]
        place[now] = np.arange(len(now))
        sides = []
        for count, row, gram in ((len(n), rows, in_left), (len(m), columns, in_right)):
            one, hit = np.zeros((count, len(now)), np.float32), place[gram] >= 0
            one[row[hit], place[gram[hit]]] = 1
            sides.append(one)
        both += sides[0] @ sides[1].T
        place[now] = -1
    return np.nonzero(both >= similarity * (n[:, None] + m[None, :] - both))


def _rest_links(placed: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (u, v) that join the components left apart: of ``placed`` (key, node, root), groups of several.

    Such groups that share nodes form a region. Its largest component is its core, all other nodes are its
    rest. The rest is compared with itself and with the core, exactly, in tiles of at most ``TILE_ROWS`` sets
    or ``TILE_BYTES`` a side (one set at least): a node is sent once a tile, so a pair costs no row and a tile
    gives a spanning forest of its links, however many they are. The core is never compared with itself.
    """
    edges = placed.join(placed.groupBy("key").agg(F.min("node").alias("low")), "key").select(F.col("low").alias("u"), F.col("node").alias("v"))
    region = connected_components(edges.distinct()).select("node", F.col("root").alias("region"))
    # The smallest node of a region has no row of its own among the components.
    nodes = placed.select("node", "root").distinct().join(region, "node", "left").withColumn("region", F.coalesce("region", "node")).join(sets.select("node", F.octet_length("sh").cast("long").alias("size")), "node")
    nodes = materialize(nodes)
    parts = nodes.groupBy("region", "root").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    regions = parts.groupBy("region").agg(F.max(F.struct("n", "size", "root")).alias("core"), F.sum("n").alias("n"), F.sum("size").alias("size"))
    tiles = lambda n, size: F.greatest(F.ceil(n / TILE_ROWS), F.ceil(size / TILE_BYTES)).cast("long")
    regions = regions.select("region", F.col("core.root").alias("core"), tiles(F.col("core.n"), F.col("core.size")).alias("cores"), tiles(F.col("n") - F.col("core.n"), F.col("size") - F.col("core.size")).alias("rests"))
    own = nodes.join(regions, "region").where("rests > 0").withColumn("is_core", F.col("root") == F.col("core"))
    own = own.withColumn("tile", F.pmod(F.xxhash64("node", F.lit(11)), F.when(F.col("is_core"), F.col("cores")).otherwise(F.col("rests"))))
    to = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    place = lambda core, a, b, left: F.struct(F.lit(core).alias("with_core"), a.alias("a"), b.alias("b"), left.alias("in_left"))
    of_core = F.transform(to(F.col("rests")), lambda k: place(True, k, F.col("tile"), F.lit(False)))
    of_rest = F.concat(F.transform(to(F.col("cores")), lambda k: place(True, F.col("tile"), k, F.lit(True))), F.transform(to(F.col("rests")), lambda k: place(False, F.least(k, F.col("tile")), F.greatest(k, F.col("tile")), F.col("tile") <= k)))
    dealt = own.select("node", "root", "region", F.explode(F.when(F.col("is_core"), of_core).otherwise(of_rest)).alias("t")).select("node", "root", "region", "t.*").join(sets, "node")

    def links(table: pa.Table) -> pa.Table:
        root, node, side = (table.column(x).to_numpy() for x in ("root", "node", "in_left"))
        own = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("sh")]
        left = np.flatnonzero(side)
        right = np.flatnonzero(~side) if (~side).any() else left
        u, v = np.empty(0, np.int64), np.empty(0, np.int64)
        if len(left):
            i, j = _similar([own[k] for k in left], [own[k] for k in right], similarity)
            apart = root[left[i]] != root[right[j]]
            forest = _forest(len(own), left[i[apart]], right[j[apart]])
            v = np.flatnonzero(forest != np.arange(len(own)))
            u = forest[v]
        return pa.table({"u": node[u], "v": node[v]})

    return dealt.groupBy("region", "with_core", "a", "b").applyInArrow(links, "u long, v long")


def jaccard_components(docs: DataFrame, id_col: str, text_col: str, n_words: int = STAGE_WORDS, similarity: float = STAGE_SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: id, component (smallest id reached by links of ``similarity`` or more).

    Equal shingle sets are one class. The SimHash fingerprint of each class is cut into blocks, and it is dealt
    to the bucket of each. Within a bucket the Hamming distance decides who are candidates: they form groups.
    First each member is compared with the centre of its group, which joins most of a large group by as many
    pairs as it has members. Classes whose groups still hold several components are then compared exactly, in
    tiles (``_rest_links``). No bucket is cut.
    """
    blocks = _blocks(docs.count(), similarity)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches):
            sets = [shingles(t or b"", n_words) for t in b.column(1).to_pylist()]
            size, fp = np.array([len(s) for s in sets], np.int64), [b""] * len(sets)
            for few, rows in ((False, np.flatnonzero(size > FEW)), (True, np.flatnonzero((size > 0) & (size <= FEW)))):
                for k, x in zip(rows, wide_fingerprints([sets[k] for k in rows], blocks.words(few)), strict=True):
                    fp[k] = x.tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_node(s) for s in sets], pa.int64()), pa.array(size), pa.array(fp, pa.binary())], names=["id", "node", "size", "fp"])

    def with_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches):
            sets = [shingles(t or b"", n_words) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "sh"])

    text = F.col(text_col).cast("binary").alias("text")
    found = materialize(docs.select(F.col(id_col).cast("long").alias("id"), text).mapInArrow(keyed, "id long, node long, size long, fp binary"))
    classes = found.where("size > 0").groupBy("node").agg(F.first("size").alias("size"), F.first("fp").alias("fp"))
    dealt = _dealt(classes, blocks).repartition(F.shiftright("at", 32)).sortWithinPartitions("at")
    groups = materialize(dealt.mapInArrow(_near_groups(blocks, similarity), "u long, v long").distinct())
    shared = groups.select(F.col("u").alias("key"), F.col("v").alias("node")).unionByName(groups.select(F.col("u").alias("key"), F.col("u").alias("node")).distinct())
    nodes = shared.select("node").distinct()
    # The texts of one row of each class in question are read again; a class may have rows without an id only.
    wanted = found.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("id").alias("wanted"))
    wanted = broadcast_if_small(wanted.where("wanted is not null").select("wanted").distinct(), BROADCAST_ROWS)
    own = docs.select(F.col(id_col).cast("long").alias("id"), text)
    again = own.where("id is not null").join(wanted, F.col("id") == F.col("wanted"), "left_semi").unionByName(own.where("id is null")).select("text")
    sets = again.mapInArrow(with_set, "node long, sh binary").join(nodes, "node", "left_semi")
    sets = materialize(sets.groupBy("node").agg(F.first("sh").alias("sh")))
    links = materialize(_verified(groups, sets, similarity))
    roots = connected_components(links)
    placed = shared.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("z")).where("a <> z").select("key")
    apart = materialize(placed.join(mixed, "key"))
    if not apart.isEmpty():
        # The roots found stand for the links they were found from.
        known = roots.select(F.col("node").alias("u"), F.col("root").alias("v"))
        roots = connected_components(known.unionByName(_rest_links(apart, sets, similarity)))
    classes = found.groupBy("node").agg(F.min("id").alias("id")).join(roots, "node", "left").select("node", "id", F.coalesce("root", "node").alias("root"))
    least = classes.groupBy("root").agg(F.min("id").alias("component"))
    return found.select("id", "node").join(classes.select("node", "root").join(least, "root"), "node").select("id", "component")


def jaccard_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component of ``jaccard_components``; ids as in ``simhash_dedup``."""
    return _one_each(docs, materialize(jaccard_components(docs, id_col, text_col)), id_col)


def op7(docs: DataFrame) -> DataFrame:
    found = simhash_components(docs)
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
