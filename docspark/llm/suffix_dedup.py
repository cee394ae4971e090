"""Suffix-array dedup: repeated strings of 400 bytes, and of 51 words, across and within documents.

The suffixes that matter are those that agree with another over the length asked for. They are found
blockwise, by a difference cover (for bytes of period 307 with 18 residues; every shift is the
difference of exactly one pair):

1. Cover sample. Any two equal strings of 400 bytes hold a pair of equal 94-byte strings that both
   start at cover positions. Only these (6 % of all positions) are named: a name is the hash of the
   94 bytes, and the names of all documents are dealt to suffix buckets by their leading bits. A
   bucket is sorted on its own, neighbours with equal names are repeats. Only starts with a repeated
   name in the 307 positions from them remain; all others are settled.
2. Long ties. The remaining starts lie mostly inside long repeats, where whole runs of suffixes are
   tied. Starts are put into cells: cut points are chosen by the content of 16 bytes, and all starts
   whose 400 bytes hold the same cut points form a cell (with denser cut points, where the 400 bytes
   hold none, as in texts with a short period). A cell has two names: of its core (from the
   first cut point to the last, which each of its strings contains) and of its span (all that its
   strings cover). Cells with equal spans are tied throughout and rank together, without a look at
   single suffixes. A cell whose core is alone has no repeats at all. Only where one core has several
   spans - where copies begin, end or differ - single starts must be compared, and one cell of each
   span takes part.
3. Those starts, and the few without a cut point, are named by their full 400 bytes, and sorted in
   buckets as in 1.

What is kept of the classical construction is the difference-cover sample and the buckets that are
sorted one at a time. What is not: the order of suffixes is that of hashed names, not of their bytes,
and ties are settled by names of cells, not by ranks of the sample (README says why, with figures).

The same rounds run over words (runs of bytes other than ASCII white space) with a cover of period 31:
they find passages of more than 50 words that stand elsewhere too, whatever white space is between
their words. Both levels share the blocks and the shuffles.

Documents travel in blocks of about ``BLOCK_BYTES``, compressed and checkpointed, and are shuffled
once for all rounds; rounds exchange packed arrays of names, one row for a block and a
bucket, and get back one or two bits a name. Every name comes once from each block at most, so
passages with any number of copies cost a bucket one entry a block. Memory holds one block, or the names
of one bucket, whose number grows with the data and of which ``SORTED`` at most are sorted at once.

Names of cover positions have 40 bits besides their bucket's (a chance match only costs time), names
that settle a repeat, of spans and full strings, 96.

Defined cases: null and empty texts have nothing to remove; texts shorter than the length likewise.
Repeated rows are copies of each other, and go whole if they are long enough. Extra columns are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm._common import materialize, n_shuffle

BLOCK_BYTES, BUCKET_TEXT, SORTED = 2 << 20, 1 << 28, 1 << 22
U = np.uint64
M1, M2, M3 = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93), U(0xC2B2AE3D27D4EB4F)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LETTER = np.random.default_rng(1).integers(1, 1 << 63, 256, dtype=np.uint64)


def difference_cover(q: int) -> np.ndarray:
    """A perfect difference set modulo q*q + q + 1 for a prime q: the powers of a generator of the
    cubic extension field (up to scalars) that lie in a plane."""
    v = q * q + q + 1
    for n in range(1, q**3):
        a, b, c = n % q, n // q % q, n // (q * q)
        x, inside = (1, 0, 0), []
        for i in range(v):  # x: coefficients of 1, t, t*t; times t with t**3 = a t*t + b t + c
            if x[2] == 0:
                inside.append(i)
            x = (x[2] * c % q, (x[0] + x[2] * b) % q, (x[1] + x[2] * a) % q)
        if len(inside) == q + 1 and len({(i - j) % v for i in inside for j in inside}) == v:
            return np.array(inside)
    raise ValueError("no difference set")


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = b >> U(32)
    x ^= b
    x *= M2
    x += a * M1
    x ^= x >> U(29)
    return x


def _words(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes at each position as a number; the end is padded."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    return np.ndarray(len(buf), "<u8", padded.data, strides=(1,)).copy()


def _double(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of 2n bytes from hashes of n bytes; the last n positions mean nothing."""
    return _mix(h, np.concatenate([h[n:], h[:n]]))


class Units:
    """The documents of a block as one sequence of units, each with a symbol of 64 bits.

    ``length``: units of a repeated string; ``order``: of the difference cover; ``gram``: units that make a cut
    point; ``cuts``: one in so many positions is one; ``reach``: units that a symbol covers.
    """

    length: int
    order: int
    gram: int
    cuts: tuple[int, ...]
    reach: int

    def __init_subclass__(cls) -> None:
        cls.period = cls.order * cls.order + cls.order + 1
        cls.named = cls.length - cls.period + 1
        cls.in_cover = np.zeros(cls.period, bool)
        cls.in_cover[difference_cover(cls.order)] = True

    def __init__(self, symbols: np.ndarray, sizes: np.ndarray):
        self.symbols = symbols
        self.end = np.cumsum(sizes)
        self.start = self.end - sizes
        self.doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)

    def cover_names(self, p: np.ndarray) -> np.ndarray:
        return self.string_hash(self.sums(1)[0], p, p + self.named)

    def full_names(self, starts: np.ndarray) -> np.ndarray:
        return self.string_hash(self.sums(1)[0], starts, starts + self.length)

    def grams(self) -> np.ndarray:
        """Hashes of ``gram`` units from each position."""
        raise NotImplementedError

    def cover(self) -> tuple[np.ndarray, np.ndarray]:
        """Cover positions where a named string fits into its document, and their names."""
        at = np.arange(len(self.symbols)) - self.start[self.doc]
        at %= self.period
        p = np.flatnonzero(self.in_cover[at])
        p = p[p + self.named <= self.end[self.doc[p]]]
        return p, self.cover_names(p)

    def zone(self, p: np.ndarray) -> np.ndarray:
        """Starts with one of the cover positions ``p`` in the period from them, where a whole string fits."""
        d = self.doc[p]
        return self.ranges(np.maximum(p - self.period + 1, self.start[d]), np.minimum(p, self.end[d] - self.length))

    def ranges(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Sorted positions of the union of ranges, ends included."""
        keep = lo <= hi
        n = len(self.symbols) + 1
        depth = np.cumsum(np.bincount(lo[keep], minlength=n) - np.bincount(hi[keep] + 1, minlength=n)[:n])
        return np.flatnonzero(depth > 0)

    def sums(self, n: int = 2) -> list[tuple]:
        """Sets of prefix sums for hashes of strings of any length, over mixed symbols."""
        w = self.symbols
        out = []
        for k, m in enumerate((M1, M3)[:n]):
            v = (w ^ (w >> U(31))) * (M2 if k else M3)
            v ^= v >> U(29)
            v *= m
            v ^= v >> U(32)
            power, inverse = _powers(m | U(5), len(v))
            out.append((np.concatenate([np.zeros(1, np.uint64), np.cumsum(v * power, dtype=np.uint64)]), inverse))
        return out

    def string_hash(self, sums: tuple, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash of the units from a to b, at least ``reach`` of them."""
        total, inverse = sums
        x = (total[b - self.reach + 1] - total[a]) * inverse[a]
        return _mix(x, (b - a).astype(np.uint64))

    def cells(self, starts: np.ndarray) -> tuple[np.ndarray, ...]:
        """Cells of the starts: first and last start, first and last cut point; and starts without a cut."""
        h = self.grams()
        h = _mix(h, h)
        found = []
        for k, density in enumerate(self.cuts):
            cut = np.flatnonzero((h >> U(40 - 16 * k)) & U(density - 1) == 0)
            cut = cut[cut + self.gram <= self.end[self.doc[cut]]]
            *cells, starts = self._cells_by(cut, starts)
            found.append(cells)
        return (*(np.concatenate(x) for x in zip(*found, strict=True)), starts)

    def _cells_by(self, cut: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
        inner = self.length - self.gram
        f = np.searchsorted(cut, starts)
        z = np.searchsorted(cut, starts + inner, "right") - 1
        bare = starts[f > z]
        one = np.flatnonzero(f <= z)
        if len(one):
            new = np.concatenate([[True], (np.diff(f[one]) != 0) | (np.diff(z[one]) != 0)])
            one = one[new]
        f, z, d = f[one], z[one], self.doc[starts[one]]
        first, last = cut[f], cut[z]
        before = np.concatenate([[-1], cut])[f]
        after = np.concatenate([cut, [len(self.symbols) + self.length]])[z + 1]
        lo = np.maximum(np.maximum(before + 1, last - inner), self.start[d])
        hi = np.minimum(np.minimum(first, after - inner - 1), self.end[d] - self.length)
        return lo, hi, first, last, bare


def _powers(m: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number, and their inverses modulo 2**64."""
    power, inverse = np.full(n, m, np.uint64), np.full(n, U(pow(int(m), -1, 1 << 64)), np.uint64)
    power[:1] = inverse[:1] = 1
    np.cumprod(power, out=power)
    np.cumprod(inverse, out=inverse)
    return power, inverse


class Bytes(Units):
    """Strings of 400 bytes; a symbol is the 8 bytes from its position."""

    length, order, gram, cuts, reach = 400, 17, 16, (64, 16), 8

    def __init__(self, buf: np.ndarray, lengths: np.ndarray):
        super().__init__(_words(buf), lengths)

    def grams(self) -> np.ndarray:
        return _double(self.symbols, 8)

    def _h64(self) -> tuple[np.ndarray, np.ndarray]:
        h32 = _double(self.grams(), 16)
        return _double(h32, 32), h32

    def cover_names(self, p: np.ndarray) -> np.ndarray:
        h64, h32 = self._h64()
        return _mix(h64[p], h32[p + self.named - 32])

    def full_names(self, starts: np.ndarray) -> np.ndarray:
        h64, _ = self._h64()
        name = h64[starts]
        for k in (64, 128, 192, 256, 320, self.length - 64):
            name = _mix(name, h64[starts + k])
        return name


class Words(Units):
    """Passages of 51 words; a symbol is the hash of a word, a run of bytes other than white space."""

    length, order, gram, cuts, reach = 51, 5, 2, (8, 2), 1

    def __init__(self, buf: np.ndarray, lengths: np.ndarray):
        ends = np.cumsum(lengths)
        inner = ~SPACE[buf]
        begins, stops = inner.copy(), inner.copy()
        begins[1:] &= ~inner[:-1]
        stops[:-1] &= ~inner[1:]
        edge = ends[lengths > 0]
        begins[(edge - lengths[lengths > 0])] |= inner[edge - lengths[lengths > 0]]
        stops[edge - 1] |= inner[edge - 1]
        a, z = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        power, inverse = _powers(M1 | U(5), len(buf))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(LETTER[buf] * power, dtype=np.uint64)])
        symbols = _mix((total[z] - total[a]) * inverse[a], (z - a).astype(np.uint64))
        doc = np.searchsorted(ends, a, "right")
        super().__init__(symbols, np.bincount(doc, minlength=len(lengths)))

    def grams(self) -> np.ndarray:
        return _double(self.symbols, 1)


LEVELS = (Bytes, Words)


def _by_bucket(bucket: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(bucket, indexes of its rows, in order)."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    return [(int(bucket[x[0]]), x) for x in np.split(order, cuts) if len(x)]


def _kinds(*columns: np.ndarray) -> np.ndarray:
    """For each row: 0 if an equal one comes before it, 2 if one comes after it only, else 1."""
    order = np.lexsort(columns[::-1])
    out = np.ones(len(order), np.uint8)
    if len(order) > 1:
        equal = np.logical_and.reduce([c[order][1:] == c[order][:-1] for c in columns])
        head = np.concatenate([[False], equal])
        out[order[:-1][equal & ~head[:-1]]] = 2
        out[order[head]] = 0
    return out


def _bits(x: np.ndarray) -> bytes:
    return np.packbits(x).tobytes()


def _unbits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def _pack(*arrays: np.ndarray) -> bytes:
    """Non-negative numbers, each array in the smallest type that holds it."""
    import zstandard

    small = [x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0)) for x in arrays]
    head = np.array([v for x in small for v in (x.itemsize, len(x))], np.int64)
    return zstandard.ZstdCompressor(1).compress(b"".join([bytes([len(small)]), head.tobytes(), *(x.tobytes() for x in small)]))


def _unpack(data: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    head, at, out = np.frombuffer(raw, np.int64, 2 * raw[0], 1).reshape(-1, 2), 1 + 16 * raw[0], []
    for width, size in head.tolist():
        out.append(np.frombuffer(raw, f"u{width}", size, at).astype(np.int64))
        at += width * size
    return out


def _steps(x: np.ndarray) -> np.ndarray:
    """Rising numbers as differences."""
    return np.diff(x, prepend=0)


NAME = np.dtype([("low", "<u4"), ("high", "u1")])
SPAN = np.dtype([("core", "<u8"), ("span", "<u8"), ("more", "<u4")])
STRING = np.dtype([("span", "<u8"), ("more", "<u4")])


class Rounds:
    """What a block sends and does in each round at one level. ``buckets``: number of suffix buckets.

    A block sends each distinct name once, in the order of its first occurrence, and keeps the
    names' buckets; the replies have a bit or two for each, in the same order. Later occurrences
    within the block are repeats without any reply.
    """

    def __init__(self, buckets: int):
        self.buckets = buckets

    def _send(self, rows: np.ndarray, bucket: np.ndarray) -> list[tuple[int, bytes]]:
        return [(b, rows[x].tobytes()) for b, x in _by_bucket(bucket)]

    def _reply(self, bucket: np.ndarray, replies: dict[int, bytes], n_bits: int = 1) -> list[np.ndarray]:
        out = np.zeros((n_bits, len(bucket)), bool)
        for b, x in _by_bucket(bucket):
            out[:, x] = _unbits(replies[b], n_bits * len(x)).reshape(n_bits, -1)
        return list(out)

    def _bucket(self, names: np.ndarray) -> np.ndarray:
        return (names % U(self.buckets)).astype(np.int64)

    def names(self, units: Units, replies: dict[int, bytes]) -> list[tuple[int, bytes]]:
        names = np.unique(units.cover()[1])
        rows = np.empty(len(names), NAME)
        rows["low"], rows["high"] = names >> U(16) & U(0xFFFFFFFF), names >> U(48) & U(0xFF)
        return self._send(rows, self._bucket(names))

    def spans(self, units: Units, replies: dict[int, bytes]) -> list[tuple[int, bytes]]:
        p, names = units.cover()
        distinct, inverse, count = np.unique(names, return_inverse=True, return_counts=True)
        (again,) = self._reply(self._bucket(distinct), replies)
        lo, hi, first, last, bare = units.cells(units.zone(p[(again | (count > 1))[inverse]]))
        if not len(lo) and not len(bare):
            return []
        rows = np.empty(len(lo), SPAN)
        if len(lo):
            one, two = units.sums()
            rows["core"] = units.string_hash(one, first, last + units.gram)
            rows["span"] = _mix(units.string_hash(one, lo, hi + units.length), (first - lo).astype(np.uint64))
            rows["more"] = units.string_hash(two, lo, hi + units.length) >> U(32)
        kind = _kinds(rows["core"], rows["span"], rows["more"])
        bucket = self._bucket(rows["core"][kind > 0])
        order = np.argsort(lo, kind="stable")  # packs best; the first of equal cells stays known by its kind
        place = np.cumsum(kind > 0) - 1
        state = _pack(_steps(lo[order]), (hi - lo)[order], kind[order], place[order][kind[order] > 0], bucket, _steps(bare))
        return [*self._send(rows[kind > 0], bucket), (-1, state)]

    def strings(self, units: Units, replies: dict[int, bytes]) -> list[tuple[int, bytes]]:
        if -1 not in replies:
            return []
        lo, size, kind, place, bucket, bare = _unpack(replies[-1])
        lo, bare = np.cumsum(lo), np.cumsum(bare)
        hi = lo + size
        reply = self._reply(bucket, replies, 2)
        again, single = kind != 1, np.zeros(len(kind), bool)
        again[kind > 0] |= reply[0][place]
        single[kind > 0] = reply[1][place]
        starts = np.union1d(units.ranges(lo[single], hi[single]), bare) if single.any() else bare
        state = [_steps(lo[again]), size[again], _steps(starts)]
        rows = np.empty(len(starts), STRING)
        if len(starts):
            rows["span"], rows["more"] = units.full_names(starts), units.string_hash(units.sums()[1], starts, starts + units.length) >> U(32)
        kind = _kinds(rows["span"], rows["more"])
        bucket = self._bucket(rows["span"][kind > 0])
        return [*self._send(rows[kind > 0], bucket), (-1, _pack(*state, kind, bucket))]

    def removed(self, units: Units, replies: dict[int, bytes]) -> np.ndarray:
        """Mask of the units that go."""
        gone = np.zeros(len(units.symbols), bool)
        if -1 not in replies:
            return gone
        lo, size, starts, kind, bucket = _unpack(replies[-1])
        lo, starts, again = np.cumsum(lo), np.cumsum(starts), kind != 1
        again[kind > 0] |= self._reply(bucket, replies)[0]
        starts = starts[again]
        gone[units.ranges(np.concatenate([lo, starts]), np.concatenate([lo + size, starts]) + units.length - 1)] = True
        return gone


def _sorted_bucket(kind: np.dtype):
    """One bucket: sorts the names that blocks sent; returns each block's bits, in its order.

    More than SORTED names are sorted in parts, by the values of their first column.
    """

    def marks(rows: np.ndarray, owner: np.ndarray) -> list[np.ndarray]:
        columns = [rows[name] for name in kind.names]
        order = np.lexsort([owner, *columns[::-1]])
        new = np.ones(len(rows) + 1, bool)
        new[1:-1] = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in columns])
        again = np.zeros(len(rows), bool)
        again[order] = ~(new[:-1] & new[1:])
        if kind is not SPAN:
            return [again]
        # Cores with several spans: one block of each span compares its starts.
        core = columns[0][order]
        group = np.cumsum(np.concatenate([[True], core[1:] != core[:-1]])) - 1
        several = np.bincount(group, weights=new[:-1]) > 1
        single = np.zeros(len(rows), bool)
        single[order] = new[:-1] & several[group]
        return [again, single]

    def run(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() < 0:
            return table.select(["block", "bucket", "data"])
        blocks, data = table.column("block").to_numpy(), table.column("data").to_pylist()
        sizes = [len(d) // kind.itemsize for d in data]
        rows = np.frombuffer(b"".join(data), kind)
        owner = np.repeat(np.argsort(np.argsort(blocks)), sizes)
        parts = -(-len(rows) // SORTED)
        if parts > 1:
            part = (rows[kind.names[0]].astype(np.uint64) * M1 >> U(40)) % U(parts)
            flags = [np.zeros(len(rows), bool) for _ in range(2 if kind is SPAN else 1)]
            for k in np.unique(part):
                own = np.flatnonzero(part == k)
                for f, m in zip(flags, marks(rows[own], owner[own]), strict=True):
                    f[own] = m
        else:
            flags = marks(rows, owner)
        ends = np.cumsum(sizes)
        out = [_bits(np.concatenate([f[e - n : e] for f in flags])) for e, n in zip(ends, sizes, strict=True)]
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "data": pa.array(out, pa.binary())})

    return run


BLOCK = "block long, ids binary, nulls binary, lengths binary, payload binary"


def _blocks(block_bytes: int):
    """Rows of about ``block_bytes`` of whole documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        number, pack = TaskContext.get().partitionId() << 32, zstandard.ZstdCompressor(1)
        ids, texts, size = [], [], 0

        def row() -> pa.RecordBatch:
            columns = [[number], [np.array([i or 0 for i in ids], np.int64).tobytes()], [np.array([i is None for i in ids]).tobytes()], [np.array([len(t) for t in texts], np.int64).tobytes()], [pack.compress(b"".join(texts))]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), *[pa.binary()] * 4), strict=True)], names=["block", "ids", "nulls", "lengths", "payload"])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                t = t.as_py() or b""
                ids.append(i)
                texts.append(t)
                size += len(t)
                if size >= block_bytes or len(ids) >= 100_000:
                    yield row()
                    number, ids, texts, size = number + 1, [], [], 0
        if ids:
            yield row()

    return run


def _open(lengths: bytes, payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(payload), np.uint8), np.frombuffer(lengths, np.int64)


def _replies(cell) -> list[dict[int, bytes]]:
    """The replies of each level; a level's state is at -1. Level k of n has the buckets k, n + k, 2n + k, …"""
    out: list[dict[int, bytes]] = [{} for _ in LEVELS]
    for r in cell or ():
        b, data = r["bucket"], r["data"]
        if b >= 0:
            out[b % len(LEVELS)][b // len(LEVELS)] = data
            continue
        at = 8 * len(LEVELS)
        for level, size in enumerate(np.frombuffer(data, np.int64, len(LEVELS)).tolist()):
            if size:
                out[level][-1] = data[at : at + size]
            at += size
    return out


def _sent(block: int, each: list[list[tuple[int, bytes]]]) -> list[tuple[int, bytes]]:
    """The rows of a block in a round: names by bucket, and its states, which go through the shuffle on their own."""
    rows = [(b * len(LEVELS) + level, d) for level, sent in enumerate(each) for b, d in sent if b >= 0]
    states = [b"".join(d for b, d in sent if b < 0) for sent in each]
    if any(states):
        rows.append((-1 - block, np.array([len(x) for x in states], np.int64).tobytes() + b"".join(states)))
    return rows


def _runs(x: np.ndarray) -> int:
    return int(x[:1].sum()) + int((x[1:] & ~x[:-1]).sum())


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary, n_passages, n_passage_words) for each row: what stays of its
    bytes, and the passages of more than 50 words in it that stand elsewhere too (maximal runs, and their words)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    blocks = materialize(rows.mapInArrow(_blocks(block_bytes), BLOCK))
    total = blocks.agg(F.sum(F.length("payload"))).first()[0] or 0
    rounds = Rounds(max(2 * n_shuffle(spark), 3 * total // BUCKET_TEXT))

    def send(step):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    block, lengths, payload = (b.column(k)[i].as_py() for k in (0, 3, 4))
                    buf, sizes = _open(lengths, payload)
                    replies = _replies(b.column(5)[i].as_py() if b.num_columns > 5 else None)
                    sent = _sent(block, [step(units(buf, sizes), r) for units, r in zip(LEVELS, replies, strict=True)])
                    yield pa.RecordBatch.from_arrays([pa.array([block] * len(sent), pa.int64()), pa.array([x for x, _ in sent], pa.int64()), pa.array([d for _, d in sent], pa.binary())], names=["block", "bucket", "data"])

        return run

    schema = "block long, bucket long, data binary"

    def with_replies(found: DataFrame) -> DataFrame:
        """All columns of the blocks each time, so that Spark shuffles them once and reuses that."""
        own = F.struct(F.greatest("bucket", F.lit(-1)).alias("bucket"), "data")
        by_block = found.groupBy("block").agg(F.collect_list(own).alias("replies"))
        return blocks.join(by_block.hint("shuffle_hash"), "block", "left").select(*blocks.columns, "replies")

    found = blocks.mapInArrow(send(rounds.names), schema).groupBy("bucket").applyInArrow(_sorted_bucket(NAME), schema)
    found = with_replies(found).mapInArrow(send(rounds.spans), schema).groupBy("bucket").applyInArrow(_sorted_bucket(SPAN), schema)
    found = with_replies(found).mapInArrow(send(rounds.strings), schema).groupBy("bucket").applyInArrow(_sorted_bucket(STRING), schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids, nulls, lengths, payload, replies = (b.column(k)[i].as_py() for k in range(1, 6))
                buf, sizes = _open(lengths, payload)
                masks = []
                for units, r in zip(LEVELS, _replies(replies), strict=True):
                    u = units(buf, sizes)
                    masks.append((rounds.removed(u, r), u.start, u.end))
                (gone, start, end), (again, first, last) = masks
                ids = np.frombuffer(ids, np.int64)
                for lo in range(0, len(ids), 512):
                    out: list[list] = [[] for _ in range(6)]
                    for a, z, c, d in zip(start[lo : lo + 512], end[lo : lo + 512], first[lo : lo + 512], last[lo : lo + 512], strict=True):
                        g, w = gone[a:z], again[c:d]
                        for x, v in zip(out, (z - a, int(g.sum()), _runs(g), buf[a:z][~g].tobytes(), _runs(w), int(w.sum())), strict=True):
                            x.append(v)
                    own = pa.array(ids[lo : lo + 512], mask=np.frombuffer(nulls, bool)[lo : lo + 512])
                    yield pa.RecordBatch.from_arrays([own, *(pa.array(x, pa.binary() if k == 3 else pa.int64()) for k, x in enumerate(out))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "n_passages", "n_passage_words"])

    return with_replies(found).mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, n_passages long, n_passage_words long")


def op1(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    found = suffix_dedup(docs, block_bytes=block_bytes)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passages", "n_passage_words")
