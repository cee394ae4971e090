"""Media columns: any bytes as a baseline JPEG, and DC-only thumbnails of baseline JPEGs.

Coding. Every 192 payload bytes are one MCU of three 8x8 blocks (no subsampling, quantisers all 1);
a byte less 32 is one quantised coefficient, the unit in which baseline JPEG is lossless. The image
is nearly square, MCUs without payload are zero. Every MCU is a restart interval of its own, so
scans are coded and decoded as thousands of independent intervals side by side in numpy, and a lost
interval costs 192 bytes. The payload's length stands in a comment segment.

Decoding. Markers are parsed (SOF0, DHT, DQT, DRI, SOS, COM); any Huffman tables, zero runs,
sampling factors and restart intervals of baseline files are read. The thumbnail takes the
luminance DC of each block; its feature string holds the dimensions and an 8x8 average hash.

Bounds: documents are coded in groups of about ``GROUP_MCUS`` MCUs and intervals decoded in lots of
as many; a longer document is coded piece by piece. Defined cases: null text is empty, and an empty
text has a payload of 192 spaces. Repeated rows have equal values. An empty table gives no rows.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT, OFFSET, GROUP_MCUS, LOT = 192, 32, 3_000, 10_000
EOB, ZRL = 0x00, 0xF0


def _code_lengths(weights: dict[int, float]) -> dict[int, int]:
    """Huffman lengths; a symbol of least weight holds the all-ones code, which JPEG forbids, and is left out."""
    heap = [(w, s, (s,)) for s, w in weights.items()] + [(0.0, -1, (-1,))]
    heapq.heapify(heap)
    length = dict.fromkeys([*weights, -1], 0)
    while len(heap) > 1:
        (w1, s1, a), (w2, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        for s in (*a, *b):
            length[s] += 1
        heapq.heappush(heap, (w1 + w2, s1, (*a, *b)))
    length.pop(-1)
    return length


def _table(length: dict[int, int]) -> tuple[bytes, dict[int, tuple[int, int]]]:
    """DHT body (16 counts, symbols) and {symbol: (code, length)} of the canonical code."""
    order = sorted(length, key=lambda s: (length[s], s))
    counts = bytes(sum(x == n for x in length.values()) for n in range(1, 17))
    codes, code, last = {}, 0, 0
    for s in order:
        code <<= length[s] - last
        codes[s], last = (code, length[s]), length[s]
        code += 1
    return counts + bytes(order), codes


def _weights() -> tuple[dict[int, float], dict[int, float]]:
    """By rule: letters less 32 have 7 bits, runs of zeros (spaces) are mostly single, the rest is rare."""
    by_size = {7: 1.0, 4: 0.06, 5: 0.06, 6: 0.12, 8: 0.05}
    ac = {run << 4 | size: max(by_size.get(size, 0.01) * 0.25**run, 2e-4) for run in range(16) for size in range(1, 11)}
    dc = {size: by_size.get(size, 0.01) for size in range(12)}
    return dc, ac | {EOB: 0.03, ZRL: 2e-4}


DC_BODY, DC_CODES = _table(_code_lengths(_weights()[0]))
AC_BODY, AC_CODES = _table(_code_lengths(_weights()[1]))


def _by_byte(codes: dict[int, tuple[int, int]], runs: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for a payload byte behind a run of zeros, at run << 8 | byte."""
    value, length = np.zeros(runs << 8, np.int32), np.zeros(runs << 8, np.uint8)
    for run in range(runs):
        for byte in range(256):
            x = byte - OFFSET
            size = abs(x).bit_length()
            code, n = codes.get(run << 4 | size, (0, 0))
            value[run << 8 | byte] = code << size | (x if x >= 0 else x + (1 << size) - 1)
            length[run << 8 | byte] = n + size
    return value, length


DC_VALUE, DC_LENGTH = _by_byte(DC_CODES, 1)
AC_VALUE, AC_LENGTH = _by_byte(AC_CODES, 16)


def _scan(payload: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of MCUs (rows of 192 payload bytes), restart markers before all but those in
    which ``first`` is -1; and where each MCU's bytes (its marker included) start.

    ``first``: for each MCU the number of its restart marker, or -1.
    """
    n = len(payload)
    c = payload.reshape(-1, 64)
    val, length = np.zeros((len(c), 65), np.int32), np.zeros((len(c), 65), np.uint8)
    val[:, 0], length[:, 0] = DC_VALUE[c[:, 0]], DC_LENGTH[c[:, 0]]
    flat = np.flatnonzero(c != OFFSET)
    k = flat & 63
    flat, k = flat[k > 0], k[k > 0]
    b = flat >> 6
    prev = np.zeros(len(k), np.int64)
    prev[1:] = np.where(b[1:] == b[:-1], k[:-1], 0)
    run = k - prev - 1
    long_run = np.flatnonzero(run >= 16)
    for j in (1, 2, 3):  # a run of 16 zeros or more takes the places of its zeros
        far = long_run[run[long_run] >= 16 * j]
        val[b[far], prev[far] + 16 * j], length[b[far], prev[far] + 16 * j] = AC_CODES[ZRL]
    symbol = (run & 15) << 8 | c.ravel()[flat]
    at = flat + b
    val.ravel()[at], length.ravel()[at] = AC_VALUE[symbol], AC_LENGTH[symbol]
    open_end = c[:, 63] == OFFSET
    val[open_end, 64], length[open_end, 64] = AC_CODES[EOB]

    used = np.flatnonzero(length)
    val, tokens = val.ravel()[used].astype(np.uint64), length.ravel()[used].astype(np.int64)
    end = np.cumsum(tokens)
    last = np.searchsorted(used, np.arange(1, n + 1) * 195) - 1  # of each MCU's tokens
    bits = np.diff(end[last], prepend=0)
    n_bytes = -(-bits // 8)
    start = np.concatenate([[0], np.cumsum(n_bytes)])
    lag = np.cumsum(8 * n_bytes - bits) - (8 * n_bytes - bits)
    at = end - tokens + np.repeat(lag, np.diff(last, prepend=-1))
    word = at >> 5
    wide = val << (64 - (at & 31) - tokens).astype(np.uint64)
    total = int(start[-1])
    size_words = total // 4 + 2
    words = np.bincount(word, (wide >> np.uint64(32)).astype(float), size_words) + np.bincount(word + 1, (wide & np.uint64(0xFFFFFFFF)).astype(float), size_words)
    raw = words.astype(">u4").view(np.uint8)[:total].copy()
    raw[start[1:] - 1] |= ((1 << (8 * n_bytes - bits)) - 1).astype(np.uint8)

    full = raw == 0xFF
    marked = 2 * np.cumsum(first >= 0)
    pos = np.arange(total) + np.cumsum(full) - full + np.repeat(marked, n_bytes)
    out = np.zeros(total + int(full.sum()) + int(marked[-1]), np.uint8)
    out[pos] = raw
    begin = pos[start[:-1]]
    m = first >= 0
    out[begin[m] - 2], out[begin[m] - 1] = 0xFF, 0xD0 + first[m] % 8
    return out, np.concatenate([begin - 2 * m, [len(out)]])


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _shape(n_mcus: int) -> tuple[int, int]:
    cols = max(1, int(np.ceil(np.sqrt(n_mcus))))
    return cols, -(-n_mcus // cols)


def _head(n_payload: int, cols: int, rows: int) -> bytes:
    sof = struct.pack(">BHHB", 8, 8 * rows, 8 * cols, 3) + bytes(x for c in (1, 2, 3) for x in (c, 0x11, 0))
    return b"\xff\xd8" + _segment(0xFE, b"payload %d" % n_payload) + _segment(0xDB, bytes([0] + [1] * 64)) + _segment(0xC0, sof) + _segment(0xC4, b"\x00" + DC_BODY) + _segment(0xC4, b"\x10" + AC_BODY) + _segment(0xDD, b"\x00\x01") + _segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]))


def padded(text: bytes) -> bytes:
    return text.ljust(max(UNIT, -(-len(text) // UNIT) * UNIT), b" ")


def encode(payloads: list[bytes]) -> list[bytes]:
    """Baseline JPEG files of payloads whose lengths are positive multiples of 192."""
    shapes = [_shape(len(p) // UNIT) for p in payloads]
    mcus = [c * r for c, r in shapes]
    filled = b"".join(p + b" " * (UNIT * m - len(p)) for p, m in zip(payloads, mcus, strict=True))
    rows = np.frombuffer(filled, np.uint8).reshape(-1, UNIT)
    numbers = np.concatenate([np.arange(-1, m - 1) for m in mcus])
    ends, scans, at = np.cumsum(mcus), [], 0
    pieces: list[list[bytes]] = [[] for _ in payloads]
    for lo in range(0, len(rows), GROUP_MCUS):
        part, starts = _scan(rows[lo : lo + GROUP_MCUS], numbers[lo : lo + GROUP_MCUS])
        part = part.tobytes()
        hi = min(len(rows), lo + GROUP_MCUS)
        while at < len(ends):
            a, z = max(lo, ends[at] - mcus[at]), min(hi, ends[at])
            pieces[at].append(part[starts[a - lo] : starts[z - lo]])
            if ends[at] > hi:
                break
            at += 1
            if at < len(ends) and ends[at] - mcus[at] >= hi:
                break
    return [_head(len(p), *s) + b"".join(x) + b"\xff\xd9" for p, s, x in zip(payloads, shapes, pieces, strict=True)]


class Parsed:
    """What the markers of one baseline file say."""

    def __init__(self, data: bytes):
        if data[:2] != b"\xff\xd8":
            raise ValueError("no SOI marker")
        self.tables: dict[int, bytes] = {}
        self.comments: list[bytes] = []
        self.quant: dict[int, bytes] = {}
        self.interval, at = 0, 2
        while True:
            marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xC0:
                self.height, self.width, n = struct.unpack_from(">xHHB", body)
                self.components = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
            elif marker == 0xC4:
                while body:
                    n = 17 + sum(body[1:17])
                    self.tables[body[0]], body = body[1:n], body[n:]
            elif marker == 0xDB:
                while body:
                    n = 1 + 64 * (1 + (body[0] >> 4))
                    self.quant[body[0] & 15], body = body[1:n], body[n:]
            elif marker == 0xDD:
                self.interval = struct.unpack(">H", body)[0]
            elif marker == 0xFE:
                self.comments.append(body)
            elif marker == 0xDA:
                picks = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
                break
            elif marker in (0xC1, 0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)):
                raise ValueError("not a baseline file")
        self.scan = at
        self.hmax, self.vmax = max(c[1] for c in self.components), max(c[2] for c in self.components)
        self.cols, self.rows = -(-self.width // (8 * self.hmax)), -(-self.height // (8 * self.vmax))
        #: For each block of an MCU: its component, DC table, AC table.
        self.blocks = [(k, picks[c[0]] >> 4, 0x10 | picks[c[0]] & 15) for k, c in enumerate(self.components) for _ in range(c[1] * c[2])]

    def key(self) -> tuple:
        return tuple(sorted(self.tables.items())), tuple(self.blocks)


def _lookup(body: bytes) -> np.ndarray:
    """For each 16 bits: length of the code they begin with << 8 | its symbol; 0: none."""
    out, code, k = np.zeros(1 << 16, np.int64), 0, 16
    for n in range(1, 17):
        for _ in range(body[n - 1]):
            out[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | body[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _intervals(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scan bytes without stuffing and markers, and where each restart interval starts."""
    full = np.flatnonzero(data[:-1] == 0xFF)
    after = data[full + 1]
    mark = full[(after >= 0xD0) & (after <= 0xD7)]
    drop = np.zeros(len(data), bool)
    drop[full[after == 0] + 1] = True
    drop[mark] = drop[mark + 1] = True
    gone = np.cumsum(drop)
    return data[~drop], np.concatenate([[0], mark + 2 - gone[mark + 1]])


def _decode_lot(data: np.ndarray, start: np.ndarray, n_blocks: np.ndarray, key: tuple) -> np.ndarray:
    """Coefficients (all blocks of all intervals, 64) in scan order; one symbol of every interval a step."""
    tables, blocks = dict(key[0]), key[1]
    ids = sorted(tables)
    lut = np.concatenate([_lookup(tables[t]) for t in ids])
    comp = np.array([b[0] for b in blocks])
    dc, ac = (np.array([ids.index(b[k]) << 16 for b in blocks]) for k in (1, 2))
    d = np.concatenate([data, np.full(8, 0xFF, np.uint8)]).astype(np.uint64)
    window = d[:-4] << np.uint64(32) | d[1:-3] << np.uint64(24) | d[2:-2] << np.uint64(16) | d[3:-1] << np.uint64(8) | d[4:]
    window = window.astype(np.int64)
    out = np.zeros(int(n_blocks.sum()) * 64, np.int16)
    p, k = start.astype(np.int64) * 8, np.zeros(len(start), np.int64)
    block, last = np.zeros(len(start), np.int64), n_blocks.astype(np.int64)
    base = (np.cumsum(n_blocks) - n_blocks).astype(np.int64) * 64
    pred = np.zeros((len(start), int(comp.max()) + 1), np.int64)
    while len(p):
        kind = block % len(blocks)
        w = window[p >> 3] << (p & 7) & 0xFFFFFFFFFF  # 40 bits, at least 33 of them ahead
        is_dc = k == 0
        e = lut[np.where(is_dc, dc[kind], ac[kind]) + (w >> 24)]
        n, symbol = e >> 8, e & 255
        if not n.all():
            raise ValueError("a code that no table has")
        size = symbol & 15
        bits = (w << n & 0xFFFFFFFFFF) >> (40 - size)
        value = np.where((size > 0) & (bits < 1 << np.maximum(size - 1, 0)), bits - (1 << size) + 1, bits)
        p = p + n + size
        rows = np.flatnonzero(is_dc)
        cs = comp[kind[rows]]
        pred[rows, cs] += value[rows]
        out[base[rows] + block[rows] * 64] = pred[rows, cs]
        run = symbol >> 4
        at = k + run
        put = np.flatnonzero(~is_dc & (size > 0))
        if len(put) and at[put].max() > 63:
            raise ValueError("a run beyond its block")
        out[base[put] + block[put] * 64 + at[put]] = value[put]
        k = np.where(is_dc, 1, np.where(size > 0, at + 1, np.where(run == 15, k + 16, 64)))
        over = k >= 64
        block, k = block + over, np.where(over, 0, k)
        going = block < last
        if not going.all():
            p, k, block, last, base, pred = p[going], k[going], block[going], last[going], base[going], pred[going]
    return out.reshape(-1, 64)


def decode(files: list[bytes]) -> list[tuple[Parsed, np.ndarray]]:
    """For each file what its markers say, and its coefficients (blocks in scan order, 64)."""
    parsed = [Parsed(f) for f in files]
    out: list = [None] * len(files)
    for key in dict.fromkeys(p.key() for p in parsed):
        own = [k for k, p in enumerate(parsed) if p.key() == key]
        data, starts, counts, at = [], [], [], 0
        for k in own:
            p = parsed[k]
            raw, start = _intervals(np.frombuffer(files[k], np.uint8)[p.scan : -2])
            mcus = p.cols * p.rows
            step = p.interval or mcus
            counts.append(np.minimum(step, mcus - step * np.arange(len(start))) * len(p.blocks))
            starts.append(start + at)
            data.append(raw)
            at += len(raw)
        raw, start, count = np.concatenate(data), np.concatenate(starts), np.concatenate(counts)
        ends = np.concatenate([start[1:], [len(raw)]])
        lots = []
        for lo in range(0, len(start), LOT):
            s = start[lo : lo + LOT]
            lots.append(_decode_lot(raw[s[0] : ends[min(len(start), lo + LOT) - 1]], s - s[0], count[lo : lo + LOT], key))
        coefs, at = np.concatenate(lots), 0
        for k, c in zip(own, counts, strict=True):
            n = int(c.sum())
            out[k] = parsed[k], coefs[at : at + n]
            at += n
    return out


def payload_of(p: Parsed, coefs: np.ndarray) -> bytes:
    n = next(int(c.split()[1]) for c in p.comments if c.startswith(b"payload "))
    return (coefs + OFFSET).astype(np.uint8).tobytes()[:n]


def thumbnail(p: Parsed, coefs: np.ndarray) -> np.ndarray:
    """Luminance of each 8x8 block from its DC coefficient alone."""
    _, h, v, quant = p.components[0]
    dc = coefs.reshape(p.rows, p.cols, len(p.blocks), 64)[:, :, : h * v, 0].reshape(p.rows, p.cols, v, h)
    dc = dc.transpose(0, 2, 1, 3).reshape(p.rows * v, p.cols * h)
    return np.clip(np.rint(dc.astype(float) * p.quant[quant][0] / 8 + 128), 0, 255).astype(np.uint8)


def feature(p: Parsed, thumb: np.ndarray) -> str:
    rows, cols = (np.arange(8) * n // 8 for n in thumb.shape)
    small = thumb[np.ix_(rows, cols)].astype(float)
    return f"{p.width}x{p.height}:{int.from_bytes(np.packbits(small > small.mean()).tobytes(), 'big'):016x}"


FIELDS = "doc_id long, n_bytes long, jpeg binary"


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes of the text, jpeg) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _groups(batches):
            files = encode([padded(t or b"") for t in texts])
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(t or b"") for t in texts], pa.int64()), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "jpeg"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, FIELDS)


def _groups(batches: Iterator[pa.RecordBatch]):
    """Ids and values of rows that together have about GROUP_MCUS units."""
    for b in batches:
        size = pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False) // UNIT + 1
        lot = np.cumsum(size) // GROUP_MCUS
        cuts = [0, *(np.flatnonzero(np.diff(lot)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if hi > lo:
                yield b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo).to_pylist()


def read_media(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload, width, height, thumb, feature, jpeg) of stored files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "payload", "width", "height", "thumb", "feature", "jpeg"]
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                files = part.column(2).to_pylist()
                found = decode(files)
                thumbs = [thumbnail(p, c) for p, c in found]
                columns = [part.column(0), part.column(1), [payload_of(p, c) for p, c in found], pa.array([p.width for p, _ in found], pa.int32()), pa.array([p.height for p, _ in found], pa.int32()), [t.tobytes() for t in thumbs], [feature(p, t) for (p, _), t in zip(found, thumbs, strict=True)], part.column(2)]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names=names)

    return media.select("doc_id", "n_bytes", "jpeg").mapInArrow(run, "doc_id long, n_bytes long, payload binary, width int, height int, thumb binary, feature string, jpeg binary")


def op2(docs: DataFrame) -> DataFrame:
    """Digest of what is read back from the stored files; the media columns stay inside one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "thumb_sha256"]
        for b in batches:
            payload, thumb, jpeg = (b.column(k).to_pylist() for k in (2, 5, 7))
            sha = lambda xs: [hashlib.sha256(x).hexdigest() for x in xs]
            columns = [b.column(0), b.column(1), pa.array(map(len, payload), pa.int64()), sha(payload), pa.array([zlib.crc32(x[-16:]) for x in payload], pa.int64()), pa.array(map(len, jpeg), pa.int64()), sha(jpeg), b.column(6), b.column(3), b.column(4), sha(thumb)]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, pa.string()) for x in columns], names=names)

    return read_media(to_media(docs)).mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int, thumb_sha256 string")
