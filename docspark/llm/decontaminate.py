"""Benchmark decontamination by spaced seeds.

Tokens are lower-cased runs of word characters. A spaced seed is a fixed mask over consecutive
tokens that ignores some positions; the hash of the kept tokens, with the mask's number, is the
seed's key. Keys of the documents and of the benchmark are joined; a hit gives a document, an item
and the diagonal on which they meet. Around each hit the item is laid over the document, on that
diagonal and up to ``SHIFT`` tokens beside it: a token of the item is covered if it and a neighbour
match on the same diagonal. A document holds an item if at least ``SIMILARITY`` of the item's
tokens are covered (of the best window of ``WINDOW`` tokens, for longer items), so substitutions,
a few insertions and losses are tolerated.

What is sent around: a bitmap of the benchmark's keys of fixed size (8 MB, whatever the benchmark's
size) prunes the documents' keys before the join; it lets false keys pass and never loses one. The
keys of the benchmark are broadcast up to ``BROADCAST_ROWS`` rows, and joined by shuffle beyond.

Defined cases: null texts are empty. Items with fewer than ``min_tokens`` tokens (by default ``MIN_TOKENS``:
shorter ones stand in texts by chance) match nothing; with 1 every item that has a token is sought. Items
shorter than all masks are sought as a whole. Texts and items of any length are read whole; an empty table on
either side gives no rows. Repeated rows each count; results are distinct
by (doc_id, item_id); of diagonals or windows that cover an item alike, any serves, as only the share
counts. Null ids of items are kept in results; documents with a null id are reported
with it but, having no name, stay in ``decontaminate``. Extra columns are ignored or kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm._common import broadcast_if_small, fresh, materialize, n_shuffle

#: 1: the token counts; 0: any token. The first needs five tokens in a row; the others pass over single
#: and regularly repeated substitutions.
MASKS = ("11111", "1101011", "111101111", "11011011011")
#: Items of at most so many tokens are also sought by a mask that an insertion in their middle leaves.
SHORT, SHORT_MASK = 12, "1111"
MIN_TOKENS, SIMILARITY, WINDOW, SHIFT = 5, 0.8, 50, 3
BITS = 26
LOT = 64
SEGMENT = 16
BROADCAST_ROWS = 500_000
WORD = re.compile(r"\w+")
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def token_hashes(text: str | None, memo: dict) -> np.ndarray:
    import xxhash

    words = WORD.findall((text or "").lower())
    if len(memo) > 500_000:
        memo.clear()
    h64 = xxhash.xxh64_intdigest
    for w in set(words).difference(memo):
        memo[w] = h64(w)
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def _mix(keys: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    keys = (keys ^ tokens) * MULTIPLIER
    return keys ^ (keys >> np.uint64(29))


def seed_keys(tokens: np.ndarray, mask: str, number: int) -> np.ndarray:
    """The key at each position where the mask fits."""
    n = max(0, len(tokens) - len(mask) + 1)
    keys = np.full(n, number + 1, np.uint64) * MULTIPLIER
    for k, bit in enumerate(mask):
        if bit == "1":
            keys = _mix(keys, tokens[k : k + n])
    return _mix(keys, keys >> np.uint64(32))


def _by_key(keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
    """Distinct keys, and the places of each."""
    order = np.argsort(keys, kind="stable")
    keys, at = keys[order], at[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], pa.ListArray.from_arrays(pa.array(np.append(first, len(keys)), pa.int32()), pa.array(at.astype(np.int32)))


def masks_for(lengths: set[int], min_tokens: int = MIN_TOKENS) -> list[tuple[int, str]]:
    """The fixed masks, one more for short items, and a full one for each item length for which they are too long."""
    shortest = min(map(len, MASKS))
    short = [(len(MASKS), SHORT_MASK)] if any(len(SHORT_MASK) < n <= SHORT for n in lengths) else []
    return [*enumerate(MASKS), *short, *((100 + n, "1" * n) for n in sorted(lengths) if min_tokens <= n < shortest)]


def _bench_tables(benchmark: DataFrame, id_col: str, text_col: str, min_tokens: int) -> tuple[DataFrame, DataFrame]:
    """Items (item_id, item, tokens) and their seeds (seed, item, ats); item is the hash of the tokens, ats are
    all places of a seed in the item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for b in batches:
            rows = [(i, t) for i, t in zip(b.column(0).to_pylist(), (token_hashes(x, memo) for x in b.column(1).to_pylist()), strict=True) if len(t) >= min_tokens]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([t.tobytes() for _, t in rows], pa.binary()), pa.array([len(t) for _, t in rows], pa.int32())], names=["item_id", "tokens", "n"])

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, tokens in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                t = np.frombuffer(tokens, np.uint64)
                keys = [seed_keys(t, m, k) for k, m in masks_for({len(t)}, min_tokens)]
                at = np.concatenate([np.arange(len(x), dtype=np.int32) for x in keys])
                seeds, places = _by_key(np.concatenate(keys), at)
                yield pa.RecordBatch.from_arrays([pa.array(seeds.view(np.int64)), pa.array([item] * len(seeds), pa.int64()), places], names=["seed", "item", "ats"])

    items = materialize(benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).mapInArrow(run, "item_id long, tokens binary, n int"))
    texts = items.select(F.xxhash64("tokens").alias("item"), "tokens").dropDuplicates(["item"])
    return items.withColumn("item", F.xxhash64("tokens")), texts.mapInArrow(seeds, "seed long, item long, ats array<int>")


def _bitmap(seeds: DataFrame) -> np.ndarray:
    """One bit for each value of the keys' lowest BITS bits; segments are built on the executors."""

    def segment(table: pa.Table) -> pa.Table:
        bits = np.zeros(1 << SEGMENT, np.uint8)
        bits[table.column("low").to_numpy()] = 1
        return pa.table({"seg": table.column("seg")[:1], "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    low = F.col("seed").bitwiseAND(F.lit((1 << BITS) - 1))
    parts = seeds.select(F.shiftright(low, SEGMENT).cast("int").alias("seg"), low.bitwiseAND(F.lit((1 << SEGMENT) - 1)).cast("int").alias("low")).distinct()
    out = np.zeros(1 << (BITS - 3), np.uint8)
    size = 1 << (SEGMENT - 3)
    for seg, bits in parts.groupBy("seg").applyInArrow(segment, "seg int, bits binary").collect():
        out[seg * size : (seg + 1) * size] = np.frombuffer(bits, np.uint8)
    return out


def _hits(docs: DataFrame, id_col: str, text_col: str, bitmap, masks: list[tuple[int, str]], longest: int) -> DataFrame:
    """Rows of two kinds: hits (run, seed, its places in the run) and the runs (run, doc_id, tokens around the hits)."""
    margin = longest + SHIFT + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bits, memo = bitmap.value, {}
        number = TaskContext.get().partitionId() << 40
        low = np.uint64((1 << BITS) - 1)
        for b in batches:
            out: list[list] = [[] for _ in range(5)]
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for first in range(0, len(ids), LOT):  # the documents of a lot are hashed as one row of tokens
                each = [token_hashes(t, memo) for t in texts[first : first + LOT]]
                ends = np.cumsum([len(t) for t in each])
                joined, at, seed = np.concatenate(each), [], []
                for k, mask in masks:
                    keys = seed_keys(joined, mask, k)
                    i = keys & low
                    hit = np.flatnonzero(bits[i >> np.uint64(3)] >> (i & np.uint64(7)).astype(np.uint8) & 1)
                    hit = hit[hit + len(mask) <= ends[np.searchsorted(ends, hit, "right")]] if len(hit) else hit
                    at.append(hit)
                    seed.append(keys[hit])
                at, seed = np.concatenate(at), np.concatenate(seed)
                order = np.argsort(at, kind="stable")
                at, seed = at[order], seed[order]
                owner = np.searchsorted(ends, at, "right")
                cuts = np.flatnonzero((np.diff(at) > margin) | (np.diff(owner) > 0)) + 1
                for part in np.split(np.arange(len(at)), cuts) if len(at) else ():
                    number += 1
                    doc = owner[part[0]]
                    tokens, start = each[doc], int(ends[doc]) - len(each[doc])
                    lo, hi = max(0, int(at[part[0]]) - start - margin), int(at[part[-1]]) - start + margin
                    seeds, places = _by_key(seed[part], at[part] - start - lo)
                    m = len(seeds)
                    out[0] += [number] * (m + 1)
                    out[1] += [ids[first + doc]] * (m + 1)
                    out[2] += [*seeds.view(np.int64).tolist(), None]
                    out[3] += [*places.to_pylist(), None]
                    out[4] += [None] * m + [tokens[lo:hi].tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.binary()), strict=True)], names=["run", "doc_id", "seed", "places", "tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "run long, doc_id long, seed long, places array<int>, tokens binary")


def coverage(item: np.ndarray, doc: np.ndarray, diagonal: int) -> float:
    """Share of the item's tokens (best window) covered near the diagonal."""
    n = len(item)
    covered = np.zeros(n, bool)
    for shift in range(-SHIFT, SHIFT + 1):
        lo = diagonal + shift
        a, z = max(0, -lo), min(n, len(doc) - lo)
        if a >= z:
            continue
        same = np.zeros(n + 2, bool)
        same[a + 1 : z + 1] = item[a:z] == doc[lo + a : lo + z]
        covered |= same[1:-1] & (same[:-2] | same[2:] | (n == 1))
    sums = np.concatenate([[0], np.cumsum(covered)])
    w = min(n, WINDOW)
    return float((sums[w:] - sums[:-w]).max() / w)


def _marked(hits: list[dict], n: int, m: int) -> np.ndarray:
    """For each diagonal from -n to m - 1 whether a pair of places of a hit lies on it.

    A seed that repeats on both sides has more pairs than there are diagonals; its differences then come from
    one correlation of the two sets of places, so that no list of pairs is held.
    """
    marked = np.zeros(n + m, bool)
    for h in hits:
        places, ats = np.asarray(h["places"], np.int64), np.asarray(h["ats"], np.int64)
        if len(places) * len(ats) <= 4 * (n + m):
            marked[(places[:, None] - ats).ravel() + n] = True
            continue
        size = 1 << int(n + m + 1).bit_length()
        left, right = np.zeros(size), np.zeros(size)
        left[places], right[n - ats] = 1, 1
        marked |= np.fft.irfft(np.fft.rfft(left) * np.fft.rfft(right), size)[: n + m] > 0.5
    return marked


def _best_of(item: np.ndarray, doc: np.ndarray, marked: np.ndarray) -> float:
    """The best coverage on the marked diagonals, by blocks of diagonals of bounded size."""
    n = len(item)
    w, best = min(n, WINDOW), 0.0
    padded = np.concatenate([np.zeros(n + SHIFT, np.uint64), doc, np.zeros(n + SHIFT, np.uint64)])
    known = np.zeros(len(padded), bool)
    known[n + SHIFT : n + SHIFT + len(doc)] = True
    rows, step = len(doc) + n, max(1, (1 << 21) // n)
    for lo in range(0, rows, step):
        here = marked[lo : lo + step]
        if not here.any():
            continue
        size = len(here) + 2 * SHIFT
        take = lambda x: np.lib.stride_tricks.sliding_window_view(x[lo : lo + size + n - 1], n)  # noqa: E731, B023
        same = (take(padded) == item) & take(known)
        near = np.zeros_like(same)
        near[:, 1:] |= same[:, :-1]
        near[:, :-1] |= same[:, 1:]
        same &= near | (n == 1)
        covered = np.logical_or.reduce([same[k : size - 2 * SHIFT + k] for k in range(2 * SHIFT + 1)])[here]
        sums = np.concatenate([np.zeros((len(covered), 1), np.int32), np.cumsum(covered, 1, dtype=np.int32)], 1)
        best = max(best, float((sums[:, w:] - sums[:, :-w]).max() / w))
    return best


def similarity_of(item: np.ndarray, doc: np.ndarray, hits: list[dict]) -> float:
    """The best coverage on the diagonals of the hits, which are places in the document and in the item."""
    n, m = len(item), len(doc)
    marked = _marked(hits, n, m)
    diagonals = np.flatnonzero(marked) - n
    if len(diagonals) * 8 > n + m:  # the same diagonals either way, many of them side by side
        return _best_of(item, doc, marked)
    return max(coverage(item, doc, int(x)) for x in diagonals)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, 64):
            part = b.slice(lo, 64)
            doc, item, hits = (part.column(k).to_pylist() for k in (2, 3, 4))
            best = [similarity_of(np.frombuffer(i, np.uint64), np.frombuffer(d, np.uint64), h) for d, i, h in zip(doc, item, hits, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(best, pa.float64())], names=["doc_id", "item", "similarity"])


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", similarity: float = SIMILARITY, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """(doc_id, item_id, similarity) of each document and each benchmark item that it holds."""
    spark = docs.sparkSession
    items, seeds = _bench_tables(benchmark, item_id_col, item_text_col, max(1, min_tokens))
    seeds = materialize(seeds)
    shortest = min(map(len, MASKS))
    n_seeds = seeds.count()
    longest = items.agg(F.max("n")).first()[0] or 0
    lengths = {r[0] for r in items.select("n").where(F.col("n") < shortest).distinct().collect()}
    bitmap = spark.sparkContext.broadcast(_bitmap(seeds))
    found = materialize(_hits(docs, id_col, text_col, bitmap, masks_for(lengths, max(1, min_tokens)), longest))
    small = n_seeds <= BROADCAST_ROWS
    near = (lambda x: F.broadcast(x)) if small else (lambda x: x)
    # A seed's places stay lists, so one that repeats is one row, not a row for each pair of places.
    met = found.where("seed is not null").select("run", "seed", "places").join(near(seeds), "seed")
    met = met.groupBy("run", "item").agg(F.collect_list(F.struct("places", "ats")).alias("hits"))
    texts = items.select("item", F.col("tokens").alias("item_tokens")).dropDuplicates(["item"])
    runs = found.where("tokens is not null").select("run", "doc_id", "tokens")
    laid = runs.join(met, "run").join(near(texts), "item").select("doc_id", "item", "tokens", "item_tokens", "hits")
    verified = laid.repartition(n_shuffle(spark)).mapInArrow(_verify, "doc_id long, item long, similarity double").where(F.col("similarity") >= similarity)
    best = verified.groupBy("doc_id", "item").agg(F.max("similarity").alias("similarity"))
    return best.join(near(items.select("item", "item_id").distinct()), "item").groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **args) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item."""
    (gone,) = fresh(docs, "gone")
    found = contaminated(docs, benchmark, **args).select(F.col("doc_id").alias(gone)).distinct()
    found = broadcast_if_small(found, BROADCAST_ROWS)
    return docs.join(found, F.col(args.get("id_col", "doc_id")).cast("long") == F.col(gone), "left_anti")
