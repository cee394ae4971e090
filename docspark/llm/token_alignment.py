"""Cross-tokenizer alignment with a fast path through an identity map of the vocabularies.

A text is encoded by a byte-level BPE (A) and by a piece model with byte fallback (B). Byte offsets where
tokens of both end cut the two sequences into groups. Most groups hold one token of each: for those an
array over A's ids, computed once from the vocabularies, names the B id of the same bytes, so that such
links are counted by A id alone, in one vector of the vocabulary's length a task. Only the other groups
give pairs, and these are made distinct within a chunk of documents (about ``CHUNK`` bytes of text) before
they are shuffled: the shuffle grows with chunks x pairs in use, not with tokens.

Counts of the whole corpus come back the same way: the vector's as two arrays of the vocabulary's length
(the only data sent to every task, at most |A| entries), the pairs' by a join on the chunks' distinct pairs.

Defined cases: null and empty texts, and texts that A or B does not give back byte for byte (B rewrites
some characters), have no tokens and zeros throughout, with an empty hash. Every row has its own result,
repeated ids and texts included; a null id stays null. Extra columns are ignored. Special tokens' strings
in a text are plain text. An empty table gives no rows. A text is held whole by one task, with some tens
of bytes a token while it is encoded.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docspark.llm._common import materialize

FOLDER, A_FILE, B_FILE = "/opt/tokenizers", "byte_bpe_50k.json", "piece_bpe_32k.model"
CHUNK, CHUNK_DOCS = 4 << 20, 20_000
#: Ids of B take the low bits of a pair.
BITS = 20
#: Fixed value: how the byte-level model cuts a text before it merges.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A run that is never cut goes to the slower encoder, whose time stays near linear in its length.
LONG_RUN = re.compile(r"\S{1000}|\s{1000}")


def byte_characters() -> dict[str, int]:
    """The byte of each character in the entries of a byte-level vocabulary: printable ones stand for
    themselves, the others for characters from 256 on, in their order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Vocabularies:
    """Both tokenizers of a folder, the bytes of their tokens, and the map from A's ids to B's."""

    def __init__(self, folder: str, a_file: str, b_file: str):
        import sentencepiece
        import tiktoken

        self.a_path = f"{folder}/{a_file}"
        with open(self.a_path, encoding="utf-8") as f:
            described = json.load(f)
        entries, of = described["model"]["vocab"], byte_characters()
        size = 1 + max([*entries.values(), *(x["id"] for x in described["added_tokens"])])
        self.a_bytes = [b""] * size
        for entry, k in entries.items():
            self.a_bytes[k] = bytes(of[c] for c in entry)
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={b: k for k, b in enumerate(self.a_bytes) if b}, special_tokens={})
        self._slow = None
        self.b = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{b_file}")
        n = self.b.get_piece_size()
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in ((k, self.b.id_to_piece(k)) for k in range(n))]
        self.a_length, self.b_length = (np.array([len(x) for x in xs], np.int64) for xs in (self.a_bytes, self.b_bytes))
        same: dict[bytes, int] = {}
        for k in sorted(range(n), key=lambda k: (self.b.is_byte(k), k)):
            same.setdefault(self.b_bytes[k], k)
        self.identity = np.array([same.get(x, -1) if x else -1 for x in self.a_bytes], np.int64)
        self.marks = [[np.array([f"{k}{end}".encode() for k in range(m)], object) for end in ends] for m, ends in ((size, ",|"), (n, ",;"))]

    def encode_a(self, text: str) -> list[int]:
        if not LONG_RUN.search(text):
            return self.a.encode_ordinary(text)
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self.a_path)
            self._slow.encode_special_tokens = True
        return self._slow.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids by A and by B; None where one of them does not give the text back."""
        raw = b" " + text.encode()
        a, b = self.encode_a(" " + text), self.b.encode(text)
        if b"".join([self.a_bytes[k] for k in a]) != raw or b"".join([self.b_bytes[k] for k in b]) != raw:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)


@lru_cache(1)
def vocabularies(folder: str, a_file: str, b_file: str) -> Vocabularies:
    return Vocabularies(folder, a_file, b_file)


NOTHING = (0, 0, 0, 0, "", *[np.zeros(0, np.int64)] * 4)


def align(v: Vocabularies, text: str) -> tuple:
    """(tokens of A, of B, groups, links, hash of the groups, A ids of regular links and their counts,
    pairs of the other links and their counts) of one text.

    Tokens of A and B overlap on exactly one stretch between neighbouring ends of either, so the links are
    those stretches.
    """
    ids = v.encode(text) if text else None
    if ids is None:
        return NOTHING
    a, b = ids
    ends_a, ends_b = np.cumsum(v.a_length[a]), np.cumsum(v.b_length[b])
    at_a, at_b = np.zeros(ends_a[-1] + 1, bool), np.zeros(ends_a[-1] + 1, bool)
    at_a[ends_a], at_b[ends_b] = True, True
    last_a, last_b = at_b[ends_a], at_a[ends_b]
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    n_a, n_b = np.bincount(group_a), np.bincount(group_b)
    stretch = np.flatnonzero(at_a | at_b)
    from_a, from_b = (np.cumsum(at_a) - at_a)[stretch], (np.cumsum(at_b) - at_b)[stretch]
    link_a, link_b = a[from_a], b[from_b]
    regular = ((n_a == 1) & (n_b == 1))[group_a[from_a]] & (v.identity[link_a] == link_b)
    out = np.empty(len(a) + len(b), object)
    for group, own, other, (inside, closing), tokens, last in ((group_a, 0, np.cumsum(n_b) - n_b, v.marks[0], a, last_a), (group_b, 1, np.cumsum(n_a), v.marks[1], b, last_b)):
        place = np.arange(len(tokens)) + other[group]
        out[place] = inside[tokens]
        out[place[last]] = closing[tokens[last]]
    digest = hashlib.sha256(b"".join(out.tolist())[:-1]).hexdigest()
    return (len(a), len(b), len(n_a), len(stretch), digest, *np.unique(link_a[regular], return_counts=True), *np.unique(link_a[~regular] << BITS | link_b[~regular], return_counts=True))


ROWS = "array<struct<doc_id:long,n_a:long,n_b:long,n_groups:long,n_links:long,groups_sha256:string>>"
CHUNKS = f"chunk long, docs {ROWS}, regular binary, irregular binary, pairs array<long>, counts array<long>, by_identity boolean"
ROW_TYPE = pa.list_(pa.struct([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())]))
CHUNK_SCHEMA = pa.schema([("chunk", pa.int64()), ("docs", ROW_TYPE), ("regular", pa.binary()), ("irregular", pa.binary()), ("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("by_identity", pa.bool_())])


def _packed(docs: list[np.ndarray], what: list[np.ndarray], counts: list[np.ndarray]) -> bytes:
    """A sparse matrix: the document's place in the chunk, the column and the count of every entry."""
    return zlib.compress(np.stack([np.concatenate([np.zeros(0, np.int64), *x]) for x in (docs, what, counts)]).astype("<i4").tobytes(), 1)


def _unpacked(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), "<i4").reshape(3, -1).astype(np.int64)


def _encoded(folder: str, a_file: str, b_file: str, chunk_size: int):
    """Chunks of aligned documents, and a last row with the task's counts by A id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, part = vocabularies(folder, a_file, b_file), TaskContext.get().partitionId()
        vector, docs, aligned, known, size, n = np.zeros(len(v.a_bytes), np.int64), [], [], {}, 0, 0

        def chunk() -> pa.RecordBatch:
            place = [np.full(len(x[5]), k) for k, x in enumerate(aligned)], [np.full(len(x[7]), k) for k, x in enumerate(aligned)]
            pairs, slot = np.unique(np.concatenate([x[7] for x in aligned]), return_inverse=True)
            counts = np.bincount(slot, np.concatenate([x[8] for x in aligned]), len(pairs)).astype(np.int64)
            rows = [dict(zip(("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"), (d, *x[:5]), strict=True)) for d, x in zip(docs, aligned, strict=True)]
            row = [part << 33 | n, rows, _packed(place[0], [x[5] for x in aligned], [x[6] for x in aligned]), _packed(place[1], [slot], [x[8] for x in aligned]), pairs, counts, False]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, CHUNK_SCHEMA, strict=True)], schema=CHUNK_SCHEMA)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                if text not in known:
                    known[text] = align(v, text)
                docs.append(doc)
                aligned.append(known[text])
                vector[aligned[-1][5]] += aligned[-1][6]
                size += len(text)
                if size >= chunk_size or len(docs) >= CHUNK_DOCS:
                    yield chunk()
                    docs, aligned, known, size, n = [], [], {}, 0, n + 1
        if docs:
            yield chunk()
        used = np.flatnonzero(vector)
        row = [None, None, None, None, used << BITS | v.identity[used], vector[used], True]
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, CHUNK_SCHEMA, strict=True)], schema=CHUNK_SCHEMA)

    return run


def _weighed(count: np.ndarray, best: np.ndarray):
    """Adds n_best and count_sum to the documents of each chunk."""
    out = pa.schema([*ROW_TYPE.value_type, ("n_best", pa.int64()), ("count_sum", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, regular, irregular, found in zip(*(batch.column(k) for k in range(4)), strict=True):
                docs, found = docs.values, found.values if found.is_valid else pa.array([], pa.struct([("slot", pa.int32()), ("n", pa.int64()), ("best", pa.bool_())]))
                sums = np.zeros((2, len(docs)), np.int64)
                in_chunk = np.asarray(found.field("n")), np.asarray(found.field("best").cast(pa.int64()))
                for packed, values in ((regular, (count, best)), (irregular, in_chunk)):
                    doc, what, n = _unpacked(packed.as_py())
                    for total, value in zip(sums, values, strict=True):
                        np.add.at(total, doc, n * value[what])
                yield pa.RecordBatch.from_arrays([*docs.flatten(), pa.array(sums[1]), pa.array(sums[0])], schema=out)

    return run


def op11(documents: DataFrame, folder: str = FOLDER, a_file: str = A_FILE, b_file: str = B_FILE, chunk_size: int = CHUNK) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum."""
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    chunks = materialize(rows.mapInArrow(_encoded(folder, a_file, b_file, chunk_size), CHUNKS))
    counts = chunks.select(F.explode(F.arrays_zip("pairs", "counts")).alias("x"), "by_identity").groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.counts").alias("n"), F.max("by_identity").alias("by_identity"))
    of_b = Window.partitionBy(F.col("pair").bitwiseAND((1 << BITS) - 1))
    counts = materialize(counts.withColumn("best", F.col("n") == F.max("n").over(of_b)))

    # One entry for an id of A at most: bounded by the vocabulary, whatever the corpus.
    by_a = counts.where("by_identity").select(F.shiftright("pair", BITS).alias("a"), "n", "best").toPandas()
    size = int(by_a["a"].max()) + 1 if len(by_a) else 1
    count, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
    count[by_a["a"]], best[by_a["a"]] = by_a["n"], by_a["best"]

    own = chunks.where("not by_identity")
    used = own.select("chunk", F.posexplode("pairs").alias("slot", "pair")).join(counts, "pair")
    found = used.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("slot", "n", "best"))).alias("found"))
    weighed = own.select("chunk", "docs", "regular", "irregular").join(found, "chunk", "left").select("docs", "regular", "irregular", "found")
    return weighed.mapInArrow(_weighed(count, best), "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
