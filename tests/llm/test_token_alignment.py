"""Cross-tokenizer alignment against a plain loop over tokens and byte ranges."""

import hashlib
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from docspark.llm import token_alignment as ta


def by_hand(texts):
    a_model, b_model = Tokenizer.from_file(f"{ta.FOLDER}/{ta.A_FILE}"), sentencepiece.SentencePieceProcessor(model_file=f"{ta.FOLDER}/{ta.B_FILE}")
    a_model.encode_special_tokens = True
    of = ta.byte_characters()

    def b_bytes(k):
        piece = b_model.id_to_piece(k)
        return bytes([int(piece[3:5], 16)]) if b_model.is_byte(k) else piece.replace("▁", " ").encode()

    def spans(ids, of_id):
        at, out = 0, []
        for k in ids:
            out.append((k, at, at + len(of_id(k))))
            at = out[-1][2]
        return out

    docs = []
    for text in texts:
        raw = b" " + (text or "").encode()
        a = spans(a_model.encode(" " + (text or ""), add_special_tokens=False).ids, lambda k: bytes(of[c] for c in a_model.id_to_token(k)))
        b = spans(b_model.encode(text or ""), b_bytes)
        whole = text and b"".join(bytes(of[c] for c in a_model.id_to_token(k)) for k, _, _ in a) == raw and b"".join(b_bytes(k) for k, _, _ in b) == raw
        docs.append((a, b) if whole else ([], []))
    links = [[(x, y) for x, i, j in a for y, k, m in b if i < m and k < j] for a, b in docs]
    counts = Counter(p for d in links for p in d)
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    out = []
    for (a, b), own in zip(docs, links, strict=True):
        cuts = sorted({x[2] for x in a} & {x[2] for x in b})
        groups = [([str(x) for x, _, e in a if lo < e <= hi], [str(y) for y, _, e in b if lo < e <= hi]) for lo, hi in zip([0, *cuts], cuts)]
        digest = hashlib.sha256(";".join(f"{','.join(x)}|{','.join(y)}" for x, y in groups).encode()).hexdigest() if a else ""
        out.append((len(a), len(b), len(groups), len(own), sum(counts[p] == best[p[1]] for p in own), sum(counts[p] for p in own), digest))
    return out


TEXTS = [
    "The quick brown fox's jumps, 12345 times!", "Étion dans çouelle réaux — naïve €5", "naïve façade  two  spaces\nand lines\t tabs", "日本語のテキスト and ascii 🙂🙂", "aaaaaaaaaaaaaaaa ababababab", "<|endoftext|> is plain <s> </s> <unk> <0x41>",
    "", None, " ", "x", "▁odd", "é combined ﬁ ligature", "\x00\x01 controls", "the the the the", "The quick brown fox's jumps, 12345 times!", "z" * 1500, " " * 1200 + "end", "ÄÖÜ übergröße Straße",
]


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "x", 7) for k, t in rows], "doc_id long, text string, chunk string, pairs int").repartition(3)


@pytest.mark.parametrize("chunk", [40, ta.CHUNK])
def test_alignment_equals_a_plain_loop(spark, chunk):
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in ta.op11(frame(spark, enumerate(TEXTS)), chunk_size=chunk).collect()}
    assert got == dict(enumerate(by_hand(TEXTS)))
    assert any(x[0] for x in got.values()) and got[6] == (0, 0, 0, 0, 0, 0, "")


def test_edge_tables(spark):
    assert ta.op11(frame(spark, [(1, "x")]).where("false")).count() == 0
    rows = ta.op11(frame(spark, [(1, "same"), (1, "same"), (None, "other"), (2, None)])).collect()
    assert len(rows) == 4 and {r.doc_id for r in rows} == {1, 2, None}
    assert [r.count_sum for r in rows if r.doc_id == 1] == [2, 2]


def test_both_encoders_of_a_agree():
    v = ta.vocabularies(ta.FOLDER, ta.A_FILE, ta.B_FILE)
    slow = Tokenizer.from_file(v.a_path)
    slow.encode_special_tokens = True
    for text in TEXTS:
        if text:
            assert v.a.encode_ordinary(" " + text) == slow.encode(" " + text, add_special_tokens=False).ids == v.encode_a(" " + text)
    assert sum(v.identity >= 0) > 10_000
    assert all(v.a_bytes[k] == v.b_bytes[j] for k, j in enumerate(v.identity) if j >= 0)
