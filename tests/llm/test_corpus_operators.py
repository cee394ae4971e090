"""The ten corpus operators against brute force, exact round trips and held-out labels, on small rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from docspark.llm import chat, decontaminate, html_extract, jpeg, mixing, pii, quality, secrets, simhash, suffix_dedup

RNG = random.Random(3)
WORDS = ["".join(RNG.choice("abcdefghiékl") for _ in range(RNG.randint(1, 8))) for _ in range(300)]


def words(n, rng=RNG):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def frame(spark, texts, ids=None):
    """Documents with extra columns of clashing names."""
    rows = [(i, t, "en", f"s{k % 3}" if k % 5 else None, len(t or ""), 1, 2.0, "x") for k, (i, t) in enumerate(zip(ids or range(len(texts)), texts, strict=True))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, score int, node double, replies string").repartition(3)


def empty(spark):
    return frame(spark, ["x"]).where("false")


# 1


def removed_by_hand(texts):
    seen = {}
    for t in texts:
        for i in range(len(t) - 399):
            seen[t[i : i + 400]] = seen.get(t[i : i + 400], 0) + 1
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - 399):
            if seen[t[i : i + 400]] > 1:
                gone[i : i + 400] = b"\x01" * 400
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), sum(gone), sum(1 for k in range(len(t)) if gone[k] and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_dedup_equals_brute_force(spark):
    base, a, b = words(600), words(150), words(110)
    texts = [base, base, base[:900] + words(9) + base[900:], base[300:1400], words(40) + a + words(9), a + b, b + a, words(20) + a[:405] + words(9), "x" * 1500, "ab" * 500, "", None, "short", " " * 401, "x" * 400, words(99) + a + words(3) + a]
    for _ in range(40):
        s = RNG.choice([base, a, b])
        at = RNG.randrange(len(s))
        texts.append(words(RNG.randint(0, 30)) + s[at : at + RNG.choice([390, 399, 400, 401, 700])] + words(RNG.randint(0, 30)))
    for block in (2_000, 1 << 20):
        got = {r.doc_id: tuple(r)[1:5] for r in suffix_dedup.op1(frame(spark, texts), block).collect()}
        assert got == dict(enumerate(removed_by_hand([(t or "").encode() for t in texts])))


def test_suffix_dedup_edges(spark):
    assert suffix_dedup.op1(empty(spark)).count() == 0
    rows = suffix_dedup.op1(frame(spark, ["q" * 400, "q" * 400, None], [7, 7, None])).collect()
    assert sorted((r.doc_id or -1, r.n_removed) for r in rows) == [(-1, 0), (7, 400), (7, 400)]
    for units in suffix_dedup.LEVELS:
        cover = np.flatnonzero(units.in_cover)
        assert len({(i - j) % units.period for i in cover for j in cover}) == units.period


# 2


def test_jpeg_round_trip(spark):
    texts = ["", None, "a", words(700), "é" * 99, " " * 192, "\x7f\x00" * 300, words(40000)]
    got = {r.doc_id: r for r in jpeg.op2(frame(spark, texts)).collect()}
    for k, t in enumerate(texts):
        b = (t or "").encode()
        p = b.ljust(max(192, -(-len(b) // 192) * 192), b" ")
        r = got[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    assert tuple(got[0])[1:] == tuple(got[1])[1:]
    assert jpeg.op2(empty(spark)).count() == 0


def test_jpeg_any_bytes_and_thumbnail():
    rng = np.random.default_rng(1)
    payloads = [rng.integers(0, 256, 192 * n, dtype=np.uint8).tobytes() for n in (1, 2, 7, 5000)] + [bytes(192), b"\xff" * 384, b"\x20" * 65 + b"A" * 127]
    for (p, coefs), want in zip(jpeg.decode(jpeg.encode(payloads)), payloads, strict=True):
        assert jpeg.payload_of(p, coefs) == want
        blocks = np.frombuffer(want, np.uint8).reshape(-1, 192)[:, 0].astype(float)
        thumb = jpeg.thumbnail(p, coefs)
        assert thumb.shape == (p.height // 8, p.width // 8)
        assert np.array_equal(thumb.ravel()[: len(blocks)], np.clip(np.rint((blocks - 32) / 8 + 128), 0, 255))
    with pytest.raises(ValueError, match="SOI"):
        jpeg.Parsed(b"no jpeg")


# 3


def test_chat_round_trip(spark):
    hard = ["\\### Assistant: </turn> ok", "### user: hi </turn>\n", "\\", "a\\\\b: c", "", None, " </turn>\n### x: ", "é\n" * 50, "### ", "x </turn>", "long " * 9000]
    rows = [(c, t, ("user", "assistant")[t % 2], hard[(3 * c + t) % len(hard)], 1) for c in range(20) for t in range(c % 7 + 1)] + [(99, 0, None, None, 1), (99, None, "assistant", "z", 1), (None, 0, "a: b", "y", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, piece int").repartition(5)
    by = {}
    for c, _, role, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0)):
        by.setdefault(c, []).append((role or "", text or ""))
    by[-7] = [("user", hard[0]), ("assistant", hard[0])]
    got = {r.conv_id: r for r in chat.op3(df).collect()}
    assert set(got) == set(by)
    for c, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        r = got[c]
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for a, t in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    pieces = chat.format_turns(df.where("conv_id = 3")).orderBy("seq").collect()
    whole = "".join(p.piece for p in pieces)
    assert [x[:2] for x in chat.parse(whole)] == by[3]
    assert [p.start for p in pieces] == [sum(len(q.piece) for q in pieces[:k]) for k in range(len(pieces))]
    assert chat.op3(df.where("false")).count() == 1  # conversation -7


# 4


def leaks_by_hand(docs, items):
    out = set()
    memo = {}
    for i, d in docs:
        dt = decontaminate.token_hashes(d, memo)
        for j, b in items:
            bt = decontaminate.token_hashes(b, memo)
            if len(bt) >= decontaminate.MIN_TOKENS and len(dt):
                if max(decontaminate.coverage(bt, dt, x) for x in range(-len(bt), len(dt) + 1)) >= 0.8:
                    out.add((i, j))
    return out


def test_decontamination(spark):
    rng = random.Random(5)
    items = [words(n, rng) for n in (5, 7, 16, 25, 40, 60, 120)] + [None, "", "one two"]
    docs = [words(120, rng) for _ in range(20)] + [None, "", "short"]
    for k, item in enumerate(items[:7]):
        docs.append(words(30, rng) + " " + item.upper() + "! " + words(20, rng))
        t = item.split()
        if len(t) > 15:
            swapped = [("zz" if i % 7 == 3 else w) for i, w in enumerate(t)]
            docs.append(words(9, rng) + " " + " ".join(swapped))
            docs.append(" ".join([*t[:8], "extra", *t[8:]]) + words(5, rng))
            docs.append(" ".join(t[: len(t) // 2]) if k < 6 else words(4, rng))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    df = frame(spark, docs)
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(df, bench).collect()}
    assert got == leaks_by_hand(list(enumerate(docs)), list(enumerate(items)))
    kept = decontaminate.decontaminate(df, bench)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == set(range(len(docs))) - {i for i, _ in got}
    assert decontaminate.contaminated(empty(spark), bench).count() == 0
    assert decontaminate.contaminated(df, bench.where("false")).count() == 0


def test_decontamination_without_broadcast(spark, monkeypatch):
    item = words(30)
    bench = spark.createDataFrame([(1, item), (2, item)], "item_id long, text string")
    df = frame(spark, [item, words(50), "x " + item])
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(df, bench).collect()} == {(0, 1), (0, 2), (2, 1), (2, 2)}


# 5


def test_secrets(spark):
    rng = random.Random(9)
    key = "".join(rng.choice("0123456789abcdef") for _ in range(40))
    texts = [f'{words(5)} token = "{key}" {words(5)}', f"{words(20)} commit {key} {words(3)}", f"see https://example.org/{WORDS[3]}/{WORDS[4]}/page12.html {words(9)}", None, "", 'password = "correct9horse$battery"'] + [words(80) for _ in range(20)]
    got = secrets.find_secrets(frame(spark, texts)).collect()
    for r in got:
        assert texts[r.doc_id][r.start : r.end] == r.value
    flagged = {r.doc_id for r in got if r.is_secret}
    assert 0 in flagged and 1 not in flagged and 2 not in flagged
    assert secrets.find_secrets(empty(spark)).count() == 0


def test_secrets_of_any_length_and_form(spark):
    rng = random.Random(21)
    key = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    jwt = f"eyJ{key(40)}.eyJ{key(300)}.{key(86)}"
    forms = [
        ('token = "{}"', "a1B2" * 60), ("{}", "eyJ" + "a1B2" * 80), ('token = "{}"', jwt), ("token: {}", jwt), ("Bearer {}", key(5000)), ('client_secret: "{}"', "hunter22"),
        ('AWS_SECRET="{}"', "abcdefgh"), ('"password":"{}"', "hunter22"), ("'accessToken' : '{}'", "it-is\"quoted"), ("api_key={}", "AKIA" + key(16)), ("secret={}", key(42) + "=="), ('s3_secret_key_1="{}"', key(43) + "="),
    ]
    texts = [f"{words(6)} {form.format(value)} {words(4)}" for form, value in forms]
    texts += ['author: "Abcdefghij"', "mail a1b2c3d4e5f6g7@example.org", 'compass: "northeast"']
    got = secrets.find_secrets(frame(spark, texts)).collect()
    found = {(r.doc_id, r.value): r for r in got}
    for k, (_, value) in enumerate(forms):
        r = found[k, value]
        assert texts[k][r.start : r.end] == value
    assert all(found[k, forms[k][1]].is_secret for k in (2, 3, 4, 9, 10, 11))
    assert not any(r.doc_id >= len(forms) for r in got)
    assert len(secrets.candidates("a1B2" * 500_000)) == 1


def test_secret_forest_on_held_out_findings(spark):
    known = {w: 5 for w in WORDS if len(w) >= 4}
    forest = secrets.fit_forest(spark, known)
    from pyspark.ml.feature import VectorAssembler

    held = secrets.labelled_findings(sorted(known), 600, seed=77)
    table = secrets.transition_table(known)
    rows = [(*secrets.features(v, b, a, frozenset(known), table), float(y)) for v, b, a, y in held]
    data = VectorAssembler(inputCols=secrets.FEATURES, outputCol="x").transform(spark.createDataFrame(rows, [*secrets.FEATURES, "label"]))
    assert forest.transform(data).where("prediction = label").count() >= 0.93 * len(held)


# 6


def test_mixing_follows_the_schedule(spark):
    rows = [(i, "abcde"[min(4, i % 7)] if i % 11 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string").repartition(4)
    weights = {"a": 5.0, "b": 1.0, "c": 2.0}
    out = mixing.mix(df, weights, block_rows=4, period=100).collect()
    assert len(out) == len(rows)
    plan = {r.source: r for r in mixing.targets(df.groupBy("source").agg(F.count("*").alias("n")), weights, 100).collect()}
    q = 100
    assert sum(r.c for r in plan.values()) == q
    assert sorted(s for r in plan.values() for s in r.slots) == list(range(q))
    for r in plan.values():
        done = np.cumsum(np.isin(np.arange(q), r.slots))
        assert np.all(np.abs(done - np.arange(1, q + 1) * r.c / q) < 1)
        assert [s // 1 for s in r.slots] == sorted(r.slots)
    for r in out:
        p = plan[r.source]
        assert r.mix_slot == r.mix_block // p.c * q + p.slots[r.mix_block % p.c]
    blocks = {}
    for r in out:
        blocks.setdefault((r.source, r.mix_block), []).append(r.doc_id)
    assert max(map(len, blocks.values())) <= 4
    for s in plan:
        own = sorted(b for x, b in blocks if x == s)
        assert own == list(range(len(own)))


def test_mixing_edges(spark):
    df = frame(spark, ["a", "b", "b", None], [1, 2, 2, None])
    out = mixing.mix(df)
    assert out.columns == [*df.columns, "mix_block", "mix_slot"]
    assert out.count() == 4
    assert mixing.mix(empty(spark)).count() == 0
    assert mixing.mix(df, {}).count() == 4


# 7


def print_by_hand(text):
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    w = [x for x in low.replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\r", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").split(b" ") if x]
    if not w:
        return 0
    grams = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or [b" ".join(w)]
    hs = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components_by_hand(ids, prints):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    low = {}
    for i, x in enumerate(ids):
        low[find(i)] = min(low.get(find(i), x), x)
    return {x: low[find(i)] for i, x in enumerate(ids)}


def test_simhash_equals_brute_force(spark):
    texts = [None, "", "a", "a b", "A\tB", "é x y z"]
    for _ in range(12):
        t = words(120).split()
        texts.append(" ".join(t))
        for _ in range(6):
            t = list(t)
            t[RNG.randrange(len(t))] = RNG.choice(WORDS)
            texts.append(" ".join(t))
    ids = [3 * k + 1 for k in range(len(texts))]
    RNG.shuffle(ids)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op7(frame(spark, texts, ids)).collect()}
    prints = [print_by_hand(t) for t in texts]
    want = components_by_hand(ids, prints)
    assert got == {i: (f"{p:016x}", want[i]) for i, p in zip(ids, prints, strict=True)}
    assert len(set(want.values())) < len(texts) - 5
    kept = simhash.simhash_dedup(frame(spark, texts, ids))
    assert {r.doc_id for r in kept.collect()} == set(want.values())


def test_simhash_links_of_dense_buckets(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = int(rng.integers(0, 2**62))
    prints = sorted({base ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) for a, b, c in rng.integers(0, 30, (400, 3))} | {int(x) for x in rng.integers(0, 2**62, 200)})
    df = spark.createDataFrame([(i, p) for i, p in enumerate(prints)], "node long, fp long")
    want = components_by_hand(list(range(len(prints))), prints)
    got = {r.node: r.root for r in simhash.connected_components(simhash.near_links(df)).collect()}
    assert {i: got.get(i, i) for i in range(len(prints))} == want
    few = np.array(prints[:300], np.uint64)
    pairs = {tuple(sorted(x)) for x in zip(*simhash._links(few, (1 << 64) - 1, 2), strict=True)}
    monkeypatch.setattr(simhash, "PAIRWISE", 10)
    assert {tuple(sorted(x)) for x in zip(*simhash._links(few, (1 << 64) - 1, 2), strict=True)} == pairs


def test_simhash_edges(spark):
    assert simhash.op7(empty(spark)).count() == 0
    rows = frame(spark, ["a b c d", "a b c d", "e f g h", "e f g h", words(30)], [5, None, None, None, 5])
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in simhash.op7(rows).collect()) == [(-1, -1), (-1, -1), (-1, 5), (5, 5), (5, 5)]
    kept = simhash.simhash_dedup(rows)
    assert kept.columns == rows.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, -1, -1, 5]


def test_near_dedup_stage_equals_brute_force(spark):
    import corpus_pipeline

    texts = [None, "", "a b", "A  b", "a b c d e"]
    for n in (60, 120, 300):
        for _ in range(4):
            base = words(n).split()
            texts.append(" ".join(base))
            for edits in (1, 1, 2, 3, 5, 8):
                t = list(base)
                for _ in range(edits):
                    t[RNG.randrange(n)] = RNG.choice(WORDS)
                texts.append(" ".join(t))
    grams = []
    for t in texts:
        w = (t or "").lower().split()
        grams.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if grams[i] == grams[j] or len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    df = frame(spark, texts)
    kept = corpus_pipeline.near_dedup(spark, df, "")
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root))
    assert len(set(root)) < len({frozenset(g) for g in grams}) - 20
    assert corpus_pipeline.near_dedup(spark, empty(spark), "").count() == 0
    rows = frame(spark, ["a b c d", "a b c d", "e f g h", None], [5, None, 5, None])
    assert sorted(r.doc_id or -1 for r in corpus_pipeline.near_dedup(spark, rows, "").collect()) == [-1, -1, 5]


# 8

PAGE = """<html><head><title>t</title><style>x</style></head><body><div id="cookie-consent"><p>We use cookies.</p></div>
<nav><ul><li><a href=/>Home</a></li><li><a href=/a>News</a></li></ul></nav><script>var a="<p>no</p>";</script>
<div class="post-content"><h1>Big &amp; bold</h1><p>The first  part of
it.<p><b>Second part with <a href=x>a link</a> in it.<br><p>Third &lt;part&gt;.</p></div>
<div id="comments"><div class="comment"><p>I do not agree with this at all.</p></div></div><form><label>Mail</label><button>Go</button></form>
<footer><p>&copy; 2024 Someone</p></footer></body></html>"""


def test_html_blocks():
    texts = [b[0] for b in html_extract.blocks(PAGE, html_extract.Vocabulary())]
    assert texts == ["We use cookies.", "Home", "News", "Big & bold", "The first part of it.", "Second part with a link in it.", "Third <part>.", "I do not agree with this at all.", "Mail", "Go", "© 2024 Someone"]
    for odd in ("", "<", "<p", "<!-- open", "a < b", "<script>x", "</p></div>", "<p title='\">x</p>", "&#x41;&bogus;", "<a" * 2000):
        html_extract.blocks(odd, html_extract.Vocabulary())


def test_html_extraction(spark):
    sample = ["<p>" + "</p><p>".join(words(RNG.randint(3, 40)).capitalize() + "." for _ in range(12)) + "</p>" for _ in range(20)]
    pages = [PAGE, None, "", "<html></html>", *sample]
    df = spark.createDataFrame([(i, f"u{i}", p, 1, "y") for i, p in enumerate(pages)], "page_id long, url string, html string, n_blocks int, text string").repartition(2)
    got = {r.page_id: r for r in html_extract.extract(df, train_pages=700).collect()}
    assert got[0].text == "Big & bold\nThe first part of it.\nSecond part with a link in it.\nThird <part>."
    assert got[0].n_chars == len(got[0].text)
    assert all(got[k].text == "" and got[k].n_chars == 0 for k in (1, 2, 3))
    assert html_extract.extract(df.where("false"), train_pages=20).count() == 0


def test_html_labeller_on_held_out_layouts():
    model, v = html_extract.train([PAGE], 700), html_extract.Vocabulary()
    layouts, right, total = html_extract.Layouts([words(12) for _ in range(300)], seed=50), 0, 0
    for _ in range(100):
        page, labels = layouts.page()
        found = html_extract.blocks(page, v)
        if not found:
            continue
        truth = dict(reversed(labels))
        scores = model.scores([html_extract.vectors(found, v)])[0]
        right += sum((p >= 0.5) == truth.get(b[0], 0) for b, p in zip(found, scores, strict=True))
        total += len(found)
    assert right >= 0.95 * total


# 9


def test_quality(spark):
    rng = random.Random(8)
    good = [words(rng.randint(20, 300), rng).capitalize() + "." for _ in range(200)]
    bad = [" ".join(w + rng.choice(["***", "###", "&&&"]) for w in words(rng.randint(20, 200), rng).split()) for _ in range(100)] + [" ".join(w.upper() + "!!" for w in words(40, rng).split()) for _ in range(40)]
    texts = [*good, *bad, None, ""]
    df = frame(spark, texts)
    labels = spark.createDataFrame([(i, int(i < 200), 0) for i in range(340)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality_scores(df, labels).collect()}
    assert len(got) == len(texts)
    held = [i for i in range(340) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert [i for i in range(len(texts)) if got[i].held_out] == [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([got[i].predicted == (i < 200) for i in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert got[340].score == got[341].score
    kept = quality.quality_filter(df, labels)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}
    assert quality.quality_scores(empty(spark), labels).count() == 0
    assert {r.score for r in quality.quality_scores(df, labels.where("false")).collect()} == {0.5}


# 10


def test_pii_values():
    key = b"k"
    text = "mail hein.19@mail5.example.com, ip 152.143.123.131### 4785380592391139$$$ +1 (743) 555-3824%%% 123-45-6789 2024-02-29 31/12/1999 GB82 WEST 1234 5698 7654 32"
    found = []
    out = pii.pseudonymize(text, key, found)
    assert [k for k, _, _ in found] == ["email", "ip", "card", "phone", "ssn", "ymd", "dmy", "iban"]
    for _, a, z in found:
        assert text[a:z] not in out
    card = next(x for x in out.split() if x.endswith("$$$"))[:-3]
    assert pii._luhn(card[:-1]) == int(card[-1])
    same = "999.1.1.1 1234567890123456 2023-02-30 000-12-3456 v1.2.3 GB00 WEST 1234 5698 7654 32 12345"
    assert pii.pseudonymize(same, key) == same
    again = pii.pseudonymize(f"x {text[text.index('4785') :][:16]} y", key)
    assert card in again


def test_pii_beside_other_digits_and_words(spark):
    card, spaced, iban = "4111111111111111", "4111 1111 1111 1111", "BE68 5390 0754 7034"
    texts = {
        f"{card} 4000056655665556": 2, f"{card} 12": 1, f"{spaced} 123": 1, f"{spaced} {spaced}": 2, f"12 {card}": 1, f"{card} 123@example.org": 2, "7536784127813050 4845168114407329": 1,
        f"{iban} ABC": 1, f"{iban} ABCD": 1, f"{iban} ABCDE": 1, f"AB12 {iban}": 1, f"{iban} {iban} X": 2, f"{card}{card}": 0, "2353820953013749": 0,
    }
    rows = {r.doc_id: r for r in pii.op10(frame(spark, list(texts))).collect()}
    for k, (text, n) in enumerate(texts.items()):
        assert rows[k].n_values >= n if n else rows[k].n_values == 0, text
        for value in (card, spaced, iban, "4000056655665556", "7536784127813050"):
            assert not n or value not in rows[k].text, text
        assert len(rows[k].text) == len(text)


def test_feistel_is_a_permutation():
    for size in (1, 2, 3, 10, 257, 1000):
        images = [pii.permute(x, size, b"key", "t") for x in range(size)]
        assert sorted(images) == list(range(size))
        assert [pii.permute(y, size, b"key", "t", inverse=True) for y in images] == list(range(size))
    dates = {pii._date(f"2024-{m:02d}-{d:02d}", lambda x, n, t: pii.permute(x, n, b"k", t)) for m in range(1, 13) for d in range(1, 29)}
    assert len(dates) == 12 * 28


def test_pii_table(spark):
    df = frame(spark, ["a 152.143.123.131", None, "", "same 152.143.123.131!"], [1, None, 2, 2])
    out = pii.pseudonymize_table(df)
    assert out.columns == df.columns
    texts = [r.text for r in out.orderBy("n_chars").collect()]
    assert texts[:2] in ([None, ""], ["", None])
    a, b = texts[2], texts[3]
    assert a.split()[1] == b.split()[1].rstrip("!") != "152.143.123.131"
    assert pii.op10(empty(spark)).count() == 0
