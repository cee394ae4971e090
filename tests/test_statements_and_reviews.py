"""Statement deduplication, terms of several words and the fold of review actions, against plain loops."""

import random
import re

from docspark.operators import compliance, dedup, workflow


def shingle_sets(texts):
    out = []
    for t in texts:
        w = re.sub(r"[^a-z0-9]+", " ", t.lower()).strip().split(" ")
        out.append({" ".join(w[k : k + 5]) for k in range(len(w) - 4)} or {" ".join(w)})
    return out


def kept_by_hand(texts, threshold=0.8):
    sets, kept = shingle_sets(texts), set()
    for a, t in enumerate(texts):
        better = [b for b, o in enumerate(texts) if (len(o), -b) > (len(t), -a) and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold]
        if not better:
            kept.add(a)
    return kept


def statements(rng):
    words = [f"w{k}" for k in range(300)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(60)]
    base = rng.choices(words, k=80)
    for _ in range(120):
        t = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
            t[rng.randrange(80)] = rng.choice(words)
        texts.append(" ".join(t) + rng.choice(["", ".", "!!"]))
    return texts


def test_statements_equal_brute_force(spark):
    texts = statements(random.Random(4))
    df = spark.createDataFrame([(k, t, f"s{k % 2}") for k, t in enumerate(texts)], "doc_id long, text string, source string").repartition(4)
    got = {r.doc_id for r in dedup.dedup_statements(df).collect() if r.kept}
    assert got == kept_by_hand(texts) and len(got) < len(texts) - 40
    assert {r.doc_id for r in dedup.dedup_statements(df, source_col="source").collect() if r.kept} == got


def test_the_gate(spark):
    rows = [(k, "the very same words stand here", f"s{k % 2}") for k in range(6)]
    schema = "doc_id long, text string, source string"
    kept = lambda rows: sum(r.kept for r in dedup.dedup_statements(spark.createDataFrame(rows, schema), source_col="source").collect())
    assert kept(rows) == 1
    assert kept(rows[:5]) == 5  # too few
    assert kept([(k, t, "one") for k, t, _ in rows]) == 6  # one source only


def test_pairs_grow_with_the_members_of_a_group(spark):
    rng, found = random.Random(8), []
    for m in (100, 400):
        base = [f"w{k}" for k in range(200)]
        texts = [" ".join([*base[: 20 + k % 7], f"own{k}", *base[20 + k % 7 :], *rng.choices(base, k=2)]) for k in range(m)]
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
        sets = dedup.shingles(df).groupBy("doc_id").agg({"g": "collect_set"}).toDF("doc_id", "s")
        classes = sets.selectExpr("xxhash64(sort_array(s)) AS cls", "sort_array(s) AS s", "struct(size(s), -doc_id) AS best").checkpoint()
        prefix = dedup.rare_prefixes(classes, 0.8).checkpoint()
        first = dedup.leader_pairs(prefix, 0.8).checkpoint()
        beaten = dedup._similar(first, classes, 0.8)
        found.append(first.count() + dedup.other_pairs(prefix, beaten, 0.8).count())
        assert {r.doc_id for r in dedup.dedup_statements(df).collect() if r.kept} == kept_by_hand(texts)
    assert found[0] < 100 * 8 and found[1] < 5 * found[0]


def test_terms_of_several_words(spark):
    rng = random.Random(1)
    vocabulary = ["credit", "agreement", "Agreement", "loan", "the", "of", "é", "x9"]
    pages = [(d, p, "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "-"]) for _ in range(rng.randint(0, 40)))) for d in range(6) for p in (1, 2, 3)]
    terms = {f"r{k}": [" ".join(rng.choices(vocabulary, k=rng.randint(1, 4))) for _ in range(rng.randint(1, 3))] for k in range(12)} | {"none": ["...", ""], "odd": ["Credit  AGREEMENT!", "loa"]}
    norm = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    reqs = spark.createDataFrame([("b", r, t) for r, t in terms.items()], "baseline_id string, requirement_id string, terms array<string>")
    texts = spark.createDataFrame(pages, "doc_id int, page_number int, text string")
    chosen = spark.createDataFrame([(d, "b") for d in range(6)], "doc_id int, baseline_id string")
    for most in (100_000, 0):  # by broadcast and by shuffle
        compliance.broadcast_if_small, kept = (lambda df, most=most: __import__("docspark.operators.shared", fromlist=["x"]).broadcast_if_small(df, most)), compliance.broadcast_if_small
        try:
            rows = compliance.evaluate_requirements(chosen, reqs, texts).collect()
            cells = {(r.requirement_id, r.doc_id, r.page_number): r.found for r in compliance.candidate_pages(reqs, texts).collect()}
        finally:
            compliance.broadcast_if_small = kept
        assert len(rows) == 6 * len(terms)
        for r in rows:
            wanted = {norm(t) for t in terms[r.requirement_id]} - {""}
            held = {t: [p for d, p, text in pages if d == r.doc_id and f" {t} " in f" {norm(text)} "] for t in wanted}
            n = sum(bool(x) for x in held.values())
            assert r.verdict == ("NOT_FOUND" if not n else "PASS" if n == len(wanted) else "PARTIAL")
            assert (r.page_references or []) == sorted({p for x in held.values() for p in x})
            assert bool(r.evidence) == bool(n) and (not n or any(f" {t} " in f" {norm(r.evidence)} " for t in wanted))
            for p in r.page_references or []:
                assert cells[r.requirement_id, r.doc_id, p] == sum(p in x for x in held.values())


def folded_by_hand(version, status, review, actions):
    log = []
    for ts, i, action, expected, notes in sorted(actions, key=lambda a: a[:2]):
        why = None
        if action == "reprocess":
            status, review = "REPROCESSING", "PENDING_REVIEW"
        elif action not in workflow.VERSIONED:
            why = "unknown action"
        elif action == "reject" and not (notes or "").strip():
            why = "notes missing"
        elif expected != version:
            why = "stale version"
        else:
            version, review = version + 1, workflow.VERSIONED[action]
        log.append((i, action, why))
    return (version, status, review), [x for x in log if x[2]]


def test_review_actions_in_order(spark):
    rng = random.Random(3)
    docs = [(d, "PROCESSED", "PENDING_REVIEW", rng.randint(0, 2)) for d in range(40)]
    acts = [(rng.randint(0, 44), rng.randint(0, 9), k, rng.choice(["approve", "reject", "correct", "reprocess", "delete", None]), rng.choice([0, 1, 2, 3, None]), rng.choice(["why", " ", None])) for k in range(400)]
    d = spark.createDataFrame(docs, "document_id long, status string, review_status string, version int")
    a = spark.createDataFrame(acts, "document_id long, ts long, action_id long, action string, expected_version int, notes string")
    want = {k: folded_by_hand(v, s, r, [x[1:] for x in acts if x[0] == k]) for k, s, r, v in docs}
    assert {r.document_id: (r.version, r.status, r.review_status) for r in workflow.apply_review_actions(d, a).collect()} == {k: w[0] for k, w in want.items()}
    rejected = {(r.document_id, r.action_id, r.action, r.reason) for r in workflow.rejected_actions(d, a).collect()}
    lost = {(x[0], x[2], x[3], "unknown document") for x in acts if x[0] >= 40}
    assert rejected == {(k, *x) for k, w in want.items() for x in w[1]} | lost
    one = spark.createDataFrame([(1, "PROCESSED", "APPROVED", 0)], d.schema)
    again = workflow.apply_review_actions(one, spark.createDataFrame([(1, 1, 1, "reprocess", None, None)], a.schema)).first()
    assert (again.status, again.version) == ("REPROCESSING", 0)
