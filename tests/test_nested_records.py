"""Encryption at paths, and nested JSON of any depth, on records made to be awkward."""

import json
import random

from pyspark.sql import functions as F

from docspark.operators import extraction, privacy, records

PATHS = ["owner.ids[*].ssn", "owner.ids[*].lots[*][*]", "tags[*]", "amount", "owner.nothing", "owner.ids"]
SCHEMA = "id int, owner struct<name:string,ids:array<struct<ssn:string,lots:array<array<int>>>>>, tags array<string>, amount double"


def key(text=b"0123456789abcdef"):
    return F.lit(text)


def people(spark):
    return spark.createDataFrame(
        [
            (1, ("a", [("1-1", [[1, 2], []]), ("1-2", None), (None, [[3, None]])]), ["x", None, "[ENCRYPTED]"], 1.5),
            (2, ("b", None), [], None),
            (3, None, None, 0.0),
            (4, ("d", []), ["", "é"], -2.0),
        ],
        SCHEMA,
    )


def as_json(df):
    return {r.id: json.loads(r.j) for r in df.select("id", F.to_json(F.struct(*[c for c in df.columns if c != "id"])).alias("j")).collect()}


def test_round_trip_over_lists(spark):
    df = people(spark)
    once = privacy.encrypt_paths(df, PATHS[:1], key()).checkpoint()
    sealed = privacy.encrypt_paths(once, PATHS, key()).checkpoint()
    rows = as_json(sealed)
    assert rows[1]["owner"] == {"name": "a", "ids": [{"ssn": "[ENCRYPTED]", "lots": [["[ENCRYPTED]", "[ENCRYPTED]"], []]}, {"ssn": "[ENCRYPTED]"}, {"lots": [["[ENCRYPTED]", None]]}]}
    assert set(rows[1]["envelope"]) == {"owner.ids[0].ssn", "owner.ids[1].ssn", "owner.ids[0].lots[0][0]", "owner.ids[0].lots[0][1]", "owner.ids[2].lots[0][0]", "tags[0]", "tags[2]", "amount"}
    assert rows[1]["envelope"]["owner.ids[1].ssn"] == as_json(once)[1]["envelope"]["owner.ids[1].ssn"]
    assert rows[2] == {"owner": {"name": "b"}, "tags": [], "envelope": {}} and set(rows[3]["envelope"]) == {"amount"}
    again = privacy.encrypt_paths(sealed, PATHS, key())
    assert as_json(again) == rows
    wrong = privacy.decrypt_paths(sealed, PATHS, key(b"fedcba9876543210"))
    assert as_json(wrong) == rows
    back = privacy.decrypt_paths(wrong, PATHS, key(), {"owner.ids[*].lots[*][*]": "int", "amount": "double"})
    assert all(not r["envelope"] for r in as_json(back).values())
    assert as_json(back.drop("envelope")) == as_json(df) and back.drop("envelope").schema.simpleString() == df.schema.simpleString()


def test_a_part_of_the_paths_is_opened(spark):
    sealed = privacy.encrypt_paths(people(spark), PATHS, key())
    part = as_json(privacy.decrypt_paths(sealed, ["tags[*]"], key()))[1]
    assert part["tags"] == ["x", None, "[ENCRYPTED]"] and "tags[0]" not in part["envelope"] and "owner.ids[0].ssn" in part["envelope"]
    assert privacy.encrypt_paths(people(spark), ["owner.nothing"], key()).first().envelope == {}
    assert privacy.encrypt_paths(people(spark).where("false"), PATHS, key()).count() == 0


def leaves_by_hand(v, path="", hidden=False):
    if isinstance(v, dict):
        for k, x in v.items():
            yield from leaves_by_hand(x, f"{path}.{k}" if path else k, hidden or k.startswith("_"))
    elif isinstance(v, list):
        for k, x in enumerate(v):
            yield from leaves_by_hand(x, f"{path}[{k}]", hidden)
    elif v not in (None, "") and not hidden and path:
        yield path, str(v)


def some_json(rng, depth):
    if depth == 0 or rng.random() < 0.2:
        return rng.choice([1, "x", "", None, 7])
    if rng.random() < 0.4:
        return [some_json(rng, depth - 1) for _ in range(rng.randint(0, 2))]
    return {rng.choice(["a", "b", "_c", "d"]): some_json(rng, depth - 1) for _ in range(rng.randint(0, 3))}


def test_leaves_at_any_depth(spark):
    rng, chain = random.Random(2), 5
    for k in range(30):
        chain = {"k": chain} if k % 3 else [0, chain]
    docs = [some_json(rng, rng.randint(1, 20)) for _ in range(60)] + [chain, {}, [], "text"]
    df = spark.createDataFrame([(k, json.dumps(d)) for k, d in enumerate(docs)] + [(900, "no json {"), (901, None)], "doc_id int, j string")
    got = sorted((r.doc_id, r.path, r.value) for r in records.leaf_paths(df, "j").collect())
    assert got == sorted((k, *leaf) for k, d in enumerate(docs) for leaf in leaves_by_hand(d))
    assert max(p.count(".") + p.count("[") for _, p, _ in got) >= 25
    few = sorted((r.doc_id, r.path) for r in records.leaf_paths(df, "j", 3).collect())
    assert few == [(k, p) for k, p, _ in got if p.replace("[", ".").lstrip(".").count(".") < 3]


def test_trees_at_any_depth(spark):
    rng = random.Random(6)

    def tree(depth):
        return [{"title": f"t{rng.randint(0, 99)}", **({"nodes": tree(depth - 1)} if rng.random() < 0.8 else {})} for _ in range(rng.randint(1, 2))] if depth else []

    def preorder(nodes, path=""):
        for k, n in enumerate(nodes, 1):
            yield f"{path}{k:03d}", n["title"]
            yield from preorder(n.get("nodes", []), f"{path}{k:03d}.")

    chain = [{"title": "end"}]
    for k in range(25):
        chain = [{"title": f"c{k}", "nodes": chain}]
    trees = [tree(9) for _ in range(8)] + [chain, [], [{"title": "x", "nodes": []}] * 1100]
    df = spark.createDataFrame([(k, json.dumps(t)) for k, t in enumerate(trees)] + [(99, "broken ["), (98, None)], "doc_id int, tree string")
    got = sorted((r.doc_id, r.path, r.title) for r in extraction.flatten_tree(df).collect())
    assert got == sorted((k, *n) for k, t in enumerate(trees) for n in preorder(t))
    assert len([1 for k, _, _ in got if k == 8]) == 26
