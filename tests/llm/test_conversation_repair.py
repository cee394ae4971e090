"""Conversation repair against a search over all short edits, a plain forward DP, and its SQL."""

import hashlib
import heapq
import random
import re
import zlib

import duckdb
import pytest

from docspark.llm import conversation_repair as cr

RNG = random.Random(13)
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def damaged_by_hand(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 1:
            text = ""
        if k == 2:
            text = re.sub("[.!?]", "", text)
        if k == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(k, 1)
    return out


def faults_by_hand(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]+$", "", text)
        out.append("b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "-")
        seen.add((role, text))
    return out


def repair_by_hand(rows):
    """Dijkstra over (cost, audit): the first state to end is the cheapest, and the least among equals."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    found, heap, done = faults_by_hand(rows), [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, q, lines = heapq.heappop(heap)
        if i == len(rows) and q in ("", "a"):
            break
        if (i, q) in done:
            continue
        done.add((i, q))
        put = {"u": "user", "a": "assistant"}[NEXT[q]]
        heapq.heappush(heap, (cost + 3, audit + "I", i, NEXT[q], (*lines, f"{put}:")))
        if i < len(rows):
            role, text, fault = rows[i][2], rows[i][3], found[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, q, lines))
            if fault in "t-":
                more = 3 * (fault == "t")
                heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, NEXT[q], (*lines, f"{put}:{text}")))
                if role[:1] and (role[:1] == NEXT[q] or (role[:1], q) == ("s", "")):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[:1], (*lines, f"{role}:{text}")))
    turns = [r[1] for r in rows if r[1] is not None]
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(found.count(f) for f in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, seq int, costs string").repartition(4)


def some_rows(convs, longest):
    rows = []
    for c in range(convs):
        for k in range(RNG.randint(1, longest)):
            turn = RNG.choice([k, k, k, k + 2, None])
            rows.append((c, turn, RNG.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), RNG.choice(["Yes.", "No!", "why", "", " \n", None, f"text {k}.", f"text {k}. ", f"cut {k}", "é?\x0b"])))
    lost = next(c for c in range(100, 10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    return [*rows, (lost, 0, "user", "Gone."), (None, 0, "user", "Hi."), (None, None, "assistant", "Hello."), (10**12, -5, "systematic", "x.")]


def result(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("block", [1, 3, cr.BLOCK])
def test_repair_equals_a_search(spark, block):
    rows = some_rows(60, 14)
    got = result(cr.repair(cr.damaged(table(spark, rows)), block))
    kept = damaged_by_hand(rows)
    assert got == {c: repair_by_hand([r for r in kept if r[0] == c]) for c in {r[0] for r in rows}}
    assert any(v[6] == "" for v in got.values()) and any("I" in v[6] for v in got.values()) and any("R" in v[6] for v in got.values())


def test_one_long_conversation_over_many_tasks(spark):
    rows = [(c, k // 2 if c == 1 else k, RNG.choice(["user", "assistant", "system"]), RNG.choice(["Same.", f"t {k}.", f"t {k}"])) for c, n in ((0, 5), (1, 3000), (2, 4)) for k in range(n)] + [(1, 7, "user", "Again.")] * 500
    got = result(cr.repair(cr.damaged(table(spark, rows)), 64))
    kept = damaged_by_hand(rows)
    assert got == {c: repair_by_hand([r for r in kept if r[0] == c]) for c in range(3)}


def test_walk_stores_few_vectors():
    rows = [(RNG.choice("sua"), RNG.choice("-t"), 1) for _ in range(900)]
    edits = "".join(e for e, _, _ in cr.walk(rows, cr.END, cr.START))
    assert len(edits) >= 900 and cr.through(cr.matrix(rows), cr.END)[cr.START] > 0
    for cut in (1, 450, 899):  # in two blocks, with the checkpoint between them
        after = cr.through(cr.matrix(rows[cut:]), cr.END)
        first = list(cr.walk(rows[:cut], after, cr.START))
        assert "".join(e for e, _, _ in first) + "".join(e for e, _, _ in cr.walk(rows[cut:], cr.END, first[-1][2])) == edits


def test_empty_table_and_sql(spark):
    assert cr.op13(table(spark, [(1, 0, "user", "x")]).where("false")).count() == 0
    con = duckdb.connect()
    con.execute("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.01/conversations.parquet'")
    df = cr.op13(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet"))
    columns = sorted(df.columns)
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({cr.OP13_SQL})").fetchall())
