"""Conversation structure repair: the cheapest edits to a legal order of roles, by a checkpointed DP.

Conversations are damaged by rule, their faults are named, and edits (keep, rerole, delete, insert) turn
the rows into ``system?`` followed by pairs of user and assistant. The DP runs backward over the rows with
one cost for each state of that grammar; walking forward, the ASCII-least edit that keeps to the remaining
cost is taken, so the edits are tight and unique.

No vector is stored for every row. The sorted rows are cut into blocks of at most ``BLOCK`` rows (and
``BLOCK_CHARS`` characters) of a conversation, wherever they lie; each block gives one min-plus matrix of
the cost between states. Folding the matrices backward gives the cost vector at the end of each block, a
checkpoint. Inside a block vectors are stored at every ceil(sqrt(rows)) rows only, and the stretch between
two is computed again while the edits are walked forward. A task so holds one block and some 2 sqrt(rows)
vectors, however long the conversation; a short conversation is one block.

Skew: equal rows are counted together before they are sorted, rows are dealt by ranges of conversation,
turn, role and text, so a huge conversation lies in many tasks; only 16 numbers a block go through one
task backward, and the blocks stream through one task forward, one at a time, as a SHA-256 of the whole
conversation admits no other order. The audit of a conversation, a letter an edit, is one value.

Defined cases: a null role or text is one space; a null conversation id is a conversation, a null turn
comes first; both are one space where the damage is drawn. Rows of one turn are ordered by role and text.
Repeated rows count each and are duplicates of the first. Roles are judged by their first character, the
empty role has none and cannot be kept. Conversations that lose all rows have zeros, an empty audit and
the hash of nothing. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm._common import materialize

BLOCK, BLOCK_CHARS = 4096, 4 << 20
#: What the edits cost. A truncated row that stays costs PENALTY on top.
REROLE, DELETE, INSERT, PENALTY = 3, 4, 3, 3
INF = 1 << 60
#: States: nothing yet, after the system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a row of the role that may be put next, and that role.
NEXT, PUT = (USER, USER, ASSISTANT, USER), ("user", "user", "assistant", "user")
#: The state after a row that is kept, by the initial of its role; -1 where it cannot be.
KEPT = {"s": (SYSTEM, -1, -1, -1), "u": (USER, USER, -1, USER), "a": (-1, -1, ASSISTANT, -1)}
NO = (-1, -1, -1, -1)
LEGAL = {"su", "ua", "au"}
BLANK, DUPLICATE, TRUNCATED, SOUND = "b", "d", "t", "-"


def closed(v: list[int]) -> list[int]:
    """The costs where rows may still be inserted first."""
    u, a = min(v[USER], INSERT + v[ASSISTANT]), min(v[ASSISTANT], INSERT + v[USER])
    return [min(v[START], INSERT + u), min(v[SYSTEM], INSERT + u), u, a]


def before(v: list[int], initial: str, fault: str, copies: int) -> list[int]:
    """The costs in front of a row and its further copies, from those behind them."""
    v = [x + DELETE * (copies - 1) for x in v]
    out = [x + DELETE for x in v]
    if fault not in (BLANK, DUPLICATE):
        stays, kept = PENALTY * (fault == TRUNCATED), KEPT.get(initial, NO)
        for q in range(4):
            if kept[q] >= 0:
                out[q] = min(out[q], stays + v[kept[q]])
            out[q] = min(out[q], REROLE + stays + v[NEXT[q]])
    return closed(out)


def matrix(rows: list[tuple[str, str, int]]) -> list[int]:
    """Cost from each state in front of the rows to each behind them, as 16 numbers."""
    columns = []
    for end in range(4):
        v = closed([0 if q == end else INF for q in range(4)])
        for row in reversed(rows):
            v = before(v, *row)
        columns.append(v)
    return [min(INF, columns[end][q]) for q in range(4) for end in range(4)]


def through(m: list[int], after: list[int]) -> list[int]:
    return [min(m[4 * q + end] + after[end] for end in range(4)) for q in range(4)]


def walk(rows: list[tuple[str, str, int]], after: list[int], q: int) -> Iterator[tuple[str, int, int]]:
    """The edits of a block from state ``q`` on: (initial, row, state after it). ``after``: the costs behind it."""
    n = len(rows)
    step = isqrt(max(0, n - 1)) + 1
    marks, v = {n: after}, after
    for i in range(n - 1, -1, -1):
        v = before(v, *rows[i])
        if i % step == 0:
            marks[i] = v
    for low in range(0, n, step):
        high = min(n, low + step)
        stretch = [marks[high]]
        for i in range(high - 1, low - 1, -1):
            stretch.append(before(stretch[-1], *rows[i]))
        for i in range(low, high):
            here, (initial, fault, copies) = stretch[high - i], rows[i]
            rest = [x + DELETE * (copies - 1) for x in stretch[high - i - 1]]
            stays, kept = PENALTY * (fault == TRUNCATED), KEPT.get(initial, NO)
            while here[q] != DELETE + rest[q] and here[q] == INSERT + here[NEXT[q]]:
                q = NEXT[q]
                yield "I", i, q
            if here[q] == DELETE + rest[q]:
                yield "D", i, q
            elif kept[q] >= 0 and here[q] == stays + rest[kept[q]]:
                q = kept[q]
                yield "K", i, q
            else:
                q = NEXT[q]
                yield "R", i, q
            for _ in range(copies - 1):
                yield "D", i, q


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): equal rows together; rows that are dropped have no copies."""
    spoken = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), spoken("role").alias("role"), spoken("text").alias("text"))
    kind = F.crc32(F.concat_ws(":", spoken("conv_id"), spoken("turn")).cast("binary")) % 20
    rows = rows.withColumn("kind", kind)
    role = F.when(F.col("kind") == 0, "").when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("kind") <= 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies")).groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))


def faults(rows: DataFrame) -> DataFrame:
    """``rows`` with the fault of the first of their copies; the further ones are blank or duplicates."""
    rows = rows.withColumn("digest", F.sha2("text", 256)).withColumn("order", F.struct(F.col("turn").isNotNull().alias("known"), "turn"))
    first = rows.where("copies > 0").groupBy("conv_id", "role", "digest").agg(F.min("order").alias("first"))
    first = first.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    rows = rows.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    fault = (
        F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK)
        .when(~F.col("order").eqNullSafe(F.col("first")), DUPLICATE)
        .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), TRUNCATED)
        .otherwise(SOUND)
    )
    return rows.select("conv_id", "turn", "role", "text", "copies", fault.alias("fault"))


BLOCKS = "conv_id long, seq long, turns array<long>, roles array<string>, texts array<string>, faults array<string>, copies array<long>, costs array<long>"
BLOCK_SCHEMA = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("faults", pa.list_(pa.string())), ("copies", pa.list_(pa.int64())), ("costs", pa.list_(pa.int64()))])


def _coded(roles: list[str], found: list[str], copies: list[int]) -> list[tuple[str, str, int]]:
    return [(r[:1], f, n) for r, f, n in zip(roles, found, copies, strict=True)]


def _blocks(most_rows: int):
    """Cuts a sorted partition into blocks of one conversation; seq is their order in the whole table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, conv, own, size = TaskContext.get().partitionId() << 33, 0, None, [], 0

        def block() -> list:
            turns, roles, texts, copies, found = (list(x) for x in zip(*own, strict=True))
            return [conv, part + seq, turns, roles, texts, found, copies, matrix(_coded(roles, found, copies))]

        for batch in batches:
            done, chars = [], 0
            for c, *row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if own and (c != conv or len(own) >= most_rows or size >= BLOCK_CHARS):
                    done.append(block())
                    own, size, seq = [], 0, seq + 1
                conv = c
                if row[3]:  # a dropped row leaves its conversation only
                    own.append(row)
                    size += len(row[2])
                    chars += len(row[2])
                elif not own:
                    done.append([c, part + seq, [], [], [], [], [], matrix([])])
                    seq += 1
                if chars >= BLOCK_CHARS:
                    yield _batch(done, BLOCK_SCHEMA)
                    done, chars = [], 0
            yield _batch(done, BLOCK_SCHEMA)
        if own:
            yield _batch([block()], BLOCK_SCHEMA)

    return run


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


END = closed([0, INF, INF, 0])


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The checkpoints: the costs behind each block, from blocks that come last first."""
    schema, conv, v = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("after", pa.list_(pa.int64()))]), object(), END
    for batch in batches:
        out = []
        for c, seq, m in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if c != conv:
                conv, v = c, END
            out.append((c, seq, v))
            v = through(m, v)
        yield _batch(out, schema)


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
RESULT_SCHEMA = pa.schema([("conv_id", pa.int64()), *((x, pa.int64()) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])


class Repair:
    """The running state of one conversation."""

    def __init__(self, conv: int | None):
        self.conv, self.q, self.cost, self.audit, self.hash, self.lines = conv, START, None, [], hashlib.sha256(), 0
        self.low = self.high = self.turn = self.initial = None
        self.turns, self.illegal, self.count = 0, 0, {BLANK: 0, DUPLICATE: 0, TRUNCATED: 0, SOUND: 0}

    def line(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
        self.lines += 1

    def block(self, after: list[int], turns: list, roles: list[str], texts: list[str], found: list[str], copies: list[int], costs: list[int]) -> None:
        rows = _coded(roles, found, copies)
        if self.cost is None:
            self.cost = through(costs, after)[START]
        for turn, (initial, fault, n) in zip(turns, rows, strict=True):
            if turn is not None:
                self.turns += turn != self.turn
                self.low, self.high, self.turn = turn if self.low is None else self.low, turn, turn
            self.count[fault] += 1
            self.count[BLANK if fault == BLANK else DUPLICATE] += n - 1
            self.illegal += (self.initial is not None and self.initial + initial not in LEGAL) + (n - 1)
            self.initial = initial
        edits = []
        for edit, i, q in walk(rows, after, self.q):
            edits.append(edit)
            if edit == "K":
                self.line(roles[i], texts[i])
            elif edit != "D":
                self.line(PUT[self.q], texts[i] if edit == "R" else "")
            self.q = q
        self.audit.append("".join(edits))

    def result(self) -> list:
        while self.q not in (START, ASSISTANT):
            self.line(PUT[self.q], "")
            self.audit.append("I")
            self.q = NEXT[self.q]
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return [self.conv, gaps, self.count[BLANK], self.count[DUPLICATE], self.count[TRUNCATED], self.illegal, self.cost or 0, "".join(self.audit), self.hash.hexdigest()]


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in order, each behind its checkpoint."""
    state, after = None, None
    for batch in batches:
        done = []
        for k in range(batch.num_rows):
            conv, _, checkpoint, *block = (x[k].as_py() for x in batch.columns)
            if state is None or conv != state.conv:
                if state:
                    done.append(state.result())
                state = Repair(conv)
            if checkpoint is not None:
                after = checkpoint
            else:
                state.block(after, *block)
        yield _batch(done, RESULT_SCHEMA)
    if state:
        yield _batch([state.result()], RESULT_SCHEMA)


def repair(rows: DataFrame, block_rows: int = BLOCK) -> DataFrame:
    """Repairs of ``rows``, which are as those of ``damaged``: one row per conversation."""
    prefix = F.substring("text", 1, 64)
    dealt = faults(rows).repartitionByRange("conv_id", "turn", "role", prefix).sortWithinPartitions("conv_id", "turn", "role", "text")
    blocks = materialize(dealt.select("conv_id", "turn", "role", "text", "copies", "fault").mapInArrow(_blocks(block_rows), BLOCKS))
    ends = blocks.select("conv_id", "seq", "costs").repartition("conv_id").sortWithinPartitions("conv_id", F.col("seq").desc())
    checkpoints = ends.mapInArrow(_folded, "conv_id long, seq long, after array<long>")
    both = blocks.withColumn("after", F.lit(None).cast("array<long>")).unionByName(checkpoints, allowMissingColumns=True)
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", "seq", F.col("after").isNull())
    return both.select("conv_id", "seq", "after", "turns", "roles", "texts", "faults", "copies", "costs").mapInArrow(_repaired, RESULT)


def op13(conversations: DataFrame) -> DataFrame:
    return repair(damaged(conversations))


#: The same by a forward DP over (cost, audit, lines), row after row; checksums by their table.
OP13_SQL = r"""WITH RECURSIVE tab AS (SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: xor(c >> 1, (c & 1) * 3988292384)) ORDER BY n) AS crc FROM range(256) r(n)),
  src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT) AS bytes FROM conversations),
  d AS (SELECT conv_id, turn, role, text, xor(list_reduce([4294967295::BIGINT] || bytes, lambda c, b: xor(crc[xor(c & 255, b) + 1], c >> 8)), 4294967295) % 20 AS k FROM src, tab),
  e AS (SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE k WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM d WHERE k <> 0), g AS (SELECT *, row_number() OVER () AS id FROM e),
  o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, id) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, id) AS nth, left(role, 1) AS r FROM g),
  f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN nth > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '-' END AS fault, lag(r) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
  put(q, q2, role) AS (VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')),
  ins(q, q2, c, a, t) AS (SELECT q, q, 0, '', []::VARCHAR[] FROM put UNION ALL SELECT q, q2, 3, 'I', [role || ':'] FROM put UNION ALL VALUES (0, 3, 6, 'II', ['user:', 'assistant:']), (1, 3, 6, 'II', ['user:', 'assistant:'])),
  kept(q, r, q2) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
  ed(conv_id, i, q, q2, c, a, t) AS (SELECT conv_id, i, q, q, 4, 'D', []::VARCHAR[] FROM f, put
    UNION ALL SELECT conv_id, i, q, q2, CASE fault WHEN 't' THEN 3 ELSE 0 END, 'K', [role || ':' || text] FROM f JOIN kept USING (r) WHERE fault IN ('t', '-')
    UNION ALL SELECT conv_id, i, q, q2, CASE fault WHEN 't' THEN 6 ELSE 3 END, 'R', [put.role || ':' || text] FROM f, put WHERE fault IN ('t', '-')),
  dp(conv_id, i, q, m) AS (SELECT DISTINCT conv_id, 0::BIGINT, 0, {'c': 0, 'a': '', 't': []::VARCHAR[]} FROM conversations
    UNION ALL SELECT dp.conv_id, dp.i + 1, ed.q2, min({'c': m.c + ins.c + ed.c, 'a': m.a || ins.a || ed.a, 't': m.t || ins.t || ed.t}) FROM dp JOIN ins ON ins.q = dp.q JOIN ed ON ed.conv_id IS NOT DISTINCT FROM dp.conv_id AND ed.i = dp.i + 1 AND ed.q = ins.q2 GROUP BY ALL),
  n AS (SELECT c.conv_id, count(i) AS n, coalesce(max(f.turn) - min(f.turn) + 1 - count(DISTINCT f.turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (before || r NOT IN ('su', 'ua', 'au')) AS illegal FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM c.conv_id GROUP BY 1),
  best AS (SELECT n.*, min({'c': m.c + ins.c, 'a': m.a || ins.a, 't': m.t || ins.t}) AS x FROM n JOIN dp ON dp.conv_id IS NOT DISTINCT FROM n.conv_id AND dp.i = n.n JOIN ins ON ins.q = dp.q WHERE ins.q2 IN (0, 3) GROUP BY ALL)
SELECT conv_id, gaps, blank, duplicate, truncated, illegal, x.c::BIGINT AS cost, x.a AS audit, sha256(array_to_string(x.t, chr(10))) AS repaired_sha256 FROM best"""
