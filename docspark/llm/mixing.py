"""Mixing sources to target weights by Pfair scheduling.

Rows of a source form blocks of ``block_rows``. Over a period of Q slots, source s has c_s slots,
its target weight in units of 1/Q. Its k-th block (from 0) is released at floor(k Q / c_s) and due
at ceil((k+1) Q / c_s); in every slot the released block with the earliest deadline runs, so at any
time each source is less than one block away from its exact share. The schedule repeats after Q
slots, so it is found once, and every block then reads its slot from it: block k of source s runs in
slot (k div c_s) Q + slot_s[k mod c_s]. A source that runs out leaves its later slots empty; all rows
are kept, and the order by slot is the mix.

DataFrame functions only. A source of any size is dealt to groups of about ``GROUP_BLOCKS`` blocks
by a mixed value of the row's id, and blocks are numbered through groups, so no source is ever one
task. Sources with as many slots have the same windows and take turns in order, so earliest deadline
first is a fold over the slots whose state is one counter for each different number of slots: N
sources have at most 4 sqrt(N) of them, as their slots add up to Q = max(period, 8 N). Shares and
schedule are made of the table of sources, one row each, never of their rows. That table and the
schedule (Q rows) are broadcast up to ``BROADCAST_ROWS`` rows and joined by shuffle beyond.

Defined cases: a null source is a source of its own. Target weights that are given count for the
sources named; others (and null or non-positive weights) weigh nothing but still get one slot a
period, as all rows are kept. Without given weights a source weighs the square root of its rows.
Ties and repeated rows get places side by side; which of equal rows comes first is not defined.
A null id counts as 0 when rows are dealt out. An empty table gives no rows. Extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docspark.llm._common import fresh

PERIOD, BLOCK_ROWS, GROUP_BLOCKS = 1000, 16, 64
BROADCAST_ROWS = 100_000
#: Slots that the fold gathers before it appends them, so that appending stays cheap.
STRETCH = 1000


def _group(id_col: Column, n: Column) -> Column:
    """A group from 0 to n - 1 by the id, mixed so that regular ids spread."""
    return F.pmod(F.shiftright(F.pmod(F.coalesce(id_col.cast("long"), F.lit(0)), F.lit(2**31)) * F.lit(2654435761), 12), n)


def shares(sizes: DataFrame, weights: dict[str, float] | None = None, period: int = PERIOD) -> DataFrame:
    """(number, source, n, c, period): each source's number of slots within the period.

    ``sizes`` has source and n. c is 1 and the source's part of the other slots by its weight, the
    rest dealt by largest remainder, ties by source.
    """
    if weights is None:
        w = F.sqrt(F.col("n"))
    else:
        w = F.lit(0.0)
        for name, x in weights.items():
            w = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(x))).otherwise(w)
        w = F.greatest(F.coalesce(w, F.lit(0.0)), F.lit(0.0))
    rows = sizes.select("source", "n", w.alias("w"))
    # Added in order of size, so that the same sources always give the same sum.
    facts = rows.agg(F.count("*").alias("k"), F.aggregate(F.sort_array(F.collect_list("w")), F.lit(0.0), lambda a, x: a + x).alias("total"))
    rows = rows.join(facts.select("k", "total", F.greatest(F.lit(period), 8 * F.col("k")).cast("long").alias("period")))
    share = F.when(F.col("total") > 0, (F.col("period") - F.col("k")) * F.col("w") / F.col("total")).otherwise(F.lit(0.0))
    rows = rows.withColumn("share", share).withColumn("low", F.floor("share").cast("long"))
    rows = rows.withColumn("number", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_first())) - 1)
    by_rest = Window.orderBy(-F.round(F.col("share") - F.col("low"), 9), "number")
    rows = rows.withColumns({"rank": F.row_number().over(by_rest) - 1, "rest": F.col("period") - F.col("k") - F.sum("low").over(by_rest.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    # The rest goes around more than once only if no source weighs anything.
    c = 1 + F.col("low") + F.when(F.col("rank") < F.pmod("rest", "k"), 1).otherwise(0) + F.floor(F.col("rest") / F.col("k"))
    return rows.select("number", "source", "n", c.cast("long").alias("c"), "period")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def schedule(plan: DataFrame) -> DataFrame:
    """(number, k, slot): the slot of each source's k-th block of the period, by earliest deadline first."""
    kinds = plan.groupBy("c", "period").agg(F.sort_array(F.collect_list("number")).alias("members"))
    one = kinds.agg(F.max("period").alias("q"), F.sort_array(F.collect_list(F.struct("c", "members"))).alias("s"))
    q = F.col("q")
    slots = "array<struct<i:int,k:bigint>>"

    def ready(done: Column, t: Column) -> Column:
        def next_block(kind: Column, x: Column) -> Column:
            m = F.size(kind.members)
            j = F.get(done, x)
            k = F.floor(j / m)
            block = F.struct(F.ceil((k + 1) * q / kind.c).alias("d"), F.get(kind.members, (j % m).cast("int")).alias("i"), x.alias("x"), k.alias("k"))
            return F.when((k < kind.c) & (F.floor(k * q / kind.c) <= t), block)

        return F.array_min(F.transform("s", next_block))

    def step(acc: Column, t: Column) -> Column:
        run = lambda p: F.struct(F.transform(acc.done, lambda j, x: F.when(x == p.x, j + 1).otherwise(j)).alias("done"), F.concat(acc.out, F.array(F.struct(p.i.alias("i"), p.k.alias("k")))).alias("out"))
        return _let(ready(acc.done, t), run)

    def stretch(acc: Column, n: Column) -> Column:
        first = n * STRETCH
        start = F.struct(acc.done.alias("done"), F.expr(f"cast(array() as {slots})").alias("out"))
        return F.aggregate(F.sequence(first, F.least(first + STRETCH, q) - 1), start, step, lambda a: F.struct(a.done.alias("done"), F.concat(acc.out, F.array(a.out)).alias("out")))

    start = F.struct(F.transform("s", lambda kind: F.lit(0).cast("long")).alias("done"), F.expr(f"cast(array() as array<{slots}>)").alias("out"))
    stretches = F.sequence(F.lit(0).cast("long"), F.ceil(q / STRETCH) - 1)
    runs = one.select(F.posexplode(F.flatten(F.aggregate(stretches, start, stretch, lambda a: a.out))).alias("slot", "r"))
    return runs.select(F.col("r.i").alias("number"), "r.k", F.col("slot").cast("long").alias("slot"))


def targets(sizes: DataFrame, weights: dict[str, float] | None = None, period: int = PERIOD) -> DataFrame:
    """(number, source, n, c, period, slots): each source's slots within the period, in rising order."""
    plan = shares(sizes, weights, period)
    return plan.join(schedule(plan).groupBy("number").agg(F.sort_array(F.collect_list("slot")).alias("slots")), "number")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", source_col: str = "source", block_rows: int = BLOCK_ROWS, period: int = PERIOD) -> DataFrame:
    """``docs`` with ``mix_block`` (number of the row's block in its source) and ``mix_slot`` (when it runs)."""
    num, src, n, c, q, group, rank, first, own, groups, turn, block, slot = fresh(docs, "num", "src", "n", "c", "period", "group", "rank", "first", "own", "groups", "turn", "block", "slot")
    source = F.col(source_col)
    sizes = docs.groupBy(source.alias("source")).agg(F.count("*").alias("n"))
    plan = shares(sizes, weights, period)
    slots = schedule(plan).toDF(num, turn, slot)
    plan = plan.toDF(num, src, n, c, q).withColumn(groups, F.ceil(F.col(n) / F.lit(block_rows * GROUP_BLOCKS)))
    n_sources = sizes.limit(BROADCAST_ROWS + 1).count()
    near, near_slots = (F.broadcast if x <= BROADCAST_ROWS else (lambda df: df) for x in (n_sources, max(period, 8 * n_sources)))
    keyed = docs.join(near(plan.select(num, src, groups)), source.eqNullSafe(F.col(src))).withColumn(group, _group(F.col(id_col), F.col(groups)))
    # Each group's first block: the blocks of the groups before it. One row a group. The source's number
    # is never null, so that numbering rows and joining their group's start share one shuffle.
    counts = keyed.groupBy(num, group).agg(F.count("*").alias(own))
    before = F.sum(F.ceil(F.col(own) / block_rows)).over(Window.partitionBy(num).orderBy(group).rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(num, group, F.coalesce(before, F.lit(0)).alias(first)).join(plan.select(num, c, q), num)
    ranked = keyed.drop(src, groups).withColumn(rank, F.row_number().over(Window.partitionBy(num, group).orderBy(F.col(id_col))))
    placed = ranked.join(starts, [num, group]).withColumn(block, F.col(first) + F.floor((F.col(rank) - 1) / block_rows))
    placed = placed.withColumn(turn, F.pmod(F.col(block), F.col(c))).join(near_slots(slots), [num, turn])
    at = F.floor(F.col(block) / F.col(c)) * F.col(q) + F.col(slot)
    return placed.select(*(docs[f"`{x}`"] for x in docs.columns if x.lower() not in ("mix_block", "mix_slot")), F.col(block).cast("long").alias("mix_block"), at.cast("long").alias("mix_slot"))


def op6(docs: DataFrame) -> DataFrame:
    return mix(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source"))
