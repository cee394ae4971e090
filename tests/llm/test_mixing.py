"""The schedule of many sources, and equal schedules by a plain simulation."""

import heapq

import numpy as np
from pyspark.sql import functions as F

from docspark.llm import mixing


def by_hand(c, q):
    """Slot by slot: the released block with the earliest deadline, ties by source."""
    future = sorted((k * q // x, -(-(k + 1) * q // x), i) for i, x in enumerate(c) for k in range(x))
    out, ready, at = [], [], 0
    for t in range(q):
        while at < len(future) and future[at][0] <= t:
            heapq.heappush(ready, future[at][1:])
            at += 1
        out.append(heapq.heappop(ready)[1])
    return out


def test_schedule_equals_simulation(spark):
    rng = np.random.default_rng(2)
    for n, period in ((1, 10), (7, 60), (40, 200), (150, 1000)):
        sizes = spark.createDataFrame([(f"s{i:03d}" if i else None, int(x)) for i, x in enumerate(rng.integers(1, 1 << rng.integers(2, 20), n))], "source string, n long")
        plan = sorted(mixing.targets(sizes, period=period).collect(), key=lambda r: r.number)
        q = max(period, 8 * n)
        assert sum(r.c for r in plan) == q == plan[0].period
        want = by_hand([r.c for r in plan], q)
        assert [[t for t, i in enumerate(want) if i == r.number] for r in plan] == [r.slots for r in plan]


def test_many_sources(spark):
    """Twenty thousand sources: each gets its share, within less than one block at any time."""
    n = 20_000
    sizes = spark.range(n).select(F.concat(F.lit("s"), "id").alias("source"), F.when(F.col("id") % 1000 == 0, 10_000_000).otherwise(1 + F.col("id") % 50).alias("n"))
    plan = mixing.shares(sizes).cache()
    rows = mixing.schedule(plan).join(plan, "number")
    got = rows.agg(F.count("*"), F.countDistinct("slot"), F.max(F.floor(F.col("k") * F.col("period") / F.col("c")) - F.col("slot")), F.max(F.col("slot") - F.ceil((F.col("k") + 1) * F.col("period") / F.col("c")))).first()
    assert tuple(got)[:2] == (8 * n, 8 * n) and got[2] <= 0 and got[3] < 0
