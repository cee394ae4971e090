"""Helpers of the operators: intermediates written once, broadcasts of checked size."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows up to which a side is marked for broadcast.
BROADCAST_ROWS = 100_000


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset, a temporary one on one machine only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="docspark-"))
    return sc.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """``df`` computed once and read by all its users, by a reliable checkpoint."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def broadcast_if_small(df: DataFrame, most_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, marked for broadcast only if it has at most ``most_rows`` rows; counting stops there."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def beside(rows: DataFrame, config: DataFrame, on: Column | None = None) -> DataFrame:
    """Each row with each row of a configuration table, or with those that meet ``on``.

    A table that a count shows to be small is sent to all tasks, and ``rows`` stay where they are. A larger one gives the same
    pairs, split among the tasks by both sides. Tables without rows give none.
    """
    return rows.join(broadcast_if_small(config), F.lit(True) if on is None else on, "inner")


def spread(df: DataFrame) -> DataFrame:
    """``df`` on all cores, if it has fewer partitions than there are: a few small files would keep most of them idle.
    A large table has more partitions and stays where it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def as_of(rows: DataFrame, marks: DataFrame, value: str, name: str, by: str = "doc_id", at: str = "at") -> DataFrame:
    """``rows`` with ``name``: the ``value`` of the last of ``marks`` at or before them, of the same ``by``.

    Both are sorted together once and read in order: the cost is that of their rows, however many marks there are.
    """
    both = rows.withColumns({"__mark": F.lit(None).cast(marks.schema[value].dataType), "__row": F.lit(1)})
    other = marks.select(by, F.col(at).cast(rows.schema[at].dataType).alias(at), F.col(value).alias("__mark"), F.lit(0).alias("__row"))
    order = Window.partitionBy(by).orderBy(F.col(at).asc_nulls_first(), "__row").rowsBetween(Window.unboundedPreceding, 0)
    merged = both.unionByName(other, allowMissingColumns=True).withColumn(name, F.last("__mark", ignorenulls=True).over(order))
    return merged.where("__row = 1").select(*rows.columns, name)
