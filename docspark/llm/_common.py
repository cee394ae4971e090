"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint.

    The folder is the one that the session names in ``spark.checkpoint.dir``.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder. Where none is named, a temporary one on one machine only; on a cluster that is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="docspark-"))
    return sc.getCheckpointDir()


def drop(spark: SparkSession, folder: str) -> None:
    """Deletes a folder, in whatever store it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def n_shuffle(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Internal column names that no column of ``df`` has, whatever its case."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        x = f"__{name}"
        while x.lower() in have:
            x = f"_{x}"
        have.add(x.lower())
        out.append(x)
    return out


def broadcast_if_small(df: DataFrame, most_rows: int) -> DataFrame:
    """``df``, checkpointed and counted; marked for broadcast only up to ``most_rows`` rows."""
    df = materialize(df)
    return F.broadcast(df) if df.count() <= most_rows else df
