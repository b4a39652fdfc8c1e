"""Session helpers shared by operators and queries."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session's ``spark.checkpoint.dir`` names, which all executors share.

    Where a session names none, a local folder is set, but only in local
    mode (tests, a laptop); on a cluster that is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.split("[")[0] == "local":
                raise ValueError("spark.checkpoint.dir names no folder that the executors share")
            folder = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` through the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, compressed; a plan that reads it several times computes it once."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def last_delivery(df: DataFrame, key: str, loaded: str = "loaded_at", keep: list[str] | None = None) -> DataFrame:
    """One row a key: the one loaded last; null times come first, ties are settled by the greatest row.

    A partial aggregate does most of the work before the shuffle, so a key
    that holds a third of all rows costs one row a task.
    """
    rest = [c for c in (keep or df.columns) if c not in (key, loaded)]
    best = F.max(F.struct(F.col(loaded), *[F.col(c) for c in rest])).alias("_last")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(best).select(key, "_last.*")


def blank(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))
