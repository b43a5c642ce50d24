"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by spark.checkpoint.dir. In local mode a temporary one will do; elsewhere
    it must be set, as executors can't see each other's own folders."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="factloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str = "graph") -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: it is computed once, and lost executors don't undo it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, name: str = "graph") -> DataFrame:
    """stored(), for tables from which joins take more than they hold: arrays are exploded, texts cut into terms. The size of a compressed file says
    nothing of that, so a join's side would be broadcast, and gathered on the driver, whatever its rows are; the hint has them shuffled instead.
    It holds for joins of what is made from the table without another join; a broadcast that is asked for goes before it."""
    return stored(df, name).hint("merge")
