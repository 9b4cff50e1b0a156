"""Tables between two steps of an operator, in the folder that the cluster names for checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session; only where it is unset, as in tests, a local folder."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known and spark.sparkContext.getCheckpointDir():
        known = spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        known = tempfile.mkdtemp(prefix="fixhound-")
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


class written:
    """Parquet tables under the shared folder."""

    @staticmethod
    def fresh(spark: SparkSession, name: str) -> str:
        return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    @staticmethod
    def table(df: DataFrame, name: str) -> DataFrame:
        """Write `df` and read it back: its lineage ends there, and a lost executor costs nothing before it."""
        folder = written.fresh(df.sparkSession, name)
        df.write.option("compression", "zstd").parquet(folder)
        return df.sparkSession.read.schema(df.schema).parquet(folder)
