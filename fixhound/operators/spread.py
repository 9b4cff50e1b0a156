"""Joins and stage boundaries that hold when one key has a third of all rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What may be broadcast. The size is measured before the hint is given.
BROADCAST_BYTES = 256 << 20
_ROW_BYTES = 32

# A key is heavy from this share of the rows on, so there are at most 1 / HEAVY_SHARE keys.
HEAVY_SHARE = 0.01
SALTS = 64
# With fewer rows than this, one task can take all of them, and no key is heavy.
SPREAD_FROM_ROWS = 1_000_000
# A table above this size is never moved just to use more cores.
SPREAD_SCAN_BYTES = 256 << 20
_SKETCH_ITEMS = 1024
_SKETCH_GROUPS = 64


def measured_bytes(df: DataFrame, text: str | None = None) -> int:
    """About how large `df` is: one aggregate; `text` names its only wide column."""
    size = F.sum(F.octet_length(text)) if text else F.lit(0)
    rows, octets = df.agg(F.count("*"), F.coalesce(size, F.lit(0))).first()
    return rows * _ROW_BYTES + octets


def fits_broadcast(df: DataFrame, text: str | None = None) -> bool:
    """Measure `df`: is it small enough to be sent to every executor?

    Used for frames that grow with the seeds, such as their patterns. Callers have another way for
    those that are too large.
    """
    return measured_bytes(df, text) <= BROADCAST_BYTES


def heavy_keys(df: DataFrame, key: str, from_rows: int | None = None) -> list:
    """Values of `key` that hold more than HEAVY_SHARE of the rows, from a frequency sketch.

    Sketches merge in two steps, so no task receives one from every input partition. The
    list has at most 1 / HEAVY_SHARE values, null among them if it is heavy. It only steers
    where rows are sent, so an estimate is good enough: joins give the same rows whatever it
    contains.
    """
    rows = df.count()
    if rows < max(1, SPREAD_FROM_ROWS if from_rows is None else from_rows):
        return []
    tracked = (
        df.select(F.col(key).alias("k"), (F.spark_partition_id() % _SKETCH_GROUPS).alias("g"))
        .groupBy("g")
        .agg(F.expr(f"approx_top_k_accumulate(k, {_SKETCH_ITEMS})").alias("s"))
        .agg(F.expr(f"approx_top_k_combine(s, {_SKETCH_ITEMS})").alias("s"))
        .selectExpr(f"explode(approx_top_k_estimate(s, {int(1 / HEAVY_SHARE)})) AS t")
        .where(F.col("t.count") > rows * HEAVY_SHARE)
        .select("t.item")
    )
    return [row[0] for row in tracked.collect()]


def hot_key_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str,
    spread_by: list[str],
    sample: DataFrame | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """Join `left`, whose keys may be lopsided, to `right`, which has few rows per key.

    Rows of heavy keys are spread over `salts` tasks by the hash of `spread_by`, and only
    the right rows of those keys are repeated. `sample` is a cheaper frame with the same
    key column, such as the table scan under `left`. With no heavy key this is a plain
    join. `how` is inner, left, left_semi or left_anti.
    """
    heavy = heavy_keys(left if sample is None else sample, key)
    if not heavy:
        return left.join(right, key, how)
    is_heavy = F.col(key).isin([value for value in heavy if value is not None])
    salt = F.when(is_heavy | F.col(key).isNull(), F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    copies = F.when(is_heavy, F.sequence(F.lit(0), F.lit(salts - 1)))
    salted_left = left.withColumn("_salt", F.coalesce(salt, F.lit(0)))
    salted_right = right.withColumn(
        "_salt", F.explode(F.coalesce(copies, F.array(F.lit(0))))
    )
    return salted_left.join(salted_right, [key, "_salt"], how).drop("_salt")


def spread_join(
    large: DataFrame, small: DataFrame, on: list[str], spread_by: list[str], salts: int
) -> DataFrame:
    """Inner join for a `large` side that is too dear to sketch: repeat all of `small`."""
    every_salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    salted = large.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    return salted.join(small.withColumn("_salt", every_salt), [*on, "_salt"]).drop("_salt")


def spread_scan(scan: DataFrame) -> DataFrame:
    """Rows of a small table that has fewer input splits than cores, over all cores.

    Any other table is left as it is stored: no large amount of text is ever moved for
    this. The size is Spark's own estimate, which needs no job.
    """
    estimate = scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if estimate > SPREAD_SCAN_BYTES:
        return scan
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= cores:
        return scan
    return scan.repartition(cores, "file_id")


def durable(df: DataFrame) -> DataFrame:
    """Write `df` to the reliable checkpoint folder and go on from there.

    Used after a pass over the corpus: what follows is small, is read more than once, and
    must not repeat the pass when an executor is lost.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """`durable` for what is wide or has a row for each file: as compressed columns, a fraction of a checkpoint's size."""
    folder = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def shared_folder(spark: SparkSession) -> str:
    """The folder of reliable checkpoints, which driver and executors share."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(shared or own_folder(context.master))
    return context.getCheckpointDir().rstrip("/")


def own_folder(master: str) -> str:
    """A folder of this machine, for sessions that have no other one."""
    if not master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="fixhound-")
