"""Streaming masking with a registry that grows batch by batch.

``readStream`` -> ``foreachBatch``: every micro-batch is masked with the
registry left by the previous batch; known values keep their pseudonyms, new
values continue each counter.  State lives in a shared folder (the session's
checkpoint directory by default), versioned by batch id, so a replayed batch
overwrites its own output and reads the same previous registry — the sink is
idempotent and the query restarts from its checkpoint after a failure.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.registry import KeyedPrior
from ..plans.jobs import Masking, mask
from ..rules import Rule
from ..session import ensure_checkpoint_dir


def _has_state(spark: SparkSession, base: str) -> bool:
    """Whether any batch has stored a value: batches without a new value leave no
    partition, and a folder without files has no schema to read."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/bucket=*")
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def registry_path(state_dir: str) -> str:
    return f"{state_dir}/registry"


def registry_schema(batch: DataFrame, key_cols: list[str]) -> str:
    """Columns of the registry, for a stream that has stored none."""
    unit = ",".join(["batch:int", *[f"`{c}`:{batch.schema[c].dataType.simpleString()}" for c in key_cols]])
    return (f"_scope struct<corpus:int>, rule string, key string, first_pos struct<u:struct<{unit}>,k:int,s:int>, "
            "first_v string, first_k int, occurrences bigint, n bigint, pseudonym string, batch int")


BUCKETS = 64


def bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("rule", "key"), F.lit(buckets)).cast("int")


def keyed_prior(spark: SparkSession, state_dir: str, batch_id: int, buckets: int = BUCKETS) -> KeyedPrior:
    """The state before batch ``batch_id``, asked by key."""
    rows = spark.read.parquet(registry_path(state_dir)).where(F.col("batch") < batch_id)
    counters = spark.read.parquet(f"{state_dir}/counters").where(F.col("batch") < batch_id)

    def lookup(seen: DataFrame) -> DataFrame:
        wanted = [r[0] for r in seen.select(bucket(buckets).alias("b")).distinct().collect()]  # at most ``buckets`` numbers
        return rows.where(F.col("bucket").isin(wanted)).drop("batch", "bucket")  # partitions: other buckets are not opened

    return KeyedPrior(lookup, counters.groupBy("_scope", "rule").agg(F.max("top").alias("_base")))


def mask_batch(batch: DataFrame, batch_id: int, state_dir: str, text_col: str, key_cols: list[str],
               rules: list[Rule], buckets: int = BUCKETS) -> None:
    """Mask one micro-batch.  The registry is stored as append-only deltas in
    ``bucket=<hash>/batch=<id>`` partitions holding the values first seen in that
    batch; the batch overwrites only its own, so a replay gives the same result.
    Nothing stays cached after the batch."""
    spark = batch.sparkSession
    units = batch.withColumn("_ord", F.struct(F.lit(batch_id).alias("batch"),
                                              *[F.col(c) for c in key_cols]))
    prior = None
    base = registry_path(state_dir)
    if batch_id > 0 and _has_state(spark, base):
        prior = Masking(None, None, None, None, [], internal=keyed_prior(spark, state_dir, batch_id, buckets))
    res = mask(units, text_col, key_cols, None, rules=rules, order_col="_ord", prior=prior)
    fresh = res.internal.where(F.col("first_pos.u.batch") == batch_id).withColumn("batch", F.lit(batch_id))
    (fresh.withColumn("bucket", bucket(buckets)).repartition("bucket").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(base))
    (fresh.groupBy("_scope", "rule", "batch").agg(F.max("n").alias("top")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{state_dir}/counters"))
    res.masked.drop("_ord").write.mode("overwrite").parquet(f"{state_dir}/masked/batch={batch_id}")
    res.unpersist()


def start(stream: DataFrame, text_col: str, key_cols: list[str], rules: list[Rule], state_dir: str | None = None,
          checkpoint: str | None = None, once: bool = True, buckets: int = BUCKETS):
    """Start the streaming masking; returns the StreamingQuery."""
    spark = stream.sparkSession
    state_dir = state_dir or os.path.join(ensure_checkpoint_dir(spark), "stream-masking")
    writer = (stream.writeStream
              .foreachBatch(lambda df, bid: mask_batch(df, bid, state_dir, text_col, key_cols, rules, buckets))
              .option("checkpointLocation", checkpoint or f"{state_dir}/_checkpoint"))
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def latest_registry(spark: SparkSession, state_dir: str, units: DataFrame, key_cols: list[str]) -> DataFrame:
    """The registry after the last completed batch (union of the deltas).
    ``units``: any frame with the key columns of the stream."""
    if not _has_state(spark, registry_path(state_dir)):
        return spark.createDataFrame([], registry_schema(units, key_cols)).drop("batch")
    return spark.read.parquet(registry_path(state_dir)).drop("batch", "bucket")
