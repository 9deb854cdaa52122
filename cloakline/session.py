"""Session helpers: local session for tests/bench, checkpoint directory."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, app: str = "cloakline") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # runtime (measured) size under which AQE broadcasts a join side
        .config("spark.sql.adaptive.autoBroadcastJoinThreshold", "64MB")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``.  With a local master and none set
    (tests) a fresh scratch folder; on a cluster that would be a folder other
    machines cannot see, so there it is an error."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="cloakline-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss), never a local one."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written as Parquet into the checkpoint folder and read back, and its
    folder: for large frames, where a checkpoint (plain rows) takes several times
    the space.  The shuffle files of the write are given back at once: Spark deletes
    them when the driver collects their plan, by itself every half hour."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def kept(df: DataFrame) -> DataFrame:
    """``df`` evaluated once: :func:`stored`, or a checkpoint where Parquet does not
    know a type."""
    kinds = df.schema.simpleString()
    return checkpointed(df) if any(k in kinds for k in ("void", "interval", "variant")) else stored(df)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Delete what :func:`stored` wrote; nothing may read it any more."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


# Below this many bytes of input per core a table is dealt over all cores first.
SPREAD_BYTES = 64 * 1024 * 1024


def spread_small(df: DataFrame) -> DataFrame:
    """A small input may be one file, hence one task: deal its rows over the cores.
    Larger inputs have splits enough and stay where they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(cores) if int(str(size)) < SPREAD_BYTES * cores else df
