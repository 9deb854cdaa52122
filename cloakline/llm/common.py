"""Shared helpers: tables of the test set, shared scratch folder, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakline.session import ensure_checkpoint_dir

#: the characters that part words: U+0020 and U+0009 to U+000D
WS = r"[\x20\x09-\x0D]"
NON_WS = r"[^\x20\x09-\x0D]"
#: rows in one Arrow batch: texts may be long, so far fewer than Spark's default
ARROW_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHIPPED: set[str] = set()


def python_ready(spark: SparkSession) -> None:
    """For operators with Python tasks: send this package to the executors (once
    per application) and bound the bytes that one Arrow batch of texts can take."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp()) / f"{package.name}.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(package.rglob("*")):
                if f.suffix in (".py", ".toml"):
                    z.write(f, f.relative_to(package.parent))
        sc.addPyFile(str(archive))
        _SHIPPED.add(sc.applicationId)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the folder that driver and executors share
    (``spark.checkpoint.dir``): cuts lineage, survives lost executors, and is
    read back column by column."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def packed(docs: DataFrame) -> DataFrame:
    """Every column inside one struct ``_all``, so that no name of the table can
    clash with a column that an operator adds."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_all"))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no model may learn from: crc32 of the id as text, modulo 5, is 0
    (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def words(text: Column) -> Column:
    """Array of the words of a text (empty for null)."""
    inner = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{WS}+|{WS}+$", "")
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, f"{WS}+"))


def word_count(text: Column) -> Column:
    """Number of words, as bigint."""
    return F.coalesce(F.regexp_count(text, F.lit(f"{NON_WS}+")), F.lit(0)).cast("bigint")
