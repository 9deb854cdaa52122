"""The registered queries of this package: each applies an operator with
production parameters to its whole table and derives the digest columns."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakline.llm import (langid, line_dedup, mixing, packing, permutation_index, piece_codec, pii, quality_knn, quality_rules, simhash,
                           spelling, token_files, turn_repair)
from cloakline.llm.common import held_out, python_ready, table, written
from cloakline.llm.oracle import ORACLES  # noqa: F401


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.learn(docs.where(~held_out()))
    found = langid.identify(docs.select("doc_id", "text"), model, reject=False)
    return found.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "lang_pred", "score", "accepted")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, size=1024, end_id=2, carry=[F.crc32("ids").alias("ids_crc32")])


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(table(spark, sf_dir, "documents"))


def op4_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(mixing.measured(table(spark, sf_dir, "documents")), "sizes")
    mixed = mixing.copies(rows, mixing.mix_plan(rows))
    return mixed.select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), "source_size", "target",
                        (F.col("copies") * F.col("_size")).alias("taken"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    python_ready(spark)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(3)
            flat = ids.flatten().to_numpy(zero_copy_only=False).view("<u4")
            ends = np.concatenate(([0], np.cumsum(b.column(2).to_numpy())))
            crc = [zlib.crc32(flat[x:y]) for x, y in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(crc, pa.int64())],
                                             names=["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = token_files.token_table(table(spark, sf_dir, "documents"), end_id=0)
    return rows.mapInArrow(digest, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op6_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_groups(table(spark, sf_dir, "documents"))


def op7_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its text after removal and the kept parts' original offsets."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return line_dedup.cleaned(docs, row_cols=("file", "row")).drop("file", "row")


def op9_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_knn.learn(docs.where(~held_out()), table(spark, sf_dir, "labels"))
    found = quality_knn.score(docs, model)
    return found.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score",
                        (F.col("score") >= quality_knn.THRESHOLD).cast("int").alias("predicted"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("bigint")
    return found.select("doc_id", *[count(k).alias(f"n_{pii.KINDS[k]}") for k in range(4)],
                        F.sha2(pii.spelled(F.col("base")).cast("binary"), 256).alias("base_sha256"), pii.spelled(F.col("spans")).alias("spans"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repaired(turn_repair.damaged(table(spark, sf_dir, "conversations")))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = piece_codec.encode_decode(table(spark, sf_dir, "documents"), end_id=2)
    spelled = F.array_join(F.col("ids").cast("array<string>"), " ")
    return found.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(spelled, 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_language_id, op2_best_fit_packing, op3_quality_rules, op4_pareto_mix, op5_token_files, op6_simhash_groups,
    op7_permutation_index, op8_line_dedup, op9_quality_knn, op10_pii, op11_conversation_repair, op12_sentencepiece, op13_spelling_variants)}
