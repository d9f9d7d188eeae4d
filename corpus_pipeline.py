"""A corpus pipeline: quality, exact and near duplicates, mixing, tokens. Each stage is written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.bpe import bpe
from shelfmark.llm.common import free_names, written
from shelfmark.llm.exact_dedup import exact_dedup
from shelfmark.llm.mixing import mix
from shelfmark.llm.near_dedup import near_duplicates
from shelfmark.llm.quality_crf import good_documents


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line-labelling field doesn't reject; it learns from `labels`."""
    return good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, that with the largest doc_id. Rows are told apart by doc_id and digest."""
    told = written(exact_dedup(docs, keep="largest").groupBy("doc_id", "text_sha256").agg(F.bool_or("kept").alias("any"), F.bool_and("kept").alias("all")), "stage-exact")
    (sha,) = free_names(docs, "sha")
    keyed = docs.withColumn(sha, F.sha2(F.coalesce("text", F.lit("")), 256))

    def same(t: DataFrame):
        return keyed["doc_id"].eqNullSafe(t["doc_id"]) & (keyed[sha] == t["text_sha256"])

    gone = told.filter("not `any`").select("doc_id", "text_sha256")
    out = keyed.join(gone, same(gone), "left_anti")
    repeated = told.filter("`any` and not `all`").select("doc_id", "text_sha256")
    if not repeated.isEmpty():
        # Rows that repeat both doc_id and text: one of them stays.
        once = out.join(repeated, same(repeated), "left_semi").dropDuplicates(["doc_id", sha])
        out = out.join(repeated, same(repeated), "left_anti").unionByName(once)
    return out.select(*docs.columns)


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates, that with the smallest doc_id.

    Rows are told apart by doc_id and text, so other rows with a dropped one's doc_id stay; rows with a null doc_id and
    texts without words all stay.
    """
    gone = near_duplicates(docs).filter("not kept").select("doc_id", "text_sha256").distinct()
    (sha,) = free_names(docs, "sha")
    keyed = docs.withColumn(sha, F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    return keyed.join(gone, (keyed["doc_id"] == gone["doc_id"]) & (keyed[sha] == gone["text_sha256"]), "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the Pfair schedule: files and their rows follow slot and place."""
    key, slot, seq = free_names(docs, "of", "slot", "seq")
    at = mix(docs).groupBy(F.col("doc_id").alias(key)).agg(F.min(F.struct("slot", "seq")).alias("at"))
    at = at.select(key, F.col("at.slot").alias(slot), F.col("at.seq").alias(seq))
    placed = docs.join(at, F.col("doc_id").eqNullSafe(F.col(key)), "left")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartitionByRange(n, slot, seq).sortWithinPartitions(slot, seq).select(*docs.columns)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every document that is left."""
    import public_tokenizers

    return bpe(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_duplicates),
    ("MinHash near-dedup", near_duplicate_groups),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", bpe_tokens),
]

#: The field and the tokens can't be expressed in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{k}")
    return docs
