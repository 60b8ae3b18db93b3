"""Five stages from raw documents to training tokens; each is written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import bpe, minhash, mixing, pii, quality
from corvane.llm.common import shared_folder, unused

#: No stage but the last could be SQL: verdicts, pseudonyms and token ids come from models, keys and a vocabulary.
ORACLE_SQL = None
PII_KEY = "corpus-pipeline"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _only(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is kept, a null id included; rows that share an id go or stay together."""
    spare = unused(docs, "kept_id")
    ids = verdicts.where("kept").select(F.col("doc_id").alias(spare))
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids[spare]), "left_semi")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return _only(docs, quality.judge(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: shingles of five words, similarity 0.8."""
    return _only(docs, minhash.near_duplicates(docs, k=5, percent=80))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to pseudonyms; n_chars follows the text. A real key comes from the session's ``spark.corvane.pii.key``."""
    rows = pii.pseudonymise(docs, spark.conf.get("spark.corvane.pii.key", PII_KEY), out_col=unused(docs, "found_pii"))
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target proportions; a document that the mix takes twice is there twice. Rows that share an id
    are each there as often as the one of them that the mix takes most often.
    """
    node, times, copy = (unused(docs, n) for n in ("mixed_id", "mixed_times", "mixed_copy"))
    copies = mixing.mix(docs).groupBy(F.col("doc_id").alias(node)).agg(F.max("copies").alias(times)).where(F.col(times) > 0)
    rows = docs.join(copies, docs["doc_id"].eqNullSafe(copies[node]))
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(*(docs[c] for c in docs.columns))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the digest of the text that the ids decode to."""
    rows = bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("personal data", personal_data),
    ("mixture", mixture),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
