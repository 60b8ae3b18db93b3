"""One query for each operator of this subpackage, over the whole of its table."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread
from . import bpe, divergence, licenses, lm_mixing, minhash, mixing, packing, pii, quality, secrets, subspace, substring, survival

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked at a Jaccard similarity of 0.8 over 4-word shingles."""
    return minhash.near_duplicates(_documents(spark, sf_dir), k=4, percent=80)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every text, digested."""
    rows = secrets.scan(_documents(spark, sf_dir), RANKS, PATTERN)
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return rows.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in secrets.KINDS[:3]),
        F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"),
    )


def _with_ids_digest(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = list(bpe.id_lists(batch.column(1)))
            digests = [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, ids), pa.int64()), pa.array(digests), batch.column(2)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again, digested."""
    rows = bpe.decode(bpe.encode(_documents(spark, sf_dir), RANKS, PATTERN), RANKS)
    return _with_ids_digest(rows.select("doc_id", "ids", F.sha2("decoded", 256).alias("decoded_sha256")))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of weighed rules on every text."""
    return quality.judge(_documents(spark, sf_dir))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that texts share, at a similarity of 0.8."""
    return substring.repeated_passages(_documents(spark, sf_dir))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of one and a half times all words takes of each document."""
    return mixing.mix(_documents(spark, sf_dir)).drop("copies")


def op7_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with personal data replaced, and how many of each kind were. A real key comes from the session's ``spark.corvane.pii.key``."""
    rows = pii.pseudonymise(_documents(spark, sf_dir), key=spark.conf.get("spark.corvane.pii.key", "op7"))
    count = lambda kind: F.size(F.filter("pii", lambda p: p["kind"] == kind)).cast("long")
    return rows.select("doc_id", "text", *(count(k).alias(f"n_{k}") for k in pii.PATTERNS))


def op8_lm_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text scored by a unigram model and by logistic context mixing, learned from six sevenths of the texts."""
    return lm_mixing.score(_documents(spark, sf_dir))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices and passages in every text."""
    return licenses.scan(_documents(spark, sf_dir))


def op10_subspace_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors linked at a cosine of 0.9."""
    return subspace.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), cosine=0.9)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language are from each other, and the terms that each has more of."""
    return divergence.audit(_documents(spark, sf_dir))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens in pieces, packed into sequences of 1024."""
    packed = packing.pack(packing.cut(_documents(spark, sf_dir), *TOKENIZER))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op13_filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove in each of their orders, for each language."""
    return survival.audit(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py one after the other."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [f for name, f in globals().items() if name.startswith("op") and callable(f)]
    return {f.__name__: f for f in own} | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the results that SQL can express."""
    from .oracles import SQL

    return dict(SQL)
