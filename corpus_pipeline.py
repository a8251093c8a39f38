"""From raw documents to token ids: toxic documents go, one of each group of near duplicates stays, secrets are
masked, sources are mixed to their target weights, and what is left is encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernweave.llm import bpe, mixing, near_dedup, secret_scan, toxicity
from fernweave.llm.queries import codec, table, toxicity_model
from fernweave.session import work_folder

#: The toxicity and secret models are fitted here and so have no SQL twin.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, fitted on the labels outside the held-out fold, does not find toxic."""
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, bpe.share(spark, model))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 80% of its five-word shingles."""
    return near_dedup.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with found secrets masked."""
    net = bpe.share(spark, secret_scan.fit(docs))
    masked = docs.withColumn("text", secret_scan.mask_column("text", net))
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks for."""
    return mixing.take(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document (packed, little-endian 32-bit), their digest and that of the bytes they decode to."""
    coded = bpe.round_trip(docs, bpe.share(spark, codec()))
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("byte_bpe", encode_texts),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what each leaves is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        folder = work_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
