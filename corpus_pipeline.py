"""A corpus pipeline: language ID, near-dedup, secret scan, mixing to target weights, BPE tokens.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last
return the columns of documents, further columns included, whatever their names.

Null and empty texts have no letters, so they go in the first stage; null ids, sources and languages are
ordinary values after it. Rows that repeat an id and a text count each, until near_dedup leaves one of
them. Texts may be very long, each is handled by one task. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paneldrift.llm import bpe, langid, minhash, mixing, secrets
from paneldrift.llm.common import written

LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: rejected are texts without letters (null and empty ones too)
    and those whose best language has a posterior below LEAST_SCORE."""
    model = langid.train(docs)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    found = langid.identify(rows, model, keep=("row",))
    good = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)
    return found.where(good).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity of 0.8 or more.

    The smallest id of a group stays, of rows that repeat it with the same text one."""
    return minhash.one_of_each(docs, size=5, percent=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret's span replaced; n_chars follows the text. A text may hold tens of
    thousands of secrets; overlapping spans become one mark."""
    clean = secrets.redact(docs, secrets.train(docs))
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in training order: documents once for each pass that takes them. Ties in the order of a
    source are broken by id and size; a null source is a source of its own."""
    return mixing.mixed_documents(docs)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the SHA-256 of the decoded bytes of each row of the mix."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = bpe.encode_documents(docs, path, public_tokenizers.PATTERN)
    return coded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
    ("bpe_tokens", bpe_tokens),
]

#: Models and hashed signatures are beyond SQL: tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written and read again before the next stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
