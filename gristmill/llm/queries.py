"""The queries op1 to op13, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import bpe, embeddings, importance, langid, oracles, packing, secrets, simhash, spelling, substring_dedup, token_counts, tokenfile, toxicity, weighted_sampling

#: A fifth of the documents, by their ids, that no label is learned from. A row without an id is not held out.
HELD_OUT = "coalesce(crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0, false)"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of all documents: where they are, and in which document they were first."""
    return substring_dedup.repeated_spans(_documents(spark, sf_dir)).select("doc_id", "start", "end", "n_words", "first_doc_id")


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    return embeddings.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates for secrets in all documents, with the forest's verdict."""
    return secrets.scan(_documents(spark, sf_dir)).select("doc_id", "start", "candidate", "score", "is_secret")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, packed."""
    return packing.pack(_documents(spark, sf_dir)).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash classes of all documents."""
    out = simhash.near_duplicates(_documents(spark, sf_dir))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return weighted_sampling.fingerprints_with_edits(_documents(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from labels of those that are not held out."""
    docs, labels = _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels.where(f"NOT {HELD_OUT}"), toxicity.language_model(docs))
    return toxicity.score(docs.withColumn("doc_id", F.col("doc_id").cast("long")), model).select("doc_id", F.expr(HELD_OUT).alias("held_out"), "score", "predicted")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back."""
    return tokenfile.token_files(_documents(spark, sf_dir)).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of all documents and the bytes that they decode to."""
    out = bpe.decode(bpe.encode(_documents(spark, sf_dir)))
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from those that are not held out."""
    docs = _documents(spark, sf_dir)
    model = langid.train(docs.where(f"NOT {HELD_OUT}"))
    return langid.predict(docs, model).select("doc_id", F.expr(HELD_OUT).alias("held_out"), "lang_pred", "score")


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of all documents that resembles the benchmark."""
    return importance.resample(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents."""
    return token_counts.count_tokens(_documents(spark, sf_dir))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents, one in 97 of which is misspelt."""
    return spelling.variants(_documents(spark, sf_dir), misspell=97)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_embeddings": op2_embeddings,
    "op3_secrets": op3_secrets,
    "op4_packing": op4_packing,
    "op5_simhash": op5_simhash,
    "op6_weighted_sampling": op6_weighted_sampling,
    "op7_toxicity": op7_toxicity,
    "op8_token_files": op8_token_files,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_langid": op10_langid,
    "op11_importance": op11_importance,
    "op12_token_counts": op12_token_counts,
    "op13_spelling": op13_spelling,
}

#: The others cannot be said in SQL; tests hold them against brute force.
ORACLE: dict[str, str] = {"op2_embeddings": oracles.EMBEDDINGS, "op11_importance": oracles.IMPORTANCE, "op13_spelling": oracles.SPELLING}
