"""A corpus pipeline of five stages: each gets what its predecessor kept and returns the columns of documents; the last
returns token ids.

Each stage works on the whole of its input. Null and repeated rows follow the operators' docstrings; of rows that repeat
a doc_id, the near-duplicate stage keeps one, and rows with a null doc_id pass it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm import byte_bpe, decontaminate, language_id, ngram_join, secret_scan
from quarrylight.llm.components import save

VOCABULARY = "byte_bpe_50k.tiktoken"
SECRET_MARK = "[SECRET]"


def _rows(docs: DataFrame, *more: str) -> DataFrame:
    """``row``, which holds all columns, so that none clashes with an operator's, beside the columns that the operator reads."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text", *more)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some language, learned from the labelled ones; a missing label is filled in."""
    named = language_id.predict(_rows(docs), language_id.train(docs), carry=["row"]).where("lang_pred <> 'und'")
    return named.select(*[F.coalesce("row.lang", "lang_pred").alias(c) if c == "lang" else F.col(f"row.`{c}`") for c in docs.columns])


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word shingle sets that links of a similarity of 0.8 join: the smallest id.

    Of rows that repeat that id, the one with the least text stays.
    """
    groups = save(ngram_join.ngram_join(docs, n=5, num=80, den=100).where("doc_id IS NOT NULL"))
    gone = groups.where("component_id <> doc_id").select("doc_id").distinct()
    kept = docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)
    again = save(groups.where("component_id = doc_id").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if again.isEmpty():
        return kept
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    least = F.struct("text", F.xxhash64(F.to_json(row)))
    one = kept.join(again.hint("merge"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, least).alias("row")).select("row.*")
    return kept.join(again.hint("merge"), "doc_id", "left_anti").select(*docs.columns).unionByName(one)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    marked = decontaminate.find_leaks(_rows(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=["row"])
    return marked.where(F.size("leaks") == 0).select("row.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of every secret."""
    scanned = secret_scan.scan(_rows(docs), carry=["row"], redact=SECRET_MARK)
    new = {"text": F.col("redacted"), "n_chars": F.when(F.size("spans") > 0, F.length("redacted").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return scanned.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, ids_sha256, decoded_sha256) of every document."""
    bpe = byte_bpe.BPE(byte_bpe.load_ranks(public_tokenizers.path(VOCABULARY)), public_tokenizers.PATTERN)
    decoded = byte_bpe.encode_and_decode(docs, bpe)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary")
    return decoded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", remove_near_duplicates),
    ("benchmark_decontamination", remove_benchmark),
    ("secret_scans", redact_secrets),
    ("byte_level_bpe", encode),
]

#: SQL can't express the language, decontamination and encoding stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
