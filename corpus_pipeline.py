"""From documents to token files: quality rules, near-duplicates, benchmark leaks, mixing, token files.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return the
columns of documents; `run` writes each stage's rows as Parquet in the shared folder and reads them for the next, after which they are deleted.

Defined cases: rows with null texts or fewer than 50 words go with the quality rules; every row is judged by its own
text, so rows that share a doc_id, or have none, stay or go one by one; of rows that repeat doc_id and text one stays; an
empty table passes through every stage; other columns, whatever their names, pass through to the last stage, which
returns doc_id, start, n_tokens and ids_crc32, and the file and place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioscan.llm import decontaminate, minhash, mixing, quality, tokenfile
from folioscan.session import discard, materialize, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the current policy."""
    return quality.passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return minhash.first_of_each(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The index of the token files, with a checksum of each document's ids as they are read back."""
    return tokenfile.checksums(tokenfile.write(docs)).select("doc_id", "start", "n_tokens", "ids_crc32", "file", "at")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("benchmark leaks", benchmark_leaks),
    ("mixing", mix_sources),
    ("token files", token_files),
]

#: The last stage's ids come from a tokenizer, and near-duplicates from an iteration, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if k:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir).drop("file", "at")
