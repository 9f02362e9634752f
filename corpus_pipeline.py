"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; its
result is written as Parquet in the shared folder and reread as the next one's ``docs``. All but
the last return the columns of ``docs``, whatever further ones there are and whatever their names;
empty tables give empty tables, and texts are taken whole whatever their length.

1. ``toxicity`` drops documents that score 0.7 or more.
2. ``near_duplicates`` keeps one document of each group (five-word shingles, similarity 0.8).
3. ``decontamination`` drops documents that hold a benchmark item.
4. ``secrets`` keeps every document, with its secrets replaced by ``[REDACTED]``.
5. ``packing`` returns pieces of sequences with their token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import decontaminate, minhash, packing, secret_scan, toxicity
from quern.llm.common import Workspace


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Trains on the labelled rows of ``docs`` that aren't held out. Null and empty texts are kept;
    rows with a null doc_id are scored but don't train; repeated rows are scored each."""
    return toxicity.without_toxic(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component one row. Texts without words are linked with nothing, but of rows of one doc_id
    and text one stays; different texts of one doc_id, or without one, stay unless they are linked."""
    return minhash.kept_documents(docs, Workspace(spark, "near-duplicates"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts hold no item and are kept; ids don't matter; repeated rows are judged each."""
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every row, with null and empty texts as they are; ``n_chars`` is the new text's."""
    return secret_scan.redacted(docs, Workspace(spark, "secrets"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts have the end id alone; repeated rows are packed each."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: SQL can express neither the toxicity model nor alignment nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = space.table(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            space.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
