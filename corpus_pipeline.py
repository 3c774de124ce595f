"""The pipeline over ``documents``: language ID, exact dedup, near dedup, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept, and returns the columns of
documents; the last returns packed pieces. ``run`` writes each stage's result as Parquet in the folder that
the cluster names in ``spark.checkpoint.dir`` and reads it back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.best_fit_packing import pack_documents
from cohortlens.llm.common import Workspace, read_table, where_among
from cohortlens.llm.content_sort_dedup import keep_one
from cohortlens.llm.jaccard_join import near_duplicates
from cohortlens.llm.language_id import UNDETERMINED, fit, identify
from cohortlens.llm.pii_bootstrap import redact

#: Its steps are learned or iterative; SQL has no form for them. The tests hold it against a brute-force version.
ORACLE_SQL = None


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents whose language cannot be told (null texts, or without a letter) go."""
    found = identify(docs, fit(docs))
    return found.where(F.col("lang_pred") != UNDETERMINED).select(*docs.columns)


def keep_one_of_equals(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of equal texts the largest doc_id stays; a row without an id stays where no equal text has one."""
    return keep_one(docs, keep="largest")


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group of similar documents the smallest doc_id stays; rows without an id stay."""
    gone = near_duplicates(docs).where("doc_id <> component_id").select("doc_id").distinct()
    may_go, stay = where_among(docs, "doc_id", gone)
    return stay.unionAll(may_go.join(gone, "doc_id", "left_anti").select(*docs.columns))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """PII: each span is replaced by its kind in brackets; n_chars follows the text."""
    return redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing into sequences of at most 2,048 tokens."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, 2048)


STAGES = [
    ("language_id", keep_identified),
    ("exact_dedup", keep_one_of_equals),
    ("jaccard_join", keep_one_of_similar),
    ("pii", redact_personal_data),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    work = Workspace(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = work.keep(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            work.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
