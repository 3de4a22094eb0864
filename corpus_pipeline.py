"""The corpus pipeline: documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet and read again by the
next one. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import langid, packing, pii, simhash, substring
from lodestrata.llm.session import cut, ensure_checkpoint_dir

#: Documents are rejected where no language is found or the best one has less than this posterior.
MIN_LANGUAGE_SCORE = 0.5


def _replaced(docs: DataFrame, columns: list[str], new: dict) -> DataFrame:
    """The carried ``columns``, those named in ``new`` replaced; other columns of ``docs`` may have any names."""
    return docs.select(*[new[c].alias(c) if c in new else F.col(f"carried.`{c}`").alias(c) for c in columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with a language; ``lang`` becomes the predicted one. Null and letterless texts go."""
    found = langid.identify(docs, langid.fit(docs), carry=docs.columns)
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SCORE))
    return _replaced(kept, docs.columns, {"lang": F.col("lang_pred")})


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each group of near duplicates the document with the smallest id."""
    return simhash.near_dedup(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that also stand in a document with a smaller id. Every document stays, if with an empty text."""
    found = substring.substring_dedup(docs, carry=[c for c in docs.columns if c != "text"])
    text = F.col("kept_text")
    return _replaced(found, docs.columns, {"text": text, "n_chars": F.length(text).cast("long")})


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by the kind found."""
    return pii.redacted(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces and their places in sequences."""
    return packing.pack(cut(packing.token_pieces(docs)))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("personal_data", personal_data),
    ("pack", pack),
]

#: SQL has no forward algorithm, SimHash, tokenizer or best-fit plan; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the tables between them go to the shared checkpoint folder."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            _remove(spark, f"{folder}/{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)


def _remove(spark: SparkSession, path: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
