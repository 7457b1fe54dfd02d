"""A corpus from raw documents to shards: five stages, each one of the operators applied to what its predecessor kept.

All stages take rows as they are: null ids, texts, languages and sources, empty and very long texts, repeated rows, empty
tables and extra columns of any name. Each docstring says what becomes of them. No stage but near-dedup merges rows, and
none joins by doc_id, so that a null or repeated id never keeps or removes another row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.decontamination import uncontaminated
from millrace.llm.mixing import equal, mix_documents
from millrace.llm.near_dedup import survivors
from millrace.llm.quality import fit_quality, score_quality
from millrace.llm.sharding import shard_documents
from millrace.llm.storage import stash


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go.

    Each row is judged by its own text, language, source and length, null and empty ones included, so repeated rows stay or go
    together; without labels of both kinds all stay. Columns are passed on as they are, in their order.
    """
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_quality(docs, model)
    kept = scored.toDF(*[f"c{i}" for i in range(len(docs.columns))], "quality", "text_view", "page_view", "keep").where("keep")
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near-duplicates stays: the one with the smallest id, null ids last.

    Of repeated rows one stays; texts without words are linked with nothing, and all their rows stay.
    """
    return survivors(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go.

    Rows are joined by their texts' digests: rows of equal text go together, whatever their ids; null and empty texts stay.
    """
    return uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, three times at most.

    Documents of a source have equal weight here, so that a source which the mix takes whole loses none. A null source is a
    source; rows equal in id, source and text are taken or left together; null texts have no words and come along as their
    source's other documents do.
    """
    return mix_documents(docs, weight=equal)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's shard and slot; equal texts (null counts as empty) share a shard, repeated rows have a slot each."""
    return shard_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mixing),
    ("sharding", sharding),
]

#: Training a classifier and drawing by hash can't be said in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
