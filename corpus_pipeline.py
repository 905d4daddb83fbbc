"""From raw documents to sampled token sequences: the corpus operators one after the other.

Each stage reads what its predecessor kept, and its decisions take effect. All but the last return the columns of
``documents``; the last one returns the sampled segmentations of what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from touchline.llm import decontaminate, piece_sampling, quality, secret_scan, simhash
from touchline.llm.queries import MODEL_FILE
from touchline.session import cut_lineage


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on a bounded sample of ``labels``, does not reject."""
    return quality.keep_good(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of SimHash near-duplicates."""
    return simhash.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within its edit budget."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secret values replaced by a mark."""
    return secret_scan.redact(docs)


def sample_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of each document: ``doc_id, rank, log_prob, perturbed, inclusion, pieces``."""
    return piece_sampling.sample(docs, MODEL_FILE)


STAGES = [("quality", keep_good), ("near_duplicates", keep_one_of_each), ("decontamination", drop_benchmark), ("secrets", redact_secrets), ("pieces", sample_pieces)]

#: The classifier is fitted, and fingerprints and edit distances are not SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
