"""From raw documents to packed training sequences, in stages that are written and read again.

Quality (rejected documents go), near duplicates (one document of each class stays), secrets (values
that look live are replaced), mixing (rare sources are repeated up to twice, no document is left
out), packing. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicework.llm import mixing, near_dups, packing, quality, secret_scan
from sluicework.llm.common import Staging, read_table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit_quality(docs, read_table(spark, sf_dir, "labels"))
    return quality.kept(docs, model.score, 0.3)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dups.keep_one(docs)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secret_scan.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_rows(docs).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, packing.default_tokenizer())


STAGES = [
    ("quality classifier", keep_good),
    ("MinHash near-dedup", keep_one_of_each),
    ("secret scans", hide_secrets),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack),
]

#: Trained models, sampling and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    staging = Staging(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        before = list(Staging.live)
        docs = staging.put(stage(spark, docs, sf_dir), f"stage-{i}")
        # What the stage has staged, and the stage before it, are written out now.
        for made in [s for s in Staging.live if s is not staging and s not in before]:
            made.clear()
        if i:
            staging.drop(f"stage-{i - 1}")
    return docs
