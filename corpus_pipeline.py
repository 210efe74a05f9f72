"""The corpus pipeline: quality classifier, language identification, near-duplicate removal, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; ``run`` writes each
stage's rows as Parquet in the shared folder and reads them back. All but the last keep the columns of
``documents``. A document goes where the classifier scores it below the threshold, where no language is
found, or where it isn't the first of its component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm import jaccard_join, langid, packing, quality_rank
from docweave.llm.common import dropped, free_name, held_out, read_table, staged
from docweave.llm.queries import tokenizer_file


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality_rank.train(docs, read_table(spark, sf_dir, "labels"), ~held_out("doc_id", 3, 1))
    name = free_name(docs, "score_")
    return quality_rank.score(docs, model, keep=tuple(docs.columns), name=name).where(F.col(name) >= 0.5).drop(name)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    net = langid.train(docs, ~held_out("doc_id", 4, 2))
    names = free_name(docs, "lang_pred_"), free_name(docs, "score_")
    found = langid.predict(docs, net, keep=tuple(docs.columns), names=names)
    return found.where(F.col(names[0]) != langid.UNKNOWN).drop(*names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.first_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = packing.pack(docs, tokenizer_file("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("packing", pack)]

#: No SQL states trained models and packing; the tests hold the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    read = None
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if read is not None:
            dropped(read)  # the stage before: its rows are in this one's files now
        read = docs
    return docs
