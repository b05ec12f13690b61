"""A corpus pipeline: documents that the quality classifier rejects go, then repeated lines, then near copies; the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.

Defined cases are those of the operators; a document all of whose text was repeated lines goes with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import jaccard_join, line_dedup, packing, quality
from tidemark.llm.common import bounded, documents, unused, written
from tidemark.llm.queries import held_out, vocabulary


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of 0.5 or more."""
    model = quality.train(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out())
    name = unused(docs, "score")
    return quality.score(docs, model, name=name).where(F.col(name) >= 0.5).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier document, or an earlier place, already has."""
    out = line_dedup.cut(docs).where("n_dropped = 0 OR trim(text) <> ''")
    new = {"text": F.col("text"), "n_chars": F.char_length("text").cast("bigint")}
    return out.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the document with the least id."""
    groups = jaccard_join.join(docs, n=5, percent=80)
    gone = written(groups.where("component_id <> doc_id").select("doc_id").distinct(), "near-copies")
    return docs.join(bounded(gone), "doc_id", "left_anti").select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of op3 over what is left."""
    cut = packing.pieces(docs, vocabulary("word_bpe_49k.json"), end_id=1, kept=300_000)
    return packing.assign(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


STAGES = [("quality", quality_stage), ("line dedup", line_stage), ("n-gram Jaccard join", near_copy_stage), ("packing", packing_stage)]
#: No stage can be put in SQL as a whole; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
