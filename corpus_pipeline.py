"""The corpus pipeline: stages over documents, each written as Parquet and read again.

All stages read texts of any length whole, leave columns that they don't know, whatever their names, as they are, and give no rows
for an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import decontaminate, linededup, packing, quality, simhash
from lodestar.llm.common import free_name, fresh_dir

#: Documents that must share a line's template.
RECURRING = 10

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without these doc_ids; rows with a null id stay."""
    name = free_name(docs, "gone")
    return docs.join(ids.select(F.col("doc_id").alias(name)).distinct(), F.col("`doc_id`").cast("long") == F.col(name), "left_anti")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the line classifier keeps, trained on the labels of these documents; all of them where no labels teach both kinds.

    A null or empty text, or one without a word, goes; a null id is judged by its text like any other; repeated rows stay or go together.
    """
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.kept_rows(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows without recurring lines, and n_chars of what is left; a row that loses its last word to this goes.

    Lines recur from RECURRING documents on: smaller groups of copies are left whole for the next stage to choose from.
    Rows with a null id or text stay as they are; an empty text has no line and stays; repeated rows lose the same lines.  Of lines of one
    template that of the smallest id, then number, stays.
    """
    count = free_name(docs, "lines_dropped")
    cut = linededup.without_lines(docs, linededup.dropped_lines(docs, min_docs=RECURRING, min_tokens=1), "doc_id", "text", count)
    left = cut.filter((F.col(count) == 0) | F.col("text").rlike(r"\S"))
    length = F.when(F.col(count) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", length).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id; rows of one id stay or go together.

    Null ids, null texts and texts without words are in no group and stay.
    """
    return _without(docs, simhash.near_copies(docs))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which no benchmark item is found.

    Null ids, null and empty texts stay, and all rows do where the benchmark is empty; repeated rows stay or go together.
    """
    return _without(docs, decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def related_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of related documents: (window, piece, doc_id, start, stop).

    Null ids, null texts and texts without words are in no window; rows that share an id are one document, the one of the most words.
    Related documents are walked along all their links, however many are connected.
    """
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", related_packing),
]

#: None: SQL can express neither the trained classifier nor the alignment; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages' result on the documents of sf_dir; each is written to the folder that executors share and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_dir(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
