"""A corpus made ready for training: five stages, each over all that the one before it kept.

A stage takes (spark, docs, sf_dir) and gives the documents that it keeps, with all their columns; the last gives packed
pieces. Stages decide by row: rows without doc_id, and rows of several texts under one, are judged each by its own text.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.decontaminate import contamination
from helixframe.llm.exact import exact_groups
from helixframe.llm.near import near_components
from helixframe.llm.packing import pack
from helixframe.llm.queries import tokenizer_path
from helixframe.llm.runtime import cut, documents, written
from helixframe.llm.toxicity import train, without_toxic

#: SQL can express neither the classifier nor the near duplicates nor the packing.
ORACLE_SQL = None
#: A column beside those of docs, by which a stage tells rows apart.
ROW = "row of the stage"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under the threshold of their language."""
    return without_toxic(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def by_row(stage):
    """The stage that drops the rows of docs which `stage` names by ROW, a number that no two rows share.

    That number is doc_id where it is whole, never null and never repeated; otherwise rows are numbered and written, so that
    their numbers stay the same whenever they are read. So a row is judged by its own text, whatever id others have.
    """

    @functools.wraps(stage)
    def go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        rows, ids = docs.agg(F.count(F.lit(1)), F.count_distinct("doc_id")).first()
        if rows == ids and isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
            named = docs.withColumn(ROW, F.col("doc_id").cast("long"))
        else:
            named = written(docs.withColumn(ROW, F.monotonically_increasing_id()))
        gone = cut(stage(spark, named.select(F.col(ROW).alias("doc_id"), "text"), named.select(F.col(ROW).alias("row"), "doc_id"), sf_dir))
        return named.join(gone.toDF(ROW), ROW, "left_anti").select(*docs.columns)

    return go


def all_but_first(groups: DataFrame, names: DataFrame) -> DataFrame:
    """The rows of groups (row, whole) but one of each: that with the smallest doc_id, then the first."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row"))
    kept = groups.join(names, "row").groupBy("whole").agg(first.alias("first")).select("first.row")
    return groups.select("row").join(kept, "row", "left_anti")


@by_row
def exact_dedup(spark: SparkSession, docs: DataFrame, names: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts all but the one with the smallest doc_id."""
    groups = cut(exact_groups(docs).filter("group_size > 1").select(F.col("doc_id").alias("row"), F.col("keep_id").alias("whole")))
    return all_but_first(groups, names)


@by_row
def near_dedup(spark: SparkSession, docs: DataFrame, names: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, by runs of five words, all rows but the one with the smallest doc_id."""
    found = cut(near_components(docs, width=5).select(F.col("doc_id").alias("row"), F.col("component_id").alias("whole")))
    several = found.filter("row <> whole").select("whole").distinct()
    return all_but_first(found.join(several, "whole", "left_semi"), names)


@by_row
def decontamination(spark: SparkSession, docs: DataFrame, names: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a word in a benchmark window."""
    return contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter("contaminated").select("doc_id")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    return pack(docs, tokenizer_path())


STAGES = [("toxicity", toxicity), ("exact dedup", exact_dedup), ("near dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
