"""A document pipeline: five operators one after the other, each on all that its predecessor kept.

run(spark, sf_dir) applies STAGES to the table `documents`. Between stages the rows are written to the folder in
spark.checkpoint.dir, so that a lost executor costs no more than one stage. Rows without doc_id can't be named in a
decision: they are dropped by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from padlens.llm import decontaminate, packing, simhash, substring, toxicity
from padlens.llm.common import staged


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents predicted toxic, each row by its own text. The model learns from the labelled rows of docs that its
    folds allow. Rows repeated or of equal texts fare alike; a null or empty text is judged as one without words."""
    return toxicity.accepted(docs.filter("doc_id is not null"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five words, similarity of 0.8): the one of least doc_id, one row of
    it, that of the least text. Null, empty and wordless texts are copies of each other."""
    groups = simhash.similar_documents(docs)
    kept = docs.join(groups.filter("doc_id = component_id").select("doc_id").distinct(), "doc_id", "left_semi")
    rows = kept.groupBy("doc_id").agg(F.min(F.struct(F.col("text").alias("_"), F.struct(*docs.columns).alias("row"))).alias("least"))
    return rows.select(*(F.col(f"least.row.{c}") for c in docs.columns))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages out that an earlier document (or place) holds; documents stay, n_chars is counted anew. Null and empty
    texts, and texts of fewer words than a passage, stay as they are; rows repeated with a doc_id are cut alike."""
    return substring.without_spans(docs, substring.repeated_spans(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item: all rows of their doc_id. Null and empty texts hold none."""
    found = decontaminate.contained(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    found = staged(found.select("doc_id").distinct(), "contaminated")  # read back, Spark knows its size: broadcast if small
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into windows; one row for each piece. A null or empty text is the end id alone; repeated rows
    are packed each."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("substring dedup", cut_repeated_passages),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack_windows),
]

#: The stages train a model and hash texts, which SQL can't express; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the pipeline makes of `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = staged(docs, "stage")
    return docs
