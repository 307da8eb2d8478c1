"""The corpus pipeline: stages over documents, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage
before kept; all but the last return the columns of documents. Further columns
stay, whatever their names (temporary columns get names that the table does not
have). Null, empty and repeated texts are defined in each stage's docstring; an
empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from protolake.llm.langid import fit_languages, identify
from protolake.llm.minhash import near_duplicates, without
from protolake.llm.mixing import mixed
from protolake.llm.packing import pack_documents
from protolake.llm.rows import unused
from protolake.llm.storage import scratch, stored
from protolake.llm.toxicity import fit_toxicity, score_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go. Null, empty and wordless texts score 0 and stay; repeated rows share their fate."""
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model, only_clean=True)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty ones too), or whose best language is below the rejection level, go."""
    return identify(docs, fit_languages(docs), only_accepted=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each component stays, once; texts without a shingle (null, empty) and rows without doc_id are linked with nothing and stay.

    Rows of one doc_id are one document: the one with the least hash of its text stays.
    """
    judged = stored(near_duplicates(docs).select("doc_id", "kept"), "kept")
    out = without(docs, stored(judged.filter("doc_id is not null and not kept").select("doc_id").distinct(), "removed"))
    repeated = judged.filter("kept").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if repeated.isEmpty():
        return out
    mine, nth = unused(docs, "kept_id"), unused(docs, "nth")
    ids, same = repeated.select(F.col("doc_id").alias(mine)), F.col("doc_id") == F.col(mine)
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    once = out.join(ids, same, "left_semi").withColumn(nth, F.row_number().over(first)).filter(F.col(nth) == 1).drop(nth)
    return out.join(ids, same, "left_anti").unionByName(once)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, each as often as slots take the block that it begins in (none, one or two times), in slot order inside every file.

    Texts without a word (null, empty) are in no block and go; a null source is a source; repeated rows are documents each.
    """
    return mixed(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of every document, with its sequence and its offset there. Null and empty texts give one piece with the end id."""
    return pack_documents(docs).drop("row_id")


STAGES = [
    ("toxicity", toxicity),
    ("language ID", language_id),
    ("near-duplicates", near_dedup),
    ("source mix", source_mix),
    ("best-fit packing", best_fit_packing),
]

#: Trained models, signatures and packing have no SQL form; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = scratch(spark, f"stage-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
