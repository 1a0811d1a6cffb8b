"""From raw documents to a training mixture, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs.  Stages take the
columns of documents and no others, so further columns of the input, whatever
their names, play no part.  Null and empty texts have no letter and go at the
first stage; repeated rows are near-duplicates of each other, of which the one with the least
id stays, ties to any one row.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.llm import decontam, lang_id, mixing, near_dup, secrets, store

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents, sets the language of those without a label, and drops texts without a letter.

    Where no document has a label, no language is set, and the same texts are kept.
    """
    model = lang_id.learn(docs)
    if not model.languages:
        return docs.select(*COLUMNS).where(F.col("text").rlike(r"\p{L}"))
    found = lang_id.identify(docs.select(*COLUMNS), model)
    return found.where("lang_pred <> 'und'").withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each near-duplicate group: that of the least id."""
    return near_dup.keep_one(docs.select(*COLUMNS))


def cut_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the spans that benchmark windows hit."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontam.decontaminate(docs.select(*COLUMNS), items)
    return decontam.remove_spans(found).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by a mark."""
    return secrets.redact(secrets.find_secrets(docs.select(*COLUMNS))).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents to the target weights; returns those drawn, with their probability."""
    mixed = mixing.mix(docs.select(*COLUMNS)).where("cv_sampled")
    return mixed.select(*COLUMNS, F.col("cv_topic").alias("topic"), F.col("cv_tokens").alias("n_tokens"), F.round("cv_probability", 6).alias("probability"))


STAGES = [
    ("language_id", identify_languages),
    ("near_dup", drop_near_duplicates),
    ("decontamination", cut_benchmark_passages),
    ("secret_scans", redact_secrets),
    ("mixing", mix_sources),
]

#: The mixture model of the first stage can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store.publish(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
