"""Text units of canonical instances: questions, answers and candidate sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sentences(instances: DataFrame, *extra: str) -> DataFrame:
    """(id, paragraph_id, sentence_id, text, label, *extra): one row for each candidate sentence. Only the nested fields named here are read."""
    exploded = instances.select("id", *extra, F.explode("candidates").alias("c")).select("id", *extra, F.col("c.id").alias("paragraph_id"), F.col("c.language").alias("label"), F.posexplode("c.sentences").alias("sentence_id", "text"))
    return exploded.select("id", "paragraph_id", "sentence_id", "text", "label", *extra)


def field(instances: DataFrame, name: str, label: str, *extra: str) -> DataFrame:
    """The question or the answer as units, with the names that TESTDATA.md gives them."""
    return instances.select("id", F.lit("").alias("paragraph_id"), F.lit(-1).alias("sentence_id"), F.col(name).alias("text"), F.col(label).alias("label"), *extra)
