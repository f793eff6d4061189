"""The flagship query of the core: what each source and language holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.sources.tables import table


def documents_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, characters and words by source and language: one scan, one partial aggregate.

    A null or empty text counts as a row without characters; null sources and languages are
    groups of their own; repeated rows count each. An empty table gives no rows. Other
    columns are ignored.
    """
    words = F.size(F.regexp_extract_all("text", F.lit(r"[^ \t\n\r]+"), F.lit(0)))
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(
        F.count("*").alias("n_docs"),
        F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("long").alias("n_chars"),
        F.sum(F.when(F.col("text").isNull(), 0).otherwise(words)).cast("long").alias("n_words"),
    )


DOCUMENTS_PROFILE_SQL = r"""
SELECT source, lang, count(*) AS n_docs,
       CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS n_chars,
       CAST(sum(coalesce(len(regexp_extract_all(text, '[^ \t\n\r]+')), 0)) AS BIGINT) AS n_words
FROM documents GROUP BY source, lang
"""
