"""Customer search on a trigram index.

The index is two Parquet tables: the distinct names, and one posting (tri,
customer_id, customer_name) for each trigram of a name in lower case, range
sorted by trigram, so that a search reads the row groups of its own trigrams
and a frequent trigram is spread over several files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import reference_data as R
from .metrics import customer_search

GRAM = 3


def write_search_index(df: DataFrame, path: str) -> None:
    """Write names and postings of the customers of ``df`` under ``path``. Null names have no postings."""
    who = ["customer_id", "customer_name"]
    df.select(*who).distinct().write.mode("overwrite").parquet(f"{path}/names")
    names = df.sparkSession.read.parquet(f"{path}/names")
    low = F.lower("customer_name")
    grams = F.transform(F.sequence(F.lit(1), F.length(low) - (GRAM - 1)), lambda i: F.substring(low, i, F.lit(GRAM)))
    postings = names.where(F.length(low) >= GRAM).select(F.explode(F.array_distinct(grams)).alias("tri"), *who)
    postings.repartitionByRange("tri", "customer_id").sortWithinPartitions("tri", "customer_id").write.mode("overwrite").parquet(f"{path}/postings")


def search_indexed(spark: SparkSession, path: str, q: str, limit: int = R.SEARCH_LIMIT) -> DataFrame:
    """``customer_search`` off the index: postings of the text's trigrams intersected, then verified.

    Texts of fewer than three characters scan the names.
    """
    text = (q or "").strip().lower()
    grams = sorted({text[i : i + GRAM] for i in range(len(text) - GRAM + 1)})
    if not grams:
        return customer_search(spark.read.parquet(f"{path}/names"), q, limit)
    hits = spark.read.parquet(f"{path}/postings").where(F.col("tri").isin(grams))
    # a customer's postings are counted in each task before they meet; customers of all trigrams are left
    both = hits.groupBy("customer_id", "customer_name").agg(F.count("*").alias("n")).where(F.col("n") == len(grams))
    return customer_search(both, q, limit)
