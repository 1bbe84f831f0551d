"""Substrings of stored texts by posting lists of their trigrams.

The index has a row for each trigram and row that holds it, dealt to folders by the trigram's hash and sorted in
them.  A search reads the folders of its own trigrams only, keeps the rows that have all of them, and looks for the
text in these; a text of fewer than three characters has no trigram and is looked for in all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of an index.
PARTS = 64
SIZE = 3


def grams(text: Column) -> Column:
    """The different trigrams of a text in lower case; none if it is null or shorter."""
    low = F.lower(text)
    starts = F.when(F.length(low) >= SIZE, F.sequence(F.lit(1), F.length(low) - SIZE + 1))
    return F.coalesce(F.array_distinct(F.transform(starts, lambda i: F.substring(low, i, F.lit(SIZE)))), F.array().cast("array<string>"))


def _part(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(PARTS)).cast("int")


def write_index(rows: DataFrame, path: str, *, key: str, text: Column) -> None:
    """Writes the index of ``text`` below ``path``; ``key`` tells rows apart, and equal or null ones share their texts.

    A trigram of very many rows is one folder's, written by as many tasks as its keys are dealt to.
    """
    post = rows.select(F.col(key).alias("key"), F.explode(grams(text)).alias("gram")).withColumn("part", _part(F.col("gram")))
    spread = post.repartition("part", F.pmod(F.xxhash64("key"), F.lit(8))).sortWithinPartitions("part", "gram")
    spread.write.partitionBy("part").parquet(path)


def search(spark: SparkSession, rows: DataFrame, path: str, query: str, *, key: str, text: Column) -> DataFrame:
    """The rows of ``rows`` whose ``text`` holds the query in any case, as a scan of all of them would find them.

    ``path`` has the index of the same rows.  A null text holds nothing; the empty query is held by every other.
    """
    low = spark.range(1).select(F.lower(F.lit(query)).alias("q"), grams(F.lit(query)).alias("g"), F.transform(grams(F.lit(query)), _part).alias("p")).first()
    if low["g"]:
        kind = rows.schema[key].dataType.simpleString()
        index = spark.read.schema(f"key {kind}, gram string, part int").parquet(path)
        own = index.where(F.col("part").isin(*sorted(set(low["p"]))) & F.col("gram").isin(*low["g"])).distinct()
        held = own.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") == len(low["g"])).select(F.col("key").alias("_key"))
        rows = rows.join(held, F.col(key).eqNullSafe(F.col("_key")), "left_semi")
    return rows.where(F.contains(F.lower(text), F.lit(low["q"])))
