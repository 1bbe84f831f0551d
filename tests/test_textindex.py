"""Searches by the index against a scan."""

import random

import pytest
from pyspark.sql import functions as F

from grantscope.operators.textindex import search, write_index

QUERIES = ["", "a", "ab", "abc", "ABC", "abca", "é", "éaé", "bcabca", "x y", "aaa", "%_a", "zzz", "İa", "日本語"]


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    rng = random.Random(2)
    rows = [(k, None if k % 17 == 0 else "".join(rng.choice(["a", "b", "c", "A", "é", "É", "x y", "日本語", "%_", "İ"]) for _ in range(rng.randint(0, 14)))) for k in range(300)]
    df = spark.createDataFrame([*rows, *rows[:10], (None, "abcabc")], "id int, t string")
    path = str(tmp_path_factory.mktemp("index") / "i")
    write_index(df, path, key="id", text=F.col("t"))
    return df, path


@pytest.mark.parametrize("query", QUERIES)
def test_search_finds_what_a_scan_finds(spark, indexed, query):
    df, path = indexed
    got = search(spark, df, path, query, key="id", text=F.col("t")).collect()
    want = df.where(F.contains(F.lower("t"), F.lower(F.lit(query)))).collect()
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_a_search_reads_the_folders_of_its_trigrams(spark, indexed):
    df, path = indexed
    plan = search(spark, df, path, "abcab", key="id", text=F.col("t"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan or "PartitionFilters: [part" in plan
    assert "PushedFilters: [In(gram" in plan
