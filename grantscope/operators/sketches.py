"""Counts of different values and quantiles by sketches that are stored and merged, so that a new run reads no old rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Registers of the distinct sketch, as a power of two (relative error 1.04 / sqrt(2 ** bits)), and items of a level of the quantile sketch (rank error some 1.7% at 200).
BITS, ITEMS = 12, 200


def sketched(rows: DataFrame, keys: Sequence[str], *, distinct: str, value: str, bits: int = BITS, items: int = ITEMS) -> DataFrame:
    """Per key the number of rows ``n``, a sketch of the different values of one column and one of the quantiles of a whole-number column.

    Nulls of both columns are left out of the sketches, a null key is one.  Sketches of a task are merged before they are shuffled, so a
    key of very many rows is a few of them.
    """
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.hll_sketch_agg(distinct, bits).alias("distinct_sketch"), F.kll_sketch_agg_bigint(F.col(value).cast("long"), items).alias("value_sketch"))


def merged(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sketches of the same or finer keys, of several runs, as one for each key."""
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_bigint("value_sketch").alias("value_sketch"))


def estimates(sketches: DataFrame, keys: Sequence[str], quantiles: Sequence[float] = (0.5, 0.9)) -> DataFrame:
    """Per key ``n``, ``n_distinct`` and ``quantiles`` (null where no value was seen)."""
    some = F.kll_sketch_get_n_bigint("value_sketch") > 0
    points = F.array(*[F.lit(float(q)) for q in quantiles])
    return sketches.select(*keys, "n", F.hll_sketch_estimate("distinct_sketch").alias("n_distinct"), F.when(some, F.kll_sketch_get_quantile_bigint("value_sketch", points)).alias("quantiles"))
