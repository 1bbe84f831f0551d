"""Two analyses against each other, and counts at several levels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import checkpointed

SAME, MOVED, NEW, GONE = "same", "moved", "new", "gone"


def compared(old: DataFrame, new: DataFrame, keys: Sequence[str], place: str = "line") -> DataFrame:
    """What became of each row of ``old``, and what is new: ``keys``, ``state``, ``old_place`` and ``new_place``.

    Rows are told by ``keys``, which leave out the place, so they survive lines that move.  Both sides are multisets: of equal
    rows those at the same place are the same, the others are matched in order of their places and have moved, and
    what is left over is gone or new.  Null keys and places equal each other.
    """
    key = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})

    def side(df: DataFrame, name: str) -> DataFrame:
        own = df.select(F.struct(*keys).alias("row"), key.alias("key"), F.col(place).cast("long").alias(name))
        nth = F.row_number().over(Window.partitionBy("key", name).orderBy(F.lit(1)))  # equal rows: any order
        return own.withColumn("nth", nth)

    def matched(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
        left, right = (x.select("row", "key", n, *[F.coalesce(F.col(n if c == "at" else c).cast("string"), F.lit("")).alias(f"_{c}") for c in on]) for x, n in ((a, "old_place"), (b, "new_place")))
        joined = left.withColumn("_a", F.lit(True)).join(right.withColumnRenamed("row", "_row").withColumn("_b", F.lit(True)), ["key", *[f"_{c}" for c in on]], "full_outer")
        return joined.select(F.coalesce("row", "_row").alias("row"), "key", "old_place", "new_place", F.col("_a").isNotNull().alias("in_old"), F.col("_b").isNotNull().alias("in_new"))

    first = checkpointed(matched(side(old, "old_place"), side(new, "new_place"), ["at", "nth"]))  # read three times
    both = F.col("in_old") & F.col("in_new")
    ordered = lambda name: F.row_number().over(Window.partitionBy("key").orderBy(name))
    rest = [first.where(~both & F.col(flag)).select("row", "key", name).withColumn("nth", ordered(name)) for flag, name in (("in_old", "old_place"), ("in_new", "new_place"))]
    second = matched(*rest, ["nth"])
    state = F.when(both, MOVED).when(F.col("in_old"), GONE).otherwise(NEW)
    out = first.where(both).withColumn("state", F.lit(SAME)).unionByName(second.withColumn("state", state))
    return out.select("row.*", "state", "old_place", "new_place")


def rolled_up(rows: DataFrame, levels: Sequence[Sequence[str]], *, files: str = "file") -> DataFrame:
    """Counts of rows and of different files at several levels, in one pass over the rows.

    Each level is a set of columns; the result has all of them, ``level`` (the level's columns, joined by commas, empty for the
    total), ``n`` and ``files``.  A column that a level lacks is null there; a null that rows have is a group of its own, told
    apart by ``level``.
    """
    columns = list(dict.fromkeys(c for level in levels for c in level))
    # rows of a file and of equal columns are one before they are repeated for the levels; then each file is one row of each group
    per = rows.groupBy(*columns, F.col(files).alias("_file")).agg(F.count("*").alias("_n"))
    absent = [F.when(F.grouping(c) == 0, c) for c in columns]
    named = per.groupingSets([[*[F.col(c) for c in level], F.col("_file")] for level in levels], *columns, "_file").agg(F.concat_ws(",", *absent).alias("level"), F.sum("_n").alias("n"))
    out = named.groupBy("level", *columns).agg(F.sum("n").alias("n"), F.count("_file").alias("files"))
    return out.select("level", *columns, "n", "files")
