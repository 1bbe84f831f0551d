"""Mixing sources to target weights by hash thresholds.

Each document has a uniform 48-bit hash.  Sizes are summed by source and hash
bucket; the running sum over a source's buckets finds the one in which its
budget ends, and only that bucket is summed again, finer, until single hash
values are left.  A document is then taken by comparing its hash with its
source's threshold, so documents are never sorted, and a smaller budget always
takes a subset of what a larger one takes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._scratch import Scratch

BITS, STEP = 48, 12
WORDS = r"[\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; null counts 0."""
    return F.coalesce(F.size(F.array_remove(F.split(text, WORDS), "")), F.lit(0)).cast("long")


def uniform_hash(key: Column) -> Column:
    """48 bits of the MD5 of the key as text (null: the empty text)."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], max_repeats: int, budget: float = 1.0) -> DataFrame:
    """Adds ``target`` to one row per source (``s``, ``sn``, ``total``).

    Sources by code point, null last, weigh ``weights`` in turn.  A target ends
    at ``max_repeats`` times the source's total; sources are capped in the order
    of that cap per weight while their share of what is left exceeds it, and the
    rest share what is left by weight.  The table has a row per source.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rank = F.row_number().over(Window.orderBy("sn", F.col("s").cast("binary")))
    w = F.element_at(cycle, ((rank - 1) % len(weights) + 1).cast("int"))
    df = sizes.withColumn("w", w).withColumn("cap", F.lit(float(max_repeats)) * F.col("total"))
    upto = Window.orderBy(F.col("cap") / F.col("w"), "sn", F.col("s").cast("binary")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    share = (F.sum("total").over(every) * F.lit(float(budget)) - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / (
        F.sum("w").over(every) - F.coalesce(F.sum("w").over(upto), F.lit(0.0))
    )
    df = df.withColumn("level", share).withColumn("capped", F.col("level") * F.col("w") >= F.col("cap"))
    rest = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("w"), "level"))).over(every)["level"]
    return df.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(rest * F.col("w"))).drop("w", "cap", "level", "capped")


def mix(
    spark: SparkSession,
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: Sequence[float] = (5.0, 2.0, 1.0),
    max_repeats: int = 3,
    budgets: Sequence[float] = (1.0,),
) -> DataFrame:
    """How many words of each document a weighted mix of the sources takes.

    Returns a row per row of ``docs``: the id, ``source``, ``size``,
    ``source_size``, and for each budget (a share of all words) ``target`` of the
    source and ``taken``, a multiple of ``size`` up to ``max_repeats`` times it;
    further budgets end in ``_1``, ``_2``...  A source's taken words differ from
    its target by at most half of one document (or of one group of equal ids).

    Null or empty texts have size 0 and take 0; texts of any length are counted whole; a null source is a source of its
    own; rows of equal id share a hash and so their fate; an empty table gives an
    empty result; other columns are ignored.
    """
    scratch = Scratch(spark, "mix")
    thin = scratch.write(_keyed(docs, id_col, source_col, text_col).select(F.col(f"`{id_col}`").alias("id"), "s", "sn", "size", "h"), "sizes")
    totals = scratch.write(thin.groupBy("s", "sn").agg(F.sum("size").alias("total")), "totals")
    out = thin.join(totals, ["s", "sn"])
    shown = [F.col("id").alias(id_col), F.when(~F.col("sn"), F.col("s")).alias("source"), "size", F.col("total").alias("source_size")]
    for n, budget in enumerate(budgets):
        end = f"_{n}" if n else ""
        state = _thresholds(scratch, thin, totals, budget, weights, max_repeats, n)
        out = out.join(state, ["s", "sn"]).withColumn(f"target{end}", F.col("target_")).withColumn(f"taken{end}", F.col("size") * copies())
        out = out.drop("target_", "repeats", "edge", "take_edge")
        shown += [f"target{end}", f"taken{end}"]
    return out.select(*shown)


def mixed(
    spark: SparkSession,
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: Sequence[float] = (5.0, 2.0, 1.0),
    max_repeats: int = 3,
    budget: float = 1.0,
) -> DataFrame:
    """The rows of ``docs``, each as often as :func:`mix` takes it, with all their columns.

    Thresholds, a row per source, are joined to the documents; texts are not shuffled
    while that table is small enough for Spark to broadcast.  Columns of ``docs`` may
    have any name.
    """
    scratch = Scratch(spark, "mixed")
    thin = scratch.write(_keyed(docs, id_col, source_col, text_col).select("s", "sn", "size", "h"), "sizes")
    totals = scratch.write(thin.groupBy("s", "sn").agg(F.sum("size").alias("total")), "totals")
    state = _thresholds(scratch, thin, totals, budget, weights, max_repeats, 0)
    inner = [f"_{i}_" for i in range(len(docs.columns))]
    plain = docs.toDF(*inner)
    of = dict(zip(docs.columns, inner, strict=True))
    rows = _keyed(plain, of[id_col], of[source_col], of[text_col], sized=False).join(state, ["s", "sn"]).withColumn("copies", copies())
    rows = rows.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.select(*inner).toDF(*docs.columns)


def _keyed(docs: DataFrame, id_col: str, source_col: str, text_col: str, sized: bool = True) -> DataFrame:
    """Adds the source (``s``, and ``sn`` if null), the hash ``h`` and the ``size``."""
    source = F.col(f"`{source_col}`")
    extra = [F.coalesce(source, F.lit("")).alias("s"), source.isNull().alias("sn"), uniform_hash(F.col(f"`{id_col}`")).alias("h")]
    if sized:
        extra.append(n_words(F.col(f"`{text_col}`")).alias("size"))
        return docs.select(F.col(f"`{id_col}`"), *extra)
    return docs.select("*", *extra)


def copies() -> Column:
    """How often a row is taken, from its source's threshold."""
    more = (F.col("h") < F.col("edge")) | (F.col("h") == F.col("edge")) & F.col("take_edge")
    return F.col("repeats") + F.when(more, F.lit(1)).otherwise(0).cast("long")


def _thresholds(scratch: Scratch, thin: DataFrame, totals: DataFrame, budget: float, weights, max_repeats: int, n: int) -> DataFrame:
    """Per source: target, whole repeats, the hash at which the rest ends and whether that hash is in."""
    key = ["s", "sn"]
    goal = targets(totals, weights, max_repeats, budget).withColumnRenamed("target", "target_")
    repeats = F.when(F.col("total") > 0, F.least(F.floor(F.col("target_") / F.col("total")), F.lit(max_repeats))).otherwise(0)
    goal = goal.withColumn("repeats", repeats.cast("long")).withColumn("rest", F.col("target_") - F.col("repeats") * F.col("total"))
    state = scratch.write(goal.select(*key, "target_", "repeats", "rest", F.lit(0).cast("long").alias("edge")), f"goal{n}")
    order = Window.partitionBy(*key).orderBy("b")
    for level in range(1, BITS // STEP + 1):
        shift = BITS - STEP * level
        bucket = F.shiftright("h", shift)
        inside = F.shiftright("h", shift + STEP) == F.col("edge") if level > 1 else F.lit(True)
        hist = thin.where("size > 0").join(state.select(*key, "rest", "edge"), key).where(inside)
        hist = hist.groupBy(*key, bucket.alias("b")).agg(F.sum("size").alias("n"), F.first("rest").alias("rest"))
        hist = hist.withColumn("upto", F.sum("n").over(order))
        found = hist.where(F.col("upto") > F.col("rest")).groupBy(*key).agg(
            F.min(F.struct("b", "n", "upto")).alias("x")
        )
        hit = F.col("x").isNotNull()
        state = state.join(found, key, "left").select(
            *key, "target_", "repeats",
            F.when(hit, F.col("rest") - F.col("x.upto") + F.col("x.n")).otherwise(F.col("rest")).alias("rest"),
            F.when(hit, F.col("x.b")).otherwise(F.shiftleft(F.col("edge") + 1, STEP) - 1).alias("edge"),
            F.coalesce(F.col("x.n"), F.lit(0)).alias("n"),
        )
        state = scratch.write(state, f"edge{n}_{level}")
    return state.select(*key, "target_", "repeats", "edge", ((F.col("rest") * 2 >= F.col("n")) & (F.col("n") > 0)).alias("take_edge"))
