"""A corpus pipeline: language ID, deduplication, decontamination, mixing, token output.

Each stage takes the session, what the stage before kept, and the folder of the
tables; all but the last return the columns of ``documents``.  Every stage's result
is written as Parquet and read again, and the operators' own tables are removed then.

All stages take whole texts of any length, nulls in any column, repeated rows and
columns beside those of ``documents``; an empty table goes through as an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grantscope.llm._scratch import Scratch, open_folders, release
from grantscope.llm.decontaminate import contaminated
from grantscope.llm.jaccard import join_classes
from grantscope.llm.language import UND, identify, train
from grantscope.llm.mixing import mixed
from grantscope.llm.token_output import read_tokens, write_tokens

TOKENIZER = "byte_bpe_50k.json"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents in which a language was found: those with a letter.

    Which language it is decides nothing, as no list of wanted ones is given.  If none
    was learned, the documents with a letter stay too.  A null text has no letter; rows of
    equal text share their fate, whatever their ids.
    """
    model = train(docs)
    if not model.langs:
        return docs.where(F.rlike("text", F.lit(r"\p{L}")))
    found = identify(spark, docs, model)
    return found.where(F.col("lang_pred") != UND).select(*docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of similar documents the row of least id, then of least text hash.

    Rows are told apart by id and text, so rows of one id with unlike texts are in
    groups of their own, and rows without an id (the last in order) are grouped too.  Of
    rows with equal id and text the one of least hash stays.  Documents without a word
    are in no group and stay.
    """
    # joins are sort-merge joins at every size: the plan, and what it moves, then grow alike
    scratch = Scratch(spark, "groups")
    th = F.xxhash64("text")
    found = join_classes(spark, docs.select("doc_id", "text", th.alias("th")), carry=["th"], label_col="label")
    found = found.groupBy(F.col("doc_id").alias("gid"), F.col("th").alias("gth")).agg(F.min("label").alias("label"), F.count("*").alias("times"))
    found = scratch.write(found, "found")
    place = F.struct(F.col("gid").isNull().alias("nul"), "gid", "gth", "times").alias("first")
    first = found.where("label is not null").groupBy("label").agg(F.min(place).alias("first"))
    first = scratch.write(first.select("first.gid", "first.gth", "first.times"), "kept")
    single = first.where("times = 1").select("gid", "gth").unionByName(found.where("label is null").select("gid", "gth"))
    keyed = docs.withColumn("_th", th)
    on = lambda rows: keyed["doc_id"].eqNullSafe(rows["gid"]) & (keyed["_th"] == rows["gth"])
    rows = keyed.join(single.hint("merge"), on(single), "left_semi").select(*docs.columns)
    if first.where("times > 1").limit(1).count():
        # several rows of equal id and text: one of them stays
        several = first.where("times > 1").select("gid", "gth")
        own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        twice = keyed.join(several.hint("merge"), on(several), "left_semi").groupBy("doc_id", "_th").agg(F.min_by(own, F.xxhash64(own)).alias("own"))
        rows = rows.unionByName(twice.select("own.*"))
    return rows


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark passage.

    Null and empty texts hold none and stay, as does everything if the benchmark is empty;
    rows of equal text share their fate.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contaminated(spark, docs, benchmark).where(F.size("leaks") == 0).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the weighted mix of the sources takes them.

    A null source is a source of its own.  Rows of equal id, null ids among them, share a
    hash and so are taken equally often, each by itself; rows of size 0, with null, empty
    or blank texts, add no words and go or stay with their hash.
    """
    return mixed(spark, docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token shards and returns what they hold, read back from the files.

    Each row is a document of its own, in ascending order of id, null ids first, equal ones
    by their tokens; null and empty texts hold only the end id.
    """
    shards = write_tokens(spark, docs, Scratch(spark, "corpus", keep=True).root, tokenizer_path=public_tokenizers.path(TOKENIZER))
    return read_tokens(spark, shards)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language_id),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", token_output),
]

#: The method of several stages has no SQL form; tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs, since = spark.read.parquet(f"{sf_dir}/documents.parquet"), open_folders()
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage-{k}")
        release(spark, since)
        if k:
            scratch.drop(f"stage-{k - 1}")
    return docs
