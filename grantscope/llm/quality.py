"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio.

Words and word pairs of every document are hashed into a fixed number of
buckets.  Two multinomials over the buckets are compared: that of documents
labelled as trusted, and that of the whole corpus.  A document's score is the
mean over its n-grams of log(trusted / raw).  The threshold is the score that a
fixed share of the trusted documents reaches, read from a histogram of fixed
bins, so it is the same however the rows are dealt out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _words as W
from ._scratch import Scratch

BUCKETS = 1 << 16
BIN = 1 / 256
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True


def features(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and of all word pairs within a text, and the text of each."""
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    pair = W.ngrams(h, 2)
    inner = doc[1:] == doc[:-1] if len(doc) else np.zeros(0, bool)
    mask = np.uint64(BUCKETS - 1)
    return np.concatenate([W.mix(h) & mask, pair[inner] & mask]).astype(np.int64), np.concatenate([doc, doc[1:][inner]])


def repeats(h: np.ndarray, first: np.ndarray, width: int = 3) -> np.ndarray:
    """Per text, words in windows of ``width`` words that the text holds twice or more."""
    n = np.diff(first)
    out = np.zeros(len(n), np.int64)
    if len(h) < width:
        return out
    doc = np.repeat(np.arange(len(n)), n)
    start = np.flatnonzero(doc[width - 1 :] == doc[: len(doc) - width + 1])
    key = W.mix((W.ngrams(h, width)[start] ^ doc[start].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(order), bool)
    again[1:] |= same
    again[:-1] |= same
    hit = np.zeros(len(h) + 1, np.int64)
    at = start[order[again]]
    np.add.at(hit, at, 1)
    cover = np.convolve(hit, np.ones(width, np.int64))[: len(h)] > 0
    return np.bincount(doc[cover], minlength=len(n))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of bucket counts over the texts of a partition: one row per bucket seen."""
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        data, offsets = W.utf8(batch.column(0))
        for i, j in W.blocks(offsets):
            part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            starts, ends, first = W.spans(part, off)
            bucket, _ = features(W.hashes(part, starts, ends), first)
            total += np.bincount(bucket, minlength=BUCKETS)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["bucket", "n"])


def _totals(texts: DataFrame) -> np.ndarray:
    """How often each bucket is found in all texts: a row per bucket at most reaches the driver."""
    out = np.zeros(BUCKETS)
    for b, n in texts.select("text").mapInArrow(_counts, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[b] = n
    return out


def _score(ratio: np.ndarray):
    names = ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "total"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = W.utf8(batch.column(1))
            for i, j in W.blocks(offsets):
                part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                starts, ends, first = W.spans(part, off)
                h = W.hashes(part, starts, ends)
                bucket, doc = features(h, first)
                upto = lambda flag: np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
                point = upto(((part & 0xC0) != 0x80) & W.IS_WORD[part])
                symbol = upto(SYMBOL[part])
                lines = [_dup_lines(part[a:b].tobytes()) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                # a sum of whole numbers is the same in any order
                total = np.bincount(doc, np.rint(ratio[bucket] * (1 << 20)), minlength=j - i)
                cols = [np.diff(first), np.diff(point[off]), np.diff(symbol[off]), np.array(lines, np.int64), repeats(h, first), total.astype(np.int64)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *[pa.array(c, pa.int64()) for c in cols]], names)

    return run


def _dup_lines(text: bytes) -> int:
    if b"\n" not in text:
        return 0
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def judge(
    spark: SparkSession,
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    trusted: str = "quality = 1",
    keep_share: float = 0.995,
    min_words: int = 50,
    max_repeat: float = 0.5,
) -> DataFrame:
    """Base counts, likelihood ratio and verdict of every document.

    The trusted multinomial comes from all labelled documents, the raw one from all
    documents; labels meet documents in a join, so neither their ids nor texts reach the driver.  A
    document is kept if its base counts pass and its mean ratio reaches the score
    that ``keep_share`` of the trusted documents reach.

    Returns id, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words``, ``base_failed``, ``kept``, ``score`` (null without words)
    and ``threshold``.  Null and empty texts have no words and fail.  A null id is
    never trusted; rows of equal id are judged each by its own text.  Without
    trusted documents only the base counts decide.  A text of any length is read whole; of
    several repetitions all count; a score equal to the threshold is kept.  Other columns
    are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(spark, "quality")
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    chosen = labels.where(trusted).select(F.col(id_col).cast("long").alias("id")).where("id is not null").distinct()
    # merged at any size: a broadcast while labels are few would only hide what the join costs
    raw, good = _totals(slim), _totals(slim.where("text is not null").join(chosen.hint("merge"), "id", "left_semi"))
    ratio = np.zeros(BUCKETS)
    if good.sum():
        ratio = np.log((good + 1) / (good.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))
    scored = slim.mapInArrow(_score(ratio), "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, total long")
    scored = scratch.write(scored, "scored")
    grams = F.greatest(F.lit(1), F.col("n_words") * 2 - 1)
    score = F.when(F.col("n_words") > 0, F.col("total") / (F.lit(float(1 << 20)) * grams))
    scored = scored.withColumn("score", score)
    bar = _threshold(scored, chosen, keep_share)
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") > F.col("n_words") * max_repeat)
    return scored.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (F.col("score") >= F.lit(bar))).alias("kept"), "score", F.lit(bar).alias("threshold"),
    )


def _threshold(scored: DataFrame, chosen: DataFrame, keep_share: float) -> float:
    """The lower edge of the bin that holds the score reached by ``keep_share`` of the trusted."""
    bins = scored.where("n_words > 0").join(chosen, "id", "left_semi").groupBy(F.floor(F.col("score") / BIN).alias("b")).count()
    rows = sorted((r[0], r[1]) for r in bins.collect())
    allowed = sum(n for _, n in rows) * (1 - keep_share)
    for b, n in rows:
        allowed -= n
        if allowed < 0:
            return b * BIN
    return -math.inf
