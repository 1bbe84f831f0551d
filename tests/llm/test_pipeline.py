"""The corpus pipeline against a plain-Python model, stage by stage."""

import collections
import hashlib
import os
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_llm import DOCS, model_components, model_targets, words_of
from tokenizers import Tokenizer

import corpus_pipeline
from grantscope.llm._scratch import CLEANUP, Scratch

LETTERS = {"en": "aeioulmnst", "fr": "éèàçouvlrm"}


def text_of(rng, lang, n):
    return " ".join("".join(rng.choice(LETTERS[lang]) for _ in range(rng.randrange(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(12)
    bench = [(k, text_of(rng, "en", 25)) for k in range(5)]
    docs = []
    for i in range(90):
        lang = rng.choice(["en", "fr"])
        text = text_of(rng, lang, rng.randrange(20, 120))
        if i % 10 == 3:
            text += "\n" + bench[i % 5][1] + " and more"
        docs.append((i, text, lang, f"s{i % 3}", len(text)))
    for i in range(90, 120):
        words = docs[rng.randrange(40)][1].split(" ")
        if i % 2:
            words[rng.randrange(len(words))] = "changed"
        docs.append((i, " ".join(words), "en", None if i % 7 == 0 else "s1", None))
    docs += [(120, None, None, "s0", None), (121, "", "en", "s0", 0), (122, "12 34 -- 56", "en", "s2", 11), (4, docs[4][1], "en", "s1", 1)]
    root = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root), docs, bench


def model(docs, bench):
    docs = [d for d in docs if d[1] and any(c.isalpha() for c in d[1])]
    least = {component for _, _, component in model_components(docs)}
    once = {}
    for d in sorted(docs, key=lambda d: d[0]):
        if d[0] in least and d[0] not in once:
            once[d[0]] = d
    docs = list(once.values())
    squeeze = lambda t: " ".join(t.lower().split())
    docs = [d for d in docs if not any(squeeze(b) in squeeze(d[1]) for _, b in bench)]
    sizes = collections.Counter()
    for d in docs:
        sizes[d[3]] += len(words_of(d[1]))
    target = model_targets(dict(sizes), (5, 2, 1), 3)
    mixed = []
    for source, total in sizes.items():
        own = sorted((int(hashlib.md5(str(d[0]).encode()).hexdigest()[:12], 16), d) for d in docs if d[3] == source)
        whole = min(3, int(target[source] // total))
        rest = target[source] - whole * total
        for _, d in own:
            n = len(words_of(d[1]))
            if rest >= n:
                more = 1
            else:
                more = int(2 * rest >= n)
                n = float("inf")
            rest -= n
            mixed += [d] * (whole + more)
    tok, at, out = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for d in sorted(mixed, key=lambda d: d[0]):
        ids = [*tok.encode(d[1], add_special_tokens=False).ids, 2]
        out.append((d[0], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_run(spark, tables):
    root, docs, bench = tables
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.run(spark, root).collect())
    assert got == sorted(model(docs, bench))


def test_stages(spark, tables):
    root, docs, _ = tables
    df = spark.read.parquet(f"{root}/documents.parquet")
    kept = corpus_pipeline.language_id(spark, df, root)
    assert kept.columns == df.columns and {r.doc_id for r in df.collect()} - {r.doc_id for r in kept.collect()} == {120, 121, 122}
    single = corpus_pipeline.ngram_jaccard_join(spark, df, root)
    assert single.columns == df.columns and single.groupBy("doc_id").count().where("count > 1").count() == 0
    clean = corpus_pipeline.benchmark_decontamination(spark, df, root)
    gone = {r.doc_id for r in df.collect()} - {r.doc_id for r in clean.collect()}
    assert {i for i in range(90) if i % 10 == 3} <= gone and clean.columns == df.columns
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.limit(0), root).count() == 0


def test_language_stage_without_languages(spark):
    rows = [(1, "some words", None), (2, "été", None), (3, "12 -- 3", None), (4, "", None), (5, None, None), (6, "語", None)]
    rows += [(k, "no text of a known language is learned", "en") for k in range(100, 160) if zlib.crc32(str(k).encode()) % 4 == 2]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = corpus_pipeline.language_id(spark, df, "")
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {3, 4, 5}


def test_jaccard_stage_decides_per_row(spark):
    rng = random.Random(31)
    a, b, c, d = (text_of(rng, "en", 60) for _ in range(4))
    near = b + " " + text_of(rng, "en", 2)
    rows = [(1, a, "en", "s0", 1), (1, b, "en", "s0", 2), (7, near, "en", "s1", 3), (None, c, "en", "s1", 4), (None, c, "en", "s2", 5), (None, d, "en", "s1", 6), (9, d, "en", "s1", 7)]
    rows += [(3, "", "en", "s1", 8), (3, None, "en", "s1", 9), (None, "", "en", "s1", 10), (5, a, "en", "s3", 11), (1, a, "en", "s3", 12), (2, near, "en", "s3", 13), (2, b, "en", "s3", 14)]
    df = spark.createDataFrame(rows, DOCS)
    got = [sorted((r.n_chars for r in corpus_pipeline.ngram_jaccard_join(spark, x, "").collect())) for x in (df, df.orderBy(F.desc("n_chars")).repartition(5))]
    assert got[0] == got[1]
    kept = {r[4]: r for r in rows if r[4] in got[0]}
    assert {8, 9, 10} <= set(kept) and len(got[0]) == len(kept) == 7
    # a by id 1 once, b by id 1, c once though without an id, d by id 9
    assert sorted((r[0] or 0, r[1]) for r in kept.values() if r[1]) == sorted([(1, a), (1, b), (0, c), (9, d)])


def test_jaccard_stage_leaves_no_shuffle_files(spark, tables):
    # they stayed until the driver collected its garbage, so the disk held the shuffles of all queries of a stage
    root, _, _ = tables
    df = spark.read.parquet(f"{root}/documents.parquet")
    places = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    shuffles = lambda: {f.split("_")[1] for d in places for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}
    before, had = shuffles(), spark.conf.get(CLEANUP)
    out = Scratch(spark, "t").write(corpus_pipeline.ngram_jaccard_join(spark, df, root), "out")
    until = time.time() + 10  # executors are told after a query's end
    while len(shuffles() - before) > 8 and time.time() < until:
        time.sleep(0.2)
    assert out.count() and len(shuffles() - before) <= 8  # those of small numbers that the driver collects
    assert spark.conf.get(CLEANUP) == had
