import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from grantscope.llm import collocations as C
from grantscope.llm._scratch import Scratch
from grantscope.llm.collocations import DENSE, PLACES, Filter, Shard, collocations, shards_of


def brute(rows, support, longest=5, most=2000):
    f, n = Counter(), Counter()
    for own, text in rows:
        lang = "und" if own is None else own
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, longest + 1):
                for i in range(len(ws) - k + 1):
                    f[lang, tuple(ws[i : i + k])] += 1
    cand = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= support}
    inside = defaultdict(int)
    for (lang, ws), a in cand.items():
        for m in range(2, len(ws)):
            for i in range(len(ws) - m + 1):
                inside[lang, ws[i : i + m]] = max(inside[lang, ws[i : i + m]], a)
    out = defaultdict(list)
    for (lang, ws), a in cand.items():
        if inside[lang, ws] < a:
            score, _, left, right = min((1000 * a * n[lang] // (f[lang, ws[:k]] * f[lang, ws[k:]]), k, f[lang, ws[:k]], f[lang, ws[k:]]) for k in range(1, len(ws)))
            out[lang].append((-score, -a, " ".join(ws).encode(), left, right))
    return sorted((lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:most], 1))


def mined(spark, rows, **options):
    df = spark.createDataFrame(rows, "lang string, text string").withColumns({"phrase": F.lit(1), "f": F.lit("x"), "words": F.lit(None).cast("int")})
    return sorted(map(tuple, collocations(spark, df.repartition(3), **options).collect()))


def texts(rng, n, vocabulary):
    return ["".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " - "]) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_brute_force_with_nulls_ties_and_repeated_rows(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["en", "de", None, "und", ""]), t) for t in texts(rng, 300, ["a", "A", "b", "été", "ÉTÉ", "x y", "c", "日本", "#"])]
    rows += rows[:40] + [("en", None), (None, None), ("en", ""), ("fr", " . , ")]
    for support in (2, 15):
        assert mined(spark, rows, support=support) == brute(rows, support)
    assert mined(spark, rows, support=2, most=7) == brute(rows, 2, most=7)
    assert mined(spark, rows, support=3, longest=3) == brute(rows, 3, longest=3)


def test_a_text_longer_than_a_shard_and_without_a_pause(spark):
    rng = random.Random(6)
    rows = [("en", " ".join(rng.choice(["the", "the", "of", "a", "b", f"w{rng.randint(0, 2000)}"]) for _ in range(2 * PLACES + 500)))]
    assert mined(spark, rows, support=60) == brute(rows, 60)


def test_empty_table(spark):
    assert mined(spark, []) == []


def test_a_shard_gives_back_its_words():
    rng = random.Random(7)
    words = [rng.choice(["the"] * 5 + ["of", f"w{rng.randint(0, 50)}"]) + rng.choice(["", "", "", "."]) for _ in range(3 * DENSE)]
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    (row,) = shards_of(data, np.array([0, len(data)]), 4)
    shard = Shard(*row[1:])
    assert row[0] == len(words) and len(row[4]) == PLACES // 8
    got = [shard.words[c - 1].decode() if c else "." for c in shard.code.tolist()]
    assert " ".join(got[5:]).rstrip(" .").split() == " ".join(words).replace(".", " .").rstrip(" .").split()


def test_filter_lets_all_through_that_were_put_in(spark):
    rng = random.Random(8)
    inside = np.array([rng.getrandbits(64) for _ in range(5000)], np.uint64)
    other = np.array([rng.getrandbits(64) for _ in range(20000)], np.uint64)
    f = Filter.of(spark.createDataFrame([(int(x),) for x in inside.view(np.int64)], "h long"))
    assert f(inside).all() and f(other).mean() < 0.05
    assert not Filter.of(spark.createDataFrame([], "h long"))(other).any()


def test_a_frequent_phrase_is_told_once_in_however_many_parts_it_stands(spark):
    rng = random.Random(9)
    vocabulary = [f"w{n}" for n in range(12)]
    rows = [("en", t) for t in texts(rng, 400, vocabulary)]
    scratch = Scratch(spark, "collocations")
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(16)
    shards = scratch.write(C.index(docs, lang_col="lang", text_col="text", context=4), "shards")
    frequent, told = C.mined(scratch, shards, support=20, longest=5, context=4)
    frequent, told, parts = frequent.collect(), told.collect(), shards.select("part").distinct().count()
    assert parts == 16 and len(frequent) > 150
    assert {(r.h, r.k) for r in frequent} == {(r.h, r.k) for r in told if (r.h, r.k) in {(x.h, x.k) for x in frequent}}
    assert len(told) <= 1.05 * len(frequent)


def test_words_that_are_names_of_languages(spark):
    rng = random.Random(10)
    names = ["en", "es", "de", "und", "EN"]
    rows = [(rng.choice(["en", "es", "de", None]), t) for t in texts(rng, 300, names)]
    assert mined(spark, rows, support=5) == brute(rows, 5)
