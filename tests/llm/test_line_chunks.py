"""Repeated chunks with the lines around them, against plain Python, and how many repeated lines they find."""

import random

import pytest
from pyspark.sql import functions as F

from grantscope.llm import line_dedup

REACH = line_dedup.REACH


def left(cuts):
    """(text, runs) of each (id, text, chunks), in plain Python; rows in order of their ids, null last."""
    order = sorted(cuts, key=lambda c: (c[0] is None, c[0] or 0))
    lines = {i: t.split("\n") for i, t, _ in order if t is not None}
    seen, out = {}, {}
    for i, text, cut in order:
        if text is None:
            out[i] = (None, 0)
            continue
        gone, at, seeds = set(), 0, []
        for chunk in cut:
            size = chunk.count("\n") + 1
            if size > 1 and chunk.strip():
                first = seen.setdefault(chunk, (i, at))
                if first != (i, at):
                    seeds.append((at, size, *first))
            at += size
        for at, size, fid, fat in seeds:
            gone.update(range(at, at + size))
            for edge, way in ((at, -1), (at + size - 1, 1)):
                follows = [s for s in seeds if (s[0] + s[1] == at if way < 0 else s[0] == at + size)]
                if any(s[2] == fid and s[0] - s[3] == at - fat for s in follows):
                    continue
                for k in range(1, REACH + 1):
                    here, there = edge + way * k, edge + way * k - (at - fat)
                    if min(here, there) < 0 or here >= len(lines[i]) or there >= len(lines[fid]) or lines[i][here] != lines[fid][there]:
                        break
                    gone.add(here)
        kept = "\n".join(x for k, x in enumerate(lines[i]) if k not in gone)
        out[i] = (kept, sum(k - 1 not in gone for k in gone))
    return out


def cuts_of(df):
    got = df.select("id", "body", line_dedup.chunks(F.col("body")).alias("c"), line_dedup.starts(F.col("body")).alias("s")).collect()
    for r in got:
        if r.body is not None:
            sizes = [c.count("\n") + 1 for c in r.c]
            assert r.s == [sum(sizes[:k]) for k in range(len(sizes))]
    return [(r.id, r.body, r.c) for r in got]


@pytest.mark.parametrize("hot", [1000, 2])
def test_chunks_and_their_neighbours(spark, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    rng = random.Random(6)
    passages = [[f"passage {n}, line {k}" for k in range(n)] for n in (3, 6, 12, 30)]
    rows = []
    for i in range(60):
        own = [f"own {i} {k}" for k in range(rng.randrange(0, 7))]
        at = rng.randrange(len(own) + 1)
        rows.append((i, "\n".join(own[:at] + passages[i % 4][: 28 if i % 3 else 30] + own[at:])))
    rows += [(100 + i, "\n".join(rng.choice(["", " ", "a", "b", "c", "\x00", "\x00x"]) for _ in range(rng.randrange(1, 40)))) for i in range(40)]
    rows += [(500, None), (501, ""), (502, "\n\n\n"), (503, "one line"), (None, rows[3][1] + "\nnew"), (504, rows[3][1])]
    df = spark.createDataFrame(rows, "id long, body string").withColumn("chunk", F.lit(1)).withColumn("at", F.lit("x")).repartition(4)
    got = {r.id: (r.text, r.n_removed) for r in line_dedup.dedup_chunks(spark, df, id_col="id", text_col="body").collect()}
    cuts = [(i, t, c) for i, t, c in cuts_of(df)]
    assert got == left(cuts)
    assert got[504] == ("", 1) and got[None] == ("new", 1)
    assert line_dedup.dedup_chunks(spark, df.limit(0), id_col="id", text_col="body").count() == 0
    twice = df.where("id in (3, 504)").unionByName(df.where("id in (3, 504)"))
    assert sorted((r.id, r.n_removed) for r in line_dedup.dedup_chunks(spark, twice, id_col="id", text_col="body").collect()) == [(3, 0), (3, 0), (504, 1), (504, 1)]


def test_recall_by_length_of_passage(spark):
    """Of the lines of passages that stand twice, in texts of their own, the share that goes."""
    rng = random.Random(3)
    rows, n, lengths = [], 0, (2, 4, 6, 8, 10, 12, 16, 20)
    for size in lengths:
        for p in range(150):
            passage = [f"{size} {p} {k} {rng.random()}" for k in range(size)]
            for _ in range(2):
                own = [f"own {n} {k} {rng.random()}" for k in range(12)]
                at = rng.randrange(1, 12)
                rows.append((n, size, "\n".join(own[:at] + passage + own[at:])))
                n += 1
    df = spark.createDataFrame(rows, "id long, size long, body string")
    got = line_dedup.dedup_chunks(spark, df.select("id", "body"), id_col="id", text_col="body").collect()
    kept = {r.id: r.text.split("\n") for r in got}
    recall = {}
    for size in lengths:
        mine = [r for r in rows if r[1] == size]
        assert all(sum(x.startswith("own ") for x in kept[r[0]]) == 12 for r in mine)  # no line of its own goes
        recall[size] = sum(r[2].count("\n") + 1 - len(kept[r[0]]) for r in mine) / (150 * size)
    print({k: round(v, 3) for k, v in recall.items()})
    assert all(v >= 0.9 for k, v in recall.items() if k >= 12) and recall[20] > 0.98, recall
