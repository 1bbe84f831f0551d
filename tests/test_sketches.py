"""Merged sketches against exact counts and quantiles."""

import random

from grantscope.operators import sketches


def test_merged_runs_are_within_the_bounds(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "b", None]), rng.choice("xy"), f"f{rng.randint(0, 30_000)}", rng.choice([None, rng.randint(0, 10**6)])) for _ in range(60_000)]
    df = spark.createDataFrame(rows, "k string, m string, file string, v int")
    runs = [df.where(f"hash(file) % 3 = {n} or hash(file) % 3 = {n - 3}") for n in range(3)]
    stored = [sketches.sketched(x, ["k", "m"], distinct="file", value="v") for x in runs]
    found = sketches.merged(stored[0].unionByName(stored[1]).unionByName(stored[2]), ["k"])
    for r in sketches.estimates(found, ["k"], (0.1, 0.5, 0.9)).collect():
        own = [x for x in rows if x[0] == r.k]
        files, values = len({x[2] for x in own}), sorted(x[3] for x in own if x[3] is not None)
        assert r.n == len(own) and abs(r.n_distinct - files) <= 4 * 1.04 / 2**6 * files
        for q, x in zip((0.1, 0.5, 0.9), r.quantiles, strict=True):
            assert abs(sum(v <= x for v in values) / len(values) - q) < 0.04


def test_no_rows_and_no_values(spark):
    df = spark.createDataFrame([("a", None, None), ("a", None, None)], "k string, file string, v int")
    (r,) = sketches.estimates(sketches.sketched(df, ["k"], distinct="file", value="v"), ["k"]).collect()
    assert (r.n, r.n_distinct, r.quantiles) == (2, 0, None)
    assert sketches.estimates(sketches.merged(sketches.sketched(df.limit(0), ["k"], distinct="file", value="v"), ["k"]), ["k"]).count() == 0
