import hashlib
import random
import zlib
from collections import defaultdict
from datetime import datetime, timedelta
from math import floor

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from grantscope.llm import queries
from grantscope.llm._scratch import Scratch
from grantscope.llm.compaction import by_lots, compact, digests, pack_runs, write_files


def first_fit(sizes, limit):
    groups = []
    for n, size in enumerate(sizes):
        at = next((g for g in groups if g[0] + size <= limit), None)
        if at is None:
            groups.append(at := [0, []])
        at[0] += size
        at[1].append(n)
    return [g[1] for g in groups]


@pytest.mark.parametrize("seed", range(60))
def test_runs_pack_as_first_fit(seed):
    rng = random.Random(seed)
    limit = rng.choice([1, 2, 7, 30, 100, 1000])
    sizes = sorted((rng.randint(1, max(1, limit // rng.choice([1, 2, 5, 20]))) for _ in range(rng.randint(0, 120))), reverse=True)
    runs = [(s, sizes.count(s)) for s in set(sizes)]
    start = {s: sizes.index(s) for s in set(sizes)}
    groups = defaultdict(list)
    for r in pack_runs(runs, limit):
        for o in range(r.first, r.last):
            groups[r.group + (o - r.first) // r.each].append(start[r.size] + o)
    assert [sorted(groups[g]) for g in sorted(groups)] == first_fit(sizes, limit)


def test_work_follows_sizes_not_files():
    placed = pack_runs([(7, 10**12), (3, 10**15)], 100)
    assert len(placed) < 10 and sum(r.last - r.first for r in placed) == 10**12 + 10**15


def brute(rows, S_small, S_limit, S_lot):
    """Final files by a plain loop over rows of (click_id, arrived_at, value)."""
    days = defaultdict(list)
    for r in rows:
        days[None if r["arrived_at"] is None else (r["arrived_at"] - datetime(1970, 1, 1)).days].append(r)
    out = {}
    for day, own in days.items():
        files = defaultdict(list)
        for r in own:
            h = zlib.crc32(("" if r["click_id"] is None else str(r["click_id"])).encode())
            files[floor(h / 16) % (1 + len(own) // S_lot), min(h % 4, h // 4 % 4)].append(r)
        for f in files.values():
            f.sort(key=lambda r: (r["arrived_at"] is not None, r["arrived_at"] or datetime.min, r["click_id"] is not None, r["click_id"] or 0))
        small = sorted((k for k, f in files.items() if len(f) < S_small), key=lambda k: (-len(files[k]), *k))
        groups = [[small[i] for i in g] for g in first_fit([len(files[k]) for k in small], S_limit)] + [[k] for k in files if k not in set(small)]
        for g in groups:
            ids = [r["click_id"] for k in g for r in files[k]]
            cents = sum(floor(100 * (r["value"] or 0) + 0.5) for k in g for r in files[k])
            own_ids = [i for i in ids if i is not None]
            digest = hashlib.sha256(",".join("" if i is None else str(i) for i in ids).encode()).hexdigest()
            out[day, *g[0]] = (len(ids), min(own_ids, default=None), max(own_ids, default=None), cents, ",".join(f"{a}-{b}" for a, b in g), digest, len(g) > 1)
    return out


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = [r.asDict() for r in spark.read.parquet(f"{folder}/clicks.parquet").select("click_id", "arrived_at", "value").collect()]
    share = lambda x: 1 + len(rows) // x
    found = queries.op11_compaction(spark, folder).collect()
    own = {(r.day, r.lot, r.piece): (r.n_rows, r.min_click_id, r.max_click_id, r.cents, r.sources, r.ids_sha256, r.rewritten) for r in found}
    assert own == brute(rows, share(600), share(500), share(150)) and len(own) == len(found)
    assert any(r.rewritten for r in found) and not all(r.rewritten for r in found)
    assert {r.columns for r in found} == {",".join(spark.read.parquet(f"{folder}/clicks.parquet").columns)}


def packed(spark, df, small=8, limit=12, per_lot=20):
    root = Scratch(spark, "t", keep=True).root
    keys = ["day", "lot", "piece"]
    files = write_files(by_lots(spark, df, time_col="arrived_at", id_col="click_id", per_lot=per_lot), root, keys, ["arrived_at", "click_id"])
    files = Scratch(spark, "f").write(files, "files")
    stamps = {r.path: pq.ParquetFile(r.path.removeprefix("file://")).metadata.serialized_size for r in files.collect()}
    return root, files, compact(spark, root, files, keys, small=small, limit=limit), stamps


def test_nulls_repeated_rows_clashing_columns_and_times(spark):
    rng = random.Random(3)
    start = datetime(1969, 12, 30, 12)
    rows = [(None if rng.random() < 0.1 else rng.randint(1, 40), None if rng.random() < 0.1 else start + timedelta(hours=rng.randint(0, 90)), rng.choice([None, 1.005, -2.5, 3.0]), 7, "x", {"a": 1}) for _ in range(150)]
    rows += rows[:20]
    df = spark.createDataFrame(rows, "click_id long, arrived_at timestamp_ntz, value double, day int, row string, path map<string,int>").withColumn("group", F.lit(1))
    root, files, final, _ = packed(spark, df)
    held = digests(final, id_col="click_id", value_col="value")
    own = {(r.day, r.lot, r.piece): (r.n_rows, r.min_id, r.max_id, r.cents, r.sources, r.ids_sha256, r.rewritten) for r in final.drop("n_rows").join(held, "path").collect()}
    assert own == brute([{"click_id": a, "arrived_at": b, "value": c} for a, b, c, *_ in rows], 8, 12, 20)
    back = spark.read.parquet(root)
    assert back.columns == df.columns and back.count() == len(rows)
    text = lambda x: sorted(str(r) for r in x.collect())
    assert text(back) == text(df)


def test_folder_holds_the_final_files_only_and_others_stay(spark, tmp_path):
    df = spark.range(300).select(F.col("id").alias("click_id"), F.timestamp_seconds(F.col("id") * 900).cast("timestamp_ntz").alias("arrived_at"), F.lit(1.0).alias("value"))
    root, files, final, _ = packed(spark, df, small=5, limit=9, per_lot=30)
    before = {r.path: r for r in files.collect()}
    rows = final.collect()
    listed = {f"{root}/{x.name}" for x in __import__("pathlib").Path(root.removeprefix("file://")).iterdir() if not x.name.endswith(".crc")}
    assert listed == {r.path for r in rows}
    assert {r.path for r in rows if not r.rewritten} <= set(before) and all(r.path not in before for r in rows if r.rewritten)
    assert sum(r.n_rows for r in rows) == 300


def test_same_bytes_whatever_the_partitions(spark):
    df = spark.range(400).select((F.col("id") % 150).alias("click_id"), F.timestamp_seconds((F.col("id") % 90) * 900).cast("timestamp_ntz").alias("arrived_at"), F.rand(1).alias("value")).cache()
    roots = [packed(spark, x)[0] for x in (df.repartition(7), df.repartition(2).orderBy(F.desc("value")))]
    read = lambda root: {x.name: x.read_bytes() for x in __import__("pathlib").Path(root.removeprefix("file://")).iterdir()}
    assert read(roots[0]) == read(roots[1])


def test_empty_table_and_sizes_that_do_not_fit(spark):
    df = spark.createDataFrame([], "click_id long, arrived_at timestamp_ntz, value double")
    root, files, final, _ = packed(spark, df)
    assert final.count() == 0
    with pytest.raises(ValueError):
        compact(spark, root, files, ["day", "lot", "piece"], small=9, limit=7)
