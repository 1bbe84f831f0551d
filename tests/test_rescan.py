"""A stream of file events against a batch over the last contents."""

import random
import shutil
from pathlib import Path

from pyspark.sql import functions as F

from grantscope.operators import signals
from grantscope.plans.samples import SAMPLES
from grantscope.sources import project
from grantscope.streaming import rescan

LINES = [x for pair in SAMPLES for x in pair] + ["Permission.camera.request();", 'p = "android.permission.NFC"', "", "if (isGranted) {", "/* openCamera( */"]
PATHS = ["a/src/A.kt", "a/src/B.java", "lib/c.dart", "a/src/Été.kt", "a/src/test/T.kt", "d/src/D.kt", "d/src/E.kt"]


def content(rng):
    return rng.choice([None, "", *["\n".join(rng.choice(LINES) for _ in range(rng.randint(1, 12)))] * 5])


def found(df):
    return sorted(map(str, df.select("file", *rescan.FIELDS).collect()))


def run(spark, root, wave, n):
    spark.createDataFrame(wave, rescan.EVENTS).write.parquet(f"{root}/events/{n}")
    stream = spark.readStream.schema(rescan.EVENTS).option("recursiveFileLookup", True).parquet(f"{root}/events")
    rescan.rescan(stream, f"{root}/state").awaitTermination()


def batch(spark, last):
    rows = [(p, p, c or "") for p, (_, gone, c) in last.items() if not gone]
    files = spark.createDataFrame(rows, "path string, relative_path string, content string")
    return found(signals.usages(signals.candidate_lines(project.source_rows(files))))


def test_waves_of_events_against_a_batch(spark, tmp_path):
    rng, last, sent = random.Random(3), {}, []
    root = f"file://{tmp_path}"
    for n in range(4):
        wave = []
        for _ in range(8):
            path = rng.choice(PATHS)
            seq = last.get(path, (0,))[0] + rng.choice([1, 1, 5])
            last[path] = (seq, rng.random() < 0.2, content(rng))
            wave.append((path, *last[path]))
        wave += rng.sample(sent, min(len(sent), 5)) + rng.sample(wave, 2)  # late, and twice
        rng.shuffle(wave)
        sent += wave
        run(spark, root, [*wave, (PATHS[0], None, False, "openCamera(")], n)
        assert found(rescan.current(spark, f"{root}/state")) == batch(spark, last)
    assert batch(spark, last)


def test_a_batch_that_is_run_again_replaces_itself(spark, tmp_path):
    rng, root = random.Random(5), f"file://{tmp_path}"
    waves = [[(p, n, False, "\n".join(rng.choice(LINES) for _ in range(9))) for p in PATHS] for n in (1, 2)]
    for n, wave in enumerate(waves):
        run(spark, root, wave, n)
    before = found(rescan.current(spark, f"{root}/state"))
    # the second batch was written but its end not noted: it is run again from the state of the first
    for x in Path(tmp_path, "state/progress/commits").glob("*1*"):
        x.unlink()
    shutil.rmtree(Path(tmp_path, "state/deltas/batch=1"))
    run(spark, root, [("z/src/Z.kt", 1, False, "no usage")], 2)
    assert found(rescan.current(spark, f"{root}/state")) == before == batch(spark, {p: (2, False, c) for p, _, _, c in waves[1]})


def test_only_what_changed_comes_out(spark, tmp_path):
    root, path = f"file://{tmp_path}", "a/src/A.kt"
    texts = ["m.openCamera(1)\nval c = OkHttpClient()\n", "m.openCamera(1)\n\nval c = OkHttpClient()\nvar v: Vibrator\n", "m.openCamera(1)\n\nval c = OkHttpClient()\nvar v: Vibrator\n"]
    for n, text in enumerate(texts):
        run(spark, root, [(path, n, False, text)], n)
    deltas = spark.read.option("recursiveFileLookup", True).schema(rescan.DELTA).parquet(f"{root}/state/deltas")
    rows = sorted((r.seq, r.sign, r.line, r.evidence) for r in deltas.collect())
    assert rows == [(0, 1, 1, "Camera2 openCamera"), (0, 1, 2, "OkHttp"), (1, -1, 2, "OkHttp"), (1, 1, 3, "OkHttp"), (1, 1, 4, "Vibrator")]
    run(spark, root, [(path, 9, True, None)], 9)
    assert rescan.current(spark, f"{root}/state").count() == 0
    assert found(rescan.current(spark, f"{root}/state").where(F.lit(True))) == []


def test_changes_are_joined_not_called_file_by_file(spark):
    row = lambda file, seq, line: (file, seq, line, *[None if line is None else "x"] * 6)
    fields = "line int, permission string, symbol string, kind string, evidence string, confidence string, snippet string"
    found = spark.createDataFrame([row("a", 2, 1), row("a", 2, 1), row("a", 3, 4), row("late", 1, 9), row("same", 5, 9), row("gone", 4, None), row("new", 1, 2)], f"file string, seq long, {fields}")
    heads = spark.createDataFrame([("a", 1), ("late", 2), ("same", 5), ("gone", 3), ("other", 1)], rescan.HEAD)
    before = spark.createDataFrame([("a", 1, 1, *["x"] * 6), ("gone", 1, 7, *["x"] * 6), ("other", 1, 8, *["x"] * 6)], f"file string, sign int, {fields}").withColumn("seq", F.lit(1).cast("long"))
    deltas, newest = rescan.changed(found, heads, before.select([c.split()[0] for c in rescan.DELTA.split(", ")]))
    assert sorted((r.file, r.seq, r.sign, r.line) for r in deltas.collect()) == [("a", 3, -1, 1), ("a", 3, 1, 4), ("gone", 4, -1, 7), ("new", 1, 1, 2)]
    assert sorted(map(tuple, newest.collect())) == [("a", 3), ("gone", 4), ("new", 1)]
    assert "Pandas" not in deltas._jdf.queryExecution().executedPlan().toString()
