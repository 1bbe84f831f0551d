"""Literals that patterns need, and the pass that looks for them."""

import random
import re

import pytest
from pyspark.sql import functions as F

from grantscope.functions import catalog
from grantscope.functions.catalog import SIGNALS, Signal
from grantscope.operators import signals
from grantscope.operators.needles import needed, places
from grantscope.plans.samples import SAMPLES


@pytest.mark.parametrize(("pattern", "literals"), [
    (r"abc\s*\(", {"abc"}), (r"\babc\b", {"abc"}), (r"ab|cd", {"ab", "cd"}), (r"ab|[0-9]", None), (r"(ab|cd)+x?yyy", {"yyy"}), (r"(?:ab)*", None), (r"(?i)abc", None), (r"(?i:abc)de", {"de"}),
    (r"[A-Z]{8}", None), (r"a\.b\+c", {"a.b+c"}), (r"(ab){2}", {"ab"}), (r"\p{L}abc", None), (r"(?=abc)x", {"x"}), (r"x(?!abc)", {"x"}), ("", None), (r"été\d", {"été"}),
])
def test_needed(pattern, literals):
    assert needed(pattern) == (None if literals is None else frozenset(literals))


def test_every_match_holds_a_needle():
    rng = random.Random(4)
    lines = [h for h, _ in SAMPLES]
    for s, (hit, miss) in zip(SIGNALS, SAMPLES, strict=True):
        assert needed(s.pattern), s.pattern
        for line in [*lines, hit, miss, "".join(rng.choice(hit) for _ in range(30))]:
            if re.search(s.pattern, line, re.A):
                assert any(x in line for x in needed(s.pattern))


def test_places(spark):
    groups = [frozenset(["ab", "b"]), frozenset(["éa"]), frozenset(["xy"])]
    files = [["ab", "", "x", "y", "éab", None, "a", "b"], [], None, ["none", "xyxy b"]]
    rows = spark.createDataFrame([(n, x) for n, x in enumerate(files)], "n int, code array<string>")
    expected = lambda x, every: [(k, [g for g, own in enumerate(groups) if any(v in (line or "") for v in own)]) for k, line in enumerate(x or []) if every or any(v in (line or "") for own in groups for v in own)]
    for every in (False, True):
        found = rows.select("n", places(F.col("code"), groups, every).alias("x")).collect()
        assert {r.n: [(p.at, p.hits) for p in r.x] for r in found} == {n: expected(x, every) for n, x in enumerate(files)}


def lines_as_a_table(spark, rows):
    df = spark.createDataFrame(rows, "relative_path string, language string, raw array<string>")
    return df.select("relative_path", F.lit("m").alias("module"), "language", F.lit("p").alias("package"), F.array(F.lit("android.x")).alias("imports"), "raw", F.col("raw").alias("code"))


def test_the_pass_changes_no_usage(spark):
    rng = random.Random(9)
    parts = [x for pair in SAMPLES for x in pair] + ["Permission.camera.request(); Permission.camera.status", 'p = "android.permission.NFC" + Manifest.permission.NFC + Manifest.permission.NFC', "", "requestPermissions(", "isGranted", "plain code"]
    rows = [(f"f{n}", rng.choice(["Kotlin", "Dart"]), [rng.choice(parts) + rng.choice(["", "  ", "; " + rng.choice(parts)]) for _ in range(rng.randint(0, 12))]) for n in range(120)]
    sources = lines_as_a_table(spark, rows)
    for known in (SIGNALS, [*SIGNALS, Signal("P", "digits", r"[0-9]"), Signal("Q", "guarded", r"code", "LOW", ("android",)), Signal("R", "not imported", r"code", "LOW", ("ios",))]):
        gated, whole = (sorted(map(str, signals.usages(x, known).collect())) for x in (signals.candidate_lines(sources, known), signals.code_lines(sources)))
        assert gated == whole and len(gated) > 500


def test_usages_are_found_in_one_scan_without_a_shuffle(spark, tmp_path):
    lines_as_a_table(spark, [("a", "Dart", ["Permission.camera"])]).write.parquet(str(tmp_path / "s"))
    df = signals.usages(signals.candidate_lines(spark.read.parquet(str(tmp_path / "s"))))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and "Exchange" not in plan and "Window [" not in plan
    assert [tuple(r)[:3] for r in df.collect()] == [("android.permission.CAMERA", "a", 1)]


def test_a_catalog_from_a_table_gives_what_the_literals_give(spark):
    table = spark.createDataFrame([(n, s.permission, s.label, s.pattern, s.confidence) for n, s in enumerate(SIGNALS)], "ord int, permission string, label string, pattern string, confidence string")
    assert catalog.from_table(table.unionByName(table).repartition(3)) == list(SIGNALS)
    many = [Signal(f"P{n % 7}", f"word {n}", rf"\bword{n}\b", "LOW", ("android",) if n % 2 else ()) for n in range(1000)]
    read = catalog.from_table(spark.createDataFrame([(s.permission, s.label, s.pattern, s.confidence, list(s.import_needles)) for s in many], "permission string, label string, pattern string, confidence string, import_needles array<string>"))
    assert sorted(map(str, read)) == sorted(map(str, many))
    rng = random.Random(1)
    sources = lines_as_a_table(spark, [(f"f{n}", "Kotlin", [" ".join(f"word{rng.randint(0, 1200)}" for _ in range(5)) for _ in range(4)]) for n in range(20)])
    got = {(r.file, r.line, r.evidence) for r in signals.usages(signals.candidate_lines(sources, read), read).collect()}
    assert got == {(r.relative_path, k + 1, f"word {w[4:]}") for r in sources.collect() for k, line in enumerate(r.code) for w in line.split() if int(w[4:]) < 1000}


def test_tables_that_are_no_catalog(spark):
    df = spark.createDataFrame([("P", None, "x", None), ("P", "l", None, None), (None, "l", "x", None), ("P", None, "x", None)], "permission string, label string, pattern string, confidence string")
    assert catalog.from_table(df) == [Signal("P", "x", "x")]
    assert catalog.from_table(df.limit(0)) == []
    with pytest.raises(ValueError):
        catalog.from_table(spark.range(5).selectExpr("string(id) permission", "'l' label", "'x' pattern"), most=4)
