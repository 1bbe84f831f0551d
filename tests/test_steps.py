"""Steps that many queries share do their work once."""


from pyspark.sql import functions as F

from grantscope.functions import catalog, text
from grantscope.operators import compare, declarations, graph, signals
from grantscope.plans import generated

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().analyzed().toString()


def test_equal_lines_are_tried_once(monkeypatch):
    tried = []
    own = declarations.function_at
    monkeypatch.setattr(declarations, "function_at", lambda line: tried.append(line) or own(line))
    code = ["class Remembered {", *["  fun once() { remembered(1) }"] * 50, "}"]
    rows = declarations.parse(code, "p")
    assert [r["calls"] for r in rows[1:]] == [[]] * 50 and rows[0]["end_line"] == 52
    assert tried.count(code[1]) == 1
    long = "  fun long() { " + "x" * declarations.LINE_CHARS
    declarations.parse([long, long], "p")
    assert tried.count(long) > 1  # a long line is not kept


def test_points_look_into_widths_of_spans_only(spark):
    points = spark.createDataFrame([("a", n) for n in range(1, 60)], "file string, line int")
    spans = spark.createDataFrame([("a", 5, 9, 0), ("a", 7, 12, 1), ("a", 40, 41, 2)], "file string, start_line int, end_line int, ord int")
    out = declarations.innermost(points, spans, point_keys=["file"], point="line", stored=True)
    assert plan_of(out).count("shiftright(_at") == 1
    found = {r["line"]: r["in_ord"] for r in out.collect()}
    assert found == {n: 1 if 7 <= n <= 12 else 0 if 5 <= n <= 6 else 2 if 40 <= n <= 41 else None for n in range(1, 60)}


def test_compared_reads_its_sides_once(spark):
    side = lambda n: spark.range(n).select((F.col("id") % 3).alias("k"), F.col("id").alias("line"))
    out = compare.compared(side(10), side(12), ["k"])
    assert "Range (" not in plan_of(out)
    assert out.groupBy("state").count().collect()[0]["state"] in ("same", "new") and out.count() == 12


def test_sources_are_made_once(spark):
    out = generated.QUERIES["project_sources"](spark, SF)
    assert not [f for f in out.inputFiles() if f.endswith("customer.parquet")]
    out = generated.QUERIES["project_usages"](spark, SF)
    assert not [f for f in out.inputFiles() if f.endswith("customer.parquet")]


def test_called_nodes_are_told_once(spark, monkeypatch):
    written = []
    own = graph.checkpointed
    monkeypatch.setattr(graph, "checkpointed", lambda df: written.append(df.columns) or own(df))
    edges = spark.createDataFrame([("a", "b", 0), ("b", "c", 0)], "callee_id string, caller_id string, caller_ord int")
    kinds = spark.createDataFrame([], "id string, entry_kind string")
    paths, _ = graph.callers_paths(spark.createDataFrame([("a",)], "id string"), edges, kinds)
    assert [r["nodes"] for r in paths.collect()] == [["c", "b", "a"]]
    assert written.count(["node"]) == 1


def test_lines_without_the_word_are_not_tried(spark):
    df = spark.createDataFrame([(["import a.b", "x", "  import c"],), ([],), (None,)], "x array<string>")
    got = df.select(text.all_matches(F.col("x"), r"^\s*import\s+([\w.]+)", "import").alias("a"), text.first_match(F.col("x"), r"^\s*import\s+([\w.]+)", "import").alias("f")).collect()
    assert [tuple(r) for r in got] == [(["a.b", "c"], "a.b"), ([], ""), (None, "")]
    kept = spark.createDataFrame([("a / b\n",), ("",), (None,), ("a // b\nc /* d\ne */",)], "t string").select(text.strip_comments(F.col("t"))).collect()
    assert [r[0] for r in kept] == ["a / b\n", "", None, "a \nc \n"]


def test_names_are_looked_for_where_hits_say_so(spark):
    code = ["x = Manifest.permission.NFC", 'y = "android.permission.NFC"', "z = Permission.camera.request();"]
    n = len(catalog.SIGNALS)
    rows = [(f"f{i}", 1, "m", "p", "Dart", [], c, c, c, [n + i] if told else []) for i, c in enumerate(code) for told in (True, False)]
    lines = spark.createDataFrame(rows, "file string, line int, module string, package string, language string, imports array<string>, raw string, code string, window string, hits array<int>")
    got = sorted((r.file, r.permission, r.kind) for r in signals.usages(lines).collect())
    assert got == [("f0", "android.permission.NFC", "PERMISSION_STRING"), ("f1", "android.permission.NFC", "PERMISSION_STRING"), ("f2", "android.permission.CAMERA", "API_CALL"), ("f2", "android.permission.CAMERA", "REQUEST")]
    assert len(signals.usages(lines.drop("hits")).collect()) >= 2 * len(got)
