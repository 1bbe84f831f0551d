"""Decision tables, declarations, graph and rules against plain-Python models."""

import itertools
import random
from collections import deque

from pyspark.sql import functions as F

from grantscope.functions.catalog import Signal
from grantscope.operators import classify, declarations, graph, rules, signals
from grantscope.plans import analyze, registry


def test_status_table(spark):
    names = ["declared", "api", "strong", "requests", "checks", "constants", "alternative"]
    cases = [c for c in itertools.product([False, True], repeat=7) if c[1] or not c[2]]
    df = spark.createDataFrame(cases, ", ".join(f"{n} boolean" for n in names)).withColumn("status", classify.status(*[F.col(n) for n in names]))
    for r in df.collect():
        if not r.declared and r.api and not r.strong and not r.requests:
            want = "WEAK_SIGNAL"
        elif not r.declared and r.alternative and not r.requests:
            want = "ALTERNATIVE_COVERED"
        elif r.api:
            want = "USED" if r.declared else "UNDECLARED_USAGE"
        elif r.declared and (r.requests or r.checks or r.constants):
            want = "REQUESTED_ONLY"
        elif r.requests or r.checks:
            want = "UNDECLARED_USAGE"
        else:
            want = "DECLARED_UNUSED"
        assert r.status == want, r


def test_risk_confidence_grade(spark):
    rows = [("WEAK_SIGNAL", "DANGEROUS", False, None, "LOW"), ("UNDECLARED_USAGE", "NORMAL", False, None, "HIGH"), ("DECLARED_UNUSED", "SPECIAL", False, None, "HIGH"),
            ("DECLARED_UNUSED", "NORMAL", False, "n", "MEDIUM"), ("USED", "DANGEROUS", False, None, "HIGH"), ("USED", "DANGEROUS", True, "n", "MEDIUM"),
            ("REQUESTED_ONLY", "NORMAL", True, None, "MEDIUM"), ("USED", "NORMAL", False, None, "LOW"), ("USED", "SPECIAL", False, None, "LOW")]
    df = spark.createDataFrame(rows, "s string, p string, r boolean, n string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", classify.risk(F.col("s"), F.col("p"), F.col("r"), F.col("n"))).collect())
    df = spark.createDataFrame([(True, False, False, True, "HIGH"), (False, False, True, True, "HIGH"), (False, True, False, True, "MEDIUM"), (False, False, False, False, "HIGH"), (False, False, False, True, "LOW")], "h boolean, m boolean, r boolean, a boolean, want string")
    assert all(r.got == r.want for r in df.withColumn("got", classify.confidence(F.col("h"), F.col("m"), F.col("r"), F.col("a"))).collect())
    grades = spark.createDataFrame([(n,) for n in (0, 9, 10, 24, 25, 44, 45, 69, 70, 100)], "n int").select(classify.grade(F.col("n"))).collect()
    assert "".join(r[0] for r in grades) == "AABBCCDDFF"
    sev = spark.createDataFrame([("CRITICAL",)] * 3, "s string")
    assert sev.agg(classify.capped_score(F.col("s"))).first()[0] == 100 and sev.limit(0).agg(classify.capped_score(F.col("s"))).first()[0] == 0


def test_declarations():
    code = [
        "package a.b", "@Marked", "", "class Outer(val s: Service) : Base(), x.y.Face {", "  @Composable fun Draw() {", "    if (x) { call() }", "    other.call2(); call()", "  }",
        "  fun Outer.ext(a: Int) = go(a)", "}", "public static int sum(int a) {", "  return helper(a);", "}", "Future<void> load() async {", "  print(1);", "}", "interface Empty", "", "", "", "", "", "", "fun late()", "",
        "", "", "{", "}",
    ]
    rows = {r["simple_name"]: r for r in declarations.parse(code, "a.b")}
    assert rows["Outer"]["super_types"] == ["Service", "Base", "Face"] and rows["Outer"]["annotations"] == ["Marked"]
    assert (rows["Outer"]["start_line"], rows["Outer"]["end_line"]) == (4, 10)
    draw = rows["Draw"]
    assert (draw["kind"], draw["qualified_name"], draw["container"], draw["end_line"], draw["calls"]) == ("COMPOSABLE", "a.b.Outer.Draw", "a.b.Outer", 8, ["call", "call2"])
    assert rows["sum"]["calls"] == ["helper"] and rows["load"]["qualified_name"] == "a.b.load"
    assert rows["Empty"]["end_line"] == rows["Empty"]["start_line"]
    assert rows["late"]["end_line"] == 29  # a brace four lines below the start still counts


def model_end(code, start):
    depth, seen = 0, False
    for n in range(start, len(code)):
        for c in code[n]:
            depth += {"{": 1, "}": -1}.get(c, 0)
            seen |= c == "{"
            if c == "}" and seen and depth <= 0:
                return n
        if not seen and n > start + 3:
            return start
    return start


def test_block_ends_against_model():
    rng = random.Random(3)
    for _ in range(3000):
        code = ["".join(rng.choice("{}a ") for _ in range(rng.randrange(3))) for _ in range(rng.randrange(1, 14))]
        starts = list(range(len(code)))
        assert declarations.block_ends(code, starts) == [model_end(code, s) for s in starts]


def test_innermost(spark):
    spans = spark.createDataFrame([("f", 1, 20, "type", False, 0), ("f", 2, 10, "outer", True, 1), ("f", 4, 6, "inner", True, 2), ("f", 5, 6, "deep type", False, 3)], "file string, start_line int, end_line int, name string, fn boolean, ord int")
    points = spark.createDataFrame([("f", 5), ("f", 8), ("f", 15), ("f", 30), ("g", 5)], "file string, line int")
    out = declarations.innermost(points, spans, point_keys=["file"], point="line", first="fn")
    assert {(r.file, r.line): r.in_name for r in out.collect()} == {("f", 5): "inner", ("f", 8): "outer", ("f", 15): "type", ("f", 30): None, ("g", 5): None}


def test_innermost_against_model(spark):
    """Spans of all lengths, equal points, nulls and spans that end before they start."""
    rng = random.Random(6)
    spans = [(rng.choice("abc"), a, a + rng.choice([-3, 0, 1, 15, 16, 17, 300, 5_000, 70_000]), rng.random() < 0.4, n) for n in range(300) for a in [rng.randrange(-200, 60_000)]] + [(None, 1, 9, True, 300), ("a", None, 9, True, 301)]
    points = [(rng.choice("abcd"), rng.randrange(-300, 70_000)) for _ in range(400)] + [("a", 5)] * 3 + [(None, 5), ("b", None)]
    want = []
    for key, at in points:
        around = [s for s in spans if key is not None and at is not None and s[0] == key and s[1] is not None and s[1] <= at <= s[2]]
        best = max(around, key=lambda s: (s[3], s[1], -s[4]), default=None)
        want.append((str(key), str(at), None if best is None else best[4]))
    df = spark.createDataFrame(spans, "k string, start_line int, end_line int, fn boolean, ord int")
    out = declarations.innermost(spark.createDataFrame(points, "k string, at int"), df, point_keys=["k"], point="at", first="fn")
    assert sorted(map(str, [(str(r.k), str(r["at"]), r.in_ord) for r in out.collect()])) == sorted(map(str, want))
    assert declarations.innermost(spark.createDataFrame(points, "k string, at int"), df.limit(0), point_keys=["k"], point="at").count() == len(points)


def test_numbers_over_ranges(spark):
    rng = random.Random(7)
    rows = [(rng.choice([0, 5, 6]), f"{n:05}", 0, "R", rng.choice(["HIGH", "MEDIUM", "CRITICAL"])) for n in range(1500)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "block int, order string, nth int, rule string, severity string").repartition(5)
    for c in ("title", "detail", "permission", "recommendation", "locations"):
        df = df.withColumn(c, F.col("order"))
    got = rules.numbered(df).collect()
    ids = {o: f"F-{n + 1:03}" for n, (_, o, *_) in enumerate(sorted(rows))}
    assert {r.title: r.id for r in got} == ids
    severity = {o: ["CRITICAL", "HIGH", "MEDIUM"].index(s) for _, o, _, _, s in rows}
    assert [r.title for r in got] == sorted(ids, key=lambda o: (severity[o], int(ids[o][2:])))


def model_paths(target, callers, kinds):
    found, seen, queue = [], {target}, deque([[target]])
    while queue and len(found) < 5:
        path = queue.popleft()
        kind, above = kinds.get(path[0]), callers.get(path[0], [])
        if kind or not above:
            found.append((kind or "UNKNOWN", path))
            if kind:
                continue
        if len(path) >= 8:
            continue
        for c in above:
            if c not in seen:
                seen.add(c)
                queue.append([c, *path])
    return found


def test_paths_against_model(spark):
    rng = random.Random(11)
    edges, kinds, want = [], [], {}
    for g in range(25):
        names = [f"{g}-{i}" for i in range(rng.randrange(2, 14))]
        callers = {}
        for a in names:
            above = rng.sample(names, rng.randrange(0, min(4, len(names))))
            callers[a] = [b for b in above if b != a]
            edges += [(a, b, k) for k, b in enumerate(callers[a])]
        own = {n: "Activity" for n in names if rng.random() < 0.15}
        kinds += list(own.items())
        want[names[0]] = model_paths(names[0], callers, own)
    targets = spark.createDataFrame([(t,) for t in want], "id string")
    found, _ = graph.callers_paths(targets, spark.createDataFrame(edges, "callee_id string, caller_id string, caller_ord int"), spark.createDataFrame(kinds, "id string, entry_kind string"))
    got = {t: [] for t in want}
    for r in found.orderBy("target", "level", "pos").collect():
        got[r.target].append((r.entry_kind, list(r.nodes)))
    assert got == want


def test_bfs_reads_every_row(spark, tmp_path):
    rng = random.Random(4)
    rows = sorted({(k, rng.randrange(1, 8), rng.choice([1, 5, 9, 150, 300, 97 + k]), rng.randrange(1000, 1200)) for k in range(1, 600)})
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    near = {}
    for _, _, s, p in rows:
        near.setdefault(f"s{s}", set()).add(f"p{p}")
        near.setdefault(f"p{p}", set()).add(f"s{s}")
    want = {}
    for t in ("s1", "s5", "s9"):
        level = {t: 1}
        for n in (2, 3, 4):
            for a in [x for x, k in level.items() if k == n - 1]:
                for b in near.get(a, ()):
                    level.setdefault(b, n)
        want |= {(t, node): n for node, n in level.items()}
    got = registry.QUERIES["bounded_bfs_whole"](spark, str(tmp_path)).collect()
    assert {(r.target, r.node): r.level for r in got} == want and len(got) == len(want)
    assert len({node for _, node in want}) > 97


def test_edges_guard(spark):
    callees = spark.createDataFrame([(f"c{i}", "many") for i in range(7)] + [(f"d{i}", "six") for i in range(6)] + [("self", "self")], "id string, name string")
    calls = spark.createDataFrame([("x", 1, "many"), ("x", 1, "six"), ("x", 1, "six"), ("self", 2, "self")], "caller_id string, caller_ord int, name string")
    assert sorted(r.callee_id for r in graph.guarded_edges(calls, callees).collect()) == [f"d{i}" for i in range(6)]


def test_guard_works_at_every_size(spark, tmp_path):
    for size in (30, 300):
        lines = [(k, n) for k in range(size) for n in range(1, 2 + k % 9)]
        root = f"{tmp_path}/{size}"
        spark.createDataFrame(lines, "l_orderkey long, l_linenumber int").write.parquet(f"{root}/lineitem.parquet")
        spark.createDataFrame([(k, 1000 + k % 7) for k in range(0, size, 2)], "o_orderkey long, o_custkey long").write.parquet(f"{root}/orders.parquet")
        got = registry.QUERIES["guarded_edges_by_order"](spark, root).collect()
        want = {(f"{k}-{n}", str(1000 + k % 7)) for k, n in lines if k % 2 == 0 and k % 9 < 6}
        assert {tuple(r) for r in got} == want and len(got) == len(want) and 0 < len(want) < sum(k % 2 == 0 for k, _ in lines)


def test_signals(spark):
    df = spark.createDataFrame([("openCamera(", ["a.b"]), ("nothing", []), ("guarded", ["x.needle.y"]), ("guarded", [])], "code string, imports array<string>")
    known = [Signal("P", "camera", r"openCamera\s*\("), Signal("Q", "guard", "guarded", "LOW", ("needle",))]
    rows = df.select(signals.matches(F.col("code"), known, F.col("imports")).alias("m")).collect()
    assert [[x.permission for x in r.m] for r in rows] == [["P"], [], ["Q"], []]
    refs = spark.createDataFrame([('x(Manifest.permission.CAMERA, "android.permission.NFC", "android.permission.CAMERA")',)], "c string").select(signals.references(F.col("c"))).first()[0]
    assert refs == ["android.permission.CAMERA", "android.permission.NFC"]


def test_findings_on_empty_inputs(spark):
    reports = analyze.permission_reports(
        spark.createDataFrame([], "permission string, file string, line int, module string, enclosing string, symbol string, kind string, evidence string, confidence string, snippet string, ord struct<a:int,b:int,c:int>"),
        spark.createDataFrame([], "permission string, file string, module string, line int, max_sdk int, sdk23_only boolean, snippet string, pos int"),
        analyze.catalog.specs(spark), analyze.catalog.alternatives(spark))
    build = spark.createDataFrame([(None, None, None, None, [])], "application_id string, min_sdk int, target_sdk int, compile_sdk int, dependencies array<string>")
    none = spark.createDataFrame([], "x int")
    found = rules.numbered(rules.project_findings(reports, build, none, none)).collect()
    assert [(f.id, f.rule) for f in found] == [("F-001", "NO_MANIFEST"), ("F-002", "NO_SOURCES")]


def test_spans_and_points_round_to_whole_seconds_as_sql_does(spark, tmp_path):
    from grantscope.plans import registry

    # the click is 0.6 s after the span's last whole second, and the later span begins 0.4 s before it: floored, it would be in the first
    rows = [(1, "2024-01-01 00:00:00.4", 7, "signup"), (2, "2024-01-04 00:00:00.6", 7, "click"), (3, "2024-01-01 00:00:00.5", 8, "signup"), (4, "2024-01-01 00:00:01.5", 8, "signup"), (5, "2024-01-01 00:00:02.4", 8, "click")]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string").selectExpr("event_id", "cast(ts as timestamp_ntz) as ts", "user_id", "event_type")
    df.write.parquet(f"{tmp_path}/events.parquet")
    assert {(r.event_id, r.span_id) for r in registry.innermost_interval(spark, str(tmp_path)).collect()} == {(2, None), (5, 4)}


def test_rows_of_one_row_group_are_dealt_out_before_work_on_them(spark, tmp_path):
    from grantscope.functions.shared import LEAST_ROWS, dealt

    path = f"{tmp_path}/t.parquet"
    spark.range(4 * LEAST_ROWS).coalesce(1).write.parquet(path)
    made = dealt(spark.read.parquet(path), "id").withColumn("text", F.concat(F.lit("x"), F.col("id"))).where(F.length("text") > 2)
    assert made.groupBy(F.spark_partition_id()).count().count() == 4 and made.count() == 4 * LEAST_ROWS - 10
    # the filter on what is made stays above the dealing
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter") < plan.index("RepartitionByExpression")


def test_joins_of_growing_sides_broadcast_nothing(spark):
    from grantscope.operators import declarations, graph

    calls = spark.createDataFrame([("a", 0, "f")], "caller_id string, caller_ord int, name string")
    edges = graph.guarded_edges(calls, spark.createDataFrame([("b", "f")], "id string, name string"))
    points = spark.createDataFrame([("k", 3), ("k", 3)], "file string, line int")
    spans = spark.createDataFrame([("k", 1, 9, 0)], "file string, start_line int, end_line int, ord int")
    found = declarations.innermost(points, spans, point_keys=["file"], point="line")
    assert [r.in_start_line for r in found.collect()] == [1, 1] and edges.count() == 1
    for df in (edges, found):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
