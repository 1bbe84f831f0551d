"""Multiset comparison, roll-ups and the closure of super types against models."""

import random
from collections import Counter

from pyspark.sql import functions as F

from grantscope.operators import compare, graph
from grantscope.operators.declarations import SCHEMA


def model(old, new):
    """State by (key, old place, new place), by counting."""
    out = Counter()
    for key in {k for k, _ in old + new}:
        a, b = (Counter(p for k, p in rows if k == key) for rows in (old, new))
        for place in a.keys() & b.keys():
            out[key, "same", place, place] += min(a[place], b[place])
        order = lambda c: sorted(c.elements(), key=lambda p: (p is not None, p))
        left, right = order(a - b), order(b - a)
        for x, y in zip(left, right, strict=False):
            out[key, "moved", x, y] += 1
        for x in left[len(right):]:
            out[key, "gone", x, None] += 1
        for y in right[len(left):]:
            out[key, "new", None, y] += 1
    return +out


def test_compared_against_model(spark):
    rng = random.Random(2)
    for size in (0, 1, 8, 60):
        rows = [[(rng.choice(["a", "b", "c", None, "d e"]), rng.choice([1, 2, 3, 10, None])) for _ in range(rng.randint(0, size))] for _ in range(2)]
        old, new = (spark.createDataFrame(x, "k string, line int").withColumn("twice", F.col("k")) for x in rows)
        found = Counter((r.k, r.state, r.old_place, r.new_place) for r in compare.compared(old, new, ["k", "twice"]).collect())
        assert found == model(*rows)


def test_rolled_up_tells_nulls_from_totals(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["p", "q", None]), rng.choice(["m", None]), rng.choice("fgh")) for _ in range(80)]
    df = spark.createDataFrame(rows, "project string, module string, file string")
    levels = [["project", "module"], ["module"], []]
    want = set()
    for level in levels:
        at = ["project", "module", "file"].index
        groups = Counter(tuple(r[at(c)] if c in level else None for c in ("project", "module")) for r in rows)
        for key, n in groups.items():
            files = len({r[2] for r in rows if all(r[at(c)] == key[("project", "module").index(c)] for c in level)})
            want.add((",".join(level), *key, n, files))
    got = compare.rolled_up(df, levels)
    assert {tuple(r) for r in got.collect()} == want
    assert "Union" not in got._jdf.queryExecution().optimizedPlan().toString()


def types(spark, rows):
    """Declarations of types (project, name, super types)."""
    blank = {c.split()[0]: None for c in SCHEMA.split(", ")}
    made = [blank | {"project": p, "id": f"{p}{n}", "simple_name": n, "qualified_name": f"x.{n}", "kind": "CLASS", "super_types": s, "relative_path": "f", "ord": k} for k, (p, n, s) in enumerate(rows)]
    calls = [blank | {"project": p, "id": f"{p}{n}#f", "simple_name": "f", "qualified_name": f"x.{n}.f", "kind": "FUNCTION", "container": f"x.{n}", "super_types": [], "relative_path": "f", "ord": 100 + k} for k, (p, n, _) in enumerate(rows)]
    return spark.createDataFrame([tuple(r[c] for c in ["project", *blank]) for r in made + calls], f"project string, {SCHEMA}")


def test_closure_against_model(spark):
    rng = random.Random(4)
    names = [f"T{n}" for n in range(12)] + ["Activity", "Service"]
    rows = [("a", n, [rng.choice(names) for _ in range(rng.randint(0, 2))]) for n in names[:12]]
    chain = [("b", f"T{n}", [f"T{n + 1}"]) for n in range(6)] + [("b", "T6", ["Service", "T3"]), ("b", "T3", ["Other"])]
    df = types(spark, rows + chain)
    want = {}
    for project in "ab":
        edges = {(n, s) for p, n, own in rows + chain if p == project for s in own if s != n}
        for start in {n for n, _ in edges}:
            seen, front, level = {start: 0}, {start}, 0
            while front:
                level += 1
                front = {s for n, s in edges if n in front} - seen.keys()
                seen |= dict.fromkeys(front, level)
            want |= {(project, start, s): x for s, x in seen.items() if x}
    assert {(r.project, r.simple_name, r["super"]): r.level for r in graph.all_supertypes(df).collect()} == want and max(want.values()) >= 5
    kinds = {transitive: {(r.project, r.container): r.entry_kind for r in graph.entry_kinds(df, transitive).where("kind = 'FUNCTION'").collect()} for transitive in (False, True)}
    assert all(kinds[True]["b", f"x.T{n}"] == "Service" for n in range(7)) and kinds[False]["b", "x.T0"] is None and kinds[False]["b", "x.T6"] == "Service"
    for (project, owner), kind in kinds[True].items():
        reached = {s: x for (p, n, s), x in want.items() if p == project and f"x.{n}" == owner and s in ("Activity", "Service")}
        assert (kind is None) == (not reached)
        if kind and kinds[False][project, owner] is None:
            assert reached[kind] == min(reached.values())
