"""Usage detection: code lines against a catalog of patterns."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import catalog, text
from ..functions.catalog import Signal
from .needles import PLACE, needed, places

#: How code names a permission by a constant, by a quoted literal, and by the Dart plugin.
CONSTANT = r"Manifest\.permission\.([A-Z0-9_]+)"
LITERAL = r'"((?:android|com\.android\.vending|com\.google\.android\.gms)[\w.]*\.(?:permission\.)?[A-Z0-9_]+)"'
DART = r"\bPermission\.([a-zA-Z]\w*)"
USAGE = ["permission", "file", "line", "module", "package", "symbol", "kind", "evidence", "confidence", "snippet", "ord"]
FILE = ["project", "seq", "module", "language", "package", "imports"]


def _kept(df: DataFrame, names: Sequence[str]) -> list[str]:
    return [c for c in names if c in df.columns]


def _near(at: Column) -> Column:
    """The code of the four lines around a line of a file, blank ones included, as one text."""
    return F.array_join(F.slice(F.col("code"), F.greatest(at - 3, F.lit(1)), at + 5 - F.greatest(at - 4, F.lit(0))), " ")


def code_lines(sources: DataFrame) -> DataFrame:
    """A row per line that is not blank: raw, code and the code of the four lines around it."""
    own = _kept(sources, FILE)
    df = sources.select("relative_path", *own, F.posexplode(F.arrays_zip("raw", "code")).alias("p", "x"), "code")
    df = df.select(F.col("relative_path").alias("file"), *own, (F.col("p") + 1).alias("line"), F.col("x.raw").alias("raw"), F.col("x.code").alias("code"), _near(F.col("p")).alias("window"))
    return df.where(F.col("code").rlike(r"\S"))


def candidate_lines(sources: DataFrame, signals: Sequence[Signal] = catalog.SIGNALS, outer: bool = False) -> DataFrame:
    """The rows of :func:`code_lines` that can hold a usage, with ``hits``: the signals whose literals the line holds.

    One pass over each file finds the literals of all signals and of all ways to name a permission.  If a signal needs no
    literal, all lines that are not blank are kept.  With ``outer`` each file has a row of line 0 and null code besides.
    """
    groups = [needed(s.pattern) for s in signals]
    named = [needed(x) for x in (CONSTANT, LITERAL, DART)]
    found = places(F.col("code"), [g or frozenset() for g in groups] + named, every=None in groups)
    if outer:
        found = F.concat(fixed([{"at": -1, "hits": []}], PLACE), found)
    own = _kept(sources, FILE)
    df = sources.select("relative_path", *own, "raw", "code", F.explode(found).alias("x")).withColumn("p", F.col("x.at"))
    df = df.select(F.col("relative_path").alias("file"), *own, (F.col("p") + 1).alias("line"), F.get("raw", F.col("p")).alias("raw"), F.get("code", F.col("p")).alias("line_code"), _near(F.col("p")).alias("window"), F.col("x.hits").alias("hits"))
    df = df.withColumnRenamed("line_code", "code")
    return df.where(F.col("code").isNull() | F.col("code").rlike(r"\S")) if None in groups else df


MATCHED = ["ord", "permission", "label", "confidence"]


def fixed(value, kind: str) -> Column:
    """A value of lists, dictionaries and texts as one literal, which Spark folds."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def matches(line: Column, signals: Sequence[Signal], imports: Column | None = None, hits: Column | None = None) -> Column:
    """All signals whose pattern is found in the line, as array of struct(ord, permission, label, confidence).

    A signal with import needles counts only where an import holds one of them.  ``hits`` has the signals whose
    literals the line holds: of those that need a literal only these are tried.  Patterns that are tried on every line
    are literals, so each is compiled once.
    """
    gated = [n for n, s in enumerate(signals) if hits is not None and needed(s.pattern)]
    told = [{"ord": n, "permission": s.permission, "label": s.label, "confidence": s.confidence, "pattern": s.pattern, "needles": list(s.import_needles) if imports is not None else []} for n, s in enumerate(signals)]
    kind = "struct<ord:int,permission:string,label:string,confidence:string,pattern:string,needles:array<string>>"
    tests = []
    for n, s in enumerate(signals):
        if n not in gated:
            hit = line.rlike(s.pattern)
            if s.import_needles and imports is not None:
                hit = hit & _some(imports, s.import_needles)
            tests.append(F.when(hit, fixed(told[n], kind)))
    found = F.array_compact(F.array(*tests)) if tests else F.array().cast(f"array<{kind}>")
    if gated:
        # the signals of a line's hits by their numbers, so a line costs what it holds and not what the catalog holds
        every = fixed(told, f"array<{kind}>")
        own = F.transform(F.filter(hits, lambda n: n < len(signals)), lambda n: F.get(every, n))
        held = lambda s: F.rlike(line, s["pattern"])
        if imports is None or not any(signals[n].import_needles for n in gated):
            test = held
        else:
            test = lambda s: held(s) & ((F.size(s["needles"]) == 0) | F.exists(imports, lambda v: F.exists(s["needles"], lambda x: F.contains(v, x))))
        some = F.filter(own, test)
        found = F.sort_array(F.concat(found, some)) if tests else some
    return F.transform(found, lambda s: F.struct(*[s[c].alias(c) for c in MATCHED]))


def _some(values: Column, needles: Sequence[str]) -> Column:
    return F.exists(values, lambda v: text_any(v, needles))


def text_any(value: Column, needles: Sequence[str]) -> Column:
    found = F.lit(False)
    for needle in needles:
        found = found | F.contains(value, F.lit(needle))
    return found


def classify(value: Column) -> Column:
    """REQUEST or CHECK by the hints in a text (requests first), else null."""
    return F.when(text.holds_any(value, catalog.REQUEST_HINTS), "REQUEST").when(text.holds_any(value, catalog.CHECK_HINTS), "CHECK")


def references(line: Column) -> Column:
    """Permissions that a line names, by constant and then by quoted literal, each once."""
    constants = F.transform(F.regexp_extract_all(line, F.lit(CONSTANT), F.lit(1)), lambda x: F.concat(F.lit("android.permission."), x))
    return F.array_distinct(F.concat(constants, F.regexp_extract_all(line, F.lit(LITERAL), F.lit(1))))


def _usage(permission: Column, symbol: Column, kind: Column, evidence: Column, confidence: Column, a: int, b: Column, c: Column) -> Column:
    order = F.struct(F.lit(a).alias("a"), b.cast("int").alias("b"), c.cast("int").alias("c"))
    return F.struct(permission.alias("permission"), symbol.alias("symbol"), kind.alias("kind"), evidence.alias("evidence"), confidence.alias("confidence"), order.alias("ord"))


def _first_each(found: Column) -> Column:
    """The first of equal permission, kind and evidence; for arrays whose length the catalog bounds."""
    same = lambda x, y: (x["permission"] == y["permission"]) & (x["kind"] == y["kind"]) & (x["evidence"] == y["evidence"])
    return F.filter(found, lambda x, i: ~F.exists(F.slice(found, F.lit(1), i), lambda y: same(x, y)))


def usages(lines: DataFrame, signals: Sequence[Signal] = catalog.SIGNALS, outer: bool = False) -> DataFrame:
    """Usages of permissions on code lines; of equal (file, line, kind, evidence) the first is kept.

    All usages of a line are one array of its row, in their order, so nothing is shuffled.  ``lines`` are those of
    :func:`candidate_lines`, or of :func:`code_lines`.  With ``outer`` a line without a usage stays, with nulls.
    Names are looked for only where ``hits`` say that a line holds what they need, and hints only where one is found.
    """
    code, zero = F.col("code"), F.lit(0)
    hits = F.col("hits") if "hits" in lines.columns else None
    holds = lambda *ways: F.lit(True) if hits is None else reduce(Column.__or__, [F.array_contains(hits, len(signals) + n) for n in ways])
    called = F.transform(matches(code, signals, F.col("imports"), hits), lambda s: _usage(s["permission"], s["label"], F.lit("API_CALL"), s["label"], s["confidence"], 0, s["ord"], zero))
    names = fixed({k: [f"android.permission.{n}" for n in v] for k, v in catalog.DART_NAMES.items()}, "map<string,array<string>>")
    asked = F.contains(code, F.lit(".request(")) | F.contains(code, F.lit("requestPermissions"))
    checked = text_any(code, [".status", "isGranted", "isDenied", ".isPermanentlyDenied"])
    more = F.when(asked, F.struct(F.lit("REQUEST").alias("kind"), F.lit("permission_handler request").alias("evidence"))).when(checked, F.struct(F.lit("CHECK").alias("kind"), F.lit("permission_handler status check").alias("evidence")))

    def of_name(name: Column, at: Column) -> Column:
        kinds = F.array_compact(F.array(F.struct(F.lit("API_CALL").alias("kind"), F.concat(F.lit("permission_handler: Permission."), name).alias("evidence")), more))
        known = F.coalesce(names[name], F.array().cast("array<string>"))
        return F.flatten(F.transform(known, lambda p: F.transform(kinds, lambda k, nth: _usage(p, F.concat(F.lit("Permission."), name), k["kind"], k["evidence"], F.lit("HIGH"), 1, at, nth))))

    known = F.filter(F.array_distinct(F.regexp_extract_all(code, F.lit(DART), F.lit(1))), lambda name: F.map_contains_key(names, name))
    dart = F.when((F.col("language") == "Dart") & holds(2), F.flatten(F.transform(known, of_name)))
    kind = F.when(F.size("names") > 0, F.coalesce(classify(code), classify(F.col("window")), F.lit("PERMISSION_STRING")))
    evidence = F.when(F.col("as") == "REQUEST", "Runtime permission request").when(F.col("as") == "CHECK", "Permission state check").otherwise("Permission constant reference")
    named = F.transform("names", lambda p, at: _usage(p, text.short_name(p), F.col("as"), evidence, F.lit("HIGH"), 2, at, zero))
    base = _kept(lines, ["project", "seq", "file", "line", "module", "package"])
    found = lines.withColumn("names", F.when(holds(0, 1), references(code))).withColumn("as", kind).select(*base, text.snippet(F.col("raw")).alias("snippet"), called.alias("called"), dart.alias("dart"), named.alias("named"))
    none = F.array().cast(found.schema["named"].dataType)
    every = F.concat(_first_each(F.col("called")), F.coalesce(_first_each(F.col("dart")), none), F.coalesce("named", none))
    rows = (F.inline_outer if outer else F.inline)(every)
    return found.select(*base, "snippet", rows).select(*_kept(lines, ["project", "seq"]), *USAGE)


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", rank).where("_n = 1").drop("_n")


def full_match(left: DataFrame, right: DataFrame, key: str | list[str]) -> DataFrame:
    """Full outer join on a key or several, with flags ``in_left`` and ``in_right``."""
    a, b = left.withColumn("in_left", F.lit(True)), right.withColumn("in_right", F.lit(True))
    joined = a.join(b, key, "full_outer")
    return joined.withColumn("in_left", F.coalesce("in_left", F.lit(False))).withColumn("in_right", F.coalesce("in_right", F.lit(False)))
