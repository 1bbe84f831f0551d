"""Reports of many projects at once: one JSON document or page a project, written by the executors.

The analysis of rows with a ``project`` column (:func:`analyze.assemble`) keeps every section as rows.  A
report is a sequence of JSON events, each a row: something opens, is a value, or closes.  Events are
dealt out by project and sorted by their place, and a task writes them to the project's file one after the
other, so no report is ever whole in memory, on an executor or on the driver.
"""

from __future__ import annotations

import html
import json
import os
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import checkpointed
from ..operators import classify
from .analyze import DECLARATION_FIELDS, USAGE_FIELDS, Analysis, as_declarations, entry_points
from .report import PAGE

#: The place of an event: section, rank and name of what it belongs to, part of that, and its place there.
PLACE = "section int, rank int, name string, part int, file string, line int, nth string"
ORDER = [c.split()[0] for c in PLACE.split(", ")]
LEAST, MOST = -(1 << 31), (1 << 31) - 1
OPEN, VALUE, CLOSE, STATE = "open", "value", "close", "state"
WRITTEN = "project string, part int, path string, n_bytes long, section int, name string, list int"
NAMES = {"application_id": "applicationId", "min_sdk": "minSdk", "target_sdk": "targetSdk", "compile_sdk": "compileSdk"}
INDENT = "    "
#: Events of a part of a report: some ten megabytes of text.
PART_EVENTS = 50_000


def _event(kind: str, key: str | None = None, text: Column | str | None = None, **place: Column | int | str) -> Column:
    given = {k: v if isinstance(v, Column) else F.lit(v) for k, v in place.items()}
    at = [given.get(c.split()[0], F.lit(None)).cast(c.split()[1]).alias(c.split()[0]) for c in PLACE.split(", ")]
    text = F.lit(text) if isinstance(text, str) or text is None else text
    return F.struct(*at, F.lit(kind).alias("kind"), F.lit(key).cast("string").alias("key"), text.cast("string").alias("text"))


def _rows(df: DataFrame, *events: Column) -> DataFrame:
    """An event or several a row, those of null text left out."""
    return df.select("project", F.explode(F.filter(F.array(*events), lambda e: (e["kind"] != VALUE) | e["text"].isNotNull())).alias("e")).select("project", "e.*")


def _json(value: Column) -> Column:
    """A value as JSON, null if it is null; fields of structs that are null are left out."""
    wrapped = F.to_json(F.struct(value.alias("v")))
    return F.when(value.isNotNull(), F.substring(wrapped, 6, F.length(wrapped) - 6))


def _list(projects: DataFrame, items: DataFrame, key: str, section: int, item: Column, **place: Column) -> DataFrame:
    """A list of the whole report, its items rows of ``items``."""
    frame = _rows(projects, _event(OPEN, key, "[", section=section, rank=LEAST), _event(CLOSE, None, "]", section=section, rank=MOST))
    return frame.unionByName(_rows(items, _event(VALUE, None, item, section=section, rank=place.pop("rank", F.lit(0)), **place)))


def project_rows(analysis: Analysis) -> DataFrame:
    """A row per project that has a source, a manifest or a build script: what the build says, files and lines by language, and the summary."""
    count = lambda name: F.count_if(F.col("language") == name).cast("int").alias(f"{name.lower()}FileCount")
    totals = analysis.sources.groupBy("project").agg(count("Kotlin"), count("Java"), count("Dart"), F.sum(F.size("raw")).alias("analyzedLineCount"))
    out = totals.join(analysis.build.withColumnsRenamed(NAMES).withColumnRenamed("dependencies", "_dependencies"), "project", "full_outer")
    out = out.join(analysis.manifests.select("project").distinct(), "project", "full_outer").join(analysis.summary, "project", "full_outer")
    numbers = [c for c in out.columns if c.endswith("Count") or c == "riskScore"]
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in numbers})
    return out.withColumn("riskGrade", F.coalesce("riskGrade", classify.grade(F.lit(0))))


def events(analysis: Analysis, generated_at: str | None = None) -> DataFrame:
    """The JSON events of all reports: ``project``, their place, ``kind``, ``key`` and ``text``."""
    at = generated_at or datetime.now(UTC).astimezone().isoformat(timespec="milliseconds")
    c, projects = F.col, project_rows(analysis)
    value = lambda key, x, section, **place: _event(VALUE, key, _json(x), section=section, **place)
    summary = [f for f in analysis.summary.columns if f != "project"]
    head = _rows(
        projects, _event(OPEN, None, "{", section=-1), value("schemaVersion", F.lit("1.0"), 0, rank=0), value("generatedAt", F.lit(at), 0, rank=1), _event(OPEN, "project", "{", section=1, rank=0),
        value("path", F.concat(F.lit(f"{analysis.root.rstrip('/')}/"), c("project")), 1, rank=1), value("name", c("project"), 1, rank=2), *[value(k, c(k), 1, rank=3 + n) for n, k in enumerate(NAMES.values())],
        *[value(k, c(k), 5, rank=n) for n, k in enumerate(["kotlinFileCount", "javaFileCount", "dartFileCount", "analyzedLineCount"])], _event(CLOSE, None, "}", section=5, rank=9),
        _event(VALUE, "summary", F.to_json(F.struct(*summary, F.lit(int(analysis.seconds * 1000)).alias("analysisDurationMs"))), section=6), _event(CLOSE, None, "}", section=99),
    )
    modules = F.to_json(F.struct(*[x for x in analysis.modules.columns if x != "project"]))
    out = head.unionByName(_list(projects, analysis.modules, "modules", 2, modules, name=c("name")))
    out = out.unionByName(_list(projects, analysis.manifests, "manifestFiles", 3, _json(c("file")), name=c("file")))
    dependencies = analysis.build.select("project", F.posexplode("dependencies").alias("n", "d"))
    out = out.unionByName(_list(projects, dependencies, "dependencies", 4, _json(c("d")), rank=c("n")))
    out = out.unionByName(_permissions(analysis, projects))
    finding = F.to_json(F.struct(*[x for x in analysis.findings.columns if x != "project"]))
    number = F.substring_index("id", "-", -1).cast("int")
    out = out.unionByName(_list(projects, analysis.findings, "findings", 8, finding, rank=classify.severity_rank(c("severity")), line=number))
    component = F.to_json(F.struct("name", "type", "exported", "permission", c("has_intent_filter").alias("hasIntentFilter"), "file", "line", "module"))
    out = out.unionByName(_list(projects, analysis.components, "components", 9, component, file=c("file"), line=c("pos")))
    entry = F.to_json(F.struct(*[x for x in analysis.entry_points.columns if x != "project"]))
    placed = entry_points(analysis.reports, place="first")
    return out.unionByName(_list(projects, placed, "entryPoints", 10, entry, rank=-F.size("reachedPermissions"), name=c("first.permission"), line=c("first.nth")))


def _permissions(analysis: Analysis, projects: DataFrame) -> DataFrame:
    """Events of the permissions: one object each, whose lists are rows of their own tables."""
    c, section = F.col, 7
    rank = classify.risk_rank(c("riskLevel"))
    reports = analysis.reports.withColumn("rank", rank)
    own = {"section": section, "rank": c("rank"), "name": c("permission")}
    value = lambda key, part: _event(VALUE, key, _json(c(key)), part=part, **own)
    lists = {"declarations": 20, "usages": 40, "runtimeRequests": 50, "permissionChecks": 60, "touchedFiles": 80}
    frames = [e for key, part in lists.items() for e in (_event(OPEN, key, "[", part=part, **own), _event(CLOSE, None, "]", part=part + 9, **own))]
    out = _rows(
        reports, _event(OPEN, None, "{", part=0, **own), *[value(k, 1 + n) for n, k in enumerate(["permission", "shortName", "protection", "group", "description", "declared"])],
        *[value(k, 30 + n) for n, k in enumerate(["status", "riskLevel", "confidence"])], value("callPaths", 70), value("policyNote", 90), *frames, _event(CLOSE, None, "}", part=99, **own),
    )
    out = out.unionByName(_rows(projects, _event(OPEN, "permissions", "[", section=section, rank=LEAST), _event(CLOSE, None, "]", section=section, rank=MOST)))
    ranked = reports.select("project", "permission", "rank")
    told = as_declarations(analysis.declared).join(ranked, ["project", "permission"])
    out = out.unionByName(_rows(told, _event(VALUE, None, F.to_json(F.struct(*DECLARATION_FIELDS)), part=21, file=c("file"), line=c("pos"), **own)))
    used = analysis.usages.join(ranked, ["project", "permission"])
    part = F.when(c("kind") == "API_CALL", 41).when(c("kind") == "PERMISSION_STRING", 42).when(c("kind") == "REQUEST", 51).otherwise(61)
    nth = F.format_string("%d%08d%08d", "ord.a", "ord.b", "ord.c")
    out = out.unionByName(_rows(used, _event(VALUE, None, F.to_json(F.struct(*USAGE_FIELDS)), part=part, file=c("file"), line=c("line"), nth=nth, **own)))
    files = used.select("project", "permission", "rank", "file").distinct()
    return out.unionByName(_rows(files, _event(VALUE, None, _json(c("file")), part=81, file=c("file"), **own)))


class JsonFile:
    """Writes JSON events to a stream, with commas, and line ends and indents if asked for.

    ``depth`` objects and lists are open already, and ``filled`` tells whether the innermost one has an item.
    """

    def __init__(self, out, pretty: bool, page: bool, depth: int = 0, filled: bool = False):
        self.out, self.pretty, self.page, self.counts, self.n = out, pretty, page, [1] * depth + [int(filled)], 0

    def raw(self, text: str) -> None:
        data = text.encode()
        self.n += len(data)
        self.out.write(data)

    def _text(self, text: str) -> None:
        self.raw(text.replace("</", "<\\/") if self.page else text)

    def event(self, kind: str, key: str | None, text: str) -> None:
        if kind == CLOSE:
            filled = self.counts.pop()
            self._text(("\n" + INDENT * (len(self.counts) - 1) if self.pretty and filled else "") + text)
            return
        level = len(self.counts) - 1
        before = ("," if self.counts[-1] else "") + ("\n" + INDENT * level if self.pretty and level else "")
        name = "" if key is None else json.dumps(key) + (": " if self.pretty else ":")
        if kind == VALUE and self.pretty and text[0] in "{[":
            text = json.dumps(json.loads(text), indent=len(INDENT), ensure_ascii=False).replace("\n", "\n" + INDENT * level)
        self._text(before + name + text)
        self.counts[-1] += 1
        if kind == OPEN:
            self.counts.append(0)


def ranged(rows: DataFrame, size: int = PART_EVENTS) -> DataFrame:
    """The events dealt out by ranges of their order, of about ``size`` rows, each with its ``_range``, and before those of a project in a range a row of kind ``state``.

    That row has the number of objects and lists that are open there as its text and the kind of the event before as its key, so
    a range can be written by itself.  It has no place, so it comes first.
    """
    at = F.struct(*ORDER)
    rows = checkpointed(rows)
    dealt = checkpointed(rows.repartitionByRange(max(1, -(-rows.count() // size)), "project", *ORDER).withColumn("_range", F.spark_partition_id()))
    step = F.when(F.col("kind") == OPEN, 1).when(F.col("kind") == CLOSE, -1).otherwise(0)
    each = dealt.groupBy("project", "_range").agg(F.sum(step).alias("_step"), F.max_by("kind", at).alias("_last"))
    order = Window.partitionBy("project").orderBy("_range")
    depth = F.coalesce(F.sum("_step").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    nothing = [F.lit(None).cast(dealt.schema[c].dataType).alias(c) for c in ORDER]
    states = each.select("project", *nothing, F.lit(STATE).alias("kind"), F.lag("_last").over(order).alias("key"), depth.cast("string").alias("text"), "_range")
    return dealt.unionByName(states)


def write_reports(analysis: Analysis, root: str, *, pretty: bool = True, page: bool = False, generated_at: str | None = None) -> DataFrame:
    """Writes each project's report below ``root`` as JSON, or as a page that holds it, and returns ``project``, ``path`` and ``n_bytes``.

    The files are those that :mod:`report` makes of one project: ``pretty`` has indents of four, else there is no white space; a
    page is compact.  One task streams a file and renames it when whole, so a lost executor leaves no half of one.  Names of
    projects are made safe for a path; two that differ only in that share no file, as its hash is in the name.
    """
    rows = events(analysis, generated_at).withColumn("_range", F.lit(None).cast("int")).repartition("project")
    return _written(rows, root, pretty and not page, page).select("project", "path", "n_bytes")


def write_parts(rows: DataFrame, root: str, *, pretty: bool = True, page: bool = False) -> DataFrame:
    """As :func:`write_reports`, but in parts, so that no task has all of a report however large it is: what stands in the parts of a project,
    in their order, is its report.

    ``rows`` are those of :func:`ranged`.  Returns ``project``, ``part``, ``path`` and ``n_bytes``, and of the part's first event
    ``section``, ``name`` and ``list`` (its part of what it belongs to).
    """
    return _written(rows.repartition("project", "_range"), root, pretty and not page, page)


def _written(rows: DataFrame, root: str, pretty: bool, page: bool) -> DataFrame:
    ordered = rows.sortWithinPartitions("project", "_range", *[F.col(x).asc_nulls_first() for x in ORDER])
    columns = [c.split() for c in WRITTEN.split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = sink = out = first = None
        state: tuple = (0, OPEN)
        place: tuple = ()

        def done() -> pa.RecordBatch:
            if page and len(out.counts) == 1:
                out.raw(PAGE.format(name="", data="\0").split("\0")[1])
            sink.close()
            fs, temp, path, uri = place
            fs.move(temp, path)
            row = (*current, uri, out.n, *first)
            return pa.RecordBatch.from_arrays([pa.array([v], kinds[c[1]]) for v, c in zip(row, columns, strict=True)], [c[0] for c in columns])

        for batch in batches:
            for project, part, section, name, own, kind, key, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if sink is not None and (project, part) != current:
                    yield done()
                    sink = None
                if kind == STATE:
                    state = (int(text), key or OPEN)
                    continue
                if sink is None:
                    ending = "html" if page else "json"
                    current, first = (project, part), (section, name, own)
                    uri = f"{root}/{file_name(project)}.{ending}" if part is None else f"{root}/{file_name(project)}/part-{part:06d}.{ending}"
                    fs, path = pafs.FileSystem.from_uri(uri)
                    fs.create_dir(os.path.dirname(path), recursive=True)
                    place = (fs, f"{os.path.dirname(path)}/.{uuid.uuid4().hex}", path, uri)
                    sink = fs.open_output_stream(place[1])
                    depth, before = (0, OPEN) if part is None else state
                    out = JsonFile(sink, pretty, page, depth, before != OPEN)
                    if page and depth == 0:
                        out.raw(PAGE.format(name=html.escape(project or ""), data="\0").split("\0")[0])
                out.event(kind, key, text)
        if sink is not None:
            yield done()

    return ordered.select("project", "_range", "section", "name", "part", "kind", "key", "text").mapInArrow(run, WRITTEN)


#: What stands outside of strings as white space; lines of a report with indents: a key and what follows it, or an item.
BLANK = re.compile(r'("(?:[^"\\]|\\.)*")|\s+')
KEY = re.compile(r'( *)"(\w+)": (.*)')
SECTIONS = {**dict.fromkeys(range(1, 6), "project"), 6: "summary", 7: "permissions", 8: "findings", 9: "components", 10: "entryPoints"}
LISTS = {2: "declarations", 4: "usages", 5: "runtimeRequests", 6: "permissionChecks", 8: "touchedFiles"}
READ = "project string, part int, nth int, what string, name string, n long"


def read_parts(pretty: DataFrame, compact: DataFrame, page: DataFrame) -> DataFrame:
    """What the parts of reports hold, read from the files that :func:`write_parts` made of the same events in three forms, a part at a time.

    Rows of ``what``, ``name`` and ``n``: the items of each list of a permission by its ``name`` (``what`` is the list's key), the
    permissions themselves in order (``permission``), the findings (``findings``), the project's own numbers (``number``), and for each
    part ``same``, ``escaped`` and ``ended``: whether the forms hold the same, whether the page's data hide no tag, and whether
    it is the last part.
    """
    named = lambda df, x: df.select("project", "part", F.col("path").alias(x))
    rows = pretty.join(named(compact, "compact"), ["project", "part"]).join(named(page, "page"), ["project", "part"])
    columns = [c.split() for c in READ.split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
    tail = PAGE.format(name="", data="\0").split("\0")[1]

    def text_of(uri: str) -> str:
        fs, path = pafs.FileSystem.from_uri(uri)
        with fs.open_input_stream(path) as f:
            return f.read().decode()

    def read(path: str, compact: str, page: str, section: int, name: str | None, own: int | None) -> Iterator[tuple]:
        long, short, data = text_of(path), text_of(compact), text_of(page)
        head, shut = PAGE.split("{data}")[0][-len('type="application/json">') :], short.replace("</", "<\\/")
        ended = data.endswith(tail)
        data = data.removesuffix(tail) if ended else data
        begins = section == -1
        whole = data == shut or begins and data.endswith(head + shut)
        same = short == BLANK.sub(lambda m: m[1] or "", long) and "\n" not in short and "null" not in short
        yield from (("same", None, int(same)), ("escaped", None, int(whole and "</script>" not in shut)), ("ended", None, int(ended)))
        at, within, counts = SECTIONS.get(section), LISTS.get((own or 0) // 10), Counter()
        for line in long.split("\n"):
            key = KEY.fullmatch(line)
            depth = (len(line) - len(line.lstrip(" "))) // len(INDENT)
            if key and depth == 1:
                at = key[2]
            elif at == "project" and key and depth == 2 and key[2].endswith("Count"):
                yield "number", key[2], int(key[3].rstrip(","))
            elif at == "findings" and depth == 2 and line.lstrip(" ")[:1] == "{":
                counts["findings", None] += 1
            elif at == "permissions" and key and depth == 3:
                within = key[2]
                if within == "permission":
                    name = json.loads(key[3].rstrip(","))
                    yield "permission", name, 1
            elif at == "permissions" and depth == 4 and line.lstrip(" ")[:1] not in "}]":
                counts[within, name] += 1
        yield from ((*k, n) for k, n in counts.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for project, part, *rest in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                found = [(project, part, k, *x) for k, x in enumerate(read(*rest))]
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in found], kinds[c[1]]) for n, c in enumerate(columns)], [c[0] for c in columns])

    # few rows, each much work: a task each
    return rows.repartition(max(1, pretty.count())).select("project", "part", "path", "compact", "page", "section", "name", "list").mapInArrow(run, READ)


def file_name(project: str | None) -> str:
    """A name for a project's file: its letters and digits, and a hash where others were left out."""
    name = project or ""
    safe = "".join(x if x.isascii() and (x.isalnum() or x in "-_.") else "_" for x in name)
    return safe if safe == name and name.strip("._") else f"{safe}-{uuid.uuid5(uuid.NAMESPACE_URL, repr(project)).hex[:12]}"


def payloads(analysis: Analysis) -> DataFrame:
    """What the service says of each project, as JSON, without an id and a place of its own."""
    c = F.col
    counts = ["riskGrade", "riskScore", "declaredPermissionCount", "usedPermissionCount", "unusedPermissionCount", "undeclaredPermissionCount", "dangerousPermissionCount"]
    found = analysis.findings.groupBy("project").agg(F.count("*").alias("findingsCount"))
    rows = project_rows(analysis).join(found, "project", "left")
    said = F.to_json(F.struct(
        c("project").alias("projectName"), F.concat(F.lit(f"{analysis.root.rstrip('/')}/"), c("project")).alias("projectPath"), F.coalesce("applicationId", F.lit("")).alias("applicationId"),
        *counts, F.coalesce("findingsCount", F.lit(0)).alias("findingsCount"), F.lit(int(analysis.seconds * 1000)).alias("analysisDurationMs"),
    ))
    return rows.select("project", said.alias("payload"))


def breaches(analysis: Analysis, level: str) -> DataFrame:
    """Per project the findings of the given severity or a graver one, for an exit code; 0 where there are none."""
    most = list(classify.SEVERITIES).index(level)
    grave = F.count_if(classify.severity_rank(F.col("severity")) <= most)
    found = analysis.findings.groupBy("project").agg(grave.alias("n"))
    return project_rows(analysis).select("project").join(found, "project", "left").select("project", F.coalesce("n", F.lit(0)).alias("breaches"))


def console_lines(analysis: Analysis) -> DataFrame:
    """The console text of each project as rows: ``project``, ``section``, ``rank``, ``name``, ``nth`` (its order) and ``line``."""
    c = F.col
    fields = ["section int", "rank int", "name string", "nth int", "line string"]

    def lines(df: DataFrame, *values: tuple) -> DataFrame:
        made = [F.struct(*[(v if isinstance(v, Column) else F.lit(v)).cast(f.split()[1]).alias(f.split()[0]) for v, f in zip(row, fields, strict=True)]) for row in values]
        return df.select("project", F.explode(F.array(*made)).alias("x")).select("project", "x.*")

    show = lambda name: F.coalesce(c(name).cast("string"), F.lit("-"))
    say = lambda text, *names: F.format_string(text, *[show(n) for n in names])
    counts = analysis.findings.groupBy("project").agg(F.count("*").alias("n_findings"))
    head = project_rows(analysis).join(counts, "project", "left").withColumn("n_findings", F.coalesce("n_findings", F.lit(0)))
    top = [
        F.lit("Permission usage analysis"), say("Project      : %s", "project"), F.format_string("Path         : %s/%s", F.lit(analysis.root.rstrip("/")), c("project")), say("Application  : %s", "applicationId"), say("SDK          : min %s / target %s", "minSdk", "targetSdk"),
        say("Sources      : %s Kotlin, %s Java, %s Dart", "kotlinFileCount", "javaFileCount", "dartFileCount"), F.lit(f"Duration     : {int(analysis.seconds * 1000)} ms"), F.lit(""), say("Risk grade   : %s (score %s/100)", "riskGrade", "riskScore"),
        say("Permissions  : %s declared, %s declared and used, %s declared but never used, %s missing from manifest", "declaredPermissionCount", "usedPermissionCount", "unusedPermissionCount", "undeclaredPermissionCount"),
        F.lit("               Every permission falls into exactly one state, the categories never overlap."), F.lit(""), F.lit("PERMISSION MAP"),
    ]
    out = lines(head, *[(0, n, "", 0, text) for n, text in enumerate(top)], (2, -2, "", 0, F.lit("")), (2, -1, "", 0, say("FINDINGS (%s)", "n_findings")))
    out = out.unionByName(lines(head.where("n_findings = 0"), (2, 0, "", 0, F.lit("  No issues found."))))
    mark = F.create_map(*[F.lit(x) for pair in classify.MARKERS.items() for x in pair])[c("status")]
    rank = classify.risk_rank(c("riskLevel"))
    told = analysis.reports.withColumn("n_paths", F.size("callPaths"))
    out = out.unionByName(lines(told, (1, rank, c("permission"), 0, F.format_string("  %s %s (%s) risk=%s usages=%d paths=%d", F.coalesce(mark, F.lit("[?]")), "shortName", "protection", "riskLevel", "usageCount", "n_paths"))))
    first = F.slice("firstUsages", 1, 3)
    places = told.select("project", "permission", "riskLevel", F.posexplode(first).alias("n", "u"))
    out = out.unionByName(lines(places, (1, rank, c("permission"), c("n") + 1, F.format_string("      %s:%d  %s", "u.file", "u.line", "u.evidence"))))
    number = F.substring_index("id", "-", -1).cast("int")
    return out.unionByName(lines(analysis.findings, (2, classify.severity_rank(c("severity")), "", number, F.format_string("  %-8s %s %s", "severity", "id", "title"))))
