"""From a project tree to permission reports, findings and a summary."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import catalog, text
from ..functions.catalog import Signal
from ..functions.shared import checkpointed, in_order
from ..operators import classify, declarations, graph, rules, signals
from ..sources import project
from ..sources.project import keys_of

DECLARATION_FIELDS = ["file", "line", "module", "maxSdkVersion", "sdk23Only", "snippet"]
NO_DECLARATIONS = "array<struct<file:string,line:int,module:string,maxSdkVersion:int,sdk23Only:boolean,snippet:string>>"
REPORT_FIELDS = [
    "permission", "shortName", "protection", "group", "description", "declared", "declarations", "status", "riskLevel", "confidence", "usages", "runtimeRequests",
    "permissionChecks", "callPaths", "touchedFiles", "policyNote",
]
USAGE_FIELDS = ["file", "line", "module", "enclosing", "symbol", "kind", "evidence", "confidence", "snippet"]


@dataclass
class Analysis:
    """The sections of a report, each a DataFrame; ``summary`` and ``build`` have one row.

    ``reports`` has a flat row per permission; ``permissions`` nests the usages in it and
    is computed only when a sink reads it.
    """

    root: str
    sources: DataFrame
    manifests: DataFrame
    components: DataFrame
    declared: DataFrame
    build: DataFrame
    usages: DataFrame
    reports: DataFrame
    permissions: DataFrame
    findings: DataFrame
    summary: DataFrame
    modules: DataFrame
    entry_points: DataFrame
    seconds: float = 0.0


def located(lines_usages: DataFrame, decls: DataFrame, stored: bool = False) -> DataFrame:
    """Adds to usages the innermost function (else type) around the line, or the package; ``stored``: the declarations are a stored table."""
    keys = keys_of(decls)
    lines_usages = checkpointed(lines_usages)  # read twice by the join
    spans = decls.select(*keys, "id", "qualified_name", "start_line", "end_line", "ord", F.col("relative_path").alias("file"), F.col("kind").isin(*declarations.FUNCTION_KINDS).alias("function"))
    out = declarations.innermost(lines_usages, spans, point_keys=[*keys, "file"], point="line", first="function", stored=stored).drop("in_project")
    return out.withColumn("enclosing", F.coalesce("in_qualified_name", "package")).withColumnRenamed("in_id", "target").drop("in_qualified_name", "in_start_line", "in_end_line", "in_ord", "in_file", "in_function")


def first_places(rows: DataFrame, keys: list[str], order: list[Column], fields: list[str], name: str, limit: int = rules.MAX_LOCATIONS) -> DataFrame:
    """Per key an array of the first rows; only these are gathered, however many a key has."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    kept = rows.withColumn("_nth", nth).where(F.col("_nth") <= limit)
    return kept.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_nth", F.struct(*fields).alias("u")))), lambda x: x["u"]).alias(name))


def as_declarations(declared: DataFrame) -> DataFrame:
    return declared.select(*keys_of(declared), "permission", "pos", "file", "line", "module", F.col("max_sdk").alias("maxSdkVersion"), F.col("sdk23_only").alias("sdk23Only"), "snippet")


def permission_reports(usages: DataFrame, declared: DataFrame, specs: DataFrame, alternatives: DataFrame) -> DataFrame:
    """Usages and declarations matched by permission (full outer), described and classified.

    A row holds the numbers of usages of each kind and the first places of them; the
    usages themselves stay rows of their table, so a permission that a whole corpus uses
    is no large row.  :func:`nested` gathers them for a report.  Where usages and declarations have a ``project``,
    a row is a permission of a project.
    """
    keys = keys_of(usages)
    own = [*keys, "permission"]
    kind, sure = F.col("kind"), F.col("confidence")
    api = kind == "API_CALL"
    n = lambda test: F.count_if(test)
    used = usages.groupBy(*own).agg(
        n(api).alias("api"), n(api & (sure != "LOW")).alias("strong"), n(api & (sure == "HIGH")).alias("high"), n(api & (sure == "MEDIUM")).alias("medium"),
        n(kind == "REQUEST").alias("requests"), n(kind == "CHECK").alias("checks"), n(kind == "PERMISSION_STRING").alias("constants"),
    )
    order = [F.col("kind") == "PERMISSION_STRING", F.col("file"), F.col("line"), F.col("ord")]
    for name, kinds in (("firstUsages", ["API_CALL", "PERMISSION_STRING"]), ("firstRequests", ["REQUEST"])):
        used = used.join(first_places(usages.where(kind.isin(*kinds)), own, order, USAGE_FIELDS, name), own, "left")
    told = declared.groupBy(*own).agg(F.count("*").alias("declarationCount"), F.bool_or(F.col("max_sdk").isNull()).alias("open_ended"))
    told = told.join(first_places(as_declarations(declared), own, [F.col("file"), F.col("pos")], DECLARATION_FIELDS, "firstDeclarations"), own, "left")
    both = signals.full_match(used, told, own).withColumn("declared", F.col("in_right")).drop("in_left", "in_right")
    covered = told.select(*keys, F.col("permission").alias("other")).join(F.broadcast(alternatives), "other").select(*keys, F.col("name").alias("permission")).distinct().withColumn("covered", F.lit(True))
    both = catalog.described(both.join(covered, own, "left"), "permission", specs)
    counts = {c: F.coalesce(F.col(c), F.lit(0)).cast("int") for c in ("api", "strong", "high", "medium", "requests", "checks", "constants", "declarationCount")}
    both = both.withColumns(counts | {
        "open_ended": F.coalesce("open_ended", F.lit(False)), "firstUsages": F.coalesce("firstUsages", F.array().cast(rules.NONE)),
        "firstRequests": F.coalesce("firstRequests", F.array().cast(rules.NONE)), "firstDeclarations": F.coalesce("firstDeclarations", F.array().cast(NO_DECLARATIONS)),
    })
    some = lambda c: F.col(c) > 0
    both = both.withColumn("status", classify.status(F.col("declared"), some("api"), some("strong"), some("requests"), some("checks"), some("constants"), F.coalesce("covered", F.lit(False))))
    every = some("api") | some("requests") | some("checks") | some("constants")
    return both.select(
        *own, text.short_name(F.col("permission")).alias("shortName"), "protection", "group", "description", "declared", "status",
        classify.risk(F.col("status"), F.col("protection"), some("requests"), F.col("policy_note")).alias("riskLevel"),
        classify.confidence(some("high"), some("medium"), some("requests"), every).alias("confidence"), F.col("policy_note").alias("policyNote"),
        "api", "requests", "checks", "constants", (F.col("api") + F.col("constants")).alias("usageCount"), "declarationCount", "open_ended", "firstUsages", "firstRequests", "firstDeclarations",
    )


def nested(reports: DataFrame, usages: DataFrame, declared: DataFrame) -> DataFrame:
    """Reports with all their usages, declarations and files, as a report shows them: a row per permission gathers them."""
    own = [*keys_of(reports), "permission"]
    row = F.struct(F.struct("file", "line", "ord").alias("at"), F.struct(*USAGE_FIELDS).alias("u"))
    found = usages.groupBy(*own).agg(F.transform(F.sort_array(F.collect_list(row)), lambda x: x["u"]).alias("found"))
    told = as_declarations(declared).groupBy(*own).agg(F.transform(F.sort_array(F.collect_list(F.struct("file", "pos", F.struct(*DECLARATION_FIELDS).alias("d")))), lambda x: x["d"]).alias("declarations"))
    both = reports.join(found, own, "left").join(told, own, "left")
    both = both.withColumn("found", F.coalesce("found", F.array().cast(rules.NONE))).withColumn("declarations", F.coalesce("declarations", F.array().cast(NO_DECLARATIONS)))
    of_kind = lambda k: F.filter("found", lambda u: u["kind"] == k)
    return both.withColumns({
        "usages": F.concat(of_kind("API_CALL"), of_kind("PERMISSION_STRING")), "runtimeRequests": of_kind("REQUEST"), "permissionChecks": of_kind("CHECK"),
        "touchedFiles": F.array_sort(F.array_distinct(F.transform("found", lambda u: u["file"]))),
    })


def chosen_usages(usages: DataFrame) -> DataFrame:
    """Per permission the first twenty API usages, or requests if there is none, with their place in the code."""
    own = [*keys_of(usages), "permission"]
    rows = usages.where(F.col("kind").isin("API_CALL", "REQUEST")).select(*own, "kind", "file", "line", "ord", "target")
    best = rows.groupBy(*own).agg(F.min("kind").alias("kind"))  # API_CALL comes first
    nth = F.row_number().over(Window.partitionBy(*own).orderBy("file", "line", "ord"))
    rows = rows.join(best, [*own, "kind"], "left_semi").withColumn("nth", nth).where(F.col("nth") <= graph.MAX_USAGES)
    return rows.where(F.col("target").isNotNull()).select(*own, "nth", "target")


def module_rows(sources: DataFrame, manifests: DataFrame) -> DataFrame:
    """Files by language and manifests of each module that has a source."""
    keys = keys_of(sources)
    count = lambda name: F.count_if(F.col("language") == name).cast("int")
    mods = sources.groupBy(*keys, "module").agg(count("Kotlin").alias("kotlinFileCount"), count("Java").alias("javaFileCount"), count("Dart").alias("dartFileCount"))
    per = manifests.groupBy(*keys, "module").agg(F.count("*").cast("int").alias("manifestCount"))
    out = mods.join(per, [*keys, "module"], "left").orderBy(*keys, "module")
    return out.select(*keys, F.col("module").alias("name"), F.col("module").alias("relativePath"), "kotlinFileCount", "javaFileCount", "dartFileCount", F.coalesce("manifestCount", F.lit(0)).alias("manifestCount"))


def entry_points(reports: DataFrame, place: str | None = None) -> DataFrame:
    """Entry points with the permissions that they reach, most first; ``place`` names a column for what orders equal numbers."""
    keys = keys_of(reports)
    rows = reports.select(*keys, "permission", F.posexplode("callPaths").alias("nth", "p")).select(*keys, "permission", "nth", "p.entryPoint", F.col("p.entryKind").alias("kind"), F.col("p.nodes")[0]["file"].alias("file"), F.col("p.nodes")[0]["line"].alias("line"))
    out = graph.inverted(rows, key=[*keys, "entryPoint"], value="permission", order=["permission", "nth"], carry=["kind", "file", "line"], place=place)
    return out.select(*[place] * bool(place), *keys, F.col("entryPoint").alias("symbol"), "kind", "file", "line", graph.module_of_file(F.col("file")).alias("module"), F.col("reached").alias("reachedPermissions"))


def summary_row(reports: DataFrame, findings: DataFrame) -> DataFrame:
    """Counts, score and grade: one row, or one for each ``project`` of the reports or the findings."""
    keys = keys_of(reports)
    n = lambda test: F.count_if(test).cast("int")
    state = F.col("status")
    per = reports.groupBy(*keys).agg(
        n(F.col("declared")).alias("declaredPermissionCount"), n(state == "USED").alias("usedPermissionCount"), n(state == "DECLARED_UNUSED").alias("unusedPermissionCount"),
        n(state == "UNDECLARED_USAGE").alias("undeclaredPermissionCount"), n((F.col("protection") == "DANGEROUS") & F.col("declared")).alias("dangerousPermissionCount"),
    )
    # of equal short names the last permission counts
    used = reports.where("usageCount > 0").groupBy(*keys, "shortName").agg(F.max_by("usageCount", "permission").alias("n"))
    used = used.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("shortName", "n")))).alias("usageCountByPermission"))
    scored = findings.groupBy(*keys).agg(classify.capped_score(F.col("severity")).alias("riskScore"), *[n(F.col("severity") == s).alias(s) for s in classify.SEVERITIES])
    if keys:
        one = per.join(used, keys, "left").join(scored, keys, "full_outer")
    else:
        one = rules.beside(per, used, scored)
    counts = {c: F.coalesce(F.col(c), F.lit(0)) for c in one.columns if c.endswith("Count") or c == "riskScore" or c in classify.SEVERITIES}
    one = one.withColumns(counts).withColumn("usageCountByPermission", F.coalesce("usageCountByPermission", F.create_map().cast("map<string,int>")))
    pairs = F.filter(F.array(*[F.struct(F.lit(s).alias("k"), F.col(s).alias("v")) for s in classify.SEVERITIES]), lambda x: x["v"] > 0)
    named = [c for c in per.columns if c not in keys]
    return one.select(*keys, *named, "usageCountByPermission", "riskScore", classify.grade(F.col("riskScore")).alias("riskGrade"), F.map_from_entries(pairs).alias("findingCountBySeverity"))


def analyze(spark: SparkSession, root: str, include_tests: bool = False, *, known: Sequence[Signal] = catalog.SIGNALS, transitive: bool = False) -> Analysis:
    """Analyses the project below ``root``; for ``known`` and ``transitive`` see :func:`assemble`."""
    began = time.time()
    sources = project.sources(spark, root, include_tests)
    return assemble(spark, root, sources, project.manifests(spark, root), project.build_config(spark, root), began, known=known, transitive=transitive)


def assemble(spark: SparkSession, root: str, sources: DataFrame, manifests: DataFrame, build: DataFrame, began: float | None = None, *, known: Sequence[Signal] = catalog.SIGNALS, transitive: bool = False) -> Analysis:
    """The analysis of given source, manifest and build rows, by the signals ``known`` (a user's own: :func:`catalog.from_table`).

    With ``transitive`` super types of super types make entry points too.

    Where all three have a ``project``, every section has it too and each project is analysed by itself, all in the same
    jobs: names, permissions, modules and findings of two projects never meet.
    """
    own = [*keys_of(build), "permission"]
    began = began or time.time()
    sources, manifests, build = checkpointed(sources), checkpointed(manifests), checkpointed(build)
    parsed = declarations.declarations(sources)
    decls = checkpointed(graph.entry_kinds(checkpointed(parsed) if transitive else parsed, transitive))
    found = checkpointed(located(signals.usages(signals.candidate_lines(sources, known), known), decls, stored=True))
    components = project.manifest_components(manifests)
    declared = checkpointed(project.declared(manifests))
    reports = checkpointed(permission_reports(found, declared, catalog.specs(spark), catalog.alternatives(spark)))
    chosen = checkpointed(chosen_usages(found))
    paths, _ = graph.callers_paths(chosen.select(F.col("target").alias("id")), graph.call_edges(decls), decls.select("id", "entry_kind"))
    routes = graph.usage_paths(decls, paths, chosen)
    none = F.array().cast("array<struct<entryPoint:string,entryKind:string,depth:int,nodes:array<struct<symbol:string,file:string,line:int>>>>")
    reports = checkpointed(reports.join(routes, own, "left").withColumn("callPaths", F.coalesce("callPaths", none)))
    report_order = [classify.risk_rank(F.col("riskLevel")), F.col("permission")]
    permissions = nested(reports, found, declared).select(*own[:-1], *REPORT_FIELDS).orderBy(*own[:-1], *report_order)
    all_findings = rules.permission_findings(reports).unionByName(rules.project_findings(reports, build, manifests, sources)).unionByName(rules.manifest_findings(manifests, components))
    findings = in_order(rules.numbered(all_findings))
    summary = checkpointed(summary_row(reports, findings))
    return Analysis(root, sources, manifests, components, declared, build, found, reports, permissions, findings, summary, module_rows(sources, manifests), entry_points(reports), time.time() - began)


def report_filter(reports: DataFrame, *, status: str | None = None, risk: str | None = None, query: str = "") -> DataFrame:
    """Reports of a status, of a risk level, and with a text in their names, description, files or usages (any case)."""
    if status:
        reports = reports.where(F.col("status") == status)
    if risk:
        reports = reports.where(F.col("riskLevel") == risk)
    if query:
        said = F.transform("usages", lambda u: F.concat_ws(" ", u["enclosing"], u["evidence"]))
        text_ = F.lower(F.concat_ws(" ", "permission", "description", "group", F.array_join("touchedFiles", " "), F.array_join(said, " ")))
        reports = reports.where(F.contains(text_, F.lit(query.lower())))
    return reports
