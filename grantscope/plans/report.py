"""Sinks of an analysis: JSON, a self-contained HTML page, console text, an exit code."""

from __future__ import annotations

import html
import json
import os
from collections import OrderedDict
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.classify import MARKERS, SEVERITIES
from .analyze import Analysis

STORED = 20


def _rows(df: DataFrame) -> list[dict]:
    """The rows as dictionaries, without null fields, in order."""
    return [json.loads(r[0]) for r in df.select(F.to_json(F.struct("*"))).collect()]


def document(analysis: Analysis) -> dict:
    """The whole report, on the driver: for one project, whose usages and findings fit there.

    Of a corpus of projects the tables of the analysis are written as they are instead.
    """
    build, summary = _rows(analysis.build)[0], _rows(analysis.summary)[0]
    count = lambda name: F.count_if(F.col("language") == name).alias(name)
    totals = analysis.sources.agg(count("Kotlin"), count("Java"), count("Dart"), F.coalesce(F.sum(F.size("raw")), F.lit(0)).alias("lines")).first()
    names = {"application_id": "applicationId", "min_sdk": "minSdk", "target_sdk": "targetSdk", "compile_sdk": "compileSdk"}
    project = {"path": os.path.abspath(analysis.root), "name": os.path.basename(os.path.abspath(analysis.root))}
    project |= {new: build[old] for old, new in names.items() if old in build}
    project |= {
        "modules": _rows(analysis.modules), "manifestFiles": [r[0] for r in analysis.manifests.select("file").orderBy("file").collect()],
        "dependencies": build.get("dependencies", []), "kotlinFileCount": totals["Kotlin"], "javaFileCount": totals["Java"], "dartFileCount": totals["Dart"],
        "analyzedLineCount": totals["lines"],
    }
    component = analysis.components.orderBy("file", "pos").select("name", "type", "exported", "permission", F.col("has_intent_filter").alias("hasIntentFilter"), "file", "line", "module")
    summary["analysisDurationMs"] = int(analysis.seconds * 1000)
    return {
        "schemaVersion": "1.0", "generatedAt": datetime.now(UTC).astimezone().isoformat(timespec="milliseconds"), "project": project, "summary": summary,
        "permissions": _rows(analysis.permissions), "findings": _rows(analysis.findings), "components": _rows(component), "entryPoints": _rows(analysis.entry_points),
    }


def pretty_json(report: dict) -> str:
    return json.dumps(report, indent=4, ensure_ascii=False)


def compact_json(report: dict) -> str:
    return json.dumps(report, separators=(",", ":"), ensure_ascii=False)


PAGE = """<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{name}</title><style>
body{{font:14px/1.5 system-ui,sans-serif;margin:2rem;max-width:70rem}}table{{border-collapse:collapse;width:100%}}
td,th{{border-bottom:1px solid #ddd;padding:.3rem .5rem;text-align:left;vertical-align:top}}input,select{{margin:.5rem .5rem .5rem 0;padding:.3rem}}
</style></head><body><h1>{name}</h1><p id="sum"></p><input id="q" placeholder="filter"><select id="st"><option value=""></option></select><select id="rk"><option value=""></option></select>
<button id="save">JSON</button><table id="perms"></table><h2>Findings</h2><table id="finds"></table><h2>Entry points</h2><table id="entries"></table>
<script id="report-data" type="application/json">{data}</script><script>
const d=JSON.parse(document.getElementById("report-data").textContent),$=i=>document.getElementById(i);
const cell=(r,v)=>{{const c=r.insertCell();c.textContent=v;return c}},tail=s=>s.split(".").slice(-2).join(".");
$("sum").textContent="Grade "+d.summary.riskGrade+", score "+d.summary.riskScore+"/100, "+Object.entries(d.summary.findingCountBySeverity).map(([k,v])=>v+" "+k).join(", ");
for(const [i,k] of [["st","status"],["rk","riskLevel"]])for(const v of new Set(d.permissions.map(p=>p[k])))$(i).add(new Option(v,v));
const hay=p=>[p.permission,p.description,p.group,...p.touchedFiles,...p.usages.map(u=>u.enclosing+" "+u.evidence)].join(" ").toLowerCase();
function draw(){{const t=$("perms");t.textContent="";for(const p of d.permissions){{if($("st").value&&p.status!==$("st").value||$("rk").value&&p.riskLevel!==$("rk").value||!hay(p).includes($("q").value.toLowerCase()))continue;
const r=t.insertRow();[p.shortName,p.status,p.riskLevel,p.confidence,p.usages.length+" usages",p.callPaths.length+" paths",p.usages.slice(0,3).map(u=>u.file+":"+u.line+" "+u.evidence).join("; ")].forEach(v=>cell(r,v))}}}}
for(const f of d.findings){{const r=$("finds").insertRow();[f.severity,f.id,f.title,f.detail,f.recommendation].forEach(v=>cell(r,v))}}
for(const e of d.entryPoints){{const r=$("entries").insertRow();[tail(e.symbol),e.kind,e.file+":"+e.line,e.reachedPermissions.map(tail).join(", ")].forEach(v=>cell(r,v))}}
for(const i of ["q","st","rk"])$(i).oninput=draw;draw();
$("save").onclick=()=>{{const a=document.createElement("a");a.href=URL.createObjectURL(new Blob([JSON.stringify(d,null,2)],{{type:"application/json"}}));a.download="report.json";a.click()}};
</script></body></html>"""


def html_page(report: dict) -> str:
    """One page that holds the data, the filter and the export; the project's name is escaped."""
    return PAGE.format(name=html.escape(report["project"]["name"]), data=compact_json(report).replace("</", "<\\/"))


def console_text(report: dict) -> str:
    project, summary = report["project"], report["summary"]
    show = lambda key: project.get(key, "-")
    lines = [
        "Permission usage analysis", f"Project      : {project['name']}", f"Path         : {project['path']}", f"Application  : {show('applicationId')}",
        f"SDK          : min {show('minSdk')} / target {show('targetSdk')}",
        f"Sources      : {project['kotlinFileCount']} Kotlin, {project['javaFileCount']} Java, {project['dartFileCount']} Dart",
        f"Duration     : {summary['analysisDurationMs']} ms", "", f"Risk grade   : {summary['riskGrade']} (score {summary['riskScore']}/100)",
        f"Permissions  : {summary['declaredPermissionCount']} declared, {summary['usedPermissionCount']} declared and used, "
        f"{summary['unusedPermissionCount']} declared but never used, {summary['undeclaredPermissionCount']} missing from manifest",
        "               Every permission falls into exactly one state, the categories never overlap.", "", "PERMISSION MAP",
    ]
    for p in report["permissions"]:
        lines.append(f"  {MARKERS.get(p['status'], '[?]')} {p['shortName']} ({p['protection']}) risk={p['riskLevel']} usages={len(p['usages'])} paths={len(p['callPaths'])}")
        lines += [f"      {u['file']}:{u['line']}  {u['evidence']}" for u in p["usages"][:3]]
    lines += ["", f"FINDINGS ({len(report['findings'])})"]
    lines += [f"  {f['severity']:<8} {f['id']} {f['title']}" for f in report["findings"]] or ["  No issues found."]
    return "\n".join(lines) + "\n"


def breaches(report: dict, level: str) -> int:
    """Findings of the given severity or a graver one."""
    order = [s for s in SEVERITIES if s != "INFO"]
    graver = order[: order.index(level) + 1]
    return sum(f["severity"] in graver for f in report["findings"])


def payload(report: dict, report_id: str) -> dict:
    """What the HTTP service says of an analysis."""
    summary, project = report["summary"], report["project"]
    counts = ["riskGrade", "riskScore", "declaredPermissionCount", "usedPermissionCount", "unusedPermissionCount", "undeclaredPermissionCount", "dangerousPermissionCount"]
    return {
        "id": report_id, "projectName": project["name"], "projectPath": project["path"], "applicationId": project.get("applicationId", ""), **{k: summary[k] for k in counts},
        "findingsCount": len(report["findings"]), "analysisDurationMs": summary["analysisDurationMs"], "reportUrl": f"/report/{report_id}",
    }


class Store:
    """The last reports, oldest out first."""

    def __init__(self, limit: int = STORED):
        self.limit, self.pages = limit, OrderedDict()

    def put(self, key: str, page: str) -> None:
        self.pages[key] = page
        while len(self.pages) > self.limit:
            self.pages.popitem(last=False)

    def get(self, key: str) -> str | None:
        return self.pages.get(key)
