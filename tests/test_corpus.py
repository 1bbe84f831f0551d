"""Many projects in one analysis: each report is what the project gives by itself."""

import json

import pytest
from pyspark.sql import functions as F

from grantscope.plans import analyze, corpus, report
from grantscope.sources import project
from test_project import FILES

OTHER = {
    "src/main/AndroidManifest.xml": '<manifest package="x"><uses-permission android:name="android.permission.INTERNET"/><uses-permission android:name="android.permission.VIBRATE"/></manifest>',
    "src/Home.kt": 'package p\nclass Home : Fragment() {\n  fun shoot() {\n    push()\n    m.openCamera("0")\n  }\n  fun push() {\n    val c = OkHttpClient()\n  }\n}\n',
    "x/src/Été.java": 'class A {\n  void sync() {\n    push();\n    String s = "</script>"; v.loadUrl(s);\n  }\n}\n',
    "lib/a.dart": "void ask() {\n  Permission.contacts.request();\n}\n",
}
PROJECTS = {"one": FILES, "two & <b>": OTHER, "manifest only": {"AndroidManifest.xml": OTHER["src/main/AndroidManifest.xml"]}}


def rows(spark, projects, keyed):
    made = [(name, path, text) for name, files in projects.items() for path, text in files.items() if "/build/" not in path]
    df = spark.createDataFrame(made, "project string, relative_path string, content string").withColumn("path", F.concat(F.lit("/p/"), "relative_path"))
    df = df if keyed else df.drop("project")
    kind = lambda x: df.where(F.col("relative_path").rlike(x))
    sources, manifests = project.source_rows(kind(r"\.(kt|java|dart)$")), project.manifest_rows(kind("AndroidManifest.xml$"))
    return analyze.assemble(spark, "/p", sources, manifests, project.build_row(kind(r"build\.gradle")))


@pytest.fixture(scope="module")
def many(spark):
    return rows(spark, PROJECTS, True)


@pytest.fixture(scope="module")
def singles(spark):
    return {name: report.document(rows(spark, {name: files}, False)) for name, files in PROJECTS.items()}


def plain(doc, name):
    doc = json.loads(json.dumps(doc))
    doc["generatedAt"] = doc["summary"]["analysisDurationMs"] = None
    doc["project"] |= {"path": "/p", "name": name}
    return doc


def test_each_report_is_that_of_its_project(spark, many, singles, tmp_path):
    for pretty in (True, False):
        found = corpus.write_reports(many, f"file://{tmp_path}/{pretty}", pretty=pretty, generated_at="now").collect()
        assert {r.project for r in found} == set(PROJECTS) and len({r.path for r in found}) == len(PROJECTS)
        for r in found:
            text = open(r.path.removeprefix("file://"), encoding="utf-8").read()
            doc = json.loads(text)
            assert plain(doc, r.project) == plain(singles[r.project], r.project)
            assert list(doc) == list(singles[r.project]) and [list(p) for p in doc["permissions"]] == [list(p) for p in singles[r.project]["permissions"]]
            assert text == (report.pretty_json if pretty else report.compact_json)(doc) and len(text.encode()) == r.n_bytes
        assert sorted(x.name for x in (tmp_path / str(pretty)).iterdir() if not x.name.endswith(".crc")) == sorted(r.path.rpartition("/")[2] for r in found)


def test_pages_hold_the_reports(many, singles, tmp_path):
    for r in corpus.write_reports(many, f"file://{tmp_path}", page=True, generated_at="now").collect():
        text = open(r.path.removeprefix("file://"), encoding="utf-8").read()
        doc = json.loads(text.partition('type="application/json">')[2].partition("</script>")[0].replace("<\\/", "</"))
        assert plain(doc, r.project) == plain(singles[r.project], r.project)
        assert text == report.html_page(doc)


def test_console_payload_and_breaches(many, singles):
    lines = corpus.console_lines(many).orderBy("project", "section", "rank", "name", "nth").collect()
    payloads = {r.project: json.loads(r.payload) for r in corpus.payloads(many).collect()}
    grave = {level: {r.project: r.breaches for r in corpus.breaches(many, level).collect()} for level in ("CRITICAL", "HIGH", "LOW")}
    for name, doc in singles.items():
        doc["project"] |= {"name": name, "path": f"/p/{name}"}
        doc["summary"]["analysisDurationMs"] = int(many.seconds * 1000)
        assert "\n".join(r.line for r in lines if r.project == name) + "\n" == report.console_text(doc)
        expected = report.payload(doc, "r")
        assert payloads[name] == {k: v for k, v in expected.items() if k not in ("id", "reportUrl")}
        assert all(grave[level][name] == report.breaches(doc, level) for level in grave)


def test_names_of_files():
    names = ["a", "a/b", "a_b", "..", "", None, "é", "a-b.c"]
    assert len({corpus.file_name(x) for x in names}) == len(names)
    assert corpus.file_name("a-b.c") == "a-b.c" and all("/" not in corpus.file_name(x) and corpus.file_name(x).strip(".") for x in names)


def test_no_projects_give_no_files(spark, tmp_path):
    assert corpus.write_reports(rows(spark, {}, True), f"file://{tmp_path}/x").count() == 0


def test_parts_make_the_reports(spark, many, singles, tmp_path):
    events = corpus.ranged(corpus.events(many, "now"), 6).localCheckpoint()
    forms = {form: corpus.write_parts(events, f"file://{tmp_path}/{form}", pretty=form == "pretty", page=form == "page").localCheckpoint() for form in ("pretty", "compact", "page")}
    held = corpus.read_parts(*forms.values()).collect()
    docs = {}
    for form, made in (("pretty", report.pretty_json), ("compact", report.compact_json), ("page", report.html_page)):
        parts = forms[form].orderBy("project", "part").collect()
        assert len(parts) > 20  # a report is cut anywhere, within lists too
        for name in PROJECTS:
            text = "".join(open(r.path.removeprefix("file://"), encoding="utf-8").read() for r in parts if r.project == name)
            if form == "pretty":
                docs[name] = json.loads(text)
                assert plain(docs[name], name) == plain(singles[name], name)
            assert text == made(docs[name])
    for name, doc in docs.items():
        own = [r for r in held if r.project == name]
        total = lambda what, of=None: sum(r.n for r in own if r.what == what and r.name == of)
        for p in doc["permissions"]:
            assert all(total(x, p["permission"]) == len(p[x]) for x in ("declarations", "usages", "runtimeRequests", "permissionChecks", "touchedFiles"))
        assert [r.name for r in sorted(own, key=lambda r: (r.part, r.nth)) if r.what == "permission"] == [p["permission"] for p in doc["permissions"]]
        assert total("findings") == len(doc["findings"]) and total("number", "analyzedLineCount") == doc["project"]["analyzedLineCount"]
        assert all(r.n for r in own if r.what in ("same", "escaped")) and sum(r.n for r in own if r.what == "ended") == 1


def test_parts_that_differ_are_told(spark, tmp_path):
    schema = "project string, part int, path string, section int, name string, list int"
    def side(form, text):
        (tmp_path / form).write_text(text)
        return spark.createDataFrame([("p", 0, f"file://{tmp_path}/{form}", 7, "x", 41)], schema)
    page = report.PAGE.format(name="", data='{"a":[1,2]}')
    flags = lambda *texts: {r.what: r.n for r in corpus.read_parts(*[side(f, t) for f, t in zip("abc", texts, strict=True)]).collect()}
    assert flags('{\n    "a": [\n        1,\n        2\n    ]\n}', '{"a":[1,2]}', page)["same"] == 1
    assert flags('{\n    "a": [\n        1\n    ]\n}', '{"a":[1,2]}', page) == {"same": 0, "escaped": 0, "ended": 1}
