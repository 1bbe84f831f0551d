"""A small project from files to report, CLI and service."""

import json

import pytest

from grantscope import cli
from grantscope.plans import report
from grantscope.plans.analyze import analyze, report_filter
from grantscope.server import Service

FILES = {
    "app/src/main/AndroidManifest.xml": """<manifest xmlns:android="http://schemas.android.com/apk/res/android">
    <uses-permission android:name="android.permission.CAMERA" />
    <uses-permission android:name="android.permission.READ_CONTACTS" />
    <uses-permission android:name="android.permission.WRITE_EXTERNAL_STORAGE" />
    <uses-permission android:name="android.permission.ACCESS_FINE_LOCATION" />
    <application android:usesCleartextTraffic="true">
        <activity android:name=".Home" android:exported="true">
            <intent-filter />
        </activity>
    </application>
</manifest>
""",
    "app/build.gradle.kts": """plugins { id("com.android.application") }
android {
    compileSdk = 34
    defaultConfig {
        applicationId = "org.example.notes"
        minSdk = 24
        targetSdk = 34
    }
}
dependencies {
    implementation("com.squareup.okhttp3:okhttp:4.12.0")
    implementation("com.google.android.gms:play-services-ads:22.0.0")
}
""",
    "app/src/main/java/org/example/notes/Home.kt": """package org.example.notes

import android.Manifest

class Home : AppCompatActivity() {
    fun snap() {
        // openCamera( in a comment does not count
        if (checkSelfPermission(Manifest.permission.CAMERA) != 0) {
            ask()
        }
    }
    fun ask() {
        requestPermissions(arrayOf(Manifest.permission.CAMERA), 1)
    }
    fun shoot() {
        manager.openCamera("0")
    }
    fun sync() {
        Net().push()
    }
}
""",
    "app/src/main/java/org/example/notes/Net.kt": """package org.example.notes

class Net {
    fun push() {
        val c = OkHttpClient()
    }
}
""",
    "app/src/main/java/org/example/notes/Rec.java": """package org.example.notes;

public class Rec extends Service {
    public int onStartCommand(int a) {
        recorder.setAudioSource(1);
        return a;
    }
}
""",
    "lib/place.dart": """void ask() {
  Permission.locationWhenInUse.request();
  if (Permission.contacts.status) {}
}
""",
    "app/src/test/java/HomeTest.kt": "class HomeTest { fun t() { setAudioSource(1) } }\n",
    "app/build/Gen.kt": "class Gen { fun g() { setAudioSource(1) } }\n",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("proj")
    for name, content in FILES.items():
        path = top / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(content)
    return top


@pytest.fixture(scope="module")
def analysis(spark, root):
    return analyze(spark, str(root))


@pytest.fixture(scope="module")
def doc(analysis):
    return report.document(analysis)


def test_permissions(doc):
    got = {p["shortName"]: (p["status"], p["riskLevel"], p["confidence"]) for p in doc["permissions"]}
    assert got == {
        "CAMERA": ("USED", "MEDIUM", "HIGH"), "READ_CONTACTS": ("USED", "HIGH", "HIGH"), "WRITE_EXTERNAL_STORAGE": ("DECLARED_UNUSED", "HIGH", "HIGH"), "ACCESS_FINE_LOCATION": ("USED", "MEDIUM", "HIGH"),
        "ACCESS_COARSE_LOCATION": ("UNDECLARED_USAGE", "HIGH", "HIGH"), "WRITE_CONTACTS": ("UNDECLARED_USAGE", "HIGH", "HIGH"), "RECORD_AUDIO": ("UNDECLARED_USAGE", "HIGH", "HIGH"), "INTERNET": ("UNDECLARED_USAGE", "HIGH", "HIGH"),
    }
    camera = next(p for p in doc["permissions"] if p["shortName"] == "CAMERA")
    assert [(u["line"], u["enclosing"].rsplit(".", 1)[1], u["evidence"]) for u in camera["usages"]] == [(8, "snap", "Camera permission constant"), (13, "ask", "Camera permission constant"), (16, "shoot", "Camera2 openCamera")]
    assert [u["line"] for u in camera["runtimeRequests"]] == [13] and [u["line"] for u in camera["permissionChecks"]] == [8]
    assert "policyNote" in camera and "policyNote" not in next(p for p in doc["permissions"] if p["shortName"] == "INTERNET")


def test_paths_and_entries(doc):
    net = next(p for p in doc["permissions"] if p["shortName"] == "INTERNET")
    assert [[n["symbol"].split("notes.")[1] for n in path["nodes"]] for path in net["callPaths"]] == [["Home.sync", "Net.push"]]
    kinds = {e["symbol"]: e["kind"] for e in doc["entryPoints"]}
    assert kinds["org.example.notes.Rec.onStartCommand"] == "Service" and kinds["org.example.notes.Home.sync"] == "AppCompatActivity"
    # calls are matched by name alone, over languages: Home.snap calls ask
    assert kinds["org.example.notes.Home.snap"] == "AppCompatActivity" and "ask" not in kinds


def test_findings_and_summary(doc):
    rules = [f["rule"] for f in doc["findings"]]
    assert rules.count("UNDECLARED_PERMISSION") == 4
    for rule in ("STORAGE_MAX_SDK", "FINE_WITHOUT_COARSE", "EXPORTED_COMPONENT_WITHOUT_PERMISSION", "CLEARTEXT_TRAFFIC", "MISSING_AD_ID", "NETWORK_WITHOUT_INTERNET", "PLAY_POLICY_SENSITIVE", "MISSING_RUNTIME_REQUEST", "MISSING_PERMISSION_CHECK"):
        assert rule in rules, rule
    assert [f["id"] for f in sorted(doc["findings"], key=lambda f: f["id"])] == [f"F-{n:03d}" for n in range(1, len(rules) + 1)]
    order = ["CRITICAL", "HIGH", "MEDIUM"]
    assert [order.index(f["severity"]) for f in doc["findings"]] == sorted(order.index(f["severity"]) for f in doc["findings"])
    s = doc["summary"]
    assert (s["declaredPermissionCount"], s["usedPermissionCount"], s["unusedPermissionCount"], s["undeclaredPermissionCount"], s["riskScore"], s["riskGrade"]) == (4, 3, 1, 4, 100, "F")
    assert sum(s["findingCountBySeverity"].values()) == len(rules) and s["usageCountByPermission"]["CAMERA"] == 3


def test_project_section(doc):
    p = doc["project"]
    assert (p["applicationId"], p["minSdk"], p["targetSdk"], p["compileSdk"]) == ("org.example.notes", 24, 34, 34)
    assert any("okhttp" in d for d in p["dependencies"]) and (p["kotlinFileCount"], p["javaFileCount"], p["dartFileCount"]) == (2, 1, 1)
    assert {m["name"]: m["manifestCount"] for m in p["modules"]} == {"app": 1, "lib": 0}


def test_tests_are_included_on_demand(spark, root):
    found = analyze(spark, str(root), include_tests=True)
    assert found.sources.where("is_test").count() == 1


def test_filter(analysis):
    names = lambda df: sorted(r.shortName for r in df.collect())
    assert names(report_filter(analysis.permissions, status="DECLARED_UNUSED")) == ["WRITE_EXTERNAL_STORAGE"]
    assert names(report_filter(analysis.permissions, query="OKHTTP")) == ["INTERNET"]
    assert names(report_filter(analysis.permissions, risk="LOW")) == []


def test_sinks(doc):
    page = report.html_page(doc | {"project": doc["project"] | {"name": "<b>"}})
    assert "&lt;b&gt;" in page and "android.permission.CAMERA" in page and "</b>" not in page.split("<script")[1]
    assert json.loads(report.pretty_json(doc)) == doc == json.loads(report.compact_json(doc))
    said = report.console_text(doc)
    assert "[MISSING-FROM-MANIFEST] INTERNET" in said and "FINDINGS (" in said
    assert report.breaches(doc, "CRITICAL") == 5 and report.breaches(doc, "MEDIUM") == len(doc["findings"])


def test_cli(spark, root, tmp_path, capsys):
    assert cli.main([str(root), "--out", str(tmp_path), "--quiet", "--fail-on", "high"], spark) == 2
    assert json.loads((tmp_path / "report.json").read_text())["schemaVersion"] == "1.0" and (tmp_path / "report.html").exists()
    assert cli.main([]) == 0 and cli.main(["--nope"]) == 1
    for wrong in (["a", "b"], ["--port", "0"], ["--port", "x"], ["--fail-on", "INFO"], ["--out"], ["/no/such/dir"], [str(root), "--no-html", "--no-json"]):
        with pytest.raises(cli.UsageError):
            cli.parse(wrong)
    assert cli.parse(["--serve", "--port", "8080"]).port == 8080


def test_service(spark, root):
    service = Service(spark, 7473)
    call = lambda method, path, body=None: service.answer(method, path, json.dumps(body).encode())
    assert call("GET", "/")[0] == 200 and call("GET", "/x")[0] == 404 and json.loads(call("GET", "/api/health")[2])["status"] == "ok"
    assert call("GET", "/api/analyze")[0] == 405 and call("POST", "/api/analyze", {"path": ""})[0] == 400 and service.answer("POST", "/api/analyze", b"{")[0] == 400
    assert call("POST", "/api/pick-folder")[0] == 500 and call("GET", "/api/pick-folder")[0] == 405
    status, _, body = call("POST", "/api/analyze", {"path": str(root), "other": 1})
    found = json.loads(body)
    assert status == 200 and found["declaredPermissionCount"] == 4 and call("GET", found["reportUrl"])[0] == 200
    store = report.Store(2)
    for k in "abc":
        store.put(k, k)
    assert store.get("a") is None and store.get("c") == "c"


def test_empty_project(spark, tmp_path):
    doc = report.document(analyze(spark, str(tmp_path)))
    assert [f["rule"] for f in doc["findings"]] == ["NO_MANIFEST", "NO_SOURCES"] and doc["summary"]["riskGrade"] == "C"
    assert doc["permissions"] == [] and "No issues" not in report.console_text(doc)
