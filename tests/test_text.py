"""Line, path and markup functions against small plain-Python models."""

import random
import time

import pytest
from pyspark.sql import functions as F

from grantscope.functions import catalog, markup, text
from grantscope.server import request_of


def one(spark, expr, **columns):
    names = list(columns)
    df = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{n} string" for n in names))
    return df.select(expr.alias("x")).first()[0]


def many(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.select("i", expr.alias("x")).orderBy("i").select("x").collect()]


def stripped(source):
    """Character by character: strings end at the line, block comments go on."""
    out, state, i = [], "", 0
    while i < len(source):
        c, two = source[i], source[i : i + 2]
        if state == "block":
            if two == "*/":
                state, i = "", i + 2
                continue
            out.append("\n" if c == "\n" else "")
        elif c == "\n":
            state = ""
            out.append(c)
        elif state == "line":
            pass
        elif state:
            out.append(c)
            if c == "\\" and i + 1 < len(source) and source[i + 1] != "\n":
                out.append(source[i + 1])
                i += 1
            elif c == state:
                state = ""
        elif two == "//":
            state = "line"
        elif two == "/*":
            state, i = "block", i + 2
            continue
        else:
            state = c if c in "\"'" else ""
            out.append(c)
        i += 1
    return "".join(out)


def test_strip_comments_against_model(spark):
    rng = random.Random(7)
    cases = ["".join(rng.choice("ab/*\"'\\\n ") for _ in range(rng.randrange(1, 40))) for _ in range(1500)]
    cases += ['val u = "http://x" // c', "a /* b\nc */ d", "'\\'' // x", '"open\n// c', "/* never", ""]
    assert many(spark, cases, text.strip_comments(F.col("v"))) == [stripped(c) for c in cases]


def test_lines(spark):
    got = many(spark, ["a\r\nb\rc\n", "", "a", "\n"], text.lines_of(F.col("v")))
    assert got == [["a", "b", "c"], [], ["a"], [""]]


@pytest.mark.parametrize(("path", "module", "manifest"), [
    ("app/src/main/A.kt", "app", "app"), ("lib/core/src/B.kt", "lib/core", "lib/core"), ("Root.kt", "Root.kt", "Root.kt"), ("x/y.kt", "x", "x"), ("", "root", "root"),
])
def test_modules(spark, path, module, manifest):
    assert one(spark, F.struct(text.module_of(F.col("p")), text.manifest_module(F.col("p"))), p=path) == (module, manifest)


def test_strict_casts(spark):
    values = ["28", "+28", "-3", " 28", "28.0", "", None, "true", "99999999999"]
    assert many(spark, values, text.strict_int(F.col("v"))) == [28, 28, -3, None, None, None, None, None, None]
    assert many(spark, ["true", "false", "TRUE", "1", None], text.strict_bool(F.col("v"))) == [True, False, None, None, None]


def test_snippet_and_tests_and_language(spark):
    assert one(spark, text.snippet(F.col("p")), p="\t " + "x" * 300) == "x" * 220
    assert many(spark, ["a/test/B.kt", "a/androidTest/B.kt", "BTest.kt", "BTest.java", "test/B.kt", "b_test.dart"], text.is_test(F.col("v"))) == [True] * 4 + [False] * 2
    assert many(spark, ["A.kt", "a.dart", "A.java"], text.language_of(F.col("v"))) == ["Kotlin", "Dart", "Java"]


MANIFEST = """<manifest package="x.y">
  <uses-permission android:name="android.permission.CAMERA" android:maxSdkVersion="28"/>
  <uses-permission-sdk-23 android:name="android.permission.NFC" android:name="android.permission.VIBRATE" />
  <uses-permission android:name=" " />
  <uses-permission android:name='android.permission.INTERNET' />
  <uses-feature android:name="cam" android:required="false"/>
  <application android:usesCleartextTraffic="true">
    <activity android:name=".A"
       android:exported="true">
      <intent-filter/>
    </activity>
    <service android:name=".S" android:exported="TRUE" />
    <receiver android:name=".R" android:permission="p"><intent-filter></intent-filter></receiver>
    <activity-alias android:name=".L"></activity-alias>
  </application>
</manifest>"""


def test_manifest(spark):
    perms = one(spark, markup.permissions(F.col("p")), p=MANIFEST)
    assert [(p.name, p.max_sdk, p.sdk23_only, p.line) for p in perms] == [("android.permission.CAMERA", 28, False, 2), ("android.permission.VIBRATE", None, True, 3)]
    parts = one(spark, markup.components(F.col("p")), p=MANIFEST)
    assert [(c.name, c.type, c.exported, c.permission, c.has_intent_filter, c.line) for c in parts] == [
        (".A", "activity", True, None, True, 8), (".S", "service", None, None, False, 12), (".R", "receiver", None, "p", True, 13), (".L", "activity-alias", None, None, False, 14),
    ]
    assert [tuple(f) for f in one(spark, markup.features(F.col("p")), p=MANIFEST)] == [("cam", False, 6)]
    assert one(spark, markup.application_attribute(F.col("p"), "android:usesCleartextTraffic"), p=MANIFEST) == "true"
    assert one(spark, F.struct(markup.manifest_package(F.col("p")), markup.has_queries(F.col("p"))), p=MANIFEST) == ("x.y", False)
    assert one(spark, F.struct(markup.permissions(F.col("p")), markup.components(F.col("p"))), p="") == ([], [])


def test_window_counts_blank_lines(spark):
    df = spark.createDataFrame([("f", i, str(i)) for i in range(1, 12)], "f string, line int, code string")
    rows = text.around(df, ["f"], "line", "code").orderBy("line").collect()
    assert rows[0].window == "1 2 3 4 5" and rows[5].window == "2 3 4 5 6 7 8 9 10" and rows[10].window == "7 8 9 10 11"


def test_catalog(spark):
    assert len(catalog.SPECS) == 49 and len(catalog.SIGNALS) == 84
    df = spark.createDataFrame([("android.permission.CAMERA",), ("android.permission.NEW",), ("com.x.Y",)], "n string")
    rows = {r.n: r for r in catalog.described(df, "n", catalog.specs(spark)).collect()}
    assert rows["android.permission.CAMERA"].group == "Camera" and rows["android.permission.CAMERA"].policy_note
    assert (rows["android.permission.NEW"].protection, rows["com.x.Y"].protection) == ("NORMAL", "SIGNATURE")
    assert rows["com.x.Y"].group == "Other" and rows["com.x.Y"].policy_note is None


def test_request_fields_are_those_of_the_service(spark):
    bodies = ['{"path": "a/b"}', '{"path": "x", "includeTests": true, "more": [1]}', '{"path": "x", "includeTests": "true"}', '{"path": "x", "includeTests": 1}', '{"path": 7}']
    bodies += ['{"path": null}', '{"path": " \\t"}', '{"path": "\\u2003"}', '{"path": {"path": "x"}}', "{}", "[]", '"x"', "7", "null", "true", "", "  ", "{", '{"path": "x"', '{"path": "x"} y', '{"path": "x"}],[1', '{"path": "x"}}', '{"path": "x"}, 2', '{"path": "x"}, "c": 1']
    bodies += ['{"includeTests": true}', '{"path": " é ", "includeTests": false}', '{"path": "' + "long/" * 5000 + '"}']
    df = spark.createDataFrame([(k, b) for k, b in enumerate([*bodies, None])], "k int, body string")
    path, tests, error = text.request_fields(F.col("body"))
    got = {r.k: (r.path, r.t, r.error) for r in df.select("k", path.alias("path"), tests.alias("t"), error.alias("error")).collect()}
    assert got == {k: request_of(b) for k, b in enumerate(bodies)} | {len(bodies): ("", False, "The body is not JSON")}


def test_many_components_of_one_manifest(spark):
    # each was given the joined text after it, made anew from two splits of the whole text
    n = 1500
    part = '<activity android:name=".É{0}">\n{1}</activity>\n<service android:name="S{0}"/>\n<activity-alias android:name="B{0}" android:exported="{2}">'
    text_ = "é<application>\n" + "".join(part.format(k, "<intent-filter/>" * (k % 2), ["true", "x", ""][k % 3]) for k in range(n)) + "<intent-filter></activity-alias>"
    began = time.monotonic()
    got = one(spark, markup.components(F.col("p")), p=text_)
    assert time.monotonic() - began < 60
    assert [c.name for c in got] == [x.format(k) for k in range(n) for x in (".É{}", "S{}", "B{}")] and [c.line for c in got[:6]] == [2, 4, 5, 5, 7, 8]
    # an alias reaches to the end tag of its own type, which only the last one has; an activity to its own
    assert [c.has_intent_filter for c in got] == [x for k in range(n) for x in (bool(k % 2), False, True)]
    assert [c.exported for c in got[2::3]] == [[True, None, None][k % 3] for k in range(n)]
