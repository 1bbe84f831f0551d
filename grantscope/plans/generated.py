"""A project written from the driver's tables, and what an analysis of it must find.

Each customer is a source file, each supplier a manifest, each nation a build script.
``QUERIES`` run the analysis, or one operator of it, over all of them; ``ORACLE_SQL``
derives the same facts from the tables' keys, without reading any of the generated text.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import catalog
from ..functions.shared import checkpointed, dealt, shared_folder
from ..operators import compare, declarations, graph, rules, signals, sketches
from ..sources import project
from ..streaming import rescan
from . import analyze, corpus, report

KOTLIN = """package org.n<n>.<seg>
import android.net.ConnectivityManager

/* openCamera( in a
   comment */ // setAudioSource(
@Marked
class C<k>(val s: Store) : <super>(), x.y.Face {
  val ssid = WifiManager("http://<seg>") // loadUrl(
  fun run<k>() {
    <api>
    helper<g>()
    onStart()
  }
  <mark>
  fun helper<g>() {
    <perm>
  }
  fun onStart() {
  }
}
"""
JAVA = """package org.n<n>.j;
import static java.util.J<k>.*;
public class C<k> extends <super> implements a.b.Face, Other {
  public void run<k>(int a) {
    <api>;
    helper<g>();
  }
  /** <seg> */ public int helper<g>() {
    <perm>
  }
}
"""
DART = """import 'package:x/y.dart';
class C<k> {
  void run<k>() {
    <dart>
    helper<g>();
  }
  Future<void> helper<g>() async {
    <api>;
  }
}
"""
MANIFEST = """<manifest package="org.s<k>">
  <uses-permission android:name="android.permission.<P>"/>
  <uses-permission-sdk-23
    android:maxSdkVersion="<max>" android:name="<Q>"/>
  <uses-feature android:name="f<k>" android:required="<required>"/>
  <!-- <uses-permission android:name="android.permission.NFC"/> -->
  <application <clear>>
    <activity android:name=".A<k>" android:exported="false" android:exported="<exported>">
      <intent-filter/>
    </activity>
    <service android:name=".S<k>" android:exported="true" android:permission="p.q"/>
    <receiver android:name="  "/>
    <provider android:name=".P<k>" android:exported="true"><intent-filter></intent-filter></provider>
  </application>
  <queries>
</manifest>
"""
SCRIPT = """// applicationId "commented.out"
<app>
minSdk <min>
targetSdkVersion(<target>)
compileSdk = <compile>
implementation("com.x:lib<n>:1.0")
implementation 'com.google.android.gms:play-services-ads:<n>'
"""
API = ['manager.openCamera("0")', "recorder.setAudioSource(1)", "val c = OkHttpClient()", "m.requestLocationUpdates(0)", "x = FileOutputStream(f)", "NotificationManagerCompat.from(c)"]
PERM = [
    "requestPermissions(arrayOf(Manifest.permission.CAMERA), 1)", "if (checkSelfPermission(Manifest.permission.RECORD_AUDIO) == 0) go()",
    'val p = "android.permission.READ_CONTACTS" + Manifest.permission.NFC', 'val q = "android.vendor.X_Y"',
]
ASKED = ["Permission.locationWhenInUse.request();", "x = Permission.contacts.status;", "y = Permission.photos;"]
SUPERS = {"AUTOMOBILE": "AppCompatActivity", "BUILDING": "Service", "FURNITURE": "Helper", "HOUSEHOLD": "Worker"}
DECLARED = ["CAMERA", "READ_CONTACTS", "WRITE_EXTERNAL_STORAGE", "ACCESS_FINE_LOCATION", "QUERY_ALL_PACKAGES", "READ_MEDIA_VIDEO"]

#: A changed file has the content of a customer so many keys later, of the same language.
LATER = 50

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def filled(template: str, **values: Column) -> Column:
    """The template with each ``<name>`` of ``values`` replaced."""
    parts = re.split(f"<({'|'.join(values)})>", template)
    return F.concat(*[values[x].cast("string") if n % 2 else F.lit(x) for n, x in enumerate(parts)])


def nth(values: list[str], at: Column) -> Column:
    return F.array(*[F.lit(x) for x in values])[F.pmod(at, F.lit(len(values))).cast("int")]


def source_files(spark: SparkSession, sf_dir: str, later: int = 0) -> DataFrame:
    """path, relative_path and content of a source file per customer, with the nation and the key; the content is that of a customer ``later``."""
    own, n = F.col("c_custkey"), F.col("c_nationkey")
    k = own + later
    above = F.lit("Base")
    for segment, name in SUPERS.items():
        above = F.when(F.col("c_mktsegment") == segment, name).otherwise(above)
    values = {
        "k": k, "n": n, "g": F.floor(k / 4), "seg": F.lower("c_mktsegment"), "super": above, "api": nth(API, k), "perm": nth(PERM, k), "dart": nth(ASKED, k),
        "mark": F.when(k % 7 == 0, "@Composable").otherwise("@Deprecated"),
    }
    java, dart = own % 5 == 1, own % 5 == 2
    named = {"k": own, "n": n}
    path = F.when(own % 25 == 24, filled("n<n>/src/test/java/C<k>Test.kt", **named)).when(java, filled("n<n>/src/main/java/C<k>.java", **named))
    path = path.when(dart, filled("lib<n>/c<k>.dart", **named)).otherwise(filled("n<n>/src/main/kotlin/C<k>.kt", **named))
    content = F.when(java, filled(JAVA, **values)).when(dart, filled(DART, **values)).otherwise(filled(KOTLIN, **values))
    df = dealt(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey", "c_mktsegment"), "c_custkey").select(path.alias("relative_path"), content.alias("content"), filled("n<n>", n=n).alias("nation"), own.alias("key"))
    return df.select(F.concat(F.lit("/p/"), "relative_path").alias("path"), "relative_path", "content", "nation", "key")


def manifest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """relative_path and content of a manifest per supplier."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    values = {
        "k": k, "n": n, "P": nth(DECLARED, k), "Q": nth(["android.permission.WRITE_EXTERNAL_STORAGE", " "], k), "max": nth(["28", " 28", "+28"], k), "required": nth(["true", "TRUE", "false"], k),
        "clear": nth([f'android:usesCleartextTraffic="{x}"' for x in ("true", "false", "TRUE")] + ["x"], k), "exported": nth(["true", "false", "TRUE"], k),
    }
    path = F.when(k % 2 == 0, filled("n<n>/src/main/s<k>/AndroidManifest.xml", **values)).otherwise(filled("n<n>/s<k>/src/main/AndroidManifest.xml", **values))
    return dealt(spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_nationkey"), "s_suppkey").select(path.alias("relative_path"), F.replace(filled(MANIFEST, **values), F.lit("<queries>"), F.when(k % 4 == 0, "<queries>").otherwise("")).alias("content"), filled("n<n>", n=n).alias("nation"))


def build_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """relative_path and content of a build script per nation."""
    n = F.col("n_nationkey")
    values = {"n": n, "min": n + 20, "target": n + 33, "compile": n + 34, "app": F.when(n >= 3, filled('applicationId "org.gen.n<n>"', n=n)).otherwise("")}
    path = filled("n<n>/build.gradle<end>", n=n, end=nth(["", ".kts"], n))
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(path.alias("relative_path"), filled(SCRIPT, **values).alias("content"), filled("n<n>", n=n).alias("nation"))


def analysis(spark: SparkSession, sf_dir: str) -> analyze.Analysis:
    sources, manifests = project.source_rows(source_files(spark, sf_dir)), project.manifest_rows(manifest_files(spark, sf_dir))
    return analyze.assemble(spark, "/p", sources, manifests, project.build_row(build_files(spark, sf_dir)))


FACTS = """
f AS (
  SELECT c_custkey AS k, c_nationkey AS n, lower(c_mktsegment) AS seg, c_custkey // 4 AS g,
         CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'AppCompatActivity' WHEN 'BUILDING' THEN 'Service' WHEN 'FURNITURE' THEN 'Helper' WHEN 'HOUSEHOLD' THEN 'Worker' ELSE 'Base' END AS super,
         CASE WHEN c_custkey % 5 = 1 THEN 'java' WHEN c_custkey % 5 = 2 THEN 'dart' ELSE 'kt' END AS t, c_custkey % 25 = 24 AS test
  FROM customer),
file AS (
  SELECT *, CASE WHEN test THEN 'n' || n || '/src/test/java/C' || k || 'Test.kt' WHEN t = 'java' THEN 'n' || n || '/src/main/java/C' || k || '.java'
                 WHEN t = 'dart' THEN 'lib' || n || '/c' || k || '.dart' ELSE 'n' || n || '/src/main/kotlin/C' || k || '.kt' END AS path,
         CASE t WHEN 'java' THEN 'org.n' || n || '.j' WHEN 'kt' THEN 'org.n' || n || '.' || seg ELSE '' END AS pkg,
         CASE t WHEN 'dart' THEN 'lib' || n ELSE 'n' || n END AS module
  FROM f),
shape(t, ord, what, s, e) AS (VALUES ('kt', 0, 'C', 7, 20), ('kt', 1, 'run', 9, 13), ('kt', 2, 'helper', 15, 17), ('kt', 3, 'onStart', 18, 19),
  ('java', 0, 'C', 3, 11), ('java', 1, 'run', 4, 7), ('java', 2, 'helper', 8, 10), ('dart', 0, 'C', 2, 10), ('dart', 1, 'run', 3, 6), ('dart', 2, 'helper', 7, 9)),
named AS (
  SELECT file.*, ord, what, s, e, CASE what WHEN 'C' THEN 'C' || k WHEN 'run' THEN 'run' || k WHEN 'helper' THEN 'helper' || g ELSE what END AS simple,
         CASE WHEN pkg = '' THEN '' ELSE pkg || '.' END || 'C' || k AS owner,
         ['openCamera', 'setAudioSource', 'OkHttpClient', 'requestLocationUpdates', 'FileOutputStream', 'from'][k % 6 + 1] AS api_call,
         ['requestPermissions,arrayOf', 'checkSelfPermission,go', '', ''][k % 4 + 1] AS perm_calls
  FROM file JOIN shape USING (t)),
decl AS (
  SELECT *, CASE what WHEN 'C' THEN owner ELSE owner || '.' || simple END AS symbol, path || '#' || (CASE what WHEN 'C' THEN owner ELSE owner || '.' || simple END) || '#' || s AS id,
         CASE WHEN what = 'C' THEN 'CLASS' WHEN what = 'helper' AND t = 'kt' AND k % 7 = 0 THEN 'COMPOSABLE' ELSE 'FUNCTION' END AS kind,
         CASE WHEN what <> 'C' OR t = 'dart' THEN '' WHEN t = 'kt' THEN 'Store,' || super || ',Face' ELSE super || ',implements,Face,Other' END AS supers,
         CASE WHEN t <> 'kt' THEN '' WHEN what = 'C' THEN 'Marked' WHEN what <> 'helper' THEN '' WHEN k % 7 = 0 THEN 'Composable' ELSE 'Deprecated' END AS marks,
         CASE WHEN what = 'run' AND t = 'dart' THEN CASE WHEN k % 3 = 0 THEN 'request,' ELSE '' END || 'helper' || g WHEN what = 'run' THEN api_call || ',helper' || g || CASE t WHEN 'kt' THEN ',onStart' ELSE '' END
              WHEN what = 'helper' AND t = 'dart' THEN api_call WHEN what = 'helper' THEN perm_calls ELSE '' END AS calls,
         CASE WHEN what = 'C' THEN NULL WHEN what = 'helper' AND t = 'kt' AND k % 7 = 0 THEN 'COMPOSABLE' WHEN t <> 'dart' AND super NOT IN ('Helper', 'Base') THEN super
              WHEN what = 'onStart' THEN 'LIFECYCLE' END AS entry
  FROM named),
hit(line_of, m, many, permission, kind, evidence, confidence, snippet, a, b, c) AS (VALUES
  ('api', 0, 6, 'CAMERA', 'API_CALL', 'Camera2 openCamera', 'HIGH', 'manager.openCamera("0")', 0, 1, 0), ('api', 1, 6, 'RECORD_AUDIO', 'API_CALL', 'MediaRecorder audio source', 'HIGH', 'recorder.setAudioSource(1)', 0, 8, 0),
  ('api', 2, 6, 'INTERNET', 'API_CALL', 'OkHttp', 'HIGH', 'val c = OkHttpClient()', 0, 58, 0), ('api', 3, 6, 'ACCESS_FINE_LOCATION', 'API_CALL', 'LocationManager updates', 'HIGH', 'm.requestLocationUpdates(0)', 0, 13, 0),
  ('api', 3, 6, 'ACCESS_BACKGROUND_LOCATION', 'API_CALL', 'Background location updates', 'LOW', 'm.requestLocationUpdates(0)', 0, 23, 0), ('api', 4, 6, 'WRITE_EXTERNAL_STORAGE', 'API_CALL', 'File output stream', 'LOW', 'x = FileOutputStream(f)', 0, 42, 0),
  ('api', 5, 6, 'POST_NOTIFICATIONS', 'API_CALL', 'NotificationManagerCompat', 'HIGH', 'NotificationManagerCompat.from(c)', 0, 48, 0),
  ('perm', 0, 4, 'CAMERA', 'API_CALL', 'Camera permission constant', 'MEDIUM', 'requestPermissions(arrayOf(Manifest.permission.CAMERA), 1)', 0, 6, 0),
  ('perm', 0, 4, 'CAMERA', 'REQUEST', 'Runtime permission request', 'HIGH', 'requestPermissions(arrayOf(Manifest.permission.CAMERA), 1)', 2, 0, 0),
  ('perm', 1, 4, 'RECORD_AUDIO', 'CHECK', 'Permission state check', 'HIGH', 'if (checkSelfPermission(Manifest.permission.RECORD_AUDIO) == 0) go()', 2, 0, 0),
  ('perm', 2, 4, 'NFC', 'PERMISSION_STRING', 'Permission constant reference', 'HIGH', 'val p = "android.permission.READ_CONTACTS" + Manifest.permission.NFC', 2, 0, 0),
  ('perm', 2, 4, 'READ_CONTACTS', 'PERMISSION_STRING', 'Permission constant reference', 'HIGH', 'val p = "android.permission.READ_CONTACTS" + Manifest.permission.NFC', 2, 1, 0),
  ('perm', 3, 4, 'android.vendor.X_Y', 'PERMISSION_STRING', 'Permission constant reference', 'HIGH', 'val q = "android.vendor.X_Y"', 2, 0, 0),
  ('dart', 0, 3, 'ACCESS_FINE_LOCATION', 'API_CALL', 'permission_handler: Permission.locationWhenInUse', 'HIGH', 'Permission.locationWhenInUse.request();', 1, 0, 0),
  ('dart', 0, 3, 'ACCESS_FINE_LOCATION', 'REQUEST', 'permission_handler request', 'HIGH', 'Permission.locationWhenInUse.request();', 1, 0, 1),
  ('dart', 0, 3, 'ACCESS_COARSE_LOCATION', 'API_CALL', 'permission_handler: Permission.locationWhenInUse', 'HIGH', 'Permission.locationWhenInUse.request();', 1, 0, 0),
  ('dart', 0, 3, 'ACCESS_COARSE_LOCATION', 'REQUEST', 'permission_handler request', 'HIGH', 'Permission.locationWhenInUse.request();', 1, 0, 1),
  ('dart', 1, 3, 'READ_CONTACTS', 'API_CALL', 'permission_handler: Permission.contacts', 'HIGH', 'x = Permission.contacts.status;', 1, 0, 0), ('dart', 1, 3, 'READ_CONTACTS', 'CHECK', 'permission_handler status check', 'HIGH', 'x = Permission.contacts.status;', 1, 0, 1),
  ('dart', 1, 3, 'WRITE_CONTACTS', 'API_CALL', 'permission_handler: Permission.contacts', 'HIGH', 'x = Permission.contacts.status;', 1, 0, 0), ('dart', 1, 3, 'WRITE_CONTACTS', 'CHECK', 'permission_handler status check', 'HIGH', 'x = Permission.contacts.status;', 1, 0, 1),
  ('dart', 2, 3, 'READ_MEDIA_IMAGES', 'API_CALL', 'permission_handler: Permission.photos', 'HIGH', 'y = Permission.photos;', 1, 0, 0),
  ('class', 0, 1, 'ACCESS_WIFI_STATE', 'API_CALL', 'WifiManager', 'HIGH', NULL, 0, 66, 0), ('import', 0, 1, 'ACCESS_NETWORK_STATE', 'API_CALL', 'ConnectivityManager', 'HIGH', 'import android.net.ConnectivityManager', 0, 65, 0)),
place(t, line_of, line, what) AS (VALUES ('kt', 'api', 10, 'run'), ('kt', 'perm', 16, 'helper'), ('kt', 'class', 8, 'C'), ('kt', 'import', 2, ''), ('java', 'api', 5, 'run'), ('java', 'perm', 9, 'helper'), ('dart', 'dart', 4, 'run'), ('dart', 'api', 8, 'helper')),
u AS (
  SELECT file.k, file.path AS file, p.line, CASE WHEN contains(h.permission, '.') THEN h.permission ELSE 'android.permission.' || h.permission END AS permission, h.kind, h.evidence, h.confidence,
         CASE WHEN p.line_of = 'class' THEN 'val ssid = WifiManager("http://' || file.seg || '") // loadUrl(' WHEN p.line_of = 'api' AND file.t <> 'kt' THEN h.snippet || ';' ELSE h.snippet END AS snippet,
         coalesce(d.symbol, file.pkg) AS enclosing, d.id AS target, p.what, h.a, h.b, h.c
  FROM file JOIN place p ON p.t = file.t JOIN hit h ON h.line_of = p.line_of AND file.k % h.many = h.m LEFT JOIN decl d ON d.k = file.k AND d.what = p.what
  WHERE NOT file.test),
man AS (
  SELECT s_suppkey AS k, CASE WHEN s_suppkey % 2 = 0 THEN 'n' || s_nationkey || '/src/main/s' || s_suppkey || '/AndroidManifest.xml' ELSE 'n' || s_nationkey || '/s' || s_suppkey || '/src/main/AndroidManifest.xml' END AS file,
         CASE WHEN s_suppkey % 2 = 0 THEN 'n' || s_nationkey ELSE 'n' || s_nationkey || '/s' || s_suppkey END AS module, [28, NULL, 28][s_suppkey % 3 + 1] AS max_sdk, ['28', ' 28', '+28'][s_suppkey % 3 + 1] AS max_text
  FROM supplier),
told AS (
  SELECT 'android.permission.' || ['CAMERA', 'READ_CONTACTS', 'WRITE_EXTERNAL_STORAGE', 'ACCESS_FINE_LOCATION', 'QUERY_ALL_PACKAGES', 'READ_MEDIA_VIDEO'][k % 6 + 1] AS permission, file, module, 2 AS line, NULL::INTEGER AS max_sdk, false AS sdk23_only, NULL AS snippet, 0 AS pos, k FROM man
  UNION ALL SELECT 'android.permission.WRITE_EXTERNAL_STORAGE', file, module, 3, max_sdk, true, '<uses-permission-sdk-23' || chr(10) || '    android:maxSdkVersion="' || max_text || '" android:name="android.permission.WRITE_EXTERNAL_STORAGE"/>', 1, k FROM man WHERE k % 2 = 0
  UNION ALL SELECT 'android.permission.NFC', file, module, 6, NULL, false, NULL, CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END, k FROM man),
declared AS (SELECT * REPLACE (coalesce(snippet, '<uses-permission android:name="' || permission || '"/>') AS snippet) FROM told),
part_ AS (
  SELECT '.A' || k AS name, 'activity' AS type, CASE k % 3 WHEN 0 THEN true WHEN 1 THEN false END AS exported, NULL AS permission, true AS has_intent_filter, 8 AS line, 0 AS pos, file, module, k FROM man
  UNION ALL SELECT '.S' || k, 'service', true, 'p.q', false, 11, 1, file, module, k FROM man UNION ALL SELECT '.P' || k, 'provider', true, NULL, true, 13, 2, file, module, k FROM man),
spec(name, protection, grp, note) AS (VALUES """ + ", ".join("('{}', '{}', '{}', {})".format(s[0], s[1], s[2], "NULL" if s[4] is None else "'" + s[4].replace("'", "''") + "'") for s in catalog.SPECS) + """),
counted AS (
  SELECT permission, count(*) FILTER (WHERE kind = 'API_CALL') AS api, count(*) FILTER (WHERE kind = 'API_CALL' AND confidence <> 'LOW') AS strong, count(*) FILTER (WHERE kind = 'API_CALL' AND confidence = 'HIGH') AS high,
         count(*) FILTER (WHERE kind = 'API_CALL' AND confidence = 'MEDIUM') AS medium, count(*) FILTER (WHERE kind = 'REQUEST') AS requests, count(*) FILTER (WHERE kind = 'CHECK') AS checks, count(*) FILTER (WHERE kind = 'PERMISSION_STRING') AS constants
  FROM u GROUP BY permission),
asked AS (SELECT permission, count(*) AS declarations, bool_or(max_sdk IS NULL) AS open_ended FROM declared GROUP BY permission),
joined AS (
  SELECT permission, asked.permission IS NOT NULL AS declared, coalesce(api, 0) AS api, coalesce(strong, 0) AS strong, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(requests, 0) AS requests,
         coalesce(checks, 0) AS checks, coalesce(constants, 0) AS constants, coalesce(declarations, 0) AS declarations, coalesce(open_ended, false) AS open_ended,
         coalesce(protection, CASE WHEN starts_with(permission, 'android.permission.') THEN 'NORMAL' ELSE 'SIGNATURE' END) AS protection, coalesce(grp, 'Other') AS grp, note,
         permission = 'android.permission.READ_MEDIA_IMAGES' AND EXISTS (SELECT 1 FROM asked WHERE permission = 'android.permission.READ_MEDIA_VIDEO')
           OR permission = 'android.permission.ACCESS_COARSE_LOCATION' AND EXISTS (SELECT 1 FROM asked WHERE permission = 'android.permission.ACCESS_FINE_LOCATION') AS covered
  FROM counted FULL JOIN asked USING (permission) LEFT JOIN spec ON spec.name = permission),
stated AS (
  SELECT *, CASE WHEN NOT declared AND strong = 0 AND requests = 0 AND api > 0 THEN 'WEAK_SIGNAL' WHEN NOT declared AND covered AND requests = 0 THEN 'ALTERNATIVE_COVERED' WHEN api > 0 AND NOT declared THEN 'UNDECLARED_USAGE'
    WHEN api > 0 THEN 'USED' WHEN declared AND requests + checks + constants > 0 THEN 'REQUESTED_ONLY' WHEN NOT declared AND requests + checks > 0 THEN 'UNDECLARED_USAGE' ELSE 'DECLARED_UNUSED' END AS status FROM joined),
reports AS (
  SELECT *, string_split(permission, '.')[-1] AS short, CASE WHEN status IN ('WEAK_SIGNAL', 'ALTERNATIVE_COVERED') THEN 'LOW' WHEN status = 'UNDECLARED_USAGE' THEN 'HIGH'
      WHEN status = 'DECLARED_UNUSED' AND protection IN ('DANGEROUS', 'SPECIAL') THEN 'HIGH' WHEN status = 'DECLARED_UNUSED' THEN 'MEDIUM' WHEN protection = 'DANGEROUS' AND requests = 0 THEN 'HIGH'
      WHEN note IS NOT NULL THEN 'MEDIUM' WHEN status = 'REQUESTED_ONLY' THEN 'MEDIUM' ELSE 'LOW' END AS risk,
    CASE WHEN high > 0 OR requests > 0 THEN 'HIGH' WHEN medium > 0 THEN 'MEDIUM' WHEN api + requests + checks + constants = 0 THEN 'HIGH' ELSE 'LOW' END AS sure
  FROM stated),
found AS (
  SELECT 0 AS block, permission AS ord, 0 AS nth, 'UNUSED_PERMISSION' AS rule, CASE WHEN protection IN ('DANGEROUS', 'SPECIAL') THEN 'HIGH' ELSE 'MEDIUM' END AS severity, permission, least(8, declarations) AS places FROM reports WHERE status = 'DECLARED_UNUSED'
  UNION ALL SELECT 0, permission, 1, 'UNDECLARED_PERMISSION', 'CRITICAL', permission, least(8, api + constants) FROM reports WHERE status = 'UNDECLARED_USAGE'
  UNION ALL SELECT 0, permission, 2, 'MISSING_RUNTIME_REQUEST', 'HIGH', permission, least(8, api + constants) FROM reports WHERE protection = 'DANGEROUS' AND status = 'USED' AND requests = 0
  UNION ALL SELECT 0, permission, 3, 'MISSING_PERMISSION_CHECK', 'MEDIUM', permission, least(8, requests) FROM reports WHERE protection = 'DANGEROUS' AND status = 'USED' AND requests > 0 AND checks = 0
  UNION ALL SELECT 0, permission, 4, 'PLAY_POLICY_SENSITIVE', CASE WHEN protection = 'SPECIAL' THEN 'HIGH' ELSE 'MEDIUM' END, permission, least(8, declarations) FROM reports WHERE declared AND note IS NOT NULL
  UNION ALL SELECT 1, '', 5, 'STORAGE_MAX_SDK', 'MEDIUM', permission, 0 FROM reports WHERE permission = 'android.permission.WRITE_EXTERNAL_STORAGE' AND declared AND open_ended
  UNION ALL SELECT 2, '', 6, 'MISSING_POST_NOTIFICATIONS', 'HIGH', permission, least(8, api + constants) FROM reports WHERE permission = 'android.permission.POST_NOTIFICATIONS' AND api > 0 AND NOT declared
  UNION ALL SELECT 3, '', 7, 'FINE_WITHOUT_COARSE', 'MEDIUM', permission, 0 FROM reports WHERE permission = 'android.permission.ACCESS_FINE_LOCATION' AND declared
  UNION ALL SELECT 5, printf('%s#%08d', file, pos), 9, 'EXPORTED_COMPONENT_WITHOUT_PERMISSION', 'MEDIUM', NULL, 1 FROM part_ WHERE exported AND permission IS NULL AND has_intent_filter
  UNION ALL SELECT 6, file, 10, 'CLEARTEXT_TRAFFIC', 'MEDIUM', NULL, 0 FROM man WHERE k % 4 = 0
  UNION ALL SELECT 7, '', 11, 'MISSING_AD_ID', 'MEDIUM', NULL, 0
  UNION ALL SELECT 8, '', 12, 'NETWORK_WITHOUT_INTERNET', 'CRITICAL', permission, 0 FROM reports WHERE permission = 'android.permission.INTERNET' AND api > 0 AND NOT declared),
findings AS (SELECT *, printf('F-%03d', row_number() OVER (ORDER BY block, ord, nth)) AS id FROM found),
chosen AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY permission ORDER BY file, line, a, b, c) AS nth FROM u WHERE kind = 'API_CALL') WHERE nth <= 20 AND target IS NOT NULL),
route AS (
  SELECT c.permission, c.nth, 1 AS level, '' AS pos, coalesce(d.entry, 'UNKNOWN') AS kind, d.symbol AS head, d.path AS file, d.s AS line, d.symbol || '@' || d.path || ':' || d.s AS nodes
  FROM chosen c JOIN decl d ON d.id = c.target WHERE d.what <> 'helper' OR d.entry IS NOT NULL
  UNION ALL
  SELECT c.permission, c.nth, 2, r.path, coalesce(r.entry, 'UNKNOWN'), r.symbol, r.path, r.s, r.symbol || '@' || r.path || ':' || r.s || ' ' || d.symbol || '@' || d.path || ':' || d.s
  FROM chosen c JOIN decl d ON d.id = c.target JOIN decl r ON r.g = d.g AND r.what = 'run' AND NOT r.test WHERE d.what = 'helper' AND d.entry IS NULL),
once AS (SELECT *, row_number() OVER (PARTITION BY permission, nodes ORDER BY nth, level, pos) AS again FROM route),
paths AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY permission ORDER BY nth, level, pos) AS spot FROM once WHERE again = 1) WHERE spot <= 12)"""


def query(sql: str | None = None, register: bool = True) -> Callable[[Query], Query]:
    """Registers a query under its function's name; ``sql`` reads the facts above."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"WITH {FACTS}\n{sql}"
        return f

    return add


@query("""SELECT path, module, CASE t WHEN 'java' THEN 'Java' WHEN 'dart' THEN 'Dart' ELSE 'Kotlin' END AS language, pkg AS package, test AS is_test,
CASE t WHEN 'java' THEN 'java.util.J' || k || '.*' WHEN 'kt' THEN 'android.net.ConnectivityManager' ELSE '' END AS imports,
CASE t WHEN 'java' THEN 11 WHEN 'dart' THEN 10 ELSE 20 END AS n_lines, CASE t WHEN 'java' THEN 11 WHEN 'dart' THEN 10 ELSE 17 END AS n_code,
t = 'kt' AS commented FROM file""")
def project_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, module, language, package, imports, test flag and comment-free code of source files."""
    df = checkpointed(project.source_rows(source_files(spark, sf_dir), include_tests=True))  # read twice
    has = lambda lines, x: F.exists(lines, lambda v: F.contains(v, F.lit(x)))
    hidden = has("raw", "loadUrl(") & has("raw", "openCamera( in") & has("raw", "setAudioSource(") & ~has("code", "loadUrl(") & ~has("code", "openCamera( in") & ~has("code", "// ") & has("code", '"http://')
    lines = signals.code_lines(df).groupBy("file").agg(F.count("*").cast("int").alias("n_code"))
    df = df.select(F.col("relative_path").alias("path"), "module", "language", "package", "is_test", F.array_join("imports", ",").alias("imports"), F.size("raw").alias("n_lines"), hidden.alias("commented"))
    return df.join(lines, F.col("path") == F.col("file")).drop("file")


@query("""SELECT path, module FROM file WHERE NOT test""")
def project_without_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files but for those of tests."""
    return project.source_rows(source_files(spark, sf_dir)).select(F.col("relative_path").alias("path"), "module")


@query("""SELECT id, kind, simple AS simple_name, symbol AS qualified_name, s AS start_line, e AS end_line, CASE what WHEN 'C' THEN NULL ELSE owner END AS container,
supers AS super_types, marks AS annotations, calls, ord, entry AS entry_kind FROM decl WHERE NOT test""")
def project_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types and functions with extent, owner, names, super types, annotations, calls, order and entry kind."""
    df = graph.entry_kinds(declarations.declarations(project.source_rows(source_files(spark, sf_dir))))
    joined = [F.array_join(c, ",").alias(c) for c in ("super_types", "annotations", "calls")]
    return df.select("id", "kind", "simple_name", "qualified_name", "start_line", "end_line", "container", *joined, "ord", "entry_kind")


@query("""SELECT id FROM decl WHERE NOT test AND entry IS NOT NULL""")
def project_entry_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions that are entry points."""
    return graph.entry_functions(graph.entry_kinds(declarations.declarations(project.source_rows(source_files(spark, sf_dir))))).select("id")


@query("""SELECT d.id AS callee_id, r.id AS caller_id FROM decl d JOIN decl r ON r.g = d.g AND r.what = 'run' AND d.what = 'helper' WHERE NOT d.test AND NOT r.test""")
def project_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls by name, names of too many functions left out."""
    return graph.call_edges(declarations.declarations(project.source_rows(source_files(spark, sf_dir)))).select("callee_id", "caller_id")


@query("""SELECT permission, file, line, kind, evidence, confidence, snippet, enclosing, target FROM u""")
def project_usages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usages on code lines with their enclosing declaration."""
    sources = checkpointed(project.source_rows(source_files(spark, sf_dir)))  # read twice, as are declarations
    found = analyze.located(signals.usages(signals.candidate_lines(sources)), checkpointed(declarations.declarations(sources)), stored=True)
    return found.select("permission", "file", "line", "kind", "evidence", "confidence", "snippet", "enclosing", "target")


@query("""SELECT permission, file, module, line, max_sdk::INTEGER AS max_sdk, sdk23_only, snippet, pos FROM declared""")
def manifest_permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared permissions of manifests, a row each."""
    return project.declared(project.manifest_rows(manifest_files(spark, sf_dir)))


@query("""SELECT name, type, exported, permission, has_intent_filter, line, pos, file, module FROM part_""")
def manifest_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of manifests, a row each."""
    return project.manifest_components(project.manifest_rows(manifest_files(spark, sf_dir)))


@query("""SELECT file, module, 'org.s' || k AS package, CASE k % 4 WHEN 0 THEN true WHEN 1 THEN false END AS cleartext, k % 4 = 0 AS queries, 'f' || k AS feature,
CASE k % 3 WHEN 0 THEN true WHEN 2 THEN false END AS required, 5 AS line FROM man""")
def manifest_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features, package, application attribute and queries block of manifests."""
    df = project.manifest_rows(manifest_files(spark, sf_dir))
    return df.select("file", "module", "package", "cleartext", "queries", F.explode("features").alias("f")).select("file", "module", "package", "cleartext", "queries", F.col("f.name").alias("feature"), "f.required", "f.line")


@query("""SELECT 'org.gen.' || (SELECT arg_min('n' || n_nationkey, 'n' || n_nationkey || '/') FROM nation WHERE n_nationkey >= 3) AS application_id,
(SELECT arg_min(n_nationkey, 'n' || n_nationkey || '/') + 20 FROM nation)::INTEGER AS min_sdk, (SELECT arg_min(n_nationkey, 'n' || n_nationkey || '/') + 33 FROM nation)::INTEGER AS target_sdk,
(SELECT arg_min(n_nationkey, 'n' || n_nationkey || '/') + 34 FROM nation)::INTEGER AS compile_sdk,
(SELECT string_agg('com.x:lib' || n_nationkey || ':1.0,com.google.android.gms:play-services-ads:' || n_nationkey, ',' ORDER BY 'n' || n_nationkey || '/') FROM nation) AS dependencies""")
def project_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the build scripts say: the first value by path, and all dependencies."""
    row = project.build_row(build_files(spark, sf_dir))
    return row.select("application_id", "min_sdk", "target_sdk", "compile_sdk", F.array_join("dependencies", ",").alias("dependencies"))


@query("""SELECT permission, short, protection, grp AS "group", note AS policy_note, declared, status, risk, sure AS confidence, (api + constants)::INTEGER AS n_usages, requests::INTEGER AS n_requests, checks::INTEGER AS n_checks,
declarations::INTEGER AS n_declarations FROM reports""")
def project_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usages against declarations by permission, described and classified (S7-S9, P17, J5-J7, U10, A1, SO1, decision tables)."""
    sources, declared = project.source_rows(source_files(spark, sf_dir)), project.declared(project.manifest_rows(manifest_files(spark, sf_dir)))
    found = analyze.located(signals.usages(signals.candidate_lines(sources)), declarations.declarations(sources))
    df = analyze.permission_reports(found, declared, catalog.specs(spark), catalog.alternatives(spark))
    return df.select("permission", F.col("shortName").alias("short"), "protection", "group", F.col("policyNote").alias("policy_note"), "declared", "status", F.col("riskLevel").alias("risk"), "confidence",
                     F.col("usageCount").alias("n_usages"), F.col("requests").alias("n_requests"), F.col("checks").alias("n_checks"), F.col("declarationCount").alias("n_declarations"))


@query("""SELECT permission, (spot - 1)::INTEGER AS nth, head AS entry_point, kind AS entry_kind, CASE level WHEN 1 THEN 1 ELSE 2 END AS depth, nodes FROM paths""")
def project_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call paths of each permission's first usages."""
    df = analysis(spark, sf_dir).reports.select("permission", F.posexplode("callPaths").alias("nth", "p"))
    nodes = F.array_join(F.transform("p.nodes", lambda v: F.concat(v["symbol"], F.lit("@"), v["file"], F.lit(":"), v["line"].cast("string"))), " ")
    return df.select("permission", "nth", F.col("p.entryPoint").alias("entry_point"), F.col("p.entryKind").alias("entry_kind"), F.col("p.depth").alias("depth"), nodes.alias("nodes"))


@query("""SELECT head AS symbol, arg_max(kind, permission || printf('%04d', spot)) AS kind, arg_max(file, permission || printf('%04d', spot)) AS file, arg_max(line, permission || printf('%04d', spot)) AS line,
split_part(arg_max(file, permission || printf('%04d', spot)), '/src/', 1) AS module, string_agg(DISTINCT permission, ',' ORDER BY permission) AS reached FROM paths GROUP BY head""")
def project_entry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entry points with the permissions that they reach."""
    df = analysis(spark, sf_dir).entry_points
    return df.select("symbol", "kind", "file", "line", "module", F.array_join("reachedPermissions", ",").alias("reached"))


@query("""SELECT id, rule, severity, permission, places::INTEGER AS n_locations FROM findings""")
def project_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules on one project, numbered."""
    return analysis(spark, sf_dir).findings.select("id", "rule", "severity", "permission", F.size("locations").alias("n_locations"))


@query("""SELECT 'n' || n_nationkey AS project, rule, severity, id FROM nation JOIN (VALUES (0, 'NO_MANIFEST', 'HIGH', 'F-001'), (1, 'UNUSED_PERMISSION', 'HIGH', 'F-001'), (1, 'PLAY_POLICY_SENSITIVE', 'MEDIUM', 'F-002'),
(1, 'BACKGROUND_LOCATION_WITHOUT_FOREGROUND', 'HIGH', 'F-003'), (1, 'MISSING_AD_ID', 'MEDIUM', 'F-004'), (1, 'NO_SOURCES', 'HIGH', 'F-005')) v(odd, rule, severity, id) ON odd = n_nationkey % 2""")
def bare_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A project per nation: one file that uses nothing, without manifest and scripts, or a manifest and a script only."""
    scripts = build_files(spark, sf_dir).withColumnRenamed("nation", "project")
    odd = F.regexp_extract("project", "[0-9]+", 0).cast("int") % 2 == 1
    files = lambda path, content: scripts.select("project", F.lit(path).alias("path"), F.lit(path).alias("relative_path"), F.lit(content).alias("content"))
    sources = files("a/src/A.kt", "fun a() {\n}\n").where(~odd)
    manifests = files("a/AndroidManifest.xml", '<uses-permission android:name="android.permission.ACCESS_BACKGROUND_LOCATION"/>').where(odd)
    found = analyze.assemble(spark, "/p", project.source_rows(sources), project.manifest_rows(manifests), project.build_row(scripts.where(odd))).findings
    return found.select("project", "rule", "severity", "id")


@query("""SELECT (SELECT count(*) FILTER (WHERE declared)::INTEGER FROM reports) AS declared, (SELECT count(*) FILTER (WHERE status = 'USED')::INTEGER FROM reports) AS used, (SELECT count(*) FILTER (WHERE status = 'DECLARED_UNUSED')::INTEGER FROM reports) AS unused,
(SELECT count(*) FILTER (WHERE status = 'UNDECLARED_USAGE')::INTEGER FROM reports) AS undeclared, (SELECT count(*) FILTER (WHERE declared AND protection = 'DANGEROUS')::INTEGER FROM reports) AS dangerous,
least(100, (SELECT sum(CASE severity WHEN 'CRITICAL' THEN 40 WHEN 'HIGH' THEN 20 ELSE 8 END) FROM findings))::INTEGER AS score, 'F' AS grade,
(SELECT string_agg(severity || '=' || n, ',' ORDER BY severity) FROM (SELECT severity, count(*) AS n FROM findings GROUP BY severity)) AS severities,
(SELECT string_agg(short || '=' || (api + constants), ',' ORDER BY short) FROM reports WHERE api + constants > 0) AS usage_counts""")
def project_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary row: counts by status, by severity and by permission, score and grade."""
    df = analysis(spark, sf_dir).summary
    said = lambda c: F.array_join(F.array_sort(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ",")
    return df.select(
        F.col("declaredPermissionCount").alias("declared"), F.col("usedPermissionCount").alias("used"), F.col("unusedPermissionCount").alias("unused"), F.col("undeclaredPermissionCount").alias("undeclared"),
        F.col("dangerousPermissionCount").alias("dangerous"), F.col("riskScore").alias("score"), F.col("riskGrade").alias("grade"), said("findingCountBySeverity").alias("severities"), said("usageCountByPermission").alias("usage_counts"),
    )


@query("""SELECT f.module AS name, count(*) FILTER (WHERE t = 'kt')::INTEGER AS kotlin, count(*) FILTER (WHERE t = 'java')::INTEGER AS java, count(*) FILTER (WHERE t = 'dart')::INTEGER AS dart,
coalesce((SELECT count(*) FROM man WHERE man.module = f.module), 0)::INTEGER AS manifests FROM file f WHERE NOT test GROUP BY f.module""")
def project_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by language and manifests per module."""
    df = analyze.module_rows(project.source_rows(source_files(spark, sf_dir)), project.manifest_rows(manifest_files(spark, sf_dir)))
    return df.select("name", F.col("kotlinFileCount").alias("kotlin"), F.col("javaFileCount").alias("java"), F.col("dartFileCount").alias("dart"), F.col("manifestCount").alias("manifests"))


@query("""SELECT 'json' AS name, 'same' AS value
UNION ALL SELECT 'order', string_agg(permission, ',' ORDER BY CASE risk WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END, permission) FROM reports
UNION ALL SELECT 'usages', (SELECT count(*) FROM u WHERE kind IN ('API_CALL', 'PERMISSION_STRING'))::VARCHAR
UNION ALL SELECT 'touched ' || permission, (SELECT count(DISTINCT file) FROM u WHERE u.permission = reports.permission)::VARCHAR FROM reports
UNION ALL SELECT 'findings', count(*)::VARCHAR FROM findings
UNION ALL SELECT 'breaches CRITICAL', count(*) FILTER (WHERE severity = 'CRITICAL')::VARCHAR FROM findings UNION ALL SELECT 'breaches HIGH', count(*) FILTER (WHERE severity <> 'MEDIUM')::VARCHAR FROM findings
UNION ALL SELECT 'breaches MEDIUM', count(*)::VARCHAR FROM findings
UNION ALL SELECT 'console ' || status, count(*)::VARCHAR FROM reports GROUP BY status
UNION ALL SELECT 'console findings', count(*)::VARCHAR FROM findings
UNION ALL SELECT 'page', 'whole'
UNION ALL SELECT 'export', string_agg(permission, ',' ORDER BY permission) FROM reports
UNION ALL SELECT 'files', (SELECT count(*) FROM file WHERE NOT test)::VARCHAR UNION ALL SELECT 'lines', (SELECT sum(CASE t WHEN 'java' THEN 11 WHEN 'dart' THEN 10 ELSE 20 END) FROM file WHERE NOT test)::VARCHAR
UNION ALL SELECT 'payload', 'F 100 ' || (SELECT count(*) FROM findings) || ' /report/r1 org.gen.n10'
UNION ALL SELECT 'stored', '20 r5'
""")
def project_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the sinks say of one project: JSON, page, console, exit code, payload, store, totals (A3, O1, O2, K1-K7, K9).

    The report is written in parts, in all three forms, and read from them; the driver has none of it.
    """
    files = [f(spark, sf_dir).withColumn("project", F.lit("p")) for f in (source_files, manifest_files, build_files)]
    done = analyze.assemble(spark, "/", project.source_rows(files[0]), project.manifest_rows(files[1]), project.build_row(files[2]))
    events, root, c = checkpointed(corpus.ranged(corpus.events(done))), shared_folder(spark, "report"), F.col
    parts = [checkpointed(corpus.write_parts(events, f"{root}/{form}", pretty=form == "pretty", page=form == "page")) for form in ("pretty", "compact", "page")]
    held = checkpointed(corpus.read_parts(*parts))
    said = lambda df, name, value: df.select((F.lit(name) if isinstance(name, str) else name).alias("name"), value.cast("string").alias("value"))
    total = lambda what: F.coalesce(F.sum(F.when(what, c("n"))), F.lit(0))
    sound = lambda what: F.min(F.when(c("what") == what, c("n"))) == 1
    ended = total(c("what") == "ended") == 1
    names = held.where("what = 'permission'")
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "nth", "name"))), lambda x: x["name"]), ",")
    touched = names.select("name").join(held.where("what = 'touchedFiles'").groupBy("name").agg(F.sum("n").alias("n")), "name", "left")
    lines = corpus.console_lines(done)
    status = F.create_map(*[F.lit(x) for status, mark in report.MARKERS.items() for x in (mark, status)])[F.regexp_extract("line", r"^  (\[[^\]]*\]) ", 1)]
    told = F.from_json("payload", "applicationId string, riskGrade string, riskScore int, findingsCount int")
    store = report.Store()
    for n in range(25):
        store.put(f"r{n}", "")
    rows = [
        said(held.agg(F.when(sound("same") & ended, "same").otherwise("other").alias("v")), "json", c("v")), said(names.agg(listed.alias("v")), "order", c("v")), said(held.agg(total(c("what") == "usages").alias("v")), "usages", c("v")),
        said(touched, F.concat(F.lit("touched "), c("name")), F.coalesce("n", F.lit(0))), said(held.agg(total(c("what") == "findings").alias("v")), "findings", c("v")),
        *[said(corpus.breaches(done, x), f"breaches {x}", c("breaches")) for x in ("CRITICAL", "HIGH", "MEDIUM")],
        said(lines.where("section = 1 and nth = 0").groupBy(status.alias("s")).agg(F.count("*").alias("n")), F.concat(F.lit("console "), c("s")), c("n")),
        said(lines.agg(F.count_if((c("section") == 2) & (c("rank") >= 0) & c("line").rlike("^  [A-Z]+ +F-[0-9]+ ")).alias("v")), "console findings", c("v")),
        said(held.agg(F.when(sound("escaped") & ended, "whole").otherwise("cut").alias("v")), "page", c("v")), said(names.agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("v")), "export", c("v")),
        said(held.agg(total((c("what") == "number") & c("name").endswith("FileCount")).alias("v")), "files", c("v")), said(held.agg(total((c("what") == "number") & (c("name") == "analyzedLineCount")).alias("v")), "lines", c("v")),
        said(corpus.payloads(done).select(told.alias("p")).select("p.*"), "payload", F.concat_ws(" ", "riskGrade", "riskScore", "findingsCount", F.lit("/report/r1"), "applicationId")),
        spark.createDataFrame([("stored", f"{len(store.pages)} {next(iter(store.pages))}")], "name string, value string"),
    ]
    return functools.reduce(DataFrame.unionByName, rows)


@query("""SELECT file, line, permission, kind, evidence, confidence, snippet FROM u WHERE k % 10 <> 7 OR k % 20 = 7""")
def incremental_usages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usages after three waves of file events on a stream with state (S4, U9, U1-U8 while files change).

    The first wave has every file.  The second changes every third file, some of them twice, and deletes every tenth; the third
    sends the second again, with old contents of changed files that come late, and brings half of the deleted files back.
    """
    root = shared_folder(spark, "rescan")
    files = lambda later, seq, where: source_files(spark, sf_dir, later).where(where).select("relative_path", F.lit(seq).cast("long").alias("seq"), F.lit(False).alias("deleted"), "content")
    gone = files(0, 5, "key % 10 = 7").withColumn("deleted", F.lit(True)).withColumn("content", F.lit(None).cast("string"))
    second = files(25, 2, "key % 9 = 0").unionByName(files(LATER, 3, "key % 3 = 0")).unionByName(gone)
    third = second.unionByName(files(0, 1, "key % 3 = 0")).unionByName(files(0, 6, "key % 20 = 7 and key % 3 <> 0")).unionByName(files(LATER, 6, "key % 20 = 7 and key % 3 = 0"))
    for n, wave in enumerate((files(0, 1, "true"), second, third)):
        wave.write.parquet(f"{root}/events/wave-{n}")
        rescan.rescan(spark.readStream.schema(rescan.EVENTS).option("recursiveFileLookup", True).parquet(f"{root}/events"), f"{root}/state").awaitTermination()
    return rescan.current(spark, f"{root}/state").select("file", "line", "permission", "kind", "evidence", "confidence", "snippet")


ORACLE_SQL["incremental_usages"] = ORACLE_SQL["incremental_usages"].replace("SELECT c_custkey AS k,", f"SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN c_custkey + {LATER} ELSE c_custkey END AS ck,").replace("file.k % h.many", "file.ck % h.many")


HEIR = """package t
<open>class C<k> : <above>() {
  fun f<k>() {
  }
}
"""


@query()
def transitive_supertypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All super types of each type, over chains of types and a cycle, and the entry points by them (J9, G3 with the switch)."""
    k = F.col("c_custkey")
    above = F.when(k == 1, "C2(), Activity").when(k == 2, "C1(), Face").when(k < 1, "Service").otherwise(F.concat(F.lit("C"), F.floor(k / 3).cast("string")))
    path = filled("m/src/C<k>.kt", k=k)
    files = dealt(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey"), "c_custkey").select(path.alias("path"), path.alias("relative_path"), filled(HEIR, k=k, above=above, open=F.when(k % 2 == 0, "open ").otherwise("")).alias("content"))
    decls = checkpointed(declarations.declarations(project.source_rows(files)))
    supers = graph.all_supertypes(decls).groupBy("simple_name").agg(F.array_join(F.sort_array(F.collect_list("super")), ",").alias("supers"), F.max("level").alias("deepest"))
    found = graph.entry_kinds(decls, transitive=True).where("kind = 'FUNCTION'").select(F.substring_index("container", ".", -1).alias("simple_name"), "entry_kind")
    return supers.join(found, "simple_name", "full_outer")


ORACLE_SQL["transitive_supertypes"] = """WITH RECURSIVE edge(a, b) AS (
  SELECT 'C' || c_custkey, 'C' || (c_custkey // 3) FROM customer WHERE c_custkey >= 3 UNION ALL SELECT 'C' || c_custkey, 'Service' FROM customer WHERE c_custkey < 1
  UNION ALL SELECT 'C1', unnest(['C2', 'Activity']) FROM customer WHERE c_custkey = 1 UNION ALL SELECT 'C2', unnest(['C1', 'Face']) FROM customer WHERE c_custkey = 2),
walk(a, b, level) AS (SELECT a, b, 1 FROM edge UNION SELECT w.a, e.b, w.level + 1 FROM walk w JOIN edge e ON e.a = w.b WHERE w.level < 25),
near AS (SELECT a, b, min(level) AS level FROM walk WHERE a <> b GROUP BY a, b)
SELECT 'C' || c_custkey AS simple_name, (SELECT string_agg(b, ',' ORDER BY b) FROM near WHERE a = 'C' || c_custkey) AS supers, (SELECT max(level) FROM near WHERE a = 'C' || c_custkey)::INTEGER AS deepest,
CASE WHEN EXISTS (SELECT 1 FROM near WHERE a = 'C' || c_custkey AND b = 'Activity') THEN 'Activity' WHEN EXISTS (SELECT 1 FROM near WHERE a = 'C' || c_custkey AND b = 'Service') THEN 'Service' END AS entry_kind FROM customer"""


def _second(facts: str) -> str:
    """The facts, with the usages of the changed files as ``later``: every third file another content, every fourth of the others a line more, every tenth gone."""
    usages = facts[facts.index("u AS (\n") : facts.index("man AS (")]
    later = usages.replace("u AS (", "later AS (", 1).replace("file.k % h.many", "file.ck % h.many").replace("p.line, CASE", "p.line + CASE WHEN file.k % 3 <> 0 AND file.k % 4 = 1 THEN 1 ELSE 0 END AS line, CASE", 1)
    changed = f"SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN c_custkey + {LATER} ELSE c_custkey END AS ck,"
    return facts.replace("SELECT c_custkey AS k,", changed).replace("man AS (", later + "man AS (", 1)


@query()
def compared_usages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usages of a project against those after changes: the same, moved, new and gone (baseline, multiset intersect and except)."""
    files = lambda later, where: source_files(spark, sf_dir, later).where(where)
    moved = files(0, "key % 3 <> 0 and key % 4 = 1 and key % 10 <> 7").withColumn("content", F.concat(F.lit("// moved\n"), "content"))
    after = files(LATER, "key % 3 = 0 and key % 10 <> 7").unionByName(moved).unionByName(files(0, "key % 3 <> 0 and key % 4 <> 1 and key % 10 <> 7"))
    old, new = (signals.usages(signals.candidate_lines(project.source_rows(x))) for x in (files(0, "true"), after))
    return compare.compared(old, new, ["file", "permission", "kind", "evidence", "snippet"])


ORACLE_SQL["compared_usages"] = f"""WITH {_second(FACTS)},
b AS (SELECT * FROM later WHERE k % 10 <> 7)
SELECT coalesce(u.file, b.file) AS file, coalesce(u.permission, b.permission) AS permission, coalesce(u.kind, b.kind) AS kind, coalesce(u.evidence, b.evidence) AS evidence, coalesce(u.snippet, b.snippet) AS snippet,
CASE WHEN u.line = b.line THEN 'same' WHEN u.line IS NULL THEN 'new' WHEN b.line IS NULL THEN 'gone' ELSE 'moved' END AS state, u.line::BIGINT AS old_place, b.line::BIGINT AS new_place
FROM u FULL JOIN b ON u.file = b.file AND u.permission = b.permission AND u.kind = b.kind AND u.evidence = b.evidence AND u.snippet = b.snippet"""


@query()
def usage_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usages and files by nation, module, group of permissions and confidence, at five levels in one pass (A2, A4, A5 as grouping sets)."""
    sources = project.source_rows(source_files(spark, sf_dir).withColumnRenamed("nation", "project"))
    found = catalog.described(signals.usages(signals.candidate_lines(sources)), "permission", catalog.specs(spark))
    found = found.withColumn("group", F.nullif("group", F.lit("Other")))  # a group that is not known is null
    return compare.rolled_up(found, [["project", "module"], ["project", "group"], ["group", "confidence"], ["group"], []])


ORACLE_SQL["usage_rollups"] = f"""WITH {FACTS},
r AS (SELECT 'n' || regexp_extract(file, '[0-9]+') AS project, split_part(file, '/', 1) AS module, nullif(coalesce(grp, 'Other'), 'Other') AS grp, confidence, file FROM u LEFT JOIN spec ON spec.name = u.permission)
SELECT 'project,module' AS level, project, module, NULL AS "group", NULL AS confidence, count(*) AS n, count(DISTINCT file) AS files FROM r GROUP BY project, module
UNION ALL SELECT 'project,group', project, NULL, grp, NULL, count(*), count(DISTINCT file) FROM r GROUP BY project, grp UNION ALL SELECT 'group,confidence', NULL, NULL, grp, confidence, count(*), count(DISTINCT file) FROM r GROUP BY grp, confidence
UNION ALL SELECT 'group', NULL, NULL, grp, NULL, count(*), count(DISTINCT file) FROM r GROUP BY grp UNION ALL SELECT '', NULL, NULL, NULL, NULL, count(*), count(DISTINCT file) FROM r"""


@query()
def usage_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and the middle key of each permission's usages from sketches of two runs, stored by module and merged, beside the exact numbers (A1, A9 approximately)."""
    found = signals.usages(signals.candidate_lines(project.source_rows(source_files(spark, sf_dir))))
    found = checkpointed(found.select("permission", F.split_part("file", F.lit("/"), F.lit(1)).alias("module"), "file", F.regexp_extract("file", "[Cc]([0-9]+)", 1).cast("int").alias("key")))
    runs = [checkpointed(sketches.sketched(found.where(f"key % 2 = {n}"), ["permission", "module"], distinct="file", value="key")) for n in range(2)]
    told = sketches.estimates(sketches.merged(runs[0].unionByName(runs[1]), ["permission"]), ["permission"], (0.5,))
    exact = found.join(told, "permission").groupBy("permission").agg(
        F.count("*").alias("usages"), F.countDistinct("file").alias("files"), F.max("n").alias("n"), F.max("n_distinct").alias("n_distinct"),
        (F.count_if(F.col("key") <= F.col("quantiles")[0]) / F.count("*")).alias("below"), (F.count_if(F.col("key") < F.col("quantiles")[0]) / F.count("*")).alias("under"))
    near = F.abs(F.col("n_distinct") - F.col("files")) <= 0.07 * F.col("files")
    return exact.select("permission", F.col("n").alias("usages"), "files", near.alias("files_near"), ((F.col("under") <= 0.55) & (F.col("below") >= 0.45)).alias("middle_near"))


ORACLE_SQL["usage_sketches"] = f"WITH {FACTS} SELECT permission, count(*)::BIGINT AS usages, count(DISTINCT file)::BIGINT AS files, true AS files_near, true AS middle_near FROM u GROUP BY permission"


def by_nation(spark: SparkSession, sf_dir: str) -> analyze.Analysis:
    """The analysis of a project per nation, all in one."""
    files = [f(spark, sf_dir).withColumnRenamed("nation", "project") for f in (source_files, manifest_files, build_files)]
    return analyze.assemble(spark, "/p", project.source_rows(files[0]), project.manifest_rows(files[1]), project.build_row(files[2]))


def _by_project(facts: str) -> str:
    """The facts of reports and findings for each nation by itself."""
    base, rest = facts.split("counted AS (", 1)
    rest = "counted AS (" + rest.split("findings AS (", 1)[0]
    named = "'n' || regexp_extract(file, '[0-9]+') AS project"
    for old, new in (
        ("SELECT permission, count", "SELECT project, permission, count"), ("FROM u GROUP BY permission", "FROM pu GROUP BY project, permission"), ("FROM declared GROUP BY permission", "FROM pd GROUP BY project, permission"),
        ("SELECT permission, asked", "SELECT project, permission, asked"), ("USING (permission)", "USING (project, permission)"),
        ("EXISTS (SELECT 1 FROM asked WHERE permission = '", "project IN (SELECT a.project FROM asked a WHERE a.permission = '"), ("SELECT 0 AS block", "SELECT project, 0 AS block"), ("UNION ALL SELECT ", "UNION ALL SELECT project, "),
        ("FROM part_", "FROM pp"), ("FROM man ", "FROM pm "), ("'MISSING_AD_ID', 'MEDIUM', NULL, 0", "'MISSING_AD_ID', 'MEDIUM', NULL, 0 FROM nations"),
        ("AND api > 0 AND NOT declared),", """AND api > 0 AND NOT declared
  UNION ALL SELECT project, 9, '', 13, 'NO_MANIFEST', 'HIGH', NULL, 0 FROM nations WHERE project NOT IN (SELECT project FROM pm)
  UNION ALL SELECT project, 10, '', 14, 'NO_SOURCES', 'HIGH', NULL, 0 FROM nations WHERE project NOT IN (SELECT 'n' || n FROM file WHERE NOT test)),"""),
    ):
        assert old in rest, old
        rest = rest.replace(old, new)
    return base + f"""pu AS (SELECT *, {named} FROM u), pd AS (SELECT *, {named} FROM declared), pm AS (SELECT *, {named} FROM man), pp AS (SELECT *, {named} FROM part_), nations AS (SELECT 'n' || n_nationkey AS project, n_nationkey AS n FROM nation),
{rest}numbered AS (SELECT *, printf('F-%03d', row_number() OVER (PARTITION BY project ORDER BY block, ord, nth)) AS id FROM found)"""


def corpus_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON report per nation, written by the executors, and what the files hold (K1, K2, A1-A8, O1-O3, W2 for many projects)."""
    written = corpus.write_reports(by_nation(spark, sf_dir), shared_folder(spark, "reports"), pretty=True)
    paths = checkpointed(written)
    usage = "array<struct<file:string,line:int>>"
    schema = f"""project struct<name:string,applicationId:string,targetSdk:int,modules:array<struct<name:string>>,manifestFiles:array<string>,dependencies:array<string>,kotlinFileCount:int,javaFileCount:int,dartFileCount:int,analyzedLineCount:long>,
summary struct<declaredPermissionCount:int,usedPermissionCount:int,unusedPermissionCount:int,undeclaredPermissionCount:int,dangerousPermissionCount:int,riskScore:int,riskGrade:string,findingCountBySeverity:map<string,int>>,
permissions array<struct<permission:string,status:string,declarations:array<struct<file:string>>,usages:{usage},runtimeRequests:{usage},permissionChecks:{usage},touchedFiles:array<string>>>,
findings array<struct<id:string,rule:string,severity:string>>, components array<struct<name:string>>"""
    read = spark.read.schema(schema).option("multiLine", True).json(os.path.dirname(paths.select("path").first()[0]))
    c, total = F.col, lambda name: F.aggregate("permissions", F.lit(0), lambda n, p: n + F.size(p[name]))
    said = F.array_join(F.transform(F.array_sort(F.map_entries("summary.findingCountBySeverity")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return read.select(
        c("project.name").alias("project"), c("project.applicationId").alias("application_id"), c("project.targetSdk").alias("target_sdk"), F.size("project.modules").alias("modules"), F.array_join("project.manifestFiles", ",").alias("manifests"),
        F.size("project.dependencies").alias("dependencies"), *[c(f"project.{x}FileCount").alias(x) for x in ("kotlin", "java", "dart")], c("project.analyzedLineCount").alias("lines"),
        *[c(f"summary.{x}PermissionCount").alias(x) for x in ("declared", "used", "unused", "undeclared", "dangerous")], c("summary.riskScore").alias("score"), c("summary.riskGrade").alias("grade"), said.alias("severities"),
        F.array_join(F.transform("permissions", lambda p: F.concat_ws("=", p["permission"], p["status"])), ",").alias("permissions"), F.array_join(F.transform("findings", lambda f: F.concat_ws(" ", f["id"], f["rule"])), ",").alias("findings"),
        total("declarations").alias("declarations"), total("usages").alias("usages"), total("runtimeRequests").alias("requests"), total("permissionChecks").alias("checks"), total("touchedFiles").alias("touched"), F.size("components").alias("components"),
    )


QUERIES["corpus_reports"] = corpus_reports
ORACLE_SQL["corpus_reports"] = f"""WITH {_by_project(FACTS)},
own AS (SELECT * FROM file WHERE NOT test),
weighed AS (SELECT project, least(100, sum(CASE severity WHEN 'CRITICAL' THEN 40 WHEN 'HIGH' THEN 20 ELSE 8 END)) AS score FROM found GROUP BY project)
SELECT project, CASE WHEN n >= 3 THEN 'org.gen.n' || n END AS application_id, (n + 33)::INTEGER AS target_sdk, (SELECT count(DISTINCT module) FROM own WHERE own.n = x.n)::INTEGER AS modules,
coalesce((SELECT string_agg(file, ',' ORDER BY file) FROM pm WHERE pm.project = x.project), '') AS manifests, 2 AS dependencies,
(SELECT count(*) FILTER (WHERE t = 'kt') FROM own WHERE own.n = x.n)::INTEGER AS kotlin, (SELECT count(*) FILTER (WHERE t = 'java') FROM own WHERE own.n = x.n)::INTEGER AS java, (SELECT count(*) FILTER (WHERE t = 'dart') FROM own WHERE own.n = x.n)::INTEGER AS dart,
coalesce((SELECT sum(CASE t WHEN 'java' THEN 11 WHEN 'dart' THEN 10 ELSE 20 END) FROM own WHERE own.n = x.n), 0)::BIGINT AS lines,
(SELECT count(*) FILTER (WHERE declared) FROM reports r WHERE r.project = x.project)::INTEGER AS declared, (SELECT count(*) FILTER (WHERE status = 'USED') FROM reports r WHERE r.project = x.project)::INTEGER AS used,
(SELECT count(*) FILTER (WHERE status = 'DECLARED_UNUSED') FROM reports r WHERE r.project = x.project)::INTEGER AS unused, (SELECT count(*) FILTER (WHERE status = 'UNDECLARED_USAGE') FROM reports r WHERE r.project = x.project)::INTEGER AS undeclared,
(SELECT count(*) FILTER (WHERE declared AND protection = 'DANGEROUS') FROM reports r WHERE r.project = x.project)::INTEGER AS dangerous,
coalesce(score, 0)::INTEGER AS score, CASE WHEN coalesce(score, 0) < 10 THEN 'A' WHEN score < 25 THEN 'B' WHEN score < 45 THEN 'C' WHEN score < 70 THEN 'D' ELSE 'F' END AS grade,
coalesce((SELECT string_agg(severity || '=' || n, ',' ORDER BY severity) FROM (SELECT severity, count(*) AS n FROM found f WHERE f.project = x.project GROUP BY severity)), '') AS severities,
coalesce((SELECT string_agg(permission || '=' || status, ',' ORDER BY CASE risk WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END, permission) FROM reports r WHERE r.project = x.project), '') AS permissions,
coalesce((SELECT string_agg(id || ' ' || rule, ',' ORDER BY CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 ELSE 2 END, id) FROM numbered f WHERE f.project = x.project), '') AS findings,
(SELECT count(*) FROM pd WHERE pd.project = x.project)::INTEGER AS declarations, (SELECT count(*) FROM pu WHERE pu.project = x.project AND kind IN ('API_CALL', 'PERMISSION_STRING'))::INTEGER AS usages,
(SELECT count(*) FROM pu WHERE pu.project = x.project AND kind = 'REQUEST')::INTEGER AS requests, (SELECT count(*) FROM pu WHERE pu.project = x.project AND kind = 'CHECK')::INTEGER AS checks,
(SELECT count(DISTINCT permission || ' ' || file) FROM pu WHERE pu.project = x.project)::INTEGER AS touched, (SELECT count(*) FROM pp WHERE pp.project = x.project)::INTEGER AS components
FROM nations x LEFT JOIN weighed USING (project)"""


def corpus_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the service, the console and an exit code say of each nation's project (K4, K5, K7, A3 for many projects)."""
    done = by_nation(spark, sf_dir)
    lines = corpus.console_lines(done)
    said = lines.where("section = 1 and nth = 0").groupBy("project").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "name", "line"))), lambda x: F.regexp_replace(x["line"], " paths=.*", "")), "\n").alias("map"))
    counts = lines.groupBy("project").agg(F.count_if(F.col("section") == 0).cast("int").alias("head"), F.count_if((F.col("section") == 2) & (F.col("rank") >= 0)).cast("int").alias("found"), F.max(F.when(F.col("line").startswith("Sources"), F.col("line"))).alias("sources"))
    out = corpus.payloads(done).select("project", F.from_json("payload", "applicationId string, riskGrade string, riskScore int, undeclaredPermissionCount int, findingsCount int").alias("p")).select("project", "p.*")
    for level in ("CRITICAL", "HIGH", "MEDIUM"):
        out = out.join(corpus.breaches(done, level).select("project", F.col("breaches").alias(level.lower())), "project")
    return out.join(counts, "project", "left").join(said, "project", "left").withColumn("map", F.coalesce("map", F.lit("")))


QUERIES["corpus_answers"] = corpus_answers
ORACLE_SQL["corpus_answers"] = f"""WITH {_by_project(FACTS)},
own AS (SELECT * FROM file WHERE NOT test),
marks(status, mark) AS (VALUES ('USED', '[DECLARED+USED]'), ('DECLARED_UNUSED', '[DECLARED+NEVER-USED]'), ('UNDECLARED_USAGE', '[MISSING-FROM-MANIFEST]'), ('REQUESTED_ONLY', '[REQUEST-ONLY]'), ('WEAK_SIGNAL', '[WEAK]'), ('ALTERNATIVE_COVERED', '[ALT-COVERED]')),
weighed AS (SELECT project, count(*) AS n_found, least(100, sum(CASE severity WHEN 'CRITICAL' THEN 40 WHEN 'HIGH' THEN 20 ELSE 8 END)) AS score, count(*) FILTER (WHERE severity = 'CRITICAL') AS critical, count(*) FILTER (WHERE severity IN ('CRITICAL', 'HIGH')) AS high FROM found GROUP BY project)
SELECT project, CASE WHEN n >= 3 THEN 'org.gen.n' || n ELSE '' END AS "applicationId", CASE WHEN coalesce(score, 0) < 10 THEN 'A' WHEN score < 25 THEN 'B' WHEN score < 45 THEN 'C' WHEN score < 70 THEN 'D' ELSE 'F' END AS "riskGrade", coalesce(score, 0)::INTEGER AS "riskScore",
(SELECT count(*) FILTER (WHERE status = 'UNDECLARED_USAGE') FROM reports r WHERE r.project = x.project)::INTEGER AS "undeclaredPermissionCount", coalesce(n_found, 0)::INTEGER AS "findingsCount",
coalesce(critical, 0)::BIGINT AS critical, coalesce(high, 0)::BIGINT AS high, coalesce(n_found, 0)::BIGINT AS medium, 13::INTEGER AS head, greatest(1, coalesce(n_found, 0))::INTEGER AS found,
'Sources      : ' || (SELECT count(*) FILTER (WHERE t = 'kt') FROM own WHERE own.n = x.n) || ' Kotlin, ' || (SELECT count(*) FILTER (WHERE t = 'java') FROM own WHERE own.n = x.n) || ' Java, ' || (SELECT count(*) FILTER (WHERE t = 'dart') FROM own WHERE own.n = x.n) || ' Dart' AS sources,
coalesce((SELECT string_agg('  ' || mark || ' ' || short || ' (' || protection || ') risk=' || risk || ' usages=' || (api + constants), chr(10) ORDER BY CASE risk WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END, permission)
  FROM reports r JOIN marks USING (status) WHERE r.project = x.project), '') AS map
FROM nations x LEFT JOIN weighed USING (project)"""


#: Files below each nation's folder: kept as source, as manifest, as script, or not scanned at all.
TREE = [
    ("src/main/java/A.kt", "class A {\n}\n"), ("src/test/java/T.java", "class T {\r\n}\r\n"), ("empty.dart", ""), ("x.gradle.kts", "class X\n"), ("build/Gen.kt", "class G\n"), ("generated/H.java", "class H\n"),
    (".cache/D.dart", "class D\n"), ("generated/AndroidManifest.xml", "<manifest/>"), ("build/AndroidManifest.xml", "<manifest/>"), ("AndroidManifest.xml", "<manifest/>"), ("build.gradle", "minSdk 21\n"), ("[odd] {name}.kt", "fun odd() {}"),
]


def _write_tree(root: str):
    """Writes the files of TREE below a folder for each key of its batches."""
    uri = root if "://" in root else "file://" + root.removeprefix("file:")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = pafs.FileSystem.from_uri(uri)
        for batch in batches:
            for n in batch.column(0).to_pylist():
                for name, content in TREE:
                    path = f"{top}/n{n}/{name}"
                    fs.create_dir(os.path.dirname(path), recursive=True)
                    with fs.open_output_stream(path) as out:
                        out.write(content.encode())
            yield batch

    return run


@query("""SELECT 'source' AS scan, 'n' || n_nationkey || x.path AS path, 'n' || n_nationkey AS module, x.lines AS n FROM nation, (VALUES ('/src/main/java/A.kt', 2), ('/src/test/java/T.java', 2), ('/[odd] {name}.kt', 1)) x(path, lines)
UNION ALL SELECT 'manifest', 'n' || n_nationkey || x.path, 'n' || n_nationkey, 0 FROM nation, (VALUES ('/generated/AndroidManifest.xml'), ('/AndroidManifest.xml')) x(path)
UNION ALL SELECT 'script', 'first', 'root', 21""")
def project_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a tree on disk, a folder per nation, folders that are not wanted never entered."""
    root = shared_folder(spark, "tree")
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("n"))
    nations.mapInArrow(_write_tree(root), "n long").write.format("noop").mode("overwrite").save()
    sources = project.sources(spark, root, include_tests=True).select(F.lit("source").alias("scan"), F.col("relative_path").alias("path"), "module", F.size("raw").alias("n"))
    manifests = project.manifests(spark, root).select(F.lit("manifest").alias("scan"), F.col("file").alias("path"), "module", F.lit(0).alias("n"))
    script = project.build_config(spark, root).select(F.lit("script").alias("scan"), F.lit("first").alias("path"), F.lit("root").alias("module"), F.col("min_sdk").alias("n"))
    return sources.unionByName(manifests).unionByName(script)
