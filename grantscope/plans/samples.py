"""Sample lines: for each signal of the catalog one line that it hits and one that it just misses.

Each customer is a file with one pair; what an analysis must find there is known from the
customer's key and the lists below alone, whatever the patterns say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import catalog
from ..functions.shared import dealt
from ..operators import signals
from ..sources import project

#: A line that the catalog's signal of this number hits, and one that no signal hits.
SAMPLES = [
    ("val f = ProcessCameraProvider . getInstance(ctx)", "val f = ProcessCameraProvider.of(ctx)"),
    ("manager.openCamera (id)", "manager.reopenCamera(id)"),
    ("val c = Camera . open (0)", "val c = FrontCamera.open(0)"),
    ("recorder.setVideoSource (1)", "recorder.setVideoSource = 1"),
    ("val i = Intent(ACTION_VIDEO_CAPTURE)", "val i = Intent(ACTION_VIDEO)"),
    ("val b = ImageCapture .Builder()", "val b = MyImageCapture.Builder()"),
    ("val p = Manifest.permission.CAMERA", "val p = Manifest.permission_CAMERA"),
    ("val r = AudioRecord (1, 2)", "val r = AudioRecorder(1, 2)"),
    ("recorder.setAudioSource (1)", "recorder.audioSource(1)"),
    ("val i = RecognizerIntent .EXTRA_PROMPT", "val i = RecognizerIntents.EXTRA"),
    ("val c = AudioPlaybackCaptureConfiguration(p)", "val c = AudioPlaybackCaptureConfig(p)"),
    ("val v = Visualizer (0)", "val v = MyVisualizer(0)"),
    ("val c: FusedLocationProviderClient? = null", "val c: FusedLocationProvider? = null"),
    ("m.getLastKnownLocation (p)", "m.getLastKnownLocationOf(p)"),
    ("val r = LocationRequest .create()", "val r = LocationRequestor.create()"),
    ("m.addNmeaListener (l)", "m.addNmeaListeners(l)"),
    ("val i = t.getAllCellInfo ()", "val i = t.allCellInfo()"),
    ("val c = getFusedLocationProviderClient(a)", "val c = getFusedLocationClient(a)"),
    ("val p = PRIORITY_LOW_POWER", "val p = PRIORITY_LOW"),
    ("val p = NETWORK_PROVIDER", "val p = NETWORK"),
    ("val r = wifi.getScanResults ()", "val r = wifi.scanResults()"),
    ("client.addGeofences (r, p)", "client.addGeofence(r, p)"),
    ("val t = FOREGROUND_SERVICE_TYPE_LOCATION", "val t = FOREGROUND_SERVICE_TYPE_CAMERA"),
    ("m.requestLocationUpdates (p, 0)", "m.requestLocationUpdate(p, 0)"),
    ("val u = ContactsContract .Contacts.CONTENT", "val u = ContactsContracts.CONTENT"),
    ("val u = parse(\"content://com.android.contacts/data\")", "val u = parse(\"content://com.android.contract\")"),
    ("resolver.applyBatch (a, o)", "resolver.applyBatches(a, o)"),
    ("val m = AccountManager .get(c)", "val m = AccountManagers.get(c)"),
    ("val u = CalendarContract .Events.TITLE", "val u = CalendarContracts.TITLE"),
    ("val u = Events . CONTENT_URI", "val u = Events.CONTENT"),
    ("val u = Telephony . Sms.Inbox.URI", "val u = Telephony.Mms.Inbox.URI"),
    ("m.sendTextMessage (n, t)", "m.sendText(n, t)"),
    ("val a = \"SMS_RECEIVED\"", "val a = \"SMS_SENT\""),
    ("val i = Intent(ACTION_CALL)", "val i = Intent(ACTION_CALLING)"),
    ("val d = t.getDeviceId ()", "val d = t.deviceId()"),
    ("val l = PhoneStateListener()", "val l = PhoneState()"),
    ("val c = CallLog .Calls.DATE", "val c = CallLogs.Calls.DATE"),
    ("val u = MediaStore . Files.getUri()", "val u = MediaStore.Downloads.getUri()"),
    ("val d = Environment . DIRECTORY_MUSIC", "val d = Environment.MUSIC"),
    ("val s = FileInputStream (f)", "val s = FileInput(f)"),
    ("resolver.insert ( MediaStore.of(x), v)", "resolver.insertAll(MediaStore.of(x), v)"),
    ("val d = getExternalStoragePublicDirectory (t)", "val d = getExternalStoragePublic(t)"),
    ("val s = FileOutputStream (f)", "val s = FileOutput(f)"),
    ("if (isExternalStorageManager ()) go", "if (isExternalStorage()) go"),
    ("val u = MediaStore . Images.Thumbs", "val u = MediaStore.Pictures.Thumbs"),
    ("val u = MediaStore . Video.Media", "val u = MediaStore.Movies.Media"),
    ("val u = MediaStore . Audio.Albums", "val u = MediaStore.Sounds.Albums"),
    ("val c = PickVisualMedia()", "val c = PickMedia()"),
    ("NotificationManagerCompat.from(c)", "NotificationManager.from(c)"),
    ("val b = NotificationCompat . Builder(c)", "val b = NotificationCompat.Style(c)"),
    ("manager.notify (1, n)", "manager.notifyAll(1, n)"),
    ("scanner.startScan (cb)", "scanner.startScanning(cb)"),
    ("val d = adapter.bondedDevices", "val d = adapter.boundDevices"),
    ("val a = BluetoothLeAdvertiser", "val a = BluetoothAdvertiser"),
    ("val m = WifiRttManager", "val m = WifiManaged"),
    ("val t = TYPE_HEART_BEAT", "val t = TYPE_HEART"),
    ("val t = TYPE_STEP_DETECTOR", "val t = TYPE_STEP"),
    ("val c = ActivityRecognition .getClient(a)", "val c = ActivityRecognized.getClient(a)"),
    ("val c = OkHttpClient()", "val c = OkHttp()"),
    ("val r = Retrofit . Builder()", "val r = Retrofit.create()"),
    ("val c = HttpClient (engine)", "val c = MyHttpClient(engine)"),
    ("val c: HttpURLConnection? = null", "val c: HttpConnection? = null"),
    ("val d = FirebaseDatabase.of()", "val d = FirebaseApp.of()"),
    ("view.loadUrl (u)", "view.loadData(u)"),
    ("AsyncImage (model)", "AsyncImages(model)"),
    ("val i = m.activeNetworkInfo", "val i = m.networkInfo"),
    ("val i = wifi.connectionInfo", "val i = wifi.connection"),
    ("wifi.setWifiEnabled (true)", "wifi.wifiEnabled(true)"),
    ("val v: Vibrator? = null", "val v: Vibrators? = null"),
    ("val l = PowerManager . WakeLock()", "val l = PowerManager.Lock()"),
    ("class M : FirebaseMessagingService()", "class M : FirebaseMessaging()"),
    ("startForegroundService (i)", "startForegroundWork(i)"),
    ("val t = FOREGROUND_SERVICE_TYPE_LOCATION or 1", "val t = FOREGROUND_SERVICE_TYPE or 1"),
    ("val a = BOOT_COMPLETED", "val a = BOOT_DONE"),
    ("alarms.setExact (t)", "alarms.setInexact(t)"),
    ("alarms.setAlarmClock (t)", "alarms.setAlarm(t)"),
    ("val l = pm.queryIntentActivities (i, 0)", "val l = pm.queryIntent(i, 0)"),
    ("if (canDrawOverlays (c)) go", "if (canDraw(c)) go"),
    ("if (pm.canRequestPackageInstalls ()) go", "if (pm.canRequestInstalls()) go"),
    ("val p = BiometricPrompt(a)", "val p = Biometric(a)"),
    ("val m: NdefMessage? = null", "val m: NdefRecord? = null"),
    ("audio.setSpeakerphoneOn (true)", "audio.speakerphoneOn(true)"),
    ("client.acknowledgePurchase(p)", "client.acknowledge(p)"),
    ("val a = MobileAds .initialize(c)", "val a = MobileAd.initialize(c)"),
]
#: Other signals that the hit line of a sample hits as well.
BESIDES = {12: [17], 17: [12], 22: [72], 23: [13], 44: [37], 45: [37], 46: [37], 72: [22], 75: [74]}
#: The sample whose line also names its permission by the constant.
NAMED = 6

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _values(rows: list[tuple]) -> str:
    quoted = lambda x: str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(quoted(x) for x in row) + ")" for row in rows)


def _chosen(values: list[str], at: Column) -> Column:
    return F.array(*[F.lit(x) for x in values])[F.pmod(at, F.lit(len(values))).cast("int")]


def _files(spark: SparkSession, sf_dir: str, path: Column, content: Column) -> DataFrame:
    df = dealt(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey"), "c_custkey").select(path.alias("relative_path"), content.alias("content"))
    return project.source_rows(df.withColumn("path", F.col("relative_path")))


def catalog_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every signal of the catalog on a line that it hits, and on one that it just misses."""
    k = F.col("c_custkey")
    pair = [_chosen([x[n] for x in SAMPLES], k) for n in (0, 1)]
    sources = _files(spark, sf_dir, F.format_string("m/src/C%d.kt", k), F.concat(pair[1], F.lit("\n"), pair[0], F.lit("\n"), pair[1], F.lit("\n")))
    return signals.usages(signals.candidate_lines(sources)).select("file", "line", "permission", "kind", "evidence", "confidence", "snippet")


def _hits() -> list[tuple]:
    every = [(n, m) for n in range(len(SAMPLES)) for m in [n, *BESIDES.get(n, [])]]
    rows = [(n, SAMPLES[n][0], s.permission, "API_CALL", s.label, s.confidence) for n, m in every for s in [catalog.SIGNALS[m]]]
    return [*rows, (NAMED, SAMPLES[NAMED][0], "android.permission.CAMERA", "PERMISSION_STRING", "Permission constant reference", "HIGH")]


QUERIES["catalog_signals"] = catalog_signals
ORACLE_SQL["catalog_signals"] = f"""WITH hit(n, snippet, permission, kind, evidence, confidence) AS (VALUES {_values(_hits())})
SELECT 'm/src/C' || c_custkey || '.kt' AS file, 2::INTEGER AS line, permission, kind, evidence, confidence, snippet FROM customer JOIN hit ON hit.n = c_custkey % {len(SAMPLES)}"""


def catalog_dart_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every name of the Dart plugin asked for, checked and only named, beside a name that is none."""
    k, names = F.col("c_custkey"), list(catalog.DART_NAMES)
    name = _chosen(names, k)
    lines = [F.concat(F.lit("var a = await Permission."), name, F.lit(".request();")), F.concat(F.lit("var b = Permission."), name, F.lit(".status;")), F.concat(F.lit("var c = Permission."), name, F.lit("; var d = Permission."), name, F.lit(";")), F.concat(F.lit("var e = Permissions."), name, F.lit("; var f = Permission."), name, F.lit("X;"))]
    sources = _files(spark, sf_dir, F.format_string("lib/c%d.dart", k), F.array_join(F.array(*lines), "\n"))
    return signals.usages(signals.candidate_lines(sources)).select("file", "line", "permission", "symbol", "kind", "evidence", "confidence")


QUERIES["catalog_dart_names"] = catalog_dart_names
ORACLE_SQL["catalog_dart_names"] = f"""WITH name(n, name, permission) AS (VALUES {_values([(n, name, f"android.permission.{p}") for n, (name, own) in enumerate(catalog.DART_NAMES.items()) for p in own])}),
form(line, kind, evidence) AS (VALUES (1, 'API_CALL', NULL), (1, 'REQUEST', 'permission_handler request'), (2, 'API_CALL', NULL), (2, 'CHECK', 'permission_handler status check'), (3, 'API_CALL', NULL))
SELECT 'lib/c' || c_custkey || '.dart' AS file, line::INTEGER AS line, permission, 'Permission.' || name AS symbol, kind, coalesce(evidence, 'permission_handler: Permission.' || name) AS evidence, 'HIGH' AS confidence
FROM customer JOIN name ON name.n = c_custkey % {len(catalog.DART_NAMES)} CROSS JOIN form"""


def user_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as lines, against a catalog read from a table: a pattern for each brand and size that the table has (S7 as a user's table, J1, U1)."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    made = part.select(F.col("p_brand").alias("permission"), F.format_string("size %d", "p_size").alias("label"), F.format_string(r"brand=%s\s+size=%d\b", "p_brand", "p_size").alias("pattern"), F.when(F.col("p_size") > 25, "HIGH").otherwise("LOW").alias("confidence")).distinct()
    known = catalog.from_table(made)
    line = F.format_string("key=%d brand=%s  size=%d type=%s", "p_partkey", "p_brand", "p_size", "p_type")
    files = dealt(part.select("p_partkey", "p_brand", "p_size", "p_type"), "p_partkey").select(F.format_string("m/src/P%d.kt", "p_partkey").alias("relative_path"), F.concat(F.lit("\n"), line, F.lit("0\n")).alias("content")).withColumn("path", F.col("relative_path"))
    return signals.usages(signals.candidate_lines(project.source_rows(files), known), known).select("file", "line", "permission", "evidence", "confidence")


QUERIES["user_catalog"] = user_catalog
ORACLE_SQL["user_catalog"] = "SELECT 'm/src/P' || p_partkey || '.kt' AS file, 2::INTEGER AS line, p_brand AS permission, 'size ' || p_size AS evidence, CASE WHEN p_size > 25 THEN 'HIGH' ELSE 'LOW' END AS confidence FROM part"
