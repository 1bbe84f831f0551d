"""Static catalog of permissions and of the code patterns that point to them.

All tables here are fixed values that results depend on.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DANGEROUS, NORMAL, SPECIAL, SIGNATURE = "DANGEROUS", "NORMAL", "SPECIAL", "SIGNATURE"
HIGH, MEDIUM, LOW = "HIGH", "MEDIUM", "LOW"


@dataclass(frozen=True)
class Signal:
    """A pattern in a code line that points to a permission."""

    permission: str
    label: str
    pattern: str
    confidence: str = HIGH
    import_needles: tuple[str, ...] = ()


#: Permission, protection, group, description, policy note, and its signals (label, pattern, confidence).
SPECS = [
    ("android.permission.CAMERA", DANGEROUS, "Camera", "Access to the device camera for photo and video capture.", "Play Console requires a camera usage justification and a privacy policy.", [
        ("CameraX ProcessCameraProvider", r"ProcessCameraProvider\s*\.\s*getInstance|bindToLifecycle\s*\(", HIGH),
        ("Camera2 openCamera", r"\bopenCamera\s*\(|\bCameraManager\b", HIGH),
        ("Deprecated Camera API", r"\bCamera\s*\.\s*open\s*\(", HIGH),
        ("MediaRecorder video source", r"setVideoSource\s*\(", HIGH),
        ("Camera intent", r"ACTION_IMAGE_CAPTURE|ACTION_VIDEO_CAPTURE", MEDIUM),
        ("CameraX use cases", r"\bImageCapture\s*\.|\bImageAnalysis\s*\.|CameraSelector\s*\.", HIGH),
        ("Camera permission constant", r"Manifest\.permission\.CAMERA", MEDIUM),
    ]),
    ("android.permission.RECORD_AUDIO", DANGEROUS, "Microphone", "Records audio from the microphone.", None, [
        ("AudioRecord", r"\bAudioRecord\s*[\(\.]", HIGH),
        ("MediaRecorder audio source", r"setAudioSource\s*\(", HIGH),
        ("SpeechRecognizer", r"SpeechRecognizer\s*\.|RecognizerIntent\s*\.", HIGH),
        ("AudioPlaybackCapture", r"AudioPlaybackCaptureConfiguration", MEDIUM),
        ("Visualizer", r"\bVisualizer\s*\(", MEDIUM),
    ]),
    ("android.permission.ACCESS_FINE_LOCATION", DANGEROUS, "Location", "Access to GPS-accurate location data.", "Location collection must be declared in the Play Data Safety form.", [
        ("FusedLocationProviderClient", r"FusedLocationProviderClient|getFusedLocationProviderClient", HIGH),
        ("LocationManager updates", r"requestLocationUpdates\s*\(|getLastKnownLocation\s*\(", HIGH),
        ("LocationRequest", r"LocationRequest\s*\.|PRIORITY_HIGH_ACCURACY", HIGH),
        ("GNSS status", r"registerGnssStatusCallback\s*\(|addNmeaListener\s*\(", HIGH),
        ("Cell info", r"getAllCellInfo\s*\(", MEDIUM),
    ]),
    ("android.permission.ACCESS_COARSE_LOCATION", DANGEROUS, "Location", "Access to approximate location.", None, [
        ("Fused location", r"FusedLocationProviderClient|getFusedLocationProviderClient", HIGH),
        ("Coarse priority", r"PRIORITY_BALANCED_POWER_ACCURACY|PRIORITY_LOW_POWER", HIGH),
        ("Network provider", r"NETWORK_PROVIDER", HIGH),
        ("Wifi scan results", r"getScanResults\s*\(", MEDIUM),
    ]),
    ("android.permission.ACCESS_BACKGROUND_LOCATION", DANGEROUS, "Location", "Location access while the app runs in the background.", "Requires a separate Google Play review and a demo video.", [
        ("Geofencing", r"GeofencingClient|GeofencingRequest|addGeofences\s*\(", HIGH),
        ("Location foreground service", r"FOREGROUND_SERVICE_TYPE_LOCATION", HIGH),
        ("Background location updates", r"requestLocationUpdates\s*\(", LOW),
    ]),
    ("android.permission.READ_CONTACTS", DANGEROUS, "Contacts", "Reads contact records.", None, [
        ("ContactsContract", r"ContactsContract\s*\.", HIGH),
        ("Contacts content uri", r"content://com\.android\.contacts", HIGH),
    ]),
    ("android.permission.WRITE_CONTACTS", DANGEROUS, "Contacts", "Creates or modifies contact records.", None, [
        ("Contacts write", r"applyBatch\s*\(|RawContacts\s*\.\s*CONTENT_URI", HIGH),
    ]),
    ("android.permission.GET_ACCOUNTS", DANGEROUS, "Contacts", "Access to the list of accounts on the device.", None, [
        ("AccountManager", r"AccountManager\s*\.|getAccountsByType\s*\(", HIGH),
    ]),
    ("android.permission.READ_CALENDAR", DANGEROUS, "Calendar", "Reads calendar events.", None, [
        ("CalendarContract", r"CalendarContract\s*\.", HIGH),
    ]),
    ("android.permission.WRITE_CALENDAR", DANGEROUS, "Calendar", "Creates or updates calendar events.", None, [
        ("Calendar write", r"Events\s*\.\s*CONTENT_URI", HIGH),
    ]),
    ("android.permission.READ_SMS", DANGEROUS, "SMS", "Reads SMS messages.", "Requires a special declaration under the Play SMS and Call Log policy.", [
        ("SMS provider", r"Telephony\s*\.\s*Sms|content://sms", HIGH),
    ]),
    ("android.permission.SEND_SMS", DANGEROUS, "SMS", "Sends SMS messages from the app.", "Requires a special declaration under the Play SMS policy.", [
        ("SmsManager", r"SmsManager\s*\.|sendTextMessage\s*\(", HIGH),
    ]),
    ("android.permission.RECEIVE_SMS", DANGEROUS, "SMS", "Intercepts incoming SMS messages.", "Requires a special declaration under the Play SMS policy.", [
        ("SMS receiver", r"SMS_RECEIVED", HIGH),
    ]),
    ("android.permission.CALL_PHONE", DANGEROUS, "Phone", "Places a phone call directly.", None, [
        ("ACTION_CALL", r"ACTION_CALL\b|placeCall\s*\(", HIGH),
    ]),
    ("android.permission.READ_PHONE_STATE", DANGEROUS, "Phone", "Access to phone state and network information.", None, [
        ("TelephonyManager", r"TelephonyManager\s*\.|getDeviceId\s*\(|getSubscriberId\s*\(", HIGH),
        ("Phone state listener", r"PhoneStateListener|TelephonyCallback", HIGH),
    ]),
    ("android.permission.READ_CALL_LOG", DANGEROUS, "Phone", "Reads the call history.", "Requires a special declaration under the Play Call Log policy.", [
        ("CallLog provider", r"CallLog\s*\.|content://call_log", HIGH),
    ]),
    ("android.permission.READ_EXTERNAL_STORAGE", DANGEROUS, "Storage", "Reads files from shared external storage.", None, [
        ("MediaStore query", r"MediaStore\s*\.\s*(Images|Video|Audio|Files)", HIGH),
        ("External storage path", r"getExternalStorageDirectory\s*\(|Environment\s*\.\s*DIRECTORY_", HIGH),
        ("File input stream", r"FileInputStream\s*\(", LOW),
    ]),
    ("android.permission.WRITE_EXTERNAL_STORAGE", DANGEROUS, "Storage", "Writes files to shared external storage.", None, [
        ("MediaStore insert", r"insert\s*\(\s*MediaStore", HIGH),
        ("Public directory write", r"getExternalStoragePublicDirectory\s*\(", HIGH),
        ("File output stream", r"FileOutputStream\s*\(", LOW),
    ]),
    ("android.permission.MANAGE_EXTERNAL_STORAGE", SPECIAL, "Storage", "Broad access to the entire file system.", "Requires a special Google Play declaration form and is rejected for most apps.", [
        ("All files access", r"MANAGE_ALL_FILES_ACCESS_PERMISSION|isExternalStorageManager\s*\(", HIGH),
    ]),
    ("android.permission.READ_MEDIA_IMAGES", DANGEROUS, "Media", "Access to image media on Android 13 and above.", None, [
        ("MediaStore images", r"MediaStore\s*\.\s*Images", HIGH),
    ]),
    ("android.permission.READ_MEDIA_VIDEO", DANGEROUS, "Media", "Access to video media on Android 13 and above.", None, [
        ("MediaStore video", r"MediaStore\s*\.\s*Video", HIGH),
    ]),
    ("android.permission.READ_MEDIA_AUDIO", DANGEROUS, "Media", "Access to audio files on Android 13 and above.", None, [
        ("MediaStore audio", r"MediaStore\s*\.\s*Audio", HIGH),
    ]),
    ("android.permission.READ_MEDIA_VISUAL_USER_SELECTED", DANGEROUS, "Media", "Partial photo and video selection access on Android 14.", None, [
        ("Photo picker", r"ACTION_PICK_IMAGES|PickVisualMedia", HIGH),
    ]),
    ("android.permission.POST_NOTIFICATIONS", DANGEROUS, "Notification", "Posts notifications on Android 13 and above.", None, [
        ("NotificationManagerCompat", r"NotificationManagerCompat", HIGH),
        ("Notification builder", r"NotificationCompat\s*\.\s*Builder", HIGH),
        ("Notify call", r"\.notify\s*\(", MEDIUM),
    ]),
    ("android.permission.BLUETOOTH_SCAN", DANGEROUS, "Bluetooth", "Scans for nearby Bluetooth devices.", None, [
        ("BLE scan", r"startScan\s*\(|BluetoothLeScanner|startDiscovery\s*\(", HIGH),
    ]),
    ("android.permission.BLUETOOTH_CONNECT", DANGEROUS, "Bluetooth", "Connects to paired Bluetooth devices.", None, [
        ("Bluetooth connect", r"connectGatt\s*\(|createRfcommSocket|getBondedDevices\s*\(|bondedDevices", HIGH),
    ]),
    ("android.permission.BLUETOOTH_ADVERTISE", DANGEROUS, "Bluetooth", "Makes the device discoverable over Bluetooth.", None, [
        ("BLE advertise", r"BluetoothLeAdvertiser|startAdvertising\s*\(", HIGH),
    ]),
    ("android.permission.NEARBY_WIFI_DEVICES", DANGEROUS, "Network", "Access to nearby Wi-Fi devices.", None, [
        ("Wifi direct", r"WifiP2pManager|WifiAwareManager|WifiRttManager", HIGH),
    ]),
    ("android.permission.BODY_SENSORS", DANGEROUS, "Sensors", "Access to body sensor data such as heart rate.", None, [
        ("Heart rate sensor", r"TYPE_HEART_RATE|TYPE_HEART_BEAT", HIGH),
    ]),
    ("android.permission.ACTIVITY_RECOGNITION", DANGEROUS, "Sensors", "Step counting and physical activity recognition.", None, [
        ("Step sensors", r"TYPE_STEP_COUNTER|TYPE_STEP_DETECTOR", HIGH),
        ("Activity recognition", r"ActivityRecognition\s*\.|ActivityRecognitionClient", HIGH),
    ]),
    ("android.permission.INTERNET", NORMAL, "Network", "Sends and receives data over the network.", None, [
        ("OkHttp", r"OkHttpClient", HIGH),
        ("Retrofit", r"Retrofit\s*\.\s*Builder", HIGH),
        ("Ktor client", r"(?<![A-Za-z])HttpClient\s*\(", HIGH),
        ("HttpURLConnection", r"HttpURLConnection", HIGH),
        ("Firebase", r"FirebaseFirestore|FirebaseAuth|FirebaseDatabase", MEDIUM),
        ("WebView", r"loadUrl\s*\(", MEDIUM),
        ("Image loading", r"Glide\s*\.|AsyncImage\s*\(|rememberAsyncImagePainter", MEDIUM),
    ]),
    ("android.permission.ACCESS_NETWORK_STATE", NORMAL, "Network", "Queries network connectivity state.", None, [
        ("ConnectivityManager", r"ConnectivityManager|NetworkCapabilities|activeNetworkInfo", HIGH),
    ]),
    ("android.permission.ACCESS_WIFI_STATE", NORMAL, "Network", "Queries Wi-Fi state information.", None, [
        ("WifiManager", r"WifiManager|connectionInfo", HIGH),
    ]),
    ("android.permission.CHANGE_WIFI_STATE", NORMAL, "Network", "Changes the Wi-Fi connection state.", None, [
        ("Wifi change", r"setWifiEnabled\s*\(", HIGH),
    ]),
    ("android.permission.VIBRATE", NORMAL, "Device", "Uses the vibration motor.", None, [
        ("Vibrator", r"\bVibrator\b|VibrationEffect|performHapticFeedback\s*\(|HapticFeedback", HIGH),
    ]),
    ("android.permission.WAKE_LOCK", NORMAL, "Device", "Keeps the device awake.", None, [
        ("WakeLock", r"newWakeLock\s*\(|PowerManager\s*\.\s*WakeLock", HIGH),
        ("Firebase messaging", r"FirebaseMessagingService", LOW),
    ]),
    ("android.permission.FOREGROUND_SERVICE", NORMAL, "Service", "Starts a foreground service.", None, [
        ("startForeground", r"startForeground\s*\(|startForegroundService\s*\(|setForeground\s*\(", HIGH),
    ]),
    ("android.permission.FOREGROUND_SERVICE_LOCATION", NORMAL, "Service", "Foreground service of type location.", None, [
        ("Location service type", r"FOREGROUND_SERVICE_TYPE_LOCATION", HIGH),
    ]),
    ("android.permission.RECEIVE_BOOT_COMPLETED", NORMAL, "Service", "Receives a broadcast when the device finishes booting.", None, [
        ("Boot receiver", r"BOOT_COMPLETED", HIGH),
    ]),
    ("android.permission.SCHEDULE_EXACT_ALARM", SPECIAL, "Alarm", "Schedules exact alarms.", "Play requires justification for exact alarm access.", [
        ("Exact alarm", r"setExact\s*\(|setExactAndAllowWhileIdle\s*\(|setAlarmClock\s*\(", HIGH),
    ]),
    ("android.permission.USE_EXACT_ALARM", SPECIAL, "Alarm", "Exact alarm access for alarm and calendar apps.", "Accepted only for apps whose core function is alarms or calendars.", [
        ("Exact alarm", r"setExactAndAllowWhileIdle\s*\(|setAlarmClock\s*\(", HIGH),
    ]),
    ("android.permission.QUERY_ALL_PACKAGES", SPECIAL, "Packages", "Lists every app installed on the device.", "High risk permission; in most cases replace it with a queries block.", [
        ("Package query", r"getInstalledPackages\s*\(|getInstalledApplications\s*\(|queryIntentActivities\s*\(", HIGH),
    ]),
    ("android.permission.SYSTEM_ALERT_WINDOW", SPECIAL, "Display", "Draws over other apps.", "Frequently reviewed by Google Play.", [
        ("Overlay", r"TYPE_APPLICATION_OVERLAY|canDrawOverlays\s*\(", HIGH),
    ]),
    ("android.permission.REQUEST_INSTALL_PACKAGES", SPECIAL, "Packages", "Requests installation of other packages.", "Should be removed from apps that do not distribute APKs.", [
        ("Install packages", r"ACTION_INSTALL_PACKAGE|canRequestPackageInstalls\s*\(", HIGH),
    ]),
    ("android.permission.USE_BIOMETRIC", NORMAL, "Security", "Uses biometric authentication.", None, [
        ("BiometricPrompt", r"BiometricPrompt|BiometricManager", HIGH),
    ]),
    ("android.permission.NFC", NORMAL, "Device", "Uses the NFC hardware.", None, [
        ("NfcAdapter", r"NfcAdapter|IsoDep|NdefMessage", HIGH),
    ]),
    ("android.permission.MODIFY_AUDIO_SETTINGS", NORMAL, "Audio", "Changes global audio settings.", None, [
        ("AudioManager", r"requestAudioFocus\s*\(|setSpeakerphoneOn\s*\(", HIGH),
    ]),
    ("com.android.vending.BILLING", NORMAL, "Billing", "Google Play in-app purchases.", None, [
        ("BillingClient", r"BillingClient|queryProductDetails|acknowledgePurchase", HIGH),
    ]),
    ("com.google.android.gms.permission.AD_ID", NORMAL, "Ads", "Access to the advertising identifier.", "Must be declared by ad-supported apps targeting Android 13 and above.", [
        ("Ads SDK", r"MobileAds\s*\.|AdRequest|AdView|InterstitialAd|RewardedAd|AdvertisingIdClient", HIGH),
    ]),
]

SIGNALS: list[Signal] = [Signal(name, label, pattern, confidence) for name, _, _, _, _, found in SPECS for label, pattern, confidence in found]

#: Names of the Dart plugin and the permissions (below android.permission) that each stands for.
DART_NAMES = {
    "camera": ["CAMERA"],
    "microphone": ["RECORD_AUDIO"],
    "speech": ["RECORD_AUDIO"],
    "location": ["ACCESS_FINE_LOCATION", "ACCESS_COARSE_LOCATION"],
    "locationWhenInUse": ["ACCESS_FINE_LOCATION", "ACCESS_COARSE_LOCATION"],
    "locationAlways": ["ACCESS_BACKGROUND_LOCATION", "ACCESS_FINE_LOCATION"],
    "photos": ["READ_MEDIA_IMAGES"],
    "photosAddOnly": ["READ_MEDIA_IMAGES"],
    "videos": ["READ_MEDIA_VIDEO"],
    "audio": ["READ_MEDIA_AUDIO"],
    "storage": ["READ_EXTERNAL_STORAGE", "WRITE_EXTERNAL_STORAGE"],
    "manageExternalStorage": ["MANAGE_EXTERNAL_STORAGE"],
    "notification": ["POST_NOTIFICATIONS"],
    "contacts": ["READ_CONTACTS", "WRITE_CONTACTS"],
    "calendar": ["READ_CALENDAR", "WRITE_CALENDAR"],
    "calendarFullAccess": ["READ_CALENDAR", "WRITE_CALENDAR"],
    "calendarWriteOnly": ["WRITE_CALENDAR"],
    "phone": ["CALL_PHONE", "READ_PHONE_STATE"],
    "sms": ["SEND_SMS", "RECEIVE_SMS", "READ_SMS"],
    "bluetoothScan": ["BLUETOOTH_SCAN"],
    "bluetoothConnect": ["BLUETOOTH_CONNECT"],
    "bluetoothAdvertise": ["BLUETOOTH_ADVERTISE"],
    "nearbyWifiDevices": ["NEARBY_WIFI_DEVICES"],
    "sensors": ["BODY_SENSORS"],
    "activityRecognition": ["ACTIVITY_RECOGNITION"],
    "scheduleExactAlarm": ["SCHEDULE_EXACT_ALARM"],
    "systemAlertWindow": ["SYSTEM_ALERT_WINDOW"],
    "requestInstallPackages": ["REQUEST_INSTALL_PACKAGES"],
}

#: Permissions of which any may stand in for another of its group.
ALTERNATIVES = [
    ["android.permission.ACCESS_FINE_LOCATION", "android.permission.ACCESS_COARSE_LOCATION"],
    ["android.permission.READ_EXTERNAL_STORAGE", "android.permission.READ_MEDIA_IMAGES", "android.permission.READ_MEDIA_VIDEO", "android.permission.READ_MEDIA_AUDIO"],
    ["android.permission.SCHEDULE_EXACT_ALARM", "android.permission.USE_EXACT_ALARM"],
]

#: Strings, compared in lower case, that tell a request or a check of a permission.
REQUEST_HINTS = [
    "requestPermissions", "RequestPermission", "RequestMultiplePermissions", "PermissionLauncher", "launchPermissionRequest",
    "shouldShowRequestPermissionRationale", "PermissionState", "rememberPermissionState", "launcher.launch",
]
CHECK_HINTS = ["checkSelfPermission", "PERMISSION_GRANTED", "checkPermission", "isGranted", "hasPermission"]

#: Supertypes and function names that make a function an entry point.
ENTRY_SUPERTYPES = [
    "Activity", "AppCompatActivity", "ComponentActivity", "FragmentActivity", "Fragment", "DialogFragment", "BottomSheetDialogFragment",
    "Service", "IntentService", "LifecycleService", "FirebaseMessagingService", "TileService", "BroadcastReceiver", "ContentProvider",
    "Application", "Worker", "CoroutineWorker", "ListenableWorker", "JobService", "JobIntentService",
]
ENTRY_FUNCTIONS = [
    "onCreate", "onStart", "onResume", "onStartCommand", "onReceive", "onBind", "doWork", "onHandleWork", "onHandleIntent",
    "onMessageReceived", "main", "onViewCreated",
]

#: Signals of a user's table at most.
MOST_SIGNALS = 20_000
UNKNOWN_DESCRIPTION = "Permission is not in the catalog and needs manual verification."


def specs(spark: SparkSession) -> DataFrame:
    """The catalog's permissions: name, protection, group, description, policy_note."""
    rows = [row[:5] for row in SPECS]
    return spark.createDataFrame(rows, "name string, protection string, group string, description string, policy_note string")


def signals(spark: SparkSession, found: Sequence[Signal] = SIGNALS) -> DataFrame:
    """The catalog's signals, numbered in order."""
    rows = [(n, s.permission, s.label, s.pattern, s.confidence, list(s.import_needles)) for n, s in enumerate(found)]
    return spark.createDataFrame(rows, "ord int, permission string, label string, pattern string, confidence string, import_needles array<string>")


def from_table(table: DataFrame, most: int = MOST_SIGNALS) -> list[Signal]:
    """Signals from a user's table: permission, label, pattern and, where it has them, confidence, import_needles and ord.

    They are in order of ``ord``, else of permission, label and pattern; equal rows count once, a null confidence is HIGH, and rows without
    a permission or a pattern are none.  A catalog is small beside the code that it is looked for in, and goes to the driver: one
    of more than ``most`` rows is an error.  A pattern that Spark cannot read is one when it is first matched.
    """
    own = {c: F.col(c) if c in table.columns else F.lit(None).cast(kind) for c, kind in (("ord", "int"), ("confidence", "string"), ("import_needles", "array<string>"))}
    rows = table.select(own["ord"].alias("ord"), "permission", F.coalesce("label", "pattern").alias("label"), "pattern", F.coalesce(own["confidence"], F.lit(HIGH)).alias("confidence"), F.coalesce(own["import_needles"], F.array().cast("array<string>")).alias("import_needles"))
    rows = rows.where("permission is not null and pattern is not null").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a catalog of more than {most} signals")
    rows.sort(key=lambda r: (r.ord is None, r.ord or 0, r.permission, r.label, r.pattern, r.confidence, r.import_needles))
    return [Signal(r.permission, r.label, r.pattern, r.confidence, tuple(r.import_needles)) for r in rows]


def alternatives(spark: SparkSession) -> DataFrame:
    """Pairs (name, other) of permissions of one group."""
    rows = [(a, b) for group in ALTERNATIVES for a in group for b in group if a != b]
    return spark.createDataFrame(rows, "name string, other string")


def described(df: DataFrame, name: Column | str, catalog: DataFrame) -> DataFrame:
    """Adds protection, group, description and policy note of a permission.

    A name that the catalog lacks is NORMAL below ``android.permission.`` and else
    SIGNATURE, of group ``Other``, with a fixed description and no note.
    """
    own = F.col(name) if isinstance(name, str) else name
    spec = F.broadcast(catalog.select(F.col("name").alias("_name"), "protection", "group", "description", "policy_note"))
    known = F.col("_name").isNotNull()
    usual = F.when(own.startswith("android.permission."), NORMAL).otherwise(SIGNATURE)
    return (
        df.join(spec, own == F.col("_name"), "left")
        .withColumn("protection", F.when(known, F.col("protection")).otherwise(usual))
        .withColumn("group", F.when(known, F.col("group")).otherwise("Other"))
        .withColumn("description", F.when(known, F.col("description")).otherwise(UNKNOWN_DESCRIPTION))
        .drop("_name")
    )
