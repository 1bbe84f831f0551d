"""Rules over the permission reports: each row that meets one is a finding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import checkpointed
from ..sources.project import keys_of
from .classify import severity_rank

USAGE = "struct<file:string,line:int,module:string,enclosing:string,symbol:string,kind:string,evidence:string,confidence:string,snippet:string>"
NONE = f"array<{USAGE}>"
MAX_LOCATIONS, ADS_SDK = 8, 33
PERMISSION = "android.permission."
AD_ID = "com.google.android.gms.permission.AD_ID"

#: Title, detail and recommendation of each rule; {0} is the subject, {1} a second value.
TEXTS = {
    "UNUSED_PERMISSION": (
        "{0} is declared but never used in code",
        "{1} is declared in the manifest, but no related API call, runtime permission request or permission constant reference was found in the code.",
        'Remove the permission from the manifest if it is not needed. If a library pulls it in, verify with the library documentation or strip it with tools:node="remove".',
    ),
    "UNDECLARED_PERMISSION": (
        "{0} is used in code but not declared in the manifest",
        "The code calls APIs that require this permission, but no matching uses-permission entry exists in AndroidManifest.xml. This throws SecurityException at runtime.",
        "Add the uses-permission entry to the manifest or remove the code path that needs it.",
    ),
    "MISSING_RUNTIME_REQUEST": (
        "{0} is a dangerous permission with no runtime request",
        "The permission is used, but no requestPermissions call or ActivityResultContracts based permission request was found in the code.",
        "Request the permission with registerForActivityResult(RequestPermission()) before the flow that uses it, and handle the denied case.",
    ),
    "MISSING_PERMISSION_CHECK": (
        "{0} is used without a permission state check",
        "The permission is requested, but no checkSelfPermission style guard was found before use.",
        "Verify the permission state with ContextCompat.checkSelfPermission before calling the API.",
    ),
    "PLAY_POLICY_SENSITIVE": (
        "{0} is sensitive under Google Play policy",
        "{1}",
        "Update the Play Console declarations and privacy policy for this permission, and consider an alternative API that removes the need for it.",
    ),
    "STORAGE_MAX_SDK": (
        "WRITE_EXTERNAL_STORAGE has no maxSdkVersion limit",
        "Because of scoped storage this permission has no effect on Android 10 and above in most cases.",
        'Limit the declaration with android:maxSdkVersion="28" or move to the MediaStore API.',
    ),
    "MISSING_POST_NOTIFICATIONS": (
        "Notifications are posted without declaring POST_NOTIFICATIONS",
        "With targetSdk {1}, notifications are not shown on Android 13 and above without this permission.",
        "Declare POST_NOTIFICATIONS in the manifest and request it at runtime.",
    ),
    "FINE_WITHOUT_COARSE": (
        "ACCESS_COARSE_LOCATION is missing next to ACCESS_FINE_LOCATION",
        "On Android 12 and above the user can pick approximate location, so the coarse permission must also be declared.",
        "Declare ACCESS_COARSE_LOCATION in the manifest and request both permissions together.",
    ),
    "BACKGROUND_LOCATION_WITHOUT_FOREGROUND": (
        "Background location is declared without foreground location",
        "ACCESS_BACKGROUND_LOCATION does not work alone, foreground location must be granted first.",
        "Declare ACCESS_FINE_LOCATION or ACCESS_COARSE_LOCATION and request the permissions in sequence.",
    ),
    "EXPORTED_COMPONENT_WITHOUT_PERMISSION": (
        "{0} is exported without permission protection",
        'The {1} component is declared with android:exported="true" and has no android:permission guard.',
        "Set exported to false if the component is not meant to be called externally, otherwise guard it with a permission.",
    ),
    "CLEARTEXT_TRAFFIC": (
        "usesCleartextTraffic is enabled",
        "{0} allows unencrypted HTTP traffic.",
        "Use HTTPS only, and if an exception is required scope it per domain with a network security config.",
    ),
    "MISSING_AD_ID": (
        "Ads SDK is present but AD_ID is not declared",
        "Ad-supported apps targeting Android 13 and above must declare com.google.android.gms.permission.AD_ID.",
        "Declare AD_ID if the advertising id is used and update the Data Safety form.",
    ),
    "NETWORK_WITHOUT_INTERNET": (
        "Network calls are present without the INTERNET permission",
        "An HTTP client is used in the code, but the INTERNET permission is not declared.",
        "Add the INTERNET permission to AndroidManifest.xml.",
    ),
    "NO_MANIFEST": (
        "No AndroidManifest.xml found",
        "No manifest file was found in the given directory, so permission declarations could not be analyzed.",
        "Make sure the target path is the root directory of an Android project.",
    ),
    "NO_SOURCES": (
        "No source files found",
        "No Kotlin, Java or Dart source file was found to analyze.",
        "Check the target path or pass the --include-tests option.",
    ),
}


def _said(text: str, subject: Column, other: Column) -> Column:
    out = F.lit(text)
    for mark, value in (("{0}", subject), ("{1}", other)):
        if mark in text:
            out = F.replace(out, F.lit(mark), F.coalesce(value.cast("string"), F.lit("")))
    return out


def finding(rule: str, severity: Column | str, *, subject: Column | None = None, other: Column | None = None, permission: Column | None = None, locations: Column | None = None, block: int, order: Column) -> Column:
    """One finding as a struct; ``block`` and ``order`` place it among all others."""
    none = F.lit(None).cast("string")
    subject, other = (none if subject is None else subject), (none if other is None else other)
    title, detail, advice = (_said(x, subject, other) for x in TEXTS[rule])
    places = F.lit(None).cast(NONE) if locations is None else locations
    return F.struct(
        F.lit(block).alias("block"), order.cast("string").alias("order"), F.lit(list(TEXTS).index(rule)).alias("nth"), F.lit(rule).alias("rule"),
        (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), title.alias("title"), detail.alias("detail"),
        (none if permission is None else permission).alias("permission"), advice.alias("recommendation"),
        F.slice(F.coalesce(places, F.array().cast(NONE)), 1, MAX_LOCATIONS).alias("locations"),
    )


def any_of(df: DataFrame, rules: list[tuple[Column, Column]]) -> DataFrame:
    """A row for each rule that a row of ``df`` meets, with its ``project`` if it has one: one pass, however many rules."""
    return df.select(*keys_of(df), F.explode(F.array_compact(F.array(*[F.when(test, made) for test, made in rules]))).alias("f")).select(*keys_of(df), "f.*")


def _manifest_place(file: Column, line: Column, module: Column, symbol: Column, evidence: str, snippet: Column) -> Column:
    return F.struct(
        file.alias("file"), line.cast("int").alias("line"), module.alias("module"), F.lit("AndroidManifest").alias("enclosing"), symbol.alias("symbol"), F.lit("MANIFEST").alias("kind"),
        F.lit(evidence).alias("evidence"), F.lit("HIGH").alias("confidence"), snippet.alias("snippet"),
    )


def permission_findings(reports: DataFrame) -> DataFrame:
    """Rules on each permission by itself."""
    c = F.col
    name, short, prot = c("permission"), c("shortName"), c("protection")
    declared_at = F.transform("firstDeclarations", lambda d: _manifest_place(d["file"], d["line"], d["module"], short, "Manifest declaration", d["snippet"]))
    grave, dangerous = prot.isin("DANGEROUS", "SPECIAL"), prot == "DANGEROUS"
    used = dangerous & (c("status") == "USED")
    make = lambda rule, severity, locations, other=None: finding(rule, severity, subject=short, other=other, permission=name, locations=locations, block=0, order=name)
    return any_of(reports, [
        (c("status") == "DECLARED_UNUSED", make("UNUSED_PERMISSION", F.when(grave, "HIGH").otherwise("MEDIUM"), declared_at, name)),
        (c("status") == "UNDECLARED_USAGE", make("UNDECLARED_PERMISSION", "CRITICAL", c("firstUsages"))),
        (used & (c("requests") == 0), make("MISSING_RUNTIME_REQUEST", "HIGH", c("firstUsages"))),
        (used & (c("requests") > 0) & (c("checks") == 0), make("MISSING_PERMISSION_CHECK", "MEDIUM", c("firstRequests"))),
        (c("declared") & c("policyNote").isNotNull(), make("PLAY_POLICY_SENSITIVE", F.when(prot == "SPECIAL", "HIGH").otherwise("MEDIUM"), declared_at, c("policyNote"))),
    ])


def beside(first: DataFrame, *others: DataFrame) -> DataFrame:
    """One row of the columns of several tables of one row each."""
    out = first.withColumn("_one", F.lit(1))
    for other in others:
        out = out.join(F.broadcast(other.withColumn("_one", F.lit(1))), "_one")
    return out.drop("_one")


def each_project(keys: list[str], *tables: DataFrame) -> DataFrame:
    """A row per project of any table, with the columns of all; counts and flags that a table lacks are 0 and false."""
    out = tables[0]
    for other in tables[1:]:
        out = out.join(other, keys, "full_outer")
    zero = {f.name: F.coalesce(F.col(f.name), F.lit(0 if f.dataType.simpleString() == "bigint" else False)) for f in out.schema.fields if f.dataType.simpleString() in ("bigint", "boolean")}
    return out.withColumns(zero)


def project_findings(reports: DataFrame, build: DataFrame, manifests: DataFrame, sources: DataFrame) -> DataFrame:
    """Rules on the project: one row of flags, so empty inputs still give a row.

    Of several projects, told apart by ``project`` in every input, each has a row: those with a source, a
    manifest or a build script.
    """
    keys = keys_of(build)
    named = lambda n: F.col("permission") == (n if "." in n else PERMISSION + n)
    has = lambda n: F.coalesce(F.bool_or(named(n) & F.col("declared")), F.lit(False))
    uses = lambda n: F.coalesce(F.bool_or(named(n) & (F.col("usageCount") > 0)), F.lit(False))
    flags = reports.groupBy(*keys).agg(
        F.coalesce(F.bool_or(named("WRITE_EXTERNAL_STORAGE") & F.col("open_ended")), F.lit(False)).alias("open_storage"),
        has("POST_NOTIFICATIONS").alias("notify"), uses("POST_NOTIFICATIONS").alias("notifies"), F.max(F.when(named("POST_NOTIFICATIONS"), F.col("firstUsages"))).alias("notified"),
        has("ACCESS_FINE_LOCATION").alias("fine"), has("ACCESS_COARSE_LOCATION").alias("coarse"), has("ACCESS_BACKGROUND_LOCATION").alias("background"),
        has(AD_ID).alias("ad_id"), has("INTERNET").alias("internet"), uses("INTERNET").alias("network"),
    )
    counts = [df.groupBy(*keys).agg(F.count("*").alias(name)) for df, name in ((manifests, "n_manifests"), (sources, "n_sources"))]
    one = each_project(keys, flags, build, *counts) if keys else beside(flags, build, *counts)
    c, sdk = F.col, F.coalesce(F.col("target_sdk") >= ADS_SDK, F.lit(False))
    ads = F.coalesce(F.exists("dependencies", lambda d: F.contains(d, F.lit("play-services-ads")) | F.contains(d, F.lit("admob"))), F.lit(False))
    make = lambda block, rule, severity, permission=None, **more: finding(rule, severity, permission=None if permission is None else F.lit(permission), block=block, order=F.lit(""), **more)
    return any_of(one, [
        (c("open_storage"), make(1, "STORAGE_MAX_SDK", "MEDIUM", PERMISSION + "WRITE_EXTERNAL_STORAGE")),
        (sdk & c("notifies") & ~c("notify"), make(2, "MISSING_POST_NOTIFICATIONS", "HIGH", PERMISSION + "POST_NOTIFICATIONS", other=c("target_sdk"), locations=c("notified"))),
        (c("fine") & ~c("coarse"), make(3, "FINE_WITHOUT_COARSE", "MEDIUM", PERMISSION + "ACCESS_FINE_LOCATION")),
        (c("background") & ~c("fine") & ~c("coarse"), make(4, "BACKGROUND_LOCATION_WITHOUT_FOREGROUND", "HIGH", PERMISSION + "ACCESS_BACKGROUND_LOCATION")),
        (ads & sdk & ~c("ad_id"), make(7, "MISSING_AD_ID", "MEDIUM")),
        (c("network") & ~c("internet"), make(8, "NETWORK_WITHOUT_INTERNET", "CRITICAL", PERMISSION + "INTERNET")),
        (c("n_manifests") == 0, make(9, "NO_MANIFEST", "HIGH")),
        (c("n_sources") == 0, make(10, "NO_SOURCES", "HIGH")),
    ])


def manifest_findings(manifests: DataFrame, components: DataFrame) -> DataFrame:
    """Rules on components and on manifests."""
    c = F.col
    exposed = F.coalesce(c("exported"), F.lit(False)) & c("permission").isNull() & c("has_intent_filter")
    place = F.array(_manifest_place(c("file"), c("line"), c("module"), c("name"), "Exported component", F.lit("")))
    order = F.format_string("%s#%08d", c("file"), c("pos"))
    exported = any_of(components, [(exposed, finding("EXPORTED_COMPONENT_WITHOUT_PERMISSION", "MEDIUM", subject=c("name"), other=c("type"), locations=place, block=5, order=order))])
    clear = any_of(manifests, [(F.coalesce(c("cleartext"), F.lit(False)), finding("CLEARTEXT_TRAFFIC", "MEDIUM", subject=c("file"), block=6, order=c("file")))])
    return exported.unionByName(clear)


def numbered(findings: DataFrame, prefix: str = "F") -> DataFrame:
    """Ids in order of emission, rows in order of severity, within each ``project`` where there are several.

    Findings are dealt out by ranges of their order, numbered within a range, and moved on
    by the number of those before: no task has them all, nor all of a project.
    """
    own, key = keys_of(findings), ["block", "order", "nth"]
    dealt = checkpointed(findings.repartitionByRange(*own, *key).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy(*own, "_range").agg(F.count("*").alias("_size"))  # of one project a row per shuffle partition at most
    before = Window.partitionBy(*own).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*own, "_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy(*own, "_range").orderBy(*key)) + F.col("_before")
    out = dealt.join(sizes if own else F.broadcast(sizes), [*own, "_range"]).withColumn("_n", rank).withColumn("id", F.format_string(prefix + "-%03d", F.col("_n")))
    out = out.orderBy(*own, severity_rank(F.col("severity")), "_n")
    return out.select(*own, "id", "rule", "severity", "title", "detail", "permission", "recommendation", "locations")
