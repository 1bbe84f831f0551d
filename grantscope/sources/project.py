"""Files of a project tree as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markup, text
from .tree import files

#: Names of folders that are not entered; ``.*`` stands for every one that begins with a dot.
SOURCE_SKIP = ["build", "out", "generated", "node_modules", ".*"]
MANIFEST_SKIP = ["build", "out", "node_modules", ".gradle", ".git", ".idea", ".cxx"]
PACKAGE = r"^\s*package\s+([A-Za-z_][\w.]*)"
IMPORT = r"^\s*import\s+(?:static\s+)?([A-Za-z_][\w.*]*)"
DEPENDENCY = r"""(?m)^\s*(?:implementation|api|kapt|ksp|compileOnly|runtimeOnly|annotationProcessor|\w+Implementation|\w+Api)\s*\(?\s*(?:platform\s*\(\s*)?["']([^"']+)["']"""


def sources(spark: SparkSession, root: str, include_tests: bool = False) -> DataFrame:
    """Kotlin, Java and Dart files with lines: raw, and code without comments."""
    df = files(spark, root, ["*.kt", "*.java", "*.dart"], SOURCE_SKIP)
    return source_rows(df, include_tests)


#: Columns of files that the rows made of them keep: the project, and of an event its number.
KEPT = ["project", "seq"]


def keys_of(df: DataFrame) -> list[str]:
    """``project`` where the rows of many projects are told apart by such a column, else nothing."""
    return ["project"] if "project" in df.columns else []


def source_rows(df: DataFrame, include_tests: bool = False, keep_empty: bool = False) -> DataFrame:
    """Source rows of (path, relative_path, content): module, language, package, imports, is_test, raw, code.

    Files without a line are dropped, and those of tests, unless asked for.  Columns ``project`` and ``seq`` stay.
    """
    rel = F.col("relative_path")
    df = df.withColumn("raw", text.lines_of(F.col("content")))
    df = df if keep_empty else df.where(F.size("raw") > 0)
    df = df.withColumn("code", F.split(text.strip_comments(F.array_join("raw", "\n")), "\n"))
    df = df.select(
        *[c for c in KEPT if c in df.columns], "path", "relative_path", text.module_of(rel).alias("module"), text.language_of(rel).alias("language"), text.is_test(rel).alias("is_test"),
        text.first_match(F.col("code"), PACKAGE, "package").alias("package"), text.all_matches(F.col("code"), IMPORT, "import").alias("imports"), "raw", "code",
    )
    return df if include_tests else df.where(~F.col("is_test"))


def manifests(spark: SparkSession, root: str) -> DataFrame:
    return manifest_rows(files(spark, root, ["AndroidManifest.xml"], MANIFEST_SKIP))


def manifest_rows(df: DataFrame) -> DataFrame:
    """Manifest rows of (relative_path, content); a ``project`` column stays."""
    content: Column = F.col("content")
    return df.select(
        *keys_of(df), F.col("relative_path").alias("file"), text.manifest_module(F.col("relative_path")).alias("module"), markup.manifest_package(content).alias("package"),
        markup.permissions(content).alias("permissions"), markup.features(content).alias("features"), markup.components(content).alias("components"),
        text.strict_bool(markup.application_attribute(content, "android:usesCleartextTraffic")).alias("cleartext"), markup.has_queries(content).alias("queries"),
    )


def declared(manifest: DataFrame) -> DataFrame:
    """A row per declaration: permission, file, module, line, max_sdk, sdk23_only, snippet, in order."""
    df = manifest.select(*keys_of(manifest), "file", "module", F.posexplode("permissions").alias("pos", "p"))
    return df.select(*keys_of(df), F.col("p.name").alias("permission"), "file", "module", F.col("p.line").alias("line"), F.col("p.max_sdk").alias("max_sdk"), F.col("p.sdk23_only").alias("sdk23_only"), F.col("p.snippet").alias("snippet"), "pos")


def manifest_components(manifest: DataFrame) -> DataFrame:
    df = manifest.select(*keys_of(manifest), "file", "module", F.posexplode("components").alias("pos", "c"))
    return df.select(*keys_of(df), "c.*", "file", "module", "pos")


def build_config(spark: SparkSession, root: str) -> DataFrame:
    """One row: application_id, min_sdk, target_sdk, compile_sdk and dependencies of the build scripts.

    The first script in order of path that sets a value counts; dependencies are the
    quoted coordinates of all scripts.
    """
    return build_row(files(spark, root, ["build.gradle", "build.gradle.kts"], SOURCE_SKIP))


def build_row(df: DataFrame) -> DataFrame:
    """What build scripts of (relative_path, content) say: one row, or one for each ``project``."""
    content = F.regexp_replace(F.col("content"), r"(?m)^\s*//.*$", "")
    number = lambda key: F.regexp_extract(content, rf"\b{key}(?:Version)?\s*[=(\s]\s*([0-9]+)", 1).try_cast("int")
    app = F.nullif(F.regexp_extract(content, r"""\bapplicationId\s*[=(\s]\s*["']([^"']+)["']""", 1), F.lit(""))
    rows = df.select(
        *keys_of(df), "relative_path", app.alias("application_id"), number("minSdk").alias("min_sdk"), number("targetSdk").alias("target_sdk"),
        number("compileSdk").alias("compile_sdk"), F.regexp_extract_all(content, F.lit(DEPENDENCY), F.lit(1)).alias("dependencies"),
    )
    first = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("relative_path"))).alias(c)
    lists = F.transform(F.sort_array(F.collect_list(F.struct("relative_path", "dependencies"))), lambda x: x["dependencies"])
    return rows.groupBy(*keys_of(df)).agg(first("application_id"), first("min_sdk"), first("target_sdk"), first("compile_sdk"), F.array_distinct(F.flatten(lists)).alias("dependencies"))
