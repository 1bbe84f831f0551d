"""Tags and attributes of XML-like text by pattern, without a parser.

Comments are not skipped, attributes are double-quoted only, and of equal
attributes the last one counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import line_at, strip, strict_bool, strict_int


def attribute(raw: Column, name: str) -> Column:
    """The last value of an attribute, or null."""
    hits = F.regexp_extract_all(raw, F.lit(rf'(?<![\w:\-]){name}\s*=\s*"([^"]*)"'), F.lit(1))
    return F.try_element_at(hits, F.lit(-1))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used: within lambdas Spark computes it anew each time."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def tags(text: Column, pattern: str) -> Column:
    """All matches, as struct(tag, line, end): the match, the line at which it begins and the characters up to its end.

    The text is split at the matches; the parts in front of the n-th match and the
    matches before it make up its place.  ``pattern`` has no group.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern)
    sizes = lambda x: (F.length(F.coalesce(x["gap"], F.lit(""))) + F.length(F.coalesce(x["tag"], F.lit("")))).alias("size")
    lines = F.transform(F.arrays_zip(found.alias("tag"), gaps.alias("gap")), lambda x: F.struct(x["tag"].alias("tag"), (line_at(F.coalesce(x["gap"], F.lit(""))) - 1).alias("gap"), (line_at(F.coalesce(x["tag"], F.lit(""))) - 1).alias("own"), sizes(x)))
    start = F.struct(F.lit(1).alias("at"), F.lit(0).alias("end"), F.array().cast("array<struct<tag:string,line:int,end:int>>").alias("out"))
    folded = F.aggregate(
        F.filter(lines, lambda x: x["tag"].isNotNull()),
        start,
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + x["own"]).cast("int").alias("at"),
            (acc["end"] + x["size"]).cast("int").alias("end"),
            F.concat(acc["out"], F.array(F.struct(x["tag"].alias("tag"), (acc["at"] + x["gap"]).cast("int").alias("line"), (acc["end"] + x["size"]).cast("int").alias("end")))).alias("out"),
        ),
    )
    return folded["out"]


def permissions(text: Column) -> Column:
    """Declared permissions: struct(name, max_sdk, sdk23_only, line, snippet); blank names are dropped."""
    found = F.transform(
        tags(text, r"<uses-permission(?:-sdk-23)?\b[^>]*>"),
        lambda t: F.struct(
            F.coalesce(attribute(t["tag"], "android:name"), F.lit("")).alias("name"),
            once(attribute(t["tag"], "android:maxSdkVersion"), strict_int).alias("max_sdk"),
            F.startswith(t["tag"], F.lit("<uses-permission-sdk-23")).alias("sdk23_only"),
            t["line"].alias("line"),
            strip(t["tag"]).alias("snippet"),
        ),
    )
    return F.filter(found, lambda p: strip(p["name"]) != "")


def features(text: Column) -> Column:
    """Declared features: struct(name, required, line)."""
    found = F.transform(
        tags(text, r"<uses-feature\b[^>]*>"),
        lambda t: F.struct(F.coalesce(attribute(t["tag"], "android:name"), F.lit("")).alias("name"), once(attribute(t["tag"], "android:required"), strict_bool).alias("required"), t["line"].alias("line")),
    )
    return F.filter(found, lambda p: strip(p["name"]) != "")


COMPONENT = r"<(?:activity-alias|activity|service|receiver|provider)\b[\s\S]*?(?:/>|>)"
KIND = r"^<(activity-alias|activity|service|receiver|provider)"
COMPONENTS = "array<struct<name:string,type:string,exported:boolean,permission:string,has_intent_filter:boolean,line:int>>"


def components(text: Column) -> Column:
    """Declared components: struct(name, type, exported, permission, has_intent_filter, line).

    The body of an element that is not closed in its own tag reaches to the next end
    tag of its type, and is empty without one.
    """
    def one(t: Column, kind: Column) -> Column:
        tag, end = t["tag"], t["end"]
        closing = F.position(F.concat(F.lit("</"), kind), text, end + 1)
        filtered = once(closing, lambda at: ~F.endswith(tag, F.lit("/>")) & (at > 0) & F.contains(F.substring(text, end + 1, at - end - 1), F.lit("<intent-filter")))
        return F.struct(
            F.coalesce(attribute(tag, "android:name"), F.lit("")).alias("name"),
            kind.alias("type"),
            once(attribute(tag, "android:exported"), strict_bool).alias("exported"),
            attribute(tag, "android:permission").alias("permission"),
            filtered.alias("has_intent_filter"),
            t["line"].alias("line"),
        )

    found = F.transform(tags(text, COMPONENT), lambda t: once(F.regexp_extract(t["tag"], KIND, 1), lambda kind: one(t, kind)))
    return F.filter(F.coalesce(found, F.array().cast(COMPONENTS)), lambda c: strip(c["name"]) != "")


def application_attribute(text: Column, name: str) -> Column:
    """An attribute of the first ``<application>`` tag."""
    return attribute(F.regexp_extract(text, r"<application\b[^>]*>", 0), name)


def manifest_package(text: Column) -> Column:
    return attribute(F.regexp_extract(text, r"<manifest\b[\s\S]*?>", 0), "package")


def has_queries(text: Column) -> Column:
    return F.contains(text, F.lit("<queries"))
