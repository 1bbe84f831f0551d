"""Decision tables, and scores and grades over them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Severities in order, with their weights; status markers of the console.
SEVERITIES = {"CRITICAL": 40, "HIGH": 20, "MEDIUM": 8, "LOW": 3, "INFO": 0}
MARKERS = {
    "USED": "[DECLARED+USED]", "DECLARED_UNUSED": "[DECLARED+NEVER-USED]", "UNDECLARED_USAGE": "[MISSING-FROM-MANIFEST]",
    "REQUESTED_ONLY": "[REQUEST-ONLY]", "WEAK_SIGNAL": "[WEAK]", "ALTERNATIVE_COVERED": "[ALT-COVERED]",
}
MAX_SCORE = 100


def status(declared: Column, api: Column, strong: Column, requests: Column, checks: Column, constants: Column, alternative: Column) -> Column:
    """Status from booleans: is it declared, and is there an API usage, a strong one, a request, a check, a constant."""
    return (
        F.when(~declared & ~strong & ~requests & api, "WEAK_SIGNAL")
        .when(~declared & alternative & ~requests, "ALTERNATIVE_COVERED")
        .when(api & ~declared, "UNDECLARED_USAGE")
        .when(api, "USED")
        .when(declared & (requests | checks | constants), "REQUESTED_ONLY")
        .when(~declared & (requests | checks), "UNDECLARED_USAGE")
        .otherwise("DECLARED_UNUSED")
    )


def risk(state: Column, protection: Column, requests: Column, note: Column) -> Column:
    grave = protection.isin("DANGEROUS", "SPECIAL")
    return (
        F.when(state.isin("WEAK_SIGNAL", "ALTERNATIVE_COVERED"), "LOW")
        .when(state == "UNDECLARED_USAGE", "HIGH")
        .when((state == "DECLARED_UNUSED") & grave, "HIGH")
        .when(state == "DECLARED_UNUSED", "MEDIUM")
        .when((protection == "DANGEROUS") & ~requests, "HIGH")
        .when(note.isNotNull(), "MEDIUM")
        .when(state == "REQUESTED_ONLY", "MEDIUM")
        .otherwise("LOW")
    )


def confidence(high: Column, medium: Column, requests: Column, any_usage: Column) -> Column:
    return F.when(high | requests, "HIGH").when(medium, "MEDIUM").when(~any_usage, "HIGH").otherwise("LOW")


def risk_rank(level: Column) -> Column:
    return F.when(level == "HIGH", 0).when(level == "MEDIUM", 1).otherwise(2)


def severity_rank(severity: Column) -> Column:
    rank = F.lit(len(SEVERITIES))
    for n, name in enumerate(SEVERITIES):
        rank = F.when(severity == name, n).otherwise(rank)
    return rank


def severity_weight(severity: Column) -> Column:
    weight = F.lit(0)
    for name, value in SEVERITIES.items():
        weight = F.when(severity == name, value).otherwise(weight)
    return weight


def grade(score: Column) -> Column:
    return F.when(score < 10, "A").when(score < 25, "B").when(score < 45, "C").when(score < 70, "D").otherwise("F")


def capped_score(severity: Column) -> Column:
    """Sum of the severities' weights, at most 100; 0 without rows."""
    return F.least(F.lit(MAX_SCORE), F.coalesce(F.sum(severity_weight(severity)), F.lit(0))).cast("int")
