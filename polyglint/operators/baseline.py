"""Known findings: suppress them, report the rest, and tell which entries are stale."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IDENTITY = ["rule", "file", "key", "language"]


def identity(findings: DataFrame) -> DataFrame:
    """The four columns that name a finding, nulls as ''. Line, level and message don't count."""
    have = set(findings.columns)
    return findings.withColumns({c: F.coalesce(F.col(c), F.lit("")) if c in have else F.lit("") for c in IDENTITY})


def reported(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    return identity(findings).join(identity(baseline).select(IDENTITY), IDENTITY, "left_anti")


def suppressed(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    return identity(findings).join(identity(baseline).select(IDENTITY), IDENTITY, "left_semi")


def stale(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    return identity(baseline).select(IDENTITY).distinct().join(identity(findings).select(IDENTITY), IDENTITY, "left_anti")


def entries(findings: DataFrame) -> DataFrame:
    """A baseline of these findings, in its file's order."""
    return identity(findings).select(IDENTITY).distinct().orderBy("file", "rule", "key", "language")


def severity(findings: DataFrame) -> DataFrame:
    """(failures, advisories): errors, and all other findings."""
    return findings.agg(F.count_if(F.col("level") == "error").alias("failures"), F.count_if(F.col("level") != "error").alias("advisories"))
