"""Which languages a command is about."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import similarity


def present(units: DataFrame) -> DataFrame:
    return units.select("catalog", "language").distinct()


def to_report(here: DataFrame, sources: DataFrame, requested: list[str] | None = None, declared: list[str] | None = None, allow_unknown: bool = False) -> DataFrame:
    """(catalog, language) to report on: the requested ones, where ['all'] is those there are and those declared; else the declared ones; else those there
    are without the source language. A requested language that no catalog has and nobody declared is an error unless allowed."""
    spark, each = here.sparkSession, here.select("catalog").distinct()
    named = lambda some: each.crossJoin(F.broadcast(spark.createDataFrame([(x,) for x in some], "language string")))  # noqa: E731  a request is short
    if requested == ["all"]:
        return here.union(named(declared)).distinct() if declared else here
    if requested:
        unknown = set(requested) - set(declared or ()) - {r[0] for r in here.select("language").where(F.col("language").isin(requested)).distinct().collect()}
        if unknown and not allow_unknown:
            raise ValueError("; ".join(_unknown(here, x) for x in sorted(unknown)))
        return named(requested)
    if declared:
        return named(declared)
    return here.join(sources.select("catalog", F.col("source_language").alias("language")), ["catalog", "language"], "left_anti")


def _unknown(here: DataFrame, language: str) -> str:
    near = closest(here.select("language"), language)
    return f"no catalog has the language {language!r}" + (f"; is it {near!r}?" if near else "")


def closest(languages: DataFrame, asked: str, least: int = 60) -> str | None:
    """The language most like the one asked for, at least 60 % alike."""
    p = similarity(F.lower("language"), F.lit(asked.lower()))
    best = languages.distinct().withColumn("p", p).where(F.col("p") >= least).orderBy(F.desc("p"), "language").first()
    return best["language"] if best else None


def to_write(here: DataFrame, requested: list[str], allow_unknown: bool = False) -> str:
    """The one language an edit is for."""
    if len(requested) != 1 or requested == ["all"]:
        raise ValueError("an edit is for one language")
    if not allow_unknown and here.where(F.col("language") == requested[0]).isEmpty():
        raise ValueError(_unknown(here, requested[0]))
    return requested[0]
