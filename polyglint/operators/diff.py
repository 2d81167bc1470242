"""What changed between two versions of a catalog's units, and which translations it stranded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def key_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(key, change) of keys added and removed. Both sides have a column key."""
    a, b = before.select("key").distinct(), after.select("key").distinct()
    return b.join(a, "key", "left_anti").withColumn("change", F.lit("added")).unionByName(a.join(b, "key", "left_anti").withColumn("change", F.lit("removed")))


def changed_paths(before: DataFrame, after: DataFrame) -> DataFrame:
    """(key, language, path, old, new) where the two versions differ, for keys and languages that both have. Sides: key, language, path, value."""
    on = ["key", "language"]
    both = before.select(on).distinct().join(after.select(on).distinct(), on)
    a, b = before.select(*on, "path", F.col("value").alias("old")), after.select(*on, "path", F.col("value").alias("new"))
    return a.join(b, [*on, "path"], "full").where("not (old <=> new)").join(both, on, "left_semi")


def source_changes(before: DataFrame, after: DataFrame, source_language: str) -> DataFrame:
    """(key, path, old, new) of keys whose source text changed: the lowest changed path."""
    one = lambda v: v.where(F.col("language") == source_language)
    changed = changed_paths(one(before), one(after))
    return changed.groupBy("key").agg(F.min("path").alias("path"), F.min_by(F.struct("old", "new"), "path").alias("v")).select("key", "path", "v.old", "v.new")


def translations_of_changes(before: DataFrame, after: DataFrame, source_language: str, reviewed: DataFrame | None = None) -> DataFrame:
    """For keys whose source changed: each translation that both versions have, (key, language, fate): updated, or stale where it
    stayed as it was. reviewed(key, language): translations already marked for review or new, which are left out."""
    changed = source_changes(before, after, source_language).select("key")
    on = ["key", "language"]
    both = before.select(on).distinct().join(after.select(on).distinct(), on).where(F.col("language") != source_language).join(changed, "key", "left_semi")
    if reviewed is not None:
        both = both.join(reviewed.select(on), on, "left_anti")
    moved = changed_paths(before.where(F.col("language") != source_language), after).select(on).distinct().withColumn("moved", F.lit(True))
    return both.join(moved, on, "left").select("key", "language", F.when(F.col("moved"), "updated").otherwise("stale").alias("fate"))
