"""What one side declares and the other lacks: bundles against projects, property lists against catalogs, regions against languages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.plural import base_language, required_categories
from ..functions.text import is_build_setting, is_translatable, is_user_facing_plist_key


def missing(declared: DataFrame, present: DataFrame, on: list[str]) -> DataFrame:
    """Rows of declared(on) that present lacks."""
    return declared.join(present.select(on).distinct(), on, "left_anti")


def bundle_against_project(units: DataFrame, keys: DataFrame) -> DataFrame:
    """units(table, key, source) of a bundle and keys(table, key) of the project: (rule, table, key). Keys that the project
    doesn't know, and translatable keys that the bundle misses."""
    a, b = units.select("table", "key").distinct(), keys.select("table", "key").distinct()
    unknown = a.join(b, ["table", "key"], "left_anti").withColumn("rule", F.lit("unknown-key"))
    lacking = b.where(is_translatable(F.col("key"))).join(a, ["table", "key"], "left_anti").withColumn("rule", F.lit("missing-from-bundle"))
    return unknown.unionByName(lacking).select("rule", "table", "key")


def bundle_plurals(units: DataFrame) -> DataFrame:
    """units(table, key, language, category, target) -> (table, key, language, missing): required categories without a target, for keys with one plural translation at least."""
    there = units.where("category is not null and coalesce(target, '') <> ''").groupBy("table", "key", "language").agg(F.collect_set("category").alias("there"))
    return there.withColumn("missing", F.array_except(required_categories(F.col("language")), "there")).where(F.size("missing") > 0).select("table", "key", "language", F.array_join("missing", ",").alias("missing"))


def bundle_languages(bundles: DataFrame) -> DataFrame:
    """bundles(bundle, expected, declared) whose metadata name another language."""
    return bundles.where(F.col("declared").isNotNull() & (F.col("declared") != F.col("expected")))


def plist_not_localized(declared: DataFrame, present: DataFrame, first: int = 4) -> DataFrame:
    """declared(target, key, value) user-facing property-list keys that no catalog of the target localizes. present(target, key).
    Where a target has no such catalog there is one row that names the first few and counts the rest."""
    asked = declared.where(is_user_facing_plist_key(F.col("key")) & (F.trim("value") != "") & ~is_build_setting(F.col("value"))).select("target", "key").distinct()
    has = present.select("target").distinct()
    each = asked.join(has, "target", "left_semi").join(present.select("target", "key").distinct(), ["target", "key"], "left_anti").select("target", F.col("key").alias("detail"))
    none = asked.join(has, "target", "left_anti").groupBy("target").agg(F.array_sort(F.collect_list("key")).alias("k"))
    more = F.when(F.size("k") > first, F.concat(F.lit(" and "), (F.size("k") - first).cast("string"), F.lit(" more"))).otherwise("")
    return each.unionByName(none.select("target", F.concat(F.array_join(F.slice("k", 1, first), ", "), more).alias("detail")))


def region_mismatch(catalogs: DataFrame, regions: DataFrame) -> DataFrame:
    """catalogs(catalog, source_language) whose base language isn't the project's development region: regions(region), the first by file and line, one row."""
    r = regions.select(F.col("region"))
    return catalogs.crossJoin(F.broadcast(r.limit(1))).where((base_language(F.col("source_language")) != base_language(F.col("region"))) & (F.lower("region") != "base"))  # broadcast: one row
