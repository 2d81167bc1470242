"""Translation status and coverage by catalog and language."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.plural import required_categories
from ..functions.text import graphemes, is_translatable, percent

COUNTS = ("translated", "needs_review")


def key_partition(entries: DataFrame) -> DataFrame:
    """entries(catalog, key, extraction_state, should_translate) with class: stale, do-not-translate, untranslatable or translatable, the first that fits."""
    return entries.withColumn(
        "class",
        F.when(F.col("extraction_state") == "stale", "stale")
        .when(~F.coalesce("should_translate", F.lit(True)), "do-not-translate")
        .when(~is_translatable(F.col("key")), "untranslatable")
        .otherwise("translatable"),
    )


def status(units: DataFrame, gaps: DataFrame | None = None) -> DataFrame:
    """(catalog, key, language, status, state): from flat units (path ''), a unit before variations; an unknown state is new.

    gaps(catalog, key, language, missing): plural gaps of keys with variations.
    """
    flat = units.where("path = ''").select("catalog", "key", "language", "value", F.when(F.col("state").isin("new", "needs_review", "translated", "stale"), F.col("state")).otherwise("new").alias("state"))
    one = flat.select("catalog", "key", "language", F.when(F.coalesce(F.col("value"), F.lit("")) == "", "empty").otherwise("unit").alias("status"), "state")
    if gaps is None:
        return one
    varied = gaps.join(one, ["catalog", "key", "language"], "left_anti").select("catalog", "key", "language", F.when(F.size("missing") > 0, "incomplete").otherwise("variations").alias("status"), F.lit("translated").alias("state"))
    return one.unionByName(varied)


def coverage(keys: DataFrame, languages: DataFrame, statuses: DataFrame, sources: DataFrame) -> DataFrame:
    """keys(catalog, key) x languages(catalog, language), held against status: per catalog and language the counts of
    translatable, translated, missing, empty, needs_review keys and the percentage. sources(catalog, source_language):
    in its source language a key counts as translated whatever its state."""
    pairs = keys.join(languages, "catalog").join(sources, "catalog", "left").join(statuses, ["catalog", "key", "language"], "left")
    own = F.coalesce(F.col("language") == F.col("source_language"), F.lit(False))
    s, state = F.col("status"), F.col("state")
    missing = ~own & (s.isNull() | ((s == "unit") & state.isin("new", "stale")))
    empty = ~own & F.coalesce(s == "empty", F.lit(False))
    done = own | ((s == "unit") & state.isin(*COUNTS)) | (s == "variations")
    out = pairs.groupBy("catalog", "language").agg(
        F.count("*").alias("translatable"), F.count_if(F.coalesce(done, F.lit(False))).alias("translated"), F.count_if(missing).alias("missing"), F.count_if(empty).alias("empty"),
        F.count_if(~own & F.coalesce(state.isin("new", "needs_review") & (s == "unit"), F.lit(False))).alias("needs_review"),
    )
    return out.withColumn("percent", percent(F.col("translated"), F.col("translatable")))


def identical_to_source(units: DataFrame, sources: DataFrame) -> DataFrame:
    """Flat translations of more than three graphemes that repeat the source text."""
    flat = units.where("path = ''").join(sources, "catalog")
    own = flat.where("language = source_language").select("catalog", "key", F.col("value").alias("source"))
    return flat.where("language <> source_language").join(own, ["catalog", "key"]).where((F.col("value") == F.col("source")) & (graphemes(F.col("value")) > 3)).select("catalog", "key", "language")


def plural_gaps(slots: DataFrame) -> DataFrame:
    """slots(catalog, key, language, node, category, has_text) -> per key and language the required categories that a
    plural node lacks, or has without text (marked), in the order of the categories."""
    per = slots.groupBy("catalog", "key", "language", "node").agg(F.collect_set("category").alias("there"), F.collect_set(F.when(F.col("has_text"), F.col("category"))).alias("full"))
    need = required_categories(F.col("language"))
    lacking = F.transform(F.filter(need, lambda c: ~F.array_contains("full", c)), lambda c: F.concat(F.col("node"), c, F.when(F.array_contains("there", c), " (empty)").otherwise("")))
    return per.select("catalog", "key", "language", lacking.alias("m")).groupBy("catalog", "key", "language").agg(F.array_sort(F.flatten(F.collect_list("m"))).alias("missing"))


def new_gaps(gaps: DataFrame, sources: DataFrame) -> DataFrame:
    """Plural gaps that the source language of the catalog doesn't have itself."""
    own = gaps.join(sources, "catalog").where("language = source_language").select("catalog", "key", F.col("missing").alias("own"))
    left = gaps.join(sources, "catalog").where("language <> source_language").join(own, ["catalog", "key"], "left")
    return left.withColumn("missing", F.array_except("missing", F.coalesce("own", F.array().cast("array<string>")))).where(F.size("missing") > 0).select("catalog", "key", "language", "missing")


def flat_where_plural(units: DataFrame, sources: DataFrame) -> DataFrame:
    """Flat translations, in languages with several categories, of keys whose source varies by plural."""
    u = units.join(sources, "catalog")
    plural = u.where((F.col("language") == F.col("source_language")) & F.col("path").rlike(r"(^|\.)plural\.")).select("catalog", "key").distinct()
    return u.where((F.col("path") == "") & (F.col("language") != F.col("source_language")) & (F.size(required_categories(F.col("language"))) > 1)).join(plural, ["catalog", "key"], "left_semi").select("catalog", "key", "language")


def shipped_languages(present: DataFrame) -> DataFrame:
    """present(catalog, language) -> languages that more than half of the catalogs have: (language, catalogs)."""
    pairs = present.distinct()
    started = pairs.agg(F.count_distinct("catalog").alias("started"))
    return pairs.groupBy("language").agg(F.count("*").alias("catalogs")).join(F.broadcast(started), F.col("catalogs") * 2 > F.col("started")).select("language", "catalogs")  # broadcast: one row


def coverage_gaps(present: DataFrame) -> DataFrame:
    """Catalogs without some shipped language: (catalog, missing, n_missing)."""
    pairs = present.distinct()
    asked = pairs.select("catalog").distinct().crossJoin(shipped_languages(present).select("language"))
    return asked.join(pairs, ["catalog", "language"], "left_anti").groupBy("catalog").agg(F.array_join(F.array_sort(F.collect_list("language")), ",").alias("missing"), F.count("*").alias("n_missing"))
