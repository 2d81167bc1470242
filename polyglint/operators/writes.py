"""Guarded upserts on units: planned as rows with an action each, refused rather than destroying structure."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

UNIT = ["catalog", "key", "language", "path"]


def plan_add(edits: DataFrame, units: DataFrame, keys: DataFrame, substitutions: DataFrame | None = None, flatten: bool = False) -> DataFrame:
    """edits(catalog, key, language, path, value[, state]) with an action: created, updated, unchanged, or a refusal.

    path is '' for a flat text, plural.<category>, device.<name>, or substitutions.<name>.plural.<category>. A device's text is
    never refused for what is there; it replaces a flat text. Refused: 'todo' placeholders; 'case-conflict'
    with another key of the catalog or an earlier one (in key order) of the same batch; 'has-variations' where a
    flat text would replace variations, unless flatten; 'has-text' where a plural would replace a flat text;
    'has-substitutions' where the unit's text is made of them; 'no-substitution' where the named one isn't there. One refused edit of a key and language refuses all of them.
    """
    e = edits.withColumn("state", F.lit("translated")) if "state" not in edits.columns else edits
    lowered = F.lower("key")
    have = keys.select("catalog", "key").distinct()
    clash = have.groupBy("catalog", lowered.alias("low")).agg(F.min("key").alias("held"), F.collect_set("key").alias("all"))
    w = W.partitionBy("catalog", "low").orderBy("key").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    e = e.withColumn("low", lowered).join(clash, ["catalog", "low"], "left").withColumn("lead", F.first("key").over(w))
    shape = units.where("value is not null").groupBy("catalog", "key", "language").agg(F.max(F.col("path") != "").alias("varied"), F.max((F.col("path") == "") & (F.col("value") != "")).alias("flat"))
    e = e.join(shape, ["catalog", "key", "language"], "left")
    if substitutions is not None:
        e = e.join(substitutions.groupBy("catalog", "key", "language").agg(F.collect_set("sub_name").alias("made")), ["catalog", "key", "language"], "left")
    else:
        e = e.withColumn("made", F.lit(None).cast("array<string>"))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    sub = F.col("path").startswith("substitutions.")
    mine = F.coalesce(F.array_contains("all", F.col("key")), F.lit(False))
    refused = (
        F.when(F.upper("value") == "TODO", "todo")
        .when(F.col("held").isNotNull() & ~mine, "case-conflict")
        .when(F.col("held").isNull() & (F.col("lead") != F.col("key")), "case-conflict")
        .when(sub & ~F.coalesce(F.array_contains("made", F.regexp_extract("path", r"^substitutions\.([^.]+)\.", 1)), F.lit(False)), "no-substitution")
        .when(sub | F.col("path").startswith("device."), None)
        .when(F.col("made").isNotNull() & F.lit(not flatten), "has-substitutions")
        .when((F.col("path") == "") & yes("varied") & F.lit(not flatten), "has-variations")
        .when((F.col("path") != "") & yes("flat"), "has-text")
    )
    old = units.select(*UNIT, F.col("value").alias("old"))
    e = e.withColumn("refused", refused).withColumn("refused", F.max("refused").over(W.partitionBy("catalog", "key", "language"))).join(old, UNIT, "left")
    action = F.when(F.col("refused").isNotNull(), F.concat(F.lit("refused: "), "refused")).when(F.col("old").isNull(), "created").when(F.col("old") == F.col("value"), "unchanged").otherwise("updated")
    return e.select(*UNIT, "value", "state", action.alias("action"))


def apply_plan(units: DataFrame, plan: DataFrame) -> DataFrame:
    """units with the plan's accepted edits merged in: (catalog, key, language, path, value, state). A flat text that was accepted over
    variations (flatten) removes them; a device's text removes a flat one."""
    done = plan.where("action in ('created', 'updated')").select(*UNIT, F.col("value").alias("new"), F.col("state").alias("new_state"))
    flat = done.where("path = ''").select("catalog", "key", "language").distinct()
    device = done.where("startswith(path, 'device.')").select("catalog", "key", "language").distinct()
    kept = units.select(*UNIT, "value", "state").join(flat.withColumn("cut", F.lit(True)), ["catalog", "key", "language"], "left").where("path = '' or cut is null").drop("cut")
    kept = kept.join(device.withColumn("cut", F.lit(True)), ["catalog", "key", "language"], "left").where("path <> '' or cut is null").drop("cut")
    return kept.join(done, UNIT, "full").select(*UNIT, F.coalesce("new", "value").alias("value"), F.coalesce("new_state", "state").alias("state"))


def counts(plan: DataFrame) -> DataFrame:
    return plan.groupBy("action").agg(F.count("*").alias("n"))


def register(keys: DataFrame, wanted: DataFrame) -> DataFrame:
    """keys(catalog, key, comment) with the wanted ones inserted where absent; a comment is set where the new one has one."""
    new = wanted.select("catalog", "key", F.col("comment").alias("new")).distinct()
    return keys.join(new, ["catalog", "key"], "full").select("catalog", "key", F.coalesce("new", "comment").alias("comment"))


def prune(keys: DataFrame, orphans: DataFrame, most: float = 0.25) -> DataFrame:
    """keys without the orphans; where they are more than `most` of all keys nothing is removed. Both (catalog, key)."""
    o = orphans.select("catalog", "key").distinct()
    totals = keys.agg(F.count("*").alias("n")).crossJoin(o.agg(F.count("*").alias("m")))  # a row each
    marked = keys.join(o.withColumn("gone", F.lit(True)), ["catalog", "key"], "left").crossJoin(F.broadcast(totals))
    return marked.where(F.col("gone").isNull() | (F.col("m") / F.greatest(F.lit(1), "n") > most)).select(keys.columns)


def rename(units: DataFrame, old: str, new: str, sources: DataFrame) -> DataFrame:
    """units with key `old` called `new`. Where it had no text of its source language, the old key becomes that text, so what users see stays.
    Refused (ValueError) where `new`, or a key that differs from it in case alone, exists."""
    taken = units.where((F.lower("key") == new.lower()) & (F.col("key") != old)).select("key").limit(1).collect()
    if taken:
        raise ValueError(f"the key {taken[0][0]!r} exists")
    hit = units.where(F.col("key") == old)
    own = hit.select("catalog").distinct().join(sources, "catalog")
    lacking = own.join(hit.select("catalog", F.col("language").alias("source_language")).distinct(), ["catalog", "source_language"], "left_anti")
    added = lacking.select("catalog", F.lit(new).alias("key"), F.col("source_language").alias("language"), F.lit("").alias("path"), F.lit(old).alias("value"), F.lit("translated").alias("state"))
    return units.select(*UNIT, "value", "state").withColumn("key", F.when(F.col("key") == old, new).otherwise(F.col("key"))).unionByName(added)


def splice(files: DataFrame, edits: DataFrame) -> DataFrame:
    """files(file, text) with edits(file, start, stop, replacement) put in, offsets in UTF-8 bytes, back to front: (file, text)."""
    both = files.join(edits.groupBy("file").agg(F.collect_list(F.struct("start", "stop", "replacement")).alias("edits")), "file")

    @F.pandas_udf("string")
    def apply(text: pd.Series, rows: pd.Series) -> pd.Series:
        out = []
        for t, es in zip(text, rows):
            data = t.encode()
            for e in sorted(es, key=lambda e: -e["start"]):
                data = data[: e["start"]] + e["replacement"].encode() + data[e["stop"] :]
            out.append(data.decode())
        return pd.Series(out)

    return both.select("file", apply("text", "edits").alias("text"))
