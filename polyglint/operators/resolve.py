"""Strings of the source code against catalogs: resolution, absence, orphans, lookup, line positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T


def reachable(target_catalogs: DataFrame, targets: DataFrame, tables: DataFrame) -> DataFrame:
    """(target, table_name, catalog, ord): catalogs a target reaches, its own before others; an inferred target reaches all.
    target_catalogs(target, ord, catalog), targets(target, inferred), tables(catalog, table_name)."""
    own = target_catalogs.select("target", "catalog", "ord")
    others = targets.where("inferred").select("target").crossJoin(tables.select("catalog")).join(own, ["target", "catalog"], "left_anti").withColumn("ord", F.lit(1 << 30))
    return own.unionByName(others.select("target", "catalog", F.col("ord").cast("int"))).join(tables, "catalog").select("target", "table_name", "catalog", "ord")


def resolve(found: DataFrame, reach: DataFrame, keys: DataFrame) -> DataFrame:
    """found(target, table_name, value) with the catalog whose key it is, the first reachable one: null where none. keys(catalog, key)."""
    strings = found.select("target", "table_name", "value").distinct()
    hit = strings.join(reach, ["target", "table_name"]).join(keys.select("catalog", F.col("key").alias("value")), ["catalog", "value"])
    best = hit.groupBy("target", "table_name", "value").agg(F.min_by("catalog", F.struct("ord", "catalog")).alias("catalog"))
    return strings.join(best, ["target", "table_name", "value"], "left")


def resolve_patterns(patterns: DataFrame, keys: DataFrame) -> DataFrame:
    """patterns(pattern, head) of interpolated strings, matched whole against keys with specifiers: (pattern, key), the lowest key.
    head: the literal text a pattern begins with; keys of another beginning aren't tried. Pairs meet on the first two characters of
    the head where it has them, so only patterns that begin with a placeholder are tried on all keys."""
    p, k = patterns.select("pattern", F.left("head", F.lit(2)).alias("h")).distinct(), keys.select("key").distinct()
    led = p.where("length(h) = 2")
    near = led.join(k.withColumn("h", F.left("key", F.lit(2))), "h")
    any_ = p.where("length(h) < 2").join(k, F.lit(True), "inner")
    both = near.select("pattern", "key").unionByName(any_.select("pattern", "key"))
    return both.where("key rlike concat('^(?:', pattern, ')$')").groupBy("pattern").agg(F.min("key").alias("key"))


def unreferenced(keys: DataFrame, used: DataFrame) -> DataFrame:
    """Keys that no used value equals."""
    return keys.join(used.select(F.col("value").alias("key")).distinct(), "key", "left_anti")


def orphans(keys: DataFrame, texts: DataFrame) -> DataFrame:
    """Keys that occur in no text as a substring. keys(id, key), texts(text).

    A word inside a key, with white space on either side, is a whole word of every text that has the key, so
    keys and texts meet on the key's longest inner word and only those pairs are searched. Keys of one or two
    words have no inner word and are compared with all texts.
    """
    words = F.split("key", r"\s+")
    inner = keys.withColumn("w", F.when(F.size(words) > 2, F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(1)))))
    long_ = inner.where("w is not null").withColumn("w", F.element_at(F.array_sort("w", lambda x, y: F.length(y) - F.length(x)), 1))
    wanted = long_.select("w").distinct()
    named = texts.where("text is not null").select("text", F.xxhash64("text").alias("t"))  # texts travel once, their words as pairs of numbers and words
    places = named.select("t", F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("w")).join(wanted, "w", "left_semi").distinct()
    tried = long_.join(places, "w").select("id", "key", "t")
    found = tried.join(named, "t").where("contains(text, key)").select("id").distinct()
    short_found = inner.where("w is null").join(texts, F.expr("contains(text, key)"), "left_semi").select("id")
    return keys.join(found.union(short_found), "id", "left_anti")


def lookup(queries: DataFrame, keys: DataFrame, top_contains: int = 10, top_similar: int = 8, least: int = 60) -> DataFrame:
    """queries(query) in keys(catalog, key): (query, catalog, tier, key, rank). The first tier that a catalog answers: exact, case;
    else what contains the query (shortest first) and what is similar (most alike first), both ranked. The queries are few, and typed."""
    q, k = queries.select("query").distinct(), keys.select("catalog", "key").distinct()
    equal = k.join(q, F.lower("key") == F.lower("query")).withColumn("tier", F.when(F.col("key") == F.col("query"), "exact").otherwise("case"))
    first = equal.groupBy("query", "catalog").agg(F.min(F.when(F.col("tier") == "exact", 0).otherwise(1)).alias("best"))
    top = equal.join(first, ["query", "catalog"]).where(F.col("best") == F.when(F.col("tier") == "exact", 0).otherwise(1)).withColumn("rank", F.row_number().over(W.partitionBy("query", "catalog").orderBy("key")))
    rest = k.crossJoin(q).join(first, ["query", "catalog"], "left_anti")
    inside = rest.where("contains(lower(key), lower(query))").withColumn("rank", F.row_number().over(W.partitionBy("query", "catalog").orderBy(F.char_length("key"), "key"))).where(F.col("rank") <= top_contains).withColumn("tier", F.lit("contains"))
    percent = T.similarity(F.lower("key"), F.lower("query"))
    similar = rest.where("not contains(lower(key), lower(query))").withColumn("p", percent).where(F.col("p") >= least).withColumn("rank", F.row_number().over(W.partitionBy("query", "catalog").orderBy(F.desc("p"), "key"))).where(F.col("rank") <= top_similar).withColumn("tier", F.lit("similar"))
    out = ["query", "catalog", "tier", "key", "rank"]
    return top.select(out).unionByName(inside.select(out)).unionByName(similar.select(out))


def line_index(files: DataFrame, key_pattern: str) -> DataFrame:
    """files(file, text) -> (file, key, line): the first line, from 1, where each key is declared. key_pattern has the key in group 1."""
    lines = files.select("file", F.posexplode(F.split("text", r"\R")).alias("at", "content"))
    hit = lines.select("file", (F.col("at") + 1).alias("line"), F.regexp_extract("content", key_pattern, 1).alias("key")).where("key <> ''")
    return hit.groupBy("file", "key").agg(F.min("line").alias("line"))


def locate(findings: DataFrame, index: DataFrame) -> DataFrame:
    """findings(file, key, line, ...) with the line of their key where they have none."""
    at = index.select("file", "key", F.col("line").alias("_line"))
    return findings.join(at, ["file", "key"], "left").withColumn("line", F.coalesce("line", "_line")).drop("_line")


def rename_sites(occurrences: DataFrame, literals: DataFrame) -> DataFrame:
    """occurrences(file, line, value) with the literal they are, (start, stop); skipped says why not: 'ambiguous' where the line has several, 'missing' where none."""
    n = literals.groupBy("file", "line", "value").agg(F.count("*").alias("n"), F.min("start").alias("start"), F.min("stop").alias("stop"))
    joined = occurrences.join(n, ["file", "line", "value"], "left")
    one = F.col("n") == 1
    return joined.select("file", "line", "value", F.when(one, F.col("start")).alias("start"), F.when(one, F.col("stop")).alias("stop"), F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "ambiguous").alias("skipped"))
