"""Views that shape the driver's tables like the engine's own relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def units(spark, sf_dir) -> DataFrame:
    """documents as flat units: catalog = source, language = lang, key = doc_id."""
    return table(spark, sf_dir, "documents").select(F.col("source").alias("catalog"), F.col("doc_id").cast("string").alias("key"), F.col("lang").alias("language"), F.lit("").alias("path"), F.col("text").alias("value"), F.lit("translated").alias("state"))


def turns(spark, sf_dir) -> DataFrame:
    """conversations as (source, translation): a user's turn and the turn after it."""
    c = table(spark, sf_dir, "conversations")
    a = c.where("role = 'user'").select("conv_id", F.col("turn").alias("turn"), F.col("text").alias("source"))
    b = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("translation"))
    return a.join(b, ["conv_id", "turn"]).select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("key"), "source", "translation")


#: With as many partitions at most, texts are shuffled without being held in memory (spark.shuffle.sort.bypassMergeThreshold).
STREAMED = 200


def neighbours(spark, sf_dir, features) -> DataFrame:
    """documents k and k + 1 as (source, translation), language from the second. features(text, language): what is kept of each text, as a struct.

    Texts are spread over tasks, whatever their file's row groups, read once, and never sorted or joined; k and k + 1 meet by what is kept."""
    n = min(STREAMED, int(spark.conf.get("spark.sql.shuffle.partitions")))
    d = table(spark, sf_dir, "documents").where("doc_id is not null").select("doc_id", "text", "lang").repartition(n, "doc_id")
    kept = d.select("doc_id", F.col("lang").alias("language"), features(F.col("text"), F.col("lang")).alias("of"))
    sides = F.array(
        F.struct(F.col("doc_id").alias("k"), F.struct(F.col("of")).alias("source"), F.when(F.lit(False), F.struct("language", "of")).alias("translation")),
        F.struct((F.col("doc_id") - 1).alias("k"), F.when(F.lit(False), F.struct(F.col("of"))).alias("source"), F.struct("language", "of").alias("translation")),
    )
    met = kept.select(F.explode(sides).alias("x")).select("x.*").groupBy("k").agg(F.collect_list("source").alias("s"), F.collect_list("translation").alias("t"))
    pairs = met.where((F.size("s") > 0) & (F.size("t") > 0)).select("k", F.explode("s").alias("s"), "t").select("k", "s", F.explode("t").alias("t"))
    return pairs.select(F.lit("documents").alias("catalog"), F.col("k").cast("string").alias("key"), F.col("t.language").alias("language"), F.lit("").alias("path"), F.col("s.of").alias("source"), F.col("t.of").alias("translation"))


def parts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part")


def part_texts(spark, sf_dir) -> DataFrame:
    """part as keys with texts: (catalog, key, text, language, value)."""
    return parts(spark, sf_dir).select(F.lit("part").alias("catalog"), F.col("p_partkey").cast("string").alias("key"), F.col("p_name").alias("text"), F.col("p_brand").alias("language"), F.col("p_type").alias("value"))


def brand_sizes(spark, sf_dir) -> DataFrame:
    return parts(spark, sf_dir).select(F.col("p_brand").alias("catalog"), F.col("p_size").cast("string").alias("language")).distinct()


def versions(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """events before and after the middle of their time as two versions: key = user_id, language = event_type, path '' with the last
    value in tens as text."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("language"), F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id", F.floor(F.col("value") / 10).cast("string").alias("value"))
    middle = F.expr("timestamp_ntz'2024-01-16 00:00:00'")
    return tuple(e.where(side).groupBy("key", "language").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value")).withColumn("path", F.lit("")) for side in (F.col("ts") < middle, F.col("ts") >= middle))
