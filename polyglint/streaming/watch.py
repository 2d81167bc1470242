"""An extension: check catalogs as they arrive in a directory. The checks themselves are batch operators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.catalogs import _NAMES, ROW, flatten


def catalog_stream(spark: SparkSession, root: str) -> DataFrame:
    """Tagged rows (sources.catalogs) of every catalog file that appears below root."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xcstrings").load(root)

    def parse(batches):
        for b in batches:
            rows = [r for path, data in zip(b["path"], b["content"]) for r in flatten(path, bytes(data))]
            if rows:
                yield pd.DataFrame(rows, columns=_NAMES)

    return files.select("path", "content").mapInPandas(parse, ROW)


def watch(spark: SparkSession, root: str, check, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Run check(rows) -> findings on each arrival and append the findings to Parquet at out, once each: a batch that is replayed replaces its own."""

    def batch(rows: DataFrame, number: int) -> None:
        check(rows).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return catalog_stream(spark, root).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
