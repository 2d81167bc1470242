"""Exact dedup against a persistent digest index, bucketed and sorted by hash.

The index is a table of SHA-256 digests on the shared folder, hash-bucketed and sorted by digest,
so the anti-join of new data against it is a sort-merge join that doesn't move the index. Its number of
buckets is stored beside it, in _polyglint.json, and holds whatever a later session asks for. New digests are
appended in the same buckets, with the batch they came in; later loads see them. A batch is appended in one
commit, and doing a batch of the same name again gives the same rows again, so a job that died half-way may be repeated.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import n_blocks, shared_path, shared_table


class DigestIndex:
    """The index at a path. The catalog entry is made anew in each session; the files, and the number of buckets, persist.

    buckets counts for a new index only; asking for another number than an index has is an error. close() takes the catalog entry away again.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.name = f"digest_index_{uuid.uuid5(uuid.NAMESPACE_URL, self.path).hex}"
        self.buckets = self._buckets(buckets)
        spark.sql(f"create table if not exists {self.name} (digest binary, doc_id bigint, batch string) using parquet clustered by (digest) sorted by (digest) into {self.buckets} buckets location '{self.path}'")

    def _buckets(self, asked: int | None) -> int:
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        file = jvm.org.apache.hadoop.fs.Path(folder, "_polyglint.json")
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(file):
            stream = fs.open(file)
            try:
                had = json.loads(bytes(stream.readAllBytes()))["buckets"]
            finally:
                stream.close()
            if asked not in (None, had):
                raise ValueError(f"the index at {self.path} has {had} buckets, not {asked}")
            return had
        if fs.exists(folder) and any(not f.getPath().getName().startswith(("_", ".")) for f in fs.listStatus(folder)):
            raise ValueError(f"{self.path} holds files but no index's description")
        fs.mkdirs(folder)
        made = asked or n_blocks(self.spark)
        stream = fs.create(file, False)  # fails where another session was first
        try:
            stream.write(json.dumps({"buckets": made, "digest": "sha-256"}).encode())
        finally:
            stream.close()
        return made

    def table(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def unseen(self, digests: DataFrame, batch: str | None = None) -> DataFrame:
        """The digests that no other batch than this one brought."""
        known = self.table() if batch is None else self.table().where(F.col("batch") != batch)
        return digests.hint("merge").join(known.select("digest").hint("merge"), "digest", "left_anti")

    def append(self, digests: DataFrame, batch: str | None = None) -> None:
        """Add digests, one commit for all; those that the batch has brought before are left as they are."""
        batch = batch or uuid.uuid4().hex
        rows = digests.select("digest", "doc_id")
        if not self.table().where(F.col("batch") == batch).isEmpty():
            rows = rows.hint("merge").join(self.table().where(F.col("batch") == batch).select("digest").hint("merge"), "digest", "left_anti")
        rows.withColumn("batch", F.lit(batch)).select("digest", "doc_id", "batch").repartition(self.buckets, "digest").write.insertInto(self.name)

    def close(self) -> None:
        self.spark.sql(f"drop table if exists {self.name}")


def digest(text: str = "text"):
    return F.unhex(F.sha2(F.col(text).cast("string").cast("binary"), 256))


def new_documents(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """(doc_id, digest, n_copies): for each text that the index lacks, its least doc_id and how many rows of docs have it. Appends them to the index.

    Equal means equal byte for byte, the empty text too. A null text has no digest: such rows aren't
    duplicates of anything and aren't returned here. Null doc_ids are passed over where another
    copy has one. Rows that repeat count as copies. An empty table gives no rows; extra columns aren't
    read. batch names the load: repeated under its name, it finds what it found the first time.
    """
    first = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest().alias("digest")).where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_copies"))
    fresh = shared_table(index.unseen(first, batch), "fresh")
    index.append(fresh, batch)
    return fresh.select("doc_id", F.lower(F.hex("digest")).alias("digest"), "n_copies")


def exact_dedup(docs: DataFrame, index_path: str | None = None, buckets: int | None = None, batch: str | None = None) -> DataFrame:
    """new_documents() against the index at index_path, a new one in the shared folder by default."""
    spark = docs.sparkSession
    index = DigestIndex(spark, index_path or shared_path(spark, "digests"), buckets)
    try:
        return new_documents(docs, index, batch)
    finally:
        index.close()


def two_loads(docs: DataFrame) -> DataFrame:
    """exact_dedup() of the documents of odd doc_id, then of all others against the index that the first load left: (load, doc_id, digest, n_copies).
    A null doc_id goes with the second load."""
    path, odd = shared_path(docs.sparkSession, "digests"), F.coalesce(F.pmod(F.col("doc_id").cast("long"), F.lit(2)) == 1, F.lit(False))
    first, second = (exact_dedup(docs.where(part), path, batch=str(k)).select(F.lit(k).alias("load"), "*") for k, part in ((1, odd), (2, ~odd)))
    return first.union(second)


def keep_first(docs: DataFrame, index_path: str | None = None) -> DataFrame:
    """The rows of docs, all columns, of which each text that is new to the index stays once: the row of least doc_id
    (nulls last, then the least other columns that can be ordered). Rows of null text all stay; an empty table stays empty."""
    spark = docs.sparkSession
    index = DigestIndex(spark, index_path or shared_path(spark, "digests"))
    rank = [F.col("doc_id").isNull(), F.col("doc_id")] + [F.col(f"`{c}`") for c, kind in docs.dtypes if c not in ("doc_id", "text") and not any(k in kind for k in ("map", "variant", "interval"))]
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    kept = docs.where("text is not null").select(digest().alias("digest"), row.alias("row"), F.struct(*rank).alias("rank")).groupBy("digest").agg(F.min_by("row", "rank").alias("row"))
    fresh = shared_table(index.unseen(kept), "fresh-rows")
    index.append(fresh.select("digest", F.col("row.doc_id").cast("long").alias("doc_id")))
    index.close()
    return fresh.select("row.*").union(docs.where("text is null"))
