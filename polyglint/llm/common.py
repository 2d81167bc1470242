"""What the operators of this subpackage share: the cluster's shared folder, a columnar
tokenizer and hashing, and routing of packed arrays to blocks.

A *token* is a whitespace-separated word, lower-cased, with everything but letters and
digits removed; words left empty are dropped. Null texts count as empty texts.
"""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
SLICE_BYTES = 8 << 20  # text handled at once by a Python worker: bounds its memory, not its input


def shared_root(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or a temporary one where that is unset and there is this machine only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if root is None:
        current = sc.getCheckpointDir()
        if current is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="polyglint-"))
            current = sc.getCheckpointDir()
        return current
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


def shared_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_root(spark).rstrip('/')}/polyglint/{tag}-{uuid.uuid4().hex}"


#: Parquet otherwise looks at a page's and a row group's size every 100 rows, which for cells of MBs come to far more than a task can hold.
PACKED = {"parquet.page.size.row.check.min": 1, "parquet.block.size.row.check.min": 1, "parquet.block.size": 16 << 20}


def shared_table(df: DataFrame, tag: str, packed: bool = False) -> DataFrame:
    """Write a frame to the shared folder and read it again: cuts lineage, survives executors. packed: its cells are large."""
    path = shared_path(df.sparkSession, tag)
    df.write.options(**(PACKED if packed else {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete a shared_table() that nothing reads any more."""
    jvm = df.sparkSession.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def in_small_batches(operator):
    """What operator(docs, ...) runs itself gets Arrow batches of about SLICE_BYTES. Otherwise a batch is all texts of a task, which
    the JVM holds outside of its heap, twice over as buffers grow, and the Python worker beside the slice at hand."""

    @functools.wraps(operator)
    def run(docs: DataFrame, *args, **kwargs):
        spark, name = docs.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
        conf, before = spark.conf, spark.conf.get(name)
        if 0 < spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() <= SLICE_BYTES:
            return operator(docs, *args, **kwargs)
        conf.set(name, str(SLICE_BYTES))
        try:
            return operator(docs, *args, **kwargs)
        finally:
            conf.set(name, before)

    return run


def n_blocks(spark: SparkSession) -> int:
    """Blocks follow spark.sql.shuffle.partitions, which is sized with the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def to_blocks(df: DataFrame, column: str = "block") -> DataFrame:
    """One partition a block."""
    return df.repartitionById(n_blocks(df.sparkSession), F.col(column))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that are read; rows without an id can't be named in a result and are left out."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")


def unused(df: DataFrame, name: str) -> str:
    """The name, with as many underscores after it as make it no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def join_checked(big: DataFrame, small: DataFrame, on, how: str, most_rows: int = 500_000) -> DataFrame:
    """Join a table of texts with a narrow one. The narrow side is stored and counted; up to most_rows it is broadcast, so
    texts stay where they are; beyond that both sides are shuffled and merged. The result is the same."""
    small = checkpointed(small)
    n = small.limit(most_rows + 1).count()
    return big.join(F.broadcast(small) if n <= most_rows else small.hint("merge"), on(small) if callable(on) else on, how)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, over an array."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def hash_text(words) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), dtype=U64, count=len(words))


def block_of(h: np.ndarray, blocks: int) -> np.ndarray:
    """A block for each hash, in the order of the hashes: its leading 32 bits, scaled."""
    return ((h >> U64(32)) * U64(blocks)) >> U64(32)


def trim() -> None:
    """Give freed memory back to the system: Python workers live on between stages, beside the JVM."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def keep_memory() -> None:
    """For work on arrays of some 100 KB, made again and again: the C library keeps up to 16 MB that are freed, and maps arrays of 4 MB
    and more by themselves. Otherwise it may give each array back to the system, and getting its pages again takes half as long as the work."""
    if _SET:
        _SET(-3, 4 << 20)  # M_MMAP_THRESHOLD
        _SET(-1, 16 << 20)  # M_TRIM_THRESHOLD


try:
    _TRIM, _SET = ctypes.CDLL(None).malloc_trim, ctypes.CDLL(None).mallopt
except (AttributeError, OSError):  # another C library
    _TRIM = _SET = None


def slices(batches, max_bytes: int = SLICE_BYTES):
    """Arrow batches cut so that each piece holds about max_bytes of text (one text at least)."""
    for batch in batches:
        at = batch.schema.get_field_index("text")
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        total = np.cumsum(lengths)
        start = 0
        while start < batch.num_rows:
            base = total[start - 1] if start else 0
            stop = min(max(start + 1, int(np.searchsorted(total, base + max_bytes, side="right"))), start + 65_535)
            yield batch.slice(start, stop - start)
            start = stop
    trim()


def tokenize(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each token, index of its text), in the order of the texts."""
    words = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    counts = np.diff(np.asarray(words.offsets))
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), counts)
    coded = words.flatten().dictionary_encode()
    cleaned = pc.replace_substring_regex(coded.dictionary, r"[^\pL\pN]+", "").to_pylist()
    hashes = hash_text(cleaned)
    kept = np.fromiter((bool(w) for w in cleaned), dtype=bool, count=len(cleaned))
    codes = np.asarray(coded.indices)
    keep = kept[codes] if len(codes) else np.zeros(0, bool)
    return (hashes[codes[keep]] if len(codes) else np.zeros(0, U64)), doc[keep]


def by_doc(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Positions sorted by text, then key."""
    order = np.argsort(key, kind="stable")
    narrow = doc.astype(np.uint16) if len(doc) and doc.max() < 65536 else doc
    return order[np.argsort(narrow[order], kind="stable")]


def runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
    return starts, np.diff(np.append(starts, len(sorted_keys)))


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start+1, ... for every start, as many as its count."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - counts), counts)


def as_batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    arrays = []
    for f in schema:
        v = columns[f.name]
        arrays.append(v if isinstance(v, pa.Array) else pa.array(v, type=f.type))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(U64, copy=False).view(np.int64)


def concat(batches, column: str, dtype) -> np.ndarray:
    """The arrays that the binary cells of one column hold, end to end."""
    parts = [np.frombuffer(c.as_buffer(), dtype=dtype) for b in batches for c in b.column(b.schema.get_field_index(column))]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (u, v): (node, root), root the least node of the component.

    Rounds of least-label hooking and pointer jumping, each cut off by a checkpoint; nodes
    without an edge don't appear.
    """
    both = checkpointed(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    label = checkpointed(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("root")))
    while True:
        near = both.join(label.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("root").alias("near"))
        hooked = label.join(near, "node").select("node", "root", F.least("root", "near").alias("low"))
        up = hooked.select(F.col("node").alias("low"), F.col("low").alias("up"))
        following = checkpointed(hooked.join(up, "low", "left").select("node", F.col("root").alias("old"), F.least("low", F.coalesce("up", "low")).alias("root")))
        if following.where("old <> root").isEmpty():
            return following.select("node", "root")
        label = following.select("node", "root")
