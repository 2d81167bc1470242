"""Repeated windows of tokens, routed to blocks in segments, and their union as spans.

A window is K tokens in a row of one document. Windows that follow each other under one anchor, a
hash that depends on the window's content alone, form a segment; a segment travels to its anchor's
block, so equal windows always meet. Blocks answer with the windows that an earlier place (lower
doc_id, or lower position in it) has too; spans are the unions of those windows by document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import U64, block_of, mix, spread

K = 50
HITS = "doc_id long, start long, stop long, first_doc_id long, first_start long"
HIT_SCHEMA = pa.schema([(k, pa.int64()) for k in ("doc_id", "start", "stop", "first_doc_id", "first_start")])
ROW = "block int, anchor binary, doc binary, start binary, windows binary, flag binary, content binary"
ROW_SCHEMA = pa.schema([("block", pa.int32())] + [(k, pa.binary()) for k in ("anchor", "doc", "start", "windows", "flag", "content")])


def segments(anchor: np.ndarray, windows: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, anchor) of each run of adjacent windows with one anchor. windows: the valid ones' positions; anchor: theirs."""
    if not len(windows):
        return windows, windows, anchor
    new = np.concatenate([[True], (np.diff(windows) != 1) | (anchor[1:] != anchor[:-1]) | (doc[windows[1:]] != doc[windows[:-1]])])
    at = np.flatnonzero(new)
    return windows[at], np.diff(np.append(at, len(windows))), anchor[at]


def rows_by_block(blocks: int, anchor, doc_id, start, windows, flag, content, size, pack):
    """A packed row for each block. content: array whose pieces of `size` elements belong to the segments, in order; pack: bytes of such."""
    route = mix(anchor)  # anchors are minima, so small; blocks must be even
    order = np.argsort(route, kind="stable")
    edges = np.searchsorted(block_of(route[order], blocks), np.arange(blocks + 1, dtype=U64))
    offsets = np.concatenate([[0], np.cumsum(size)])
    out = {k: [] for k in ROW_SCHEMA.names}
    for k in np.flatnonzero(np.diff(edges)):
        part = order[edges[k] : edges[k + 1]]
        data = pack(content[spread(offsets[part], size[part])])
        for name, v in (("block", int(k)), ("anchor", anchor[part].tobytes()), ("doc", doc_id[part].astype(np.int64).tobytes()), ("start", start[part].astype(np.int64).tobytes()), ("windows", windows[part].astype(np.uint32).tobytes()), ("flag", flag[part].astype(np.uint8).tobytes()), ("content", data)):
            out[name].append(v)
    return pa.RecordBatch.from_pydict({f.name: pa.array(out[f.name], f.type) for f in ROW_SCHEMA}, schema=ROW_SCHEMA)


def hits(doc, start, seen, segment, first_doc, first_start, length):
    """Runs of flagged windows as a batch of HITS. All arrays are by window, in the segments' order; length: tokens from the window's start that are repeated."""
    at = np.flatnonzero(seen)
    if not len(at):
        return pa.RecordBatch.from_pydict({k: pa.array([], pa.int64()) for k in HIT_SCHEMA.names}, schema=HIT_SCHEMA)
    new = np.concatenate([[True], (np.diff(at) != 1) | (segment[at[1:]] != segment[at[:-1]])])
    head = np.flatnonzero(new)
    stop = np.maximum.reduceat(start[at] + length[at], head)
    a = at[head]
    return pa.RecordBatch.from_pydict({"doc_id": pa.array(doc[a]), "start": pa.array(start[a]), "stop": pa.array(stop), "first_doc_id": pa.array(first_doc[a]), "first_start": pa.array(first_start[a])}, schema=HIT_SCHEMA)


def union_spans(found: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, first_doc_id, first_start): touching and overlapping hits of a document joined; first_*: the earliest place of the window at start."""
    w = W.partitionBy("doc_id").orderBy("start", "stop")
    before = F.max("stop").over(w.rowsBetween(W.unboundedPreceding, -1))
    island = F.sum(F.when(before >= F.col("start"), 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0))
    source = F.struct("first_doc_id", "first_start")
    return (
        found.withColumn("island", island).groupBy("doc_id", "island")
        .agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min_by(source, F.struct("start", "first_doc_id", "first_start")).alias("source"))
        .select("doc_id", "start", (F.col("stop") - F.col("start")).alias("n_tokens"), "source.first_doc_id", "source.first_start")
    )
