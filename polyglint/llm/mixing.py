"""Mixing sources to target weights by pivotal dependent rounding.

A document of source s should appear c = w_s T / m_s times, w_s the source's target weight, m_s its
mass in characters and T the mass of the whole. Its whole copies are certain; the fractional parts
are rounded together: two fractional probabilities meet, mass is moved between them at random, and
one becomes 0 or 1, until a group is left with one residual. Residuals meet again in a reduction
tree, within the source first and across sources last, so every source's copies, and the total,
come out within one of what was asked, and each document's expectation is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, checkpointed, mix, shared_table, unused

LEAF, FAN_IN, EPS = 20_000, 64, 1e-9


def draw(a: np.ndarray, b: np.ndarray, level: int, seed: int) -> np.ndarray:
    """Uniform numbers that depend on who meets, where and the seed alone."""
    with np.errstate(over="ignore"):
        salt = mix(np.array([level], U64) * U64(0xD6E8FEB86659FD93) + np.array([seed & (2**64 - 1)], U64))
        return (mix(mix(mix(a.astype(np.int64).view(U64)) + salt) * U64(0x9E3779B97F4A7C15) + b.astype(np.int64).view(U64)) >> U64(11)) * 2.0**-53


def pivotal(ids: np.ndarray, ps: np.ndarray, level: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Round the probabilities by pairs of neighbours, those left over again by pairs, until one at most is left:
    (0 or 1 for each, -1 for the one left; the probability of the one left, 0 elsewhere)."""
    ids, p = np.asarray(ids, np.int64), np.array(ps, float)
    turn = 0
    while True:
        open_ = np.flatnonzero((p > EPS) & (p < 1 - EPS))
        if len(open_) < 2:
            break
        a, b = open_[: len(open_) // 2 * 2 : 2], open_[1 : len(open_) // 2 * 2 : 2]
        x, y, total, u = p[a], p[b], p[a] + p[b], draw(ids[a], ids[b], 64 * level + turn, seed)
        low = total <= 1
        # up to 1 the winner takes all the mass; beyond, the winner is filled to 1 and the other keeps the rest
        first = np.where(low, u * total < x, u * (2 - total) < 1 - y)
        p[a] = np.where(low, np.where(first, total, 0.0), np.where(first, 1.0, total - 1))
        p[b] = np.where(low, np.where(first, 0.0, total), np.where(first, total - 1, 1.0))
        turn += 1
    up = (p > 0.5).astype(np.int32)
    up[open_] = -1
    rest = np.zeros(len(p))
    rest[open_] = p[open_]
    return up, rest


_ROUND = "source string, doc_id long, uid long, up int, p double"


def _round(level: int, seed: int, last: bool):
    def work(t: pa.Table) -> pa.Table:
        uid, doc = np.asarray(t.column("uid")), np.asarray(t.column("doc_id"))
        order = np.lexsort((doc, uid))
        up, rest = pivotal(uid[order], np.asarray(t.column("p"))[order], level, seed)
        if last:  # the one residual of the whole is drawn alone
            k = np.flatnonzero(up < 0)
            up[k], rest[k] = draw(uid[order][k], np.full(len(k), -1), 64 * level + 63, seed) < rest[k], 0
        return pa.table({"source": t.column("source").take(pa.array(order)), "doc_id": pa.array(doc[order], pa.int64()), "uid": pa.array(uid[order], pa.int64()), "up": pa.array(up, pa.int32()), "p": pa.array(rest, pa.float64())})

    return work


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, size: float = 1.0, seed: int = 17) -> DataFrame:
    """One row for each document: doc_id, source, expected (copies asked for), copies (drawn).

    weights: target share of characters by source, scaled to sum to 1; sources without one get 0.
    None asks for shares in proportion to the square root of each source's characters. size: mass of
    the mix as a multiple of the input's. A null source is the source ''. A null or empty text has
    no mass; it gets its source's rate like any other, but where a whole source has none its
    documents get no copy. Rows that repeat a doc_id within a source are one document; rows without
    doc_id are left out. An empty table gives no rows. Extra columns aren't read. Draws depend on
    ids, seed and table size only, so a rerun gives the same.
    """
    mass = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.coalesce(F.length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("mass")).where("doc_id is not null")
    rows = shared_table(mass.groupBy("doc_id", "source").agg(F.max("mass").alias("mass")), "mass")
    per = checkpointed(rows.groupBy("source").agg(F.sum("mass").alias("mass_s"), F.count("*").alias("n_s")))
    if weights is None:
        per = per.withColumn("w", F.sqrt(F.col("mass_s").cast("double")))
    else:
        pairs = [(k, float(v)) for k, v in weights.items()]
        known = docs.sparkSession.createDataFrame(pairs, "source string, w double")
        per = per.join(known, "source", "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    total = per.agg(F.sum("mass_s").alias("m"), F.sum("w").alias("w")).first()
    rate = F.when(F.col("mass_s") > 0, F.col("w") / F.lit(float(total["w"] or 1) or 1.0) * F.lit(float(total["m"] or 0) * size) / F.col("mass_s")).otherwise(0.0)
    rates = checkpointed(per.select("source", rate.alias("expected"), F.ceil(F.col("n_s") / LEAF).alias("leaves")))
    uid = F.xxhash64("doc_id", "source")
    asked = rows.join(rates, "source").withColumn("uid", uid)
    frac = asked.select("source", "doc_id", "uid", (F.col("expected") - F.floor("expected")).alias("p"), F.pmod(F.xxhash64(F.lit(seed), "uid"), F.col("leaves")).alias("cell"))
    widest = rates.agg(F.max("leaves")).first()[0] or 1
    level, settled = 0, []
    while True:
        across = widest == 0
        keys = [F.lit(0).alias("one")] if across else [F.col("source"), F.col("cell")]
        done = shared_table(frac.groupBy(*keys).applyInArrow(_round(level, seed, across), _ROUND), f"round-{level}")
        settled.append(done.where("up >= 0").select("source", "doc_id", "up"))
        if across:
            break
        widest = 0 if widest <= 1 else -(-widest // FAN_IN)
        level += 1
        cells = F.greatest(F.lit(1), F.ceil(F.col("leaves") / float(FAN_IN**level)))
        frac = done.where("up < 0").join(rates.select("source", "leaves"), "source").select("source", "doc_id", "uid", "p", F.pmod(F.xxhash64(F.lit(seed + level), "uid"), cells).alias("cell"))
    ups = settled[0]
    for s in settled[1:]:
        ups = ups.union(s)
    out = asked.select("doc_id", "source", "expected").join(ups, ["doc_id", "source"])
    return out.select("doc_id", "source", "expected", (F.floor("expected") + F.col("up")).cast("long").alias("copies"))


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, size: float = 1.0, seed: int = 17) -> DataFrame:
    """The rows of docs that get a copy at all by mix_sources(), all columns, with the number of copies in the added column mix_copies,
    which takes the place of an input column of that name.

    Rows of null doc_id can't be drawn and are left out. A null source is the source ''. Rows that repeat a doc_id within a source are
    one document: each of them comes with its copies. Texts that are null or empty get their source's rate. An empty table gives no rows.
    """
    if "mix_copies" in docs.columns:
        docs = docs.drop("mix_copies")
    one, two = unused(docs, "_mix_id"), unused(docs, "_mix_source")
    drawn = mix_sources(docs, weights, size, seed).where("copies > 0").select(F.col("doc_id").alias(one), F.col("source").alias(two), F.col("copies").alias("mix_copies"))
    on = (F.col("doc_id").cast("long") == F.col(one)) & (F.coalesce(F.col("source").cast("string"), F.lit("")) == F.col(two))
    return docs.join(drawn, on).drop(one, two)
