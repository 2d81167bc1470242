"""Benchmark decontamination with a distributed positional inverted index.

The index is sharded by document, as search engines do: each piece of the training table becomes a
segment whose token postings, sorted by term and position, are stored in the shared folder as one
row for the segment: term hashes, where each term's postings end, the positions. Positions count
through the segment's texts, each with its own range. A segment answers
alone, so nothing is shuffled: the test items travel to it.

A query starts from the items' rarest terms, by document frequency over the whole index. Exact:
the rarest term's positions, less its offset in the item, are candidate starts; the next rarest
terms' lists, adjusted likewise, are intersected until all terms have been met. Proximity: a start
is a match where at least `coverage` of the item's tokens lie within `slack` of their place; since
at most (1 - coverage) of the tokens may be missing, candidates come from the lists of that many
rarest terms plus one, which loses none.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, as_batch, id_and_text, in_small_batches, join_checked, runs, shared_table, slices, spread, tokenize, trim, unused

COVERAGE, SLACK = 0.75, 3
ITEMS_AT_ONCE, BYTES_AT_ONCE = 20_000, 16 << 20  # items, and bytes of them, that are sent to the segments at once; more are taken in turns
GAP = 1  # between texts; a start is only ever compared with postings of its own text


@in_small_batches
def build_index(docs: DataFrame) -> DataFrame:
    """The stored index: a row for each segment (docs, starts, terms, ends, positions), all packed arrays."""
    schema = pa.schema([(k, pa.binary()) for k in ("docs", "starts", "terms", "ends", "positions")])

    def work(batches):
        for b in slices(batches):
            tok, doc = tokenize(b.column(1))
            first, lengths = runs(doc)
            gaps = np.zeros(b.num_rows, np.int64)
            gaps[doc[first]] = lengths
            starts = np.concatenate([[0], np.cumsum(gaps + GAP)])[:-1]
            where = np.arange(len(tok)) - np.repeat(first, lengths) + starts[doc]
            order = np.argsort(tok, kind="stable")
            at, n = runs(tok[order])
            yield as_batch(
                schema, docs=[np.asarray(b.column(0)).astype(np.int64).tobytes()], starts=[starts.tobytes()],
                terms=[tok[order][at].tobytes()], ends=[(at + n).astype(np.uint32).tobytes()], positions=[where[order].astype(np.uint32).tobytes()],
            )

    return shared_table(id_and_text(docs).mapInArrow(work, "docs binary, starts binary, terms binary, ends binary, positions binary"), "postings", packed=True)


class Items:
    """Test items as flat arrays: item ids, where each begins, its tokens' hashes and offsets."""

    def __init__(self, ids: list[int], texts: list[str]):
        tok, doc = tokenize(pa.array(texts, pa.string()))
        first, lengths = runs(doc)
        self.ids = np.array([ids[doc[f]] for f in first], np.int64)
        self.first, self.length, self.tok = first, lengths, tok
        self.offset = np.arange(len(tok)) - np.repeat(first, lengths)
        self.item = np.repeat(np.arange(len(first)), lengths)

    def by_rarity(self, terms: np.ndarray, df: np.ndarray) -> None:
        """Order each item's tokens from the rarest, ties by their offset."""
        at = np.searchsorted(terms, self.tok) if len(terms) else np.zeros(len(self.tok), np.int64)
        at = np.minimum(at, max(0, len(terms) - 1))
        freq = np.where(terms[at] == self.tok, df[at], 0) if len(terms) else np.zeros(len(self.tok), np.int64)
        self.rare = np.lexsort((self.offset, freq, self.item))


def term_frequency(index: DataFrame, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document frequency of the wanted terms over all segments."""
    sent = index.sparkSession.sparkContext.broadcast(wanted)

    def work(batches):
        want = sent.value
        total = np.zeros(len(want), np.int64)
        for b in batches:
            for starts, terms, ends, positions in zip(*(b.column(k) for k in range(4))):
                starts, terms = np.frombuffer(starts.as_buffer(), np.int64), np.frombuffer(terms.as_buffer(), U64)
                if not len(terms):
                    continue
                ends, positions = np.frombuffer(ends.as_buffer(), np.uint32).astype(np.int64), np.frombuffer(positions.as_buffer(), np.uint32)
                at = np.minimum(np.searchsorted(terms, want), len(terms) - 1)
                hit = np.flatnonzero(terms[at] == want)
                begins = np.concatenate([[0], ends[:-1]])[at[hit]]
                n = ends[at[hit]] - begins
                key = (np.repeat(hit, n) << 32) | np.searchsorted(starts, positions[spread(begins, n)], side="right")
                total += np.bincount(key[runs(key)[0]] >> 32, minlength=len(want))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": pa.array(some, pa.int64()), "df": pa.array(total[some], pa.int64())})

    rows = index.select("starts", "terms", "ends", "positions").mapInArrow(work, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()  # a row for a test term at most
    df = np.zeros(len(wanted), np.int64)
    for r in rows:
        df[r["term"]] = r["df"]
    return wanted, df


def answer(items: Items, docs, starts, terms, ends, positions, coverage: float, slack: int):
    """Matches within a segment: (index of the item, index of the text, start in the text, tokens met, exact)."""
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    if not len(terms) or not len(items.tok):
        return none
    begins = np.concatenate([[0], ends[:-1]])
    rank = np.minimum(np.searchsorted(terms, items.tok), len(terms) - 1)
    known = terms[rank] == items.tok
    packed = (np.repeat(np.arange(len(terms), dtype=np.int64), ends - begins) << 33) | positions  # sorted by term, then position
    met_least = np.ceil(coverage * items.length - 1e-9).astype(np.int64)
    tries = items.length - met_least + 1
    enough = np.bincount(items.item, weights=known, minlength=len(items.ids)) >= met_least
    # candidate starts, from the rarest terms
    picked = items.rare[spread(items.first, tries)]
    picked = picked[known[picked] & enough[items.item[picked]]]
    n = ends[rank[picked]] - begins[rank[picked]]
    where = positions[spread(begins[rank[picked]], n)]
    item = np.repeat(items.item[picked], n)
    start = where - np.repeat(items.offset[picked], n)
    text = np.searchsorted(starts, where, side="right") - 1
    start = (start[:, None] + np.arange(-slack, slack + 1)).ravel()
    item, text = np.repeat(item, 2 * slack + 1), np.repeat(text, 2 * slack + 1)
    order = np.lexsort((start, text, item))
    item, text, start = item[order], text[order], start[order]
    if not len(item):
        return none
    new = np.concatenate([[True], (item[1:] != item[:-1]) | (text[1:] != text[:-1]) | (start[1:] != start[:-1])])
    item, text, start = item[new], text[new], start[new]
    ends_of = np.append(starts[1:], np.int64(1) << 32)
    # meet the terms from the rarest; a candidate that has lost too many is dropped
    size = items.length[item]
    allowed = size - met_least[item]
    lost, whole = np.zeros(len(item), np.int64), np.ones(len(item), bool)
    alive = np.arange(len(item))
    for k in range(int(size.max())):
        go = alive[(size[alive] > k)]
        if not len(go):
            break
        t = items.rare[items.first[item[go]] + k]
        at = start[go] + items.offset[t]
        base, first, last = rank[t] << 33, starts[text[go]], ends_of[text[go]] - 1
        from_, to = np.maximum(at - slack, first), np.minimum(at + slack, last)
        low = np.searchsorted(packed, base | from_)
        value = packed[np.minimum(low, len(packed) - 1)]
        near = known[t] & (from_ <= to) & (low < len(packed)) & (value <= (base | np.maximum(to, 0)))
        place = base | np.clip(at, first, last)
        exact = near & (at >= first) & (at <= last) & (packed[np.minimum(np.searchsorted(packed, place), len(packed) - 1)] == place)
        lost[go] += ~near
        whole[go] &= exact
        alive = alive[lost[alive] <= allowed[alive]]
    return item[alive], text[alive], start[alive] - starts[text[alive]], (size - lost)[alive], whole[alive].astype(np.int64)


@in_small_batches
def find(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, slack: int = SLACK) -> DataFrame:
    """One row for each document and test item that match: doc_id, item_id, kind ('exact' where a start
    has every token in its place, else 'proximity'), start (token offset in the document of the best
    match: exact first, then the most tokens met, then the least offset; it may be negative where the
    item's head is missing), met and n_tokens (the item's).

    Null, empty and token-free texts of either table match nothing; rows without an id are left out.
    Rows that repeat an id count as one where they agree and are searched each where they don't; the
    best match is returned. Empty tables give no rows. Extra columns aren't read.
    """
    spark = docs.sparkSession
    index = build_index(docs)
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int64()), ("met", pa.int64()), ("n_tokens", pa.int64()), ("exact", pa.int64())])
    kind = "doc_id long, item_id long, start long, met long, n_tokens long, exact long"
    tests = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    many = tests.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size")).first()
    rounds = max(1, math.ceil(many["n"] / ITEMS_AT_ONCE), math.ceil(many["size"] / BYTES_AT_ONCE))
    found = []
    for k in range(rounds):
        rows = tests.where(F.pmod(F.xxhash64("item_id"), F.lit(rounds)) == k).orderBy("item_id", "text").collect()  # about ITEMS_AT_ONCE rows and BYTES_AT_ONCE bytes
        items = Items([r["item_id"] for r in rows], [r["text"] for r in rows])
        items.by_rarity(*term_frequency(index, np.unique(items.tok)))
        sent = spark.sparkContext.broadcast(items)

        def work(batches, sent=sent):
            items = sent.value
            for b in batches:
                for row in zip(*(b.column(c) for c in range(5))):
                    d, starts, terms, ends, positions = (np.frombuffer(x.as_buffer(), t) for x, t in zip(row, (np.int64, np.int64, U64, np.uint32, np.uint32)))
                    item, text, start, met, exact = answer(items, d, starts, terms, ends.astype(np.int64), positions.astype(np.int64), coverage, slack)
                    yield as_batch(schema, doc_id=d[text], item_id=items.ids[item], start=start, met=met, n_tokens=items.length[item], exact=exact)
            trim()

        found.append(index.select("docs", "starts", "terms", "ends", "positions").mapInArrow(work, kind))
    every = found[0]
    for f in found[1:]:
        every = every.union(f)
    best = every.groupBy("doc_id", "item_id").agg(F.min(F.struct((-F.col("exact")).alias("e"), (-F.col("met")).alias("m"), F.col("start"), F.col("n_tokens"))).alias("b"))
    return best.select("doc_id", "item_id", F.when(F.col("b.e") == -1, "exact").otherwise("proximity").alias("kind"), F.col("b.start").alias("start"), (-F.col("b.m")).alias("met"), F.col("b.n_tokens").alias("n_tokens"))


@in_small_batches
def decontaminate(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, slack: int = SLACK) -> DataFrame:
    """The rows of docs, all columns, without the documents that match a test item by find().

    Every row of a doc_id goes where one of its rows matches. Rows of null doc_id, and of null, empty or
    token-free text, stay. An item of one word takes every document that has the word: leave such items out
    of benchmark if that isn't meant. Repeated rows stay repeated; empty tables give an empty one, or all rows.
    """
    name = unused(docs, "_hit")
    hit = find(docs, benchmark, coverage, slack).select(F.col("doc_id").alias(name)).distinct()
    return join_checked(docs, hit, F.col("doc_id").cast("long") == F.col(name), "left_anti")
