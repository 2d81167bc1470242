"""N-gram Jaccard join: a blocked sparse product of the document-by-n-gram incidence.

Two passes over the texts. The first makes each document's n-gram set: its size, a signature
(equal sets share one, so copies collapse into one row of the matrix) and a table of how often
n-grams occur. The second puts each row's columns into one global order, frequent columns last,
and sends the part that a pair over the threshold can't avoid sharing, n - ceil(t n) + 1 columns,
to blocks of columns. A block multiplies its slice of the matrix with its transpose and emits, for
every pair that shares a column in it and whose sizes may go together, how many it shares: a tile of
partial overlap counts. Tiles are added up by pair over all blocks. A pair shares nothing outside of
what was added but columns in the rest of one of its rows, so its overlap is at most the sum plus
the longer rest; pairs for which that is below t/(1+t)(|a|+|b|) are discarded. The rows of the
survivors, a few in a hundred more than the pairs over the threshold, meet in blocks, where the
overlap is accumulated over stripes of all columns, and a pair goes as soon as what is left of
either row can't lift it to the bound. Each step only discards what can't be over the threshold.

Pairs of a column grow as the square of its rows, so a column of more than HOT rows emits its rows
instead. Rows that have such a column are put into chunks, alike ones together, and wherever two
chunks have one in common, all of their rows meet in full: a dense product counts every overlap in
place, and no pair is written. Pairs of such chunks aren't taken from the tiles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE_BYTES, U64, as_batch, block_of, by_doc, checkpointed, components, id_and_text, in_small_batches, join_checked, mix, n_blocks, runs, shared_table, signed, slices, spread, to_blocks, tokenize, trim

N, THRESHOLD = 3, 0.5
# Cells of the frequency table: so many a block, as blocks grow in number with the data, and from LEAST to MOST. It only orders columns, so
# collisions cost time and disk, not pairs: in a table too small for its data common columns look like any other, and get into prefixes.
CELLS, LEAST_CELLS, MOST_CELLS = 1 << 18, 1 << 20, 1 << 26
CELLS_PART = 1 << 18  # counted together
PART = 1 << 15
PAIRS_AT_ONCE = 1 << 21
STRIPES = 4  # of columns, in the last step
HOT = 128  # rows of a column beyond which they are compared chunk by chunk instead of pair by pair
CHUNK_ROWS, CHUNK_CELLS = 1024, 1 << 20  # of a chunk at most, but for one row that has more
DENSE = 1 << 14  # pairs of rows in a column beyond which adding it up densely is faster


def shingles(tok: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each text, with the text's index. A text of fewer than n tokens has one: all of it."""
    m = len(tok)
    with np.errstate(over="ignore"):
        if m >= n:
            h = tok[: m - n + 1].copy()
            for k in range(1, n):
                h = mix(h * U64(0x9E3779B97F4A7C15) + tok[k : m - n + 1 + k])
            whole = doc[: m - n + 1] == doc[n - 1 :]
            h, d = h[whole], doc[: m - n + 1][whole]
        else:
            h, d = np.zeros(0, U64), np.zeros(0, np.int32)
        starts, lengths = runs(doc)
        short = np.flatnonzero(lengths < n)
        if len(short):
            extra = []
            for s, length in zip(starts[short], lengths[short]):
                x = tok[s : s + 1].copy()
                for k in range(1, length):
                    x = mix(x * U64(0x9E3779B97F4A7C15) + tok[s + k : s + k + 1])
                extra.append(mix(x + U64(int(length)))[0])
            h, d = np.concatenate([h, np.array(extra, U64)]), np.concatenate([d, doc[starts[short]]])
    order = by_doc(h, d)
    h, d = h[order], d[order]
    if len(h):
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])
        h, d = h[new], d[new]
    return h, d


def sets_of(batch, n: int):
    """(ids, signature, size, hashes, text's index) of a batch; signature and size by text."""
    tok, doc = tokenize(batch.column(1))
    h, d = shingles(tok, doc, n)
    rows = batch.num_rows
    size = np.bincount(d, minlength=rows).astype(np.int64)
    sig = np.zeros(rows, U64)
    starts, _ = runs(d)
    if len(h):
        with np.errstate(over="ignore"):
            sig[d[starts]] = mix(np.add.reduceat(mix(h), starts) + np.bitwise_xor.reduceat(h, starts) * U64(3))
    return np.asarray(batch.column(0)), sig, size, h, d


def n_cells(blocks: int) -> int:
    """A power of two."""
    return min(MOST_CELLS, max(LEAST_CELLS, 1 << (blocks * CELLS - 1).bit_length()))


def _cell(h: np.ndarray, cells: int) -> np.ndarray:
    return (h & U64(cells - 1)).astype(np.uint32)


def pack_counts(counts: np.ndarray) -> bytes:
    """A part of a task's table, mostly zeros: steps between the cells in use, and their counts."""
    at = np.flatnonzero(counts)
    return len(at).to_bytes(4, "little") + pa.Codec("zstd", 1).compress(planes(np.diff(at, prepend=0)).tobytes() + counts[at].tobytes(), asbytes=True)


def unpack_counts(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(cells in use, their counts)."""
    n = int.from_bytes(data[:4], "little")
    raw = np.frombuffer(pa.Codec("zstd").decompress(data[4:], 5 * n), np.uint8)
    step = np.ascontiguousarray(raw[: 4 * n].reshape(4, n).T).view(np.uint32).ravel()
    return np.cumsum(step, dtype=np.int64), raw[4 * n :]


def profiles(docs: DataFrame, n: int) -> tuple[DataFrame, bytes]:
    """Table (doc_id, sig, n), sig null for a document without an n-gram, and a byte for each cell: how frequent its n-grams are."""
    schema = pa.schema([("doc_id", pa.int64()), ("sig", pa.int64()), ("n", pa.int64()), ("part", pa.int32()), ("counts", pa.binary())])
    cells = n_cells(n_blocks(docs.sparkSession))

    def work(batches):
        total = np.zeros(cells, np.uint8)  # up to 255 a task; more is frequent enough
        for b in slices(batches):
            ids, sig, size, h, d = sets_of(b, n)
            used = np.sort(_cell(h, cells))
            at, times = runs(used)
            used = used[at]
            total[used] = np.minimum(total[used] + times, 255)
            k = b.num_rows
            yield as_batch(schema, doc_id=ids, sig=pa.array(signed(sig), mask=size == 0), n=size, part=pa.nulls(k, pa.int32()), counts=pa.nulls(k, pa.binary()))
        for p in range(cells // CELLS_PART):
            part = total[p * CELLS_PART : (p + 1) * CELLS_PART]
            if part.any():
                yield as_batch(schema, **{c: pa.nulls(1, pa.int64()) for c in ("doc_id", "sig", "n")}, part=[p], counts=[pack_counts(part)])

    made = shared_table(id_and_text(docs).mapInArrow(work, "doc_id long, sig long, n long, part int, counts binary"), "profiles")
    load = max(1.0, (made.where("part is null").agg(F.sum("n")).first()[0] or 0) / cells)

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(CELLS_PART, np.int64)
        for c in table.column("counts"):
            at, times = unpack_counts(c.as_py())
            total[at] += times
        rank = np.minimum(255, np.round(16 * np.log2(1 + total / load))).astype(np.uint8)
        return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "rank": pa.array([rank.tobytes()], pa.binary())})

    summed = made.where("part is not null").select("part", "counts").groupBy("part").applyInArrow(add, "part int, rank binary")
    rank = bytearray(cells)
    for r in summed.collect():  # a byte a cell, MOST_CELLS at most, whatever the input
        rank[r["part"] * CELLS_PART : (r["part"] + 1) * CELLS_PART] = r["rank"]
    return made.where("part is null").select("doc_id", "sig", "n"), bytes(rank)


def _need(t: float, a, b):
    """The least overlap of sets of these sizes with Jaccard t."""
    return np.ceil(t / (1 + t) * (a + b) - 1e-9)


def _emit_prefixes(docs: DataFrame, n: int, t: float, rank: bytes) -> DataFrame:
    spark = docs.sparkSession
    blocks, shared = n_blocks(spark), spark.sparkContext.broadcast(rank)
    schema = pa.schema([("block", pa.int32())] + [(k, pa.binary()) for k in ("h", "row", "sig", "n")])

    def work(batches):
        frequent = np.frombuffer(shared.value, np.uint8)
        for b in slices(batches):
            _, sig, size, h, d = sets_of(b, n)
            order = by_doc((frequent[_cell(h, len(frequent))].astype(U64) << U64(56)) | (h >> U64(8)), d)
            h, d = h[order], d[order]
            starts, lengths = runs(d)
            take = spread(starts, lengths - np.ceil(t * lengths - 1e-9).astype(np.int64) + 1)
            h, d = h[take], d[take]
            order = np.argsort(h, kind="stable")
            h, d = h[order], d[order]
            # within a block 32 bits tell columns apart: a clash only counts a column too much for a pair, and blocks grow in number with the data
            low = h.astype(np.uint32)
            edges = np.searchsorted(block_of(h, blocks), np.arange(blocks + 1, dtype=U64))
            out = {k: [] for k in schema.names}
            for k in np.flatnonzero(np.diff(edges)):
                part = slice(edges[k], edges[k + 1])
                used, local = np.unique(d[part], return_inverse=True)
                for name, v in (("block", int(k)), ("h", low[part]), ("row", local.astype(np.uint16)), ("sig", sig[used]), ("n", size[used].astype(np.uint32))):
                    out[name].append(v if name == "block" else v.tobytes())
            yield as_batch(schema, **out)

    return id_and_text(docs).mapInArrow(work, "block int, h binary, row binary, sig binary, n binary")


TILE = "bucket int, n_sets int, n_pairs int, data binary"
TILE_SCHEMA = pa.schema([("bucket", pa.int32()), ("n_sets", pa.int32()), ("n_pairs", pa.int32()), ("data", pa.binary())])


def planes(x: np.ndarray) -> np.ndarray:
    """The numbers' lowest bytes, then the next, and so on: those that are mostly 0 compress to nothing."""
    return np.ascontiguousarray(x.astype(np.uint32).view(np.uint8).reshape(-1, 4).T)


def pack(sig: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray, count: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Tiles of partial counts, one for each bucket of left sets. a and b index sig (ascending) and size; pairs sorted by (a, b).
    Pairs of a group of alike sets are neighbours, so their differences and counts compress to a byte or so a pair."""
    codec = pa.Codec("zstd", 1)
    bucket = block_of(mix(sig.view(U64)), buckets)[a].astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    out = {k: [] for k in TILE_SCHEMA.names}
    for k, n in zip(*runs(bucket[order])):
        part = order[k : k + n]
        used, local = np.unique(np.concatenate([a[part], b[part]]), return_inverse=True)
        x, y = local[:n], local[n:]
        step = np.diff(x, prepend=0)
        ahead = np.where(np.concatenate([[True], step[1:] != 0]), y, np.diff(y, prepend=0))
        data = b"".join(v.tobytes() for v in (sig[used], *map(planes, (size[used], step, ahead, count[part]))))
        for c, v in zip(out, (int(bucket[part[0]]), len(used), int(n), codec.compress(data, asbytes=True))):
            out[c].append(v)
    return as_batch(TILE_SCHEMA, **out)


def unpack(n_sets: int, n_pairs: int, data: pa.Buffer):
    """(left set, right set, their sizes, count) of a tile's pairs."""
    raw = pa.Codec("zstd").decompress(data, 12 * n_sets + 12 * n_pairs)
    number = lambda n, at: np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n, at).reshape(4, n).T).view(np.uint32).ravel().astype(np.int64)
    sig, size = np.frombuffer(raw, np.int64, n_sets), number(n_sets, 8 * n_sets)
    step, ahead, count = (number(n_pairs, 12 * n_sets + 4 * n_pairs * k) for k in range(3))
    a = np.cumsum(step)
    head, length = runs(a)
    total = np.cumsum(ahead)
    b = total - np.repeat(total[head] - ahead[head], length)
    return sig[a], sig[b], size[a], size[b], count


def pack_column(column: int, sig: np.ndarray, size: np.ndarray, buckets: int):
    """The rows of a hot column, told from tiles by having no pairs."""
    codec = pa.Codec("zstd", 1)
    for at in range(0, len(sig), PART):
        part = slice(at, at + PART)
        data = b"".join((np.int64(column).tobytes(), sig[part].tobytes(), size[part].astype(np.uint32).tobytes()))
        yield as_batch(TILE_SCHEMA, bucket=[column % buckets], n_sets=[len(sig[part])], n_pairs=[0], data=[codec.compress(data, asbytes=True)])


def unpack_column(n_sets: int, data: pa.Buffer):
    """(rows, their sizes, the column of each)."""
    raw = pa.Codec("zstd").decompress(data, 8 + 12 * n_sets)
    return np.frombuffer(raw, np.int64, n_sets, 8), np.frombuffer(raw, np.uint32, n_sets, 8 + 8 * n_sets).astype(np.int64), np.repeat(np.frombuffer(raw, np.int64, 1), n_sets)


def _multiply(t: float, buckets: int):
    """A block's slice of the matrix times its transpose: tiles of partial counts, and the rows of hot columns."""

    def work(batches):
        found, block = {k: [] for k in ("h", "sig", "size")}, 0
        for b in batches:
            if b.num_rows:
                block = b.column(b.schema.get_field_index("block"))[0].as_py()
            for h, row, sig, size in zip(*(b.column(b.schema.get_field_index(c)) for c in ("h", "row", "sig", "n"))):
                of = np.frombuffer(row.as_buffer(), np.uint16)
                found["h"].append(np.frombuffer(h.as_buffer(), np.uint32))
                found["sig"].append(np.frombuffer(sig.as_buffer(), np.int64)[of])
                found["size"].append(np.frombuffer(size.as_buffer(), np.uint32)[of])
        if not found["h"]:
            return
        h, sig, size = (np.concatenate(found.pop(k)) for k in ("h", "sig", "size"))
        order = np.argsort(h, kind="stable")
        starts, lengths = runs(h[order])
        order = order[np.repeat(lengths > 1, lengths)]  # a column of one row makes no pair
        h, sig, size = h[order], sig[order], size[order]
        sets, first, row = np.unique(sig, return_index=True, return_inverse=True)
        sizes = size[first].astype(np.int64)
        order = np.lexsort((row, size, h))
        h, row = h[order], row[order]
        if len(h):
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])
            h, row = h[new], row[new]
        starts, lengths = runs(h)
        hot = np.flatnonzero(lengths > HOT)
        shares = np.full(len(sets), -1)  # a hot column of each row
        for k in hot[::-1]:
            of = row[starts[k] : starts[k] + lengths[k]]
            shares[of] = k
            yield from pack_column((block << 32) | int(h[starts[k]]), sets[of], sizes[of], buckets)
        cold = np.repeat(lengths <= HOT, lengths)
        h, row = h[cold], row[cold]
        size = sizes[row]
        starts, lengths = runs(h)
        run = np.repeat(np.arange(len(starts), dtype=U64), lengths) << U64(32)
        most = np.minimum(np.floor(size / t + 1e-9), 2**32 - 1).astype(U64)  # sizes that may go together
        partners = np.searchsorted(run | size.astype(U64), run | most, side="right") - np.arange(len(h)) - 1
        done = np.concatenate([[0], np.cumsum(partners)])
        here = 0
        while here < len(h):
            stop = max(here + 1, int(np.searchsorted(done, done[here] + PAIRS_AT_ONCE, side="right")) - 1)
            left, right = row[np.repeat(np.arange(here, stop), partners[here:stop])], row[spread(np.arange(here, stop) + 1, partners[here:stop])]
            here = stop
            apart = (shares[left] < 0) | (shares[left] != shares[right])  # others meet by their hot column
            left, right = left[apart], right[apart]
            if len(left):
                pair = np.sort((np.minimum(left, right) << 32) | np.maximum(left, right))
                at, count = runs(pair)
                yield pack(sets, sizes, pair[at] >> 32, pair[at] & 0xFFFFFFFF, count, buckets)
        trim()

    return work


PAIR = "sa long, sb long, hot long"
PAIR_SCHEMA = pa.schema([("sa", pa.int64()), ("sb", pa.int64()), ("hot", pa.int64())])


def _add(t: float):
    """Sums of a bucket's partial counts; pairs whose overlap can't reach the bound are discarded. Rows of a hot column come through as (row, size, column)."""

    def work(batches):
        parts = []
        for b in batches:
            for n, m, data in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                if m:
                    parts.append(unpack(n, m, data.as_buffer()))
                else:
                    sig, size, column = unpack_column(n, data.as_buffer())
                    yield as_batch(PAIR_SCHEMA, sa=sig, sb=size, hot=column)
        if not parts:
            return
        a, b, na, nb, count = (np.concatenate(x) for x in zip(*parts))
        del parts
        order = np.lexsort((b, a))
        a, b, na, nb, count = a[order], b[order], na[order], nb[order], count[order]
        at = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        total, na, nb = np.add.reduceat(count, at), na[at], nb[at]
        rest = np.ceil(t * np.maximum(na, nb) - 1e-9) - 1  # columns of the longer row that weren't sent
        go = np.minimum(np.minimum(na, nb), total + rest) >= _need(t, na, nb)
        yield as_batch(PAIR_SCHEMA, sa=a[at[go]], sb=b[at[go]], hot=pa.nulls(int(go.sum()), pa.int64()))
        trim()

    return work


def overlaps(a: np.ndarray, b: np.ndarray, offset: np.ndarray, columns: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """(indices of the pairs over the threshold, their overlaps). Pairs of rows a, b; row i has columns[offset[i]:offset[i + 1]], sorted.

    Overlaps are accumulated over stripes of columns; a pair goes when the columns left in either row can't lift it to the bound."""
    values, code = np.unique(columns, return_inverse=True)
    width, size = max(1, len(values)), np.diff(offset)
    key = np.repeat(np.arange(len(size)), size) * width + code
    cuts = [offset[:-1]]
    for s in range(1, STRIPES):
        cuts.append(np.searchsorted(key, np.arange(len(size)) * width + s * width // STRIPES))
    cuts.append(offset[1:])
    alive, got = np.arange(len(a)), np.zeros(len(a), np.int64)
    need = _need(t, size[a], size[b])
    for s in range(STRIPES):
        x, y = a[alive], b[alive]
        swap = (cuts[s + 1] - cuts[s])[x] > (cuts[s + 1] - cuts[s])[y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        n = (cuts[s + 1] - cuts[s])[x]
        done = np.concatenate([[0], np.cumsum(n)])
        here = 0
        while here < len(x):
            stop = max(here + 1, int(np.searchsorted(done, done[here] + PAIRS_AT_ONCE, side="right")) - 1)
            wanted = code[spread(cuts[s][x[here:stop]], n[here:stop])] + np.repeat(y[here:stop] * width, n[here:stop])
            hit = np.concatenate([[0], np.cumsum(key[np.minimum(np.searchsorted(key, wanted), len(key) - 1)] == wanted)])
            edge = done[here : stop + 1] - done[here]
            got[alive[here:stop]] += hit[edge[1:]] - hit[edge[:-1]]
            here = stop
        left = np.minimum(offset[1:][a[alive]] - cuts[s + 1][a[alive]], offset[1:][b[alive]] - cuts[s + 1][b[alive]])
        alive = alive[got[alive] + left >= need[alive]]
    return alive, got[alive]


def dense_overlaps(left: np.ndarray, right: np.ndarray, offset: np.ndarray, columns: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows a, rows b, overlaps) of the pairs of a row of left and one of right that are over the threshold. Row i has columns[offset[i]:offset[i + 1]]."""
    size = np.diff(offset)
    total = np.zeros((len(left), len(right)), np.float32)  # counts to 2 ** 24 are exact
    ends = []
    for side in (left, right):
        code = columns[spread(offset[side], size[side])]
        row = np.repeat(np.arange(len(side)), size[side])
        order = np.argsort(code, kind="stable")
        ends.append((code[order], row[order]))
    (x, x_row), (y, y_row) = ends
    x_at, x_n = runs(x)
    y_at, y_n = runs(y)
    _, i, j = np.intersect1d(x[x_at], y[y_at], assume_unique=True, return_indices=True)
    x_at, x_n, y_at, y_n = x_at[i], x_n[i], y_at[j], y_n[j]
    many = x_n * y_n > DENSE
    for a in range(0, int(many.sum()), CHUNK_ROWS):
        dense = []
        for at, n, row, rows in ((x_at, x_n, x_row, len(left)), (y_at, y_n, y_row, len(right))):
            at, n = at[many][a : a + CHUNK_ROWS], n[many][a : a + CHUNK_ROWS]
            m = np.zeros((rows, len(at)), np.float32)
            m[row[spread(at, n)], np.repeat(np.arange(len(at)), n)] = 1
            dense.append(m)
        total += dense[0] @ dense[1].T
    x_at, x_n, y_at, y_n = x_at[~many], x_n[~many], y_at[~many], y_n[~many]
    done = np.concatenate([[0], np.cumsum(x_n * y_n)])
    here = 0
    while here < len(x_n):
        stop = max(here + 1, int(np.searchsorted(done, done[here] + PAIRS_AT_ONCE, side="right")) - 1)
        part = slice(here, stop)
        each = spread(x_at[part], x_n[part])
        times = np.repeat(y_n[part], x_n[part])
        cell = np.repeat(x_row[each], times) * len(right) + y_row[spread(np.repeat(y_at[part], x_n[part]), times)]
        total += np.bincount(cell, minlength=total.size).reshape(total.shape)
        here = stop
    i, j = np.nonzero(total >= _need(t, size[left][:, None], size[right][None, :]))
    return left[i], right[j], total[i, j].astype(np.int64)


def labels_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of the connected component of each of n nodes."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = np.minimum(label, label[label])
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(label, before):
            break
    return label


def _chunks(hot: DataFrame, t: float) -> tuple[DataFrame, DataFrame | None]:
    """(sig, n, chunk) of the rows with a hot column, and (block, x, y): the chunks x <= y that have a hot column in common and sizes that
    may go together, numbered from 0. No meetings (None) where no column is hot.

    Rows go by the least column that their columns' rows have, which brings alike rows together, then by size. That only orders
    them: whichever chunk a row is in, that chunk meets all that share a hot column with it."""
    if hot.isEmpty():
        return hot, None
    first = hot.groupBy("sig").agg(F.min("hot").alias("first"))
    reach = hot.join(first, "sig").groupBy("hot").agg(F.min("first").alias("reach"))
    keyed = hot.join(reach, "hot").groupBy("sig", "n").agg(F.min("reach").alias("key"))
    up_to = Window.partitionBy("key").orderBy("n", "sig").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = [F.floor((F.count("*").over(up_to) - 1) / CHUNK_ROWS), F.floor(F.sum("n").over(up_to) / CHUNK_CELLS)]
    chunks = checkpointed(keyed.select("sig", "n", F.xxhash64("key", *cut).alias("chunk")))
    has = checkpointed(hot.join(chunks.select("sig", "chunk"), "sig").select("hot", "chunk").distinct())
    range_ = chunks.groupBy("chunk").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    meet = has.toDF("hot", "x").join(has.toDF("hot", "y"), "hot").where("x <= y").select("x", "y").distinct()
    meet = meet.join(range_.toDF("x", "xl", "xh"), "x").join(range_.toDF("y", "yl", "yh"), "y").where((F.col("xh") >= t * F.col("yl") - 1e-9) & (F.col("yh") >= t * F.col("xl") - 1e-9))
    return chunks, checkpointed(meet.select((F.row_number().over(Window.orderBy("x", "y")) - 1).alias("block"), "x", "y"))


@in_small_batches
def _links(docs: DataFrame, n: int, threshold: float, finish, kind: str) -> tuple[DataFrame, DataFrame]:
    """(finish's rows for each block of pairs, members). members: (doc_id, sig, n) as profiles() makes them."""
    t, spark = threshold, docs.sparkSession
    members, rank = profiles(docs, n)
    blocks = n_blocks(spark)
    holders = checkpointed(members.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.countDistinct("doc_id").alias("copies")))
    tiles = to_blocks(_emit_prefixes(docs, n, t, rank)).mapInArrow(_multiply(t, blocks), TILE)
    made = shared_table(to_blocks(tiles, "bucket").mapInArrow(_add(t), PAIR), "pairs")
    chunks, meetings = _chunks(made.where("hot is not null").select(F.col("sa").alias("sig"), F.col("sb").alias("n"), "hot"), t)
    found = made.where("hot is null").select("sa", "sb")
    if meetings is not None:
        where = chunks.select("sig", "chunk")
        pair = found.join(where.toDF("sa", "ca"), "sa", "left").join(where.toDF("sb", "cb"), "sb", "left").withColumn("low", F.least("ca", "cb")).withColumn("high", F.greatest("ca", "cb"))
        covered = (F.col("low") == F.col("x")) & (F.col("high") == F.col("y")) & F.col("ca").isNotNull() & F.col("cb").isNotNull()
        found = checkpointed(pair.join(meetings.select("x", "y"), covered, "left_anti").select("sa", "sb"))

    # A pair goes where the least set near either end says, so a group of alike sets meets in one place.
    least = checkpointed(found.union(found.select("sb", "sa")).toDF("sig", "other").groupBy("sig").agg(F.least(F.min("other"), F.first("sig")).alias("low")))
    placed = checkpointed(
        found.join(least.toDF("sa", "la"), "sa").join(least.toDF("sb", "lb"), "sb")
        .select("sa", "sb", F.pmod(F.xxhash64(F.least("la", "lb")), F.lit(blocks)).cast("int").alias("block"))
    )
    wanted = placed.select(F.col("sa").alias("sig"), "block").union(placed.select(F.col("sb").alias("sig"), "block")).distinct()
    if meetings is not None:  # a meeting is a block of its own; instead of pairs it has the numbers of its chunks
        numbered = meetings.select((F.col("block") + blocks).cast("int").alias("block"), "x", "y")
        goes = numbered.select(F.col("x").alias("chunk"), "block").union(numbered.select(F.col("y").alias("chunk"), "block")).distinct()
        wanted = wanted.union(chunks.join(goes, "chunk").select("sig", "block"))
        placed = placed.union(numbered.select("x", "y", "block"))
        holders = holders.join(chunks.select("sig", "chunk"), "sig", "left")
    else:
        holders = holders.withColumn("chunk", F.lit(None).cast("long"))
    targets = wanted.join(holders, "sig").groupBy("doc_id", "sig", "copies", "chunk").agg(F.collect_set("block").alias("at"))
    row_schema = pa.schema([("block", pa.int32()), ("sig", pa.int64()), ("copies", pa.int64()), ("chunk", pa.int64()), ("h", pa.binary())])

    def rows(batches):
        for b in slices(batches, 2 << 20):
            _, sig, size, h, d = sets_of(b, n)
            starts = np.concatenate([[0], np.cumsum(size)])
            packed = np.ascontiguousarray((h >> U64(16)).view(np.uint8).reshape(-1, 8)[:, :6])  # 48 bits tell n-grams of two documents apart
            out = {k: [] for k in row_schema.names}
            filled = 0
            for i, (s, copies, chunk, at) in enumerate(zip(*(b.column(k).to_pylist() for k in (2, 3, 4, 5)))):
                if signed(sig[i : i + 1])[0] == s:
                    row = packed[starts[i] : starts[i + 1]].tobytes()
                    for k in at:
                        for c, v in zip(out, (k, s, copies, chunk, row)):
                            out[c].append(v)
                        filled += len(row)
                        if filled > SLICE_BYTES:  # a row of a large group goes to many blocks
                            yield as_batch(row_schema, **out)
                            out, filled = {k: [] for k in row_schema.names}, 0
            yield as_batch(row_schema, **out)

    full = join_checked(id_and_text(docs), targets, "doc_id", "inner").select("doc_id", "text", "sig", "copies", "chunk", "at").mapInArrow(rows, "block int, sig long, copies long, chunk long, h binary")

    def verify(left: pa.Table, right: pa.Table) -> pa.Table:
        sig = np.asarray(right.column("sig"))
        sets, first = np.unique(sig, return_index=True)
        right = right.take(pa.array(first))
        cells = [c.as_buffer() for c in right.column("h")]
        size = np.array([len(c) // 6 for c in cells], np.int64)
        columns = np.zeros((int(size.sum()), 8), np.uint8)
        columns[:, :6] = np.frombuffer(b"".join(cells), np.uint8).reshape(-1, 6)
        offset, columns = np.concatenate([[0], np.cumsum(size)]), columns.view(U64).ravel()
        if left.num_rows and left.column("block")[0].as_py() >= blocks:
            chunk = np.asarray(right.column("chunk"))
            x, y = (np.flatnonzero(chunk == left.column(c)[0].as_py()) for c in ("sa", "sb"))
            a, b, got = dense_overlaps(x, y, offset, columns, t)
            if left.column("sa")[0] == left.column("sb")[0]:
                once = a < b
                a, b, got = a[once], b[once], got[once]
        else:
            a, b = np.searchsorted(sets, np.asarray(left.column("sa"))), np.searchsorted(sets, np.asarray(left.column("sb")))
            ok, got = overlaps(a, b, offset, columns, t)
            a, b = a[ok], b[ok]
        made = finish(sets, size, np.asarray(right.column("copies")), a, b, got)
        trim()
        return made

    return shared_table(placed.groupBy("block").cogroup(full.groupBy("block")).applyInArrow(verify, kind), "links"), members


def set_pairs(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): pairs (sa, sb, overlap, n_union) of distinct n-gram sets at or over the
    threshold, and members (doc_id, sig, n), which documents have which set (null: none)."""

    def finish(sets, size, copies, a, b, got):
        return pa.table({"sa": sets[a], "sb": sets[b], "overlap": got, "n_union": size[a] + size[b] - got})

    return _links(docs, n, threshold, finish, "sa long, sb long, overlap long, n_union long")


def ngram_jaccard_join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each doc_id: doc_id, class_id, n_links. Two documents are linked where their sets of
    word n-grams have a Jaccard similarity of at least the threshold; n_links is how many others a
    document is linked to, copies of one text counted each; class_id is the least doc_id of those that
    links connect, the document's own where it has none. set_pairs() has the pairs of different sets.

    A text of fewer than n tokens has one n-gram, its whole; a null, empty or token-free text has none
    and no link. Rows without doc_id are left out. Rows that repeat a doc_id with the same text count
    once; with different texts, the document stands for all of them, and its n_links adds up theirs.
    Ties don't arise: every link counts. An empty table gives no rows; extra columns aren't read.
    """

    def finish(sets, size, copies, a, b, got):
        links = np.bincount(a, weights=copies[b], minlength=len(sets)) + np.bincount(b, weights=copies[a], minlength=len(sets))
        some = np.flatnonzero(links)
        return pa.table({"sig": sets[some], "root": sets[labels_of(len(sets), a, b)][some], "links": links[some].astype(np.int64)})

    found, members = _links(docs, n, threshold, finish, "sig long, root long, links long")
    have = checkpointed(members.select("doc_id", "sig").distinct())
    least = checkpointed(have.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("low"), (F.count("*") - 1).alias("copies")))
    star = have.join(least, "sig").where("doc_id <> low").select(F.col("doc_id").alias("u"), F.col("low").alias("v"))
    near = found.where("sig <> root").join(least.select("sig", F.col("low").alias("u")), "sig").join(least.select(F.col("sig").alias("root"), F.col("low").alias("v")), "root").where("u <> v").select("u", "v")
    group = components(star.union(near))
    links = least.join(found.groupBy("sig").agg(F.sum("links").alias("links")), "sig", "left").select("sig", (F.col("copies") + F.coalesce("links", F.lit(0))).alias("links"))
    each = have.join(links, "sig", "left").groupBy("doc_id").agg(F.sum(F.coalesce("links", F.lit(0))).alias("n_links"))
    return each.join(group.toDF("doc_id", "root"), "doc_id", "left").select("doc_id", F.coalesce("root", "doc_id").alias("class_id"), "n_links")


def near_duplicate_ids(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, root) of the documents to drop: all but the least doc_id of each class of ngram_jaccard_join(), whose cases hold here too."""
    return ngram_jaccard_join(docs, n, threshold).where("doc_id <> class_id").select("doc_id", F.col("class_id").alias("root"))
