"""Substring dedup by recompression.

Every document is a sequence of symbols, its tokens at first. A step gives each run of one symbol a
name, lets each symbol fall left or right by a bit of its name's hash, and gives every adjacent
left-right pair a name. A Spark round does some steps (FIRST in the first round, STEPS in others) on
slices of the corpus; then the distinct new names of all slices meet, by name, in blocks, which name
those that occur more than once in the corpus and return the names to the slices. A symbol
knows the tokens its existence depends on; where a window of K tokens holds them all, every copy of the
window holds the same symbol. So a symbol that got no name, being the only one, rules out all windows that
hold what it depends on, and it is closed: nothing is paired with it or counted on it again. Rounds go
on until no symbol that a window can hold is new. What is left are windows all of whose interior symbols
are shared. A window's anchor is the least name among its interior symbols in the first round that finds any in it (its
least token's, if none does); windows of one anchor meet in a block, with their tokens, and repeats are
verified token by token. Symbols of later rounds only rule out: a window holds few of them, so as anchors they would
cut what is sent into short pieces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, block_of, drop_table, id_and_text, mix, n_blocks, runs, shared_table, slices, spread, to_blocks, tokenize, trim
from .spans import HITS, K, ROW, hits, rows_by_block, segments, union_spans

FIRST, STEPS = 4, 2  # steps in the first round and in others
SLICE = 4 << 20
_B = 0x9E3779B97F4A7C15 | 1
_INV = pow(_B, -1, 1 << 64)


def window_prints(tok: np.ndarray, k: int) -> np.ndarray:
    """A fingerprint of every k tokens in a row."""
    n = len(tok)
    with np.errstate(over="ignore"):
        power = np.concatenate([[U64(1)], np.cumprod(np.full(max(0, n - 1), U64(_B)))]) if n else np.zeros(0, U64)
        total = np.concatenate([[U64(0)], np.cumsum(tok * power)])
        inverse = np.concatenate([[U64(1)], np.cumprod(np.full(max(0, n - k), U64(_INV)))])
        return mix((total[k:] - total[: n - k + 1]) * inverse)


class Symbols:
    """Symbols of a slice in order: name, text, first token, the first and last token that each depends on, whether it is closed, whether its name is new."""

    def __init__(self, name, doc, begin, left, right, shut, fresh):
        self.name, self.doc, self.begin, self.left, self.right, self.shut, self.fresh = name, doc, begin, left, right, shut, fresh

    def take(self, at) -> "Symbols":
        return Symbols(*(x[at] for x in (self.name, self.doc, self.begin, self.left, self.right, self.shut, self.fresh)))


def start(tok: np.ndarray, doc: np.ndarray) -> Symbols:
    at, no = np.arange(len(tok), dtype=np.int64), np.zeros(len(tok), bool)
    return Symbols(tok, doc, at, at, at, no, no)


def step(s: Symbols, salt: int) -> Symbols:
    """Name runs, then left-right pairs."""
    if not len(s.name):
        return s
    with np.errstate(over="ignore"):
        edge = np.concatenate([[True], s.doc[1:] != s.doc[:-1]])
        ends = np.append(edge[1:], True)
        again = np.concatenate([[False], (s.name[1:] == s.name[:-1]) & ~s.shut[1:] & ~s.shut[:-1]]) & ~edge
        first = np.flatnonzero(~again)
        size = np.diff(np.append(first, len(again)))
        last = first + size - 1
        # a run depends on its neighbours, which differ; beyond a text's ends nothing is known
        dl = np.where(edge[first], s.left[first] - 1, s.left[np.maximum(first - 1, 0)])
        dr = np.where(ends[last], s.right[last] + 1, s.right[np.minimum(last + 1, len(again) - 1)])
        shut = s.shut[first]
        t = s.take(first)
        t.name = np.where(size > 1, mix(t.name * U64(_B) + size.astype(U64) * U64(0xD6E8FEB86659FD93)), t.name)
        t.left, t.right, t.fresh = np.where(shut, t.left, dl), np.where(shut, t.right, dr), t.fresh | (size > 1)
        n = len(t.name)
        edge = np.concatenate([[True], t.doc[1:] != t.doc[:-1]])
        ends = np.append(edge[1:], True)
        side = (mix(t.name + U64(salt + 1) * U64(0xA0761D6478BD642F)) & U64(1)).astype(bool)  # True: left
        joined = np.append(side[:-1] & ~side[1:] & ~shut[:-1] & ~shut[1:], False) & ~ends
        second = np.concatenate([[False], joined[:-1]])
        following, previous = np.minimum(np.arange(n) + 1, n - 1), np.maximum(np.arange(n) - 1, 0)
        dl = np.where(side, t.left, np.where(edge, t.left - 1, t.left[previous]))
        dr = np.where(~side, t.right, np.where(ends, t.right + 1, t.right[following]))
        dl, dr = np.where(joined | shut, t.left, dl), np.where(joined, t.right[following], np.where(shut, t.right, dr))
        t.name = np.where(joined, mix(mix(t.name) * U64(_B) + t.name[following]), t.name)
        t.left, t.right, t.fresh = dl, dr, t.fresh | joined
        return t.take(~second)


def least_in(key: np.ndarray, low: np.ndarray, width: np.ndarray) -> np.ndarray:
    """The least key of each range; widths from 1."""
    depth = np.floor(np.log2(width)).astype(np.int64)
    best, table = np.zeros(len(low), U64), key
    for j in range(int(depth.max()) + 1 if len(low) else 0):
        if j:
            half = 1 << (j - 1)
            table = np.minimum(table[:-half], table[half:])
        on = depth == j
        best[on] = np.minimum(table[low[on]], table[low[on] + width[on] - (1 << j)])
    return best


def held(s: Symbols, alive: np.ndarray, k: int) -> np.ndarray:
    """Whether some window that is still in question holds all that the symbol depends on."""
    n, total = len(alive), np.concatenate([[0], np.cumsum(alive)])
    low, high = np.clip(s.right - k + 1, 0, n), np.clip(s.left + 1, 0, n)
    return (s.right - s.left < k) & (high > low) & (total[high] > total[np.minimum(low, high)])


def close(s: Symbols, keep: np.ndarray) -> Symbols:
    """Close all but the ones to keep. Of closed neighbours the inner ones aren't needed: neighbours' ranges are."""
    s.shut = s.shut | ~keep
    s.fresh = s.fresh & keep
    n = len(s.shut)
    if n:
        dull = s.shut & np.append(s.shut[1:] & (s.doc[1:] == s.doc[:-1]), False) & np.concatenate([[False], s.shut[:-1] & (s.doc[1:] == s.doc[:-1])])
        return s.take(~dull)
    return s


def settle(s: Symbols, alive: np.ndarray, anchor: np.ndarray, k: int) -> tuple[Symbols, np.ndarray]:
    """After naming (name 0: the only one): the symbols that still matter, and the windows still in question; anchors are set in place."""
    dead = ~s.shut & (s.name == 0)
    on = dead & (s.right - s.left < k)
    change = np.zeros(len(alive) + 1, np.int64)
    np.add.at(change, np.clip(s.right[on] - k + 1, 0, len(alive)), 1)
    np.add.at(change, np.clip(s.left[on] + 1, 0, len(alive)), -1)
    alive = alive & (np.cumsum(change)[:-1] == 0)
    s.shut = s.shut | dead
    live = s.take(~s.shut)
    windows = np.flatnonzero(alive & (anchor == 0))
    low = np.searchsorted(live.left, windows, side="left")
    width = np.searchsorted(live.right, windows + k - 1, side="right") - low
    has = width > 0
    anchor[windows[has]] = least_in(mix(live.name), low[has], width[has])
    return close(s, ~s.shut & held(s, alive, k)), alive


STATE = "kind int, slice long, block int, n long, docs binary, count binary, words binary, code binary, alive binary, anchor binary, known binary, which binary, begin binary, left binary, right binary, shut binary"
STATE_SCHEMA = pa.schema([("kind", pa.int32()), ("slice", pa.int64()), ("block", pa.int32()), ("n", pa.int64()), *((k, pa.binary()) for k in "docs count words code alive anchor known which begin left right shut".split())])


def squeeze(x: np.ndarray) -> bytes:
    """An array's bytes by planes, compressed."""
    raw = np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T).tobytes()
    return len(x).to_bytes(8, "little") + (pa.Codec("zstd", 1).compress(raw, asbytes=True) if raw else b"")


def expand(cell, kind) -> np.ndarray:
    data = cell.as_py() if hasattr(cell, "as_py") else cell
    n, size = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    raw = np.frombuffer(pa.Codec("zstd").decompress(data[8:], n * size), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, n).T).view(kind).ravel()


def table_of(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pydict({f.name: pa.array([r.get(f.name) for r in rows], f.type) for f in STATE_SCHEMA}, schema=STATE_SCHEMA)


def stored(slice_id: int, blocks: int, docs, count, tok, s: Symbols, alive, anchor, k: int) -> list[dict]:
    """A slice's state (kind 0) and its new names by block (kind 1). New names are known by their place in the order of blocks, then names."""
    edge = np.concatenate([[0], np.cumsum(alive)])
    n = len(alive)
    covered = edge[np.minimum(np.arange(len(tok)) + 1, n)] > edge[np.clip(np.arange(len(tok)) - k + 1, 0, n)] if len(tok) else np.zeros(0, bool)
    words, code = np.unique(np.where(covered, tok, U64(0)), return_inverse=True)
    fresh = ~s.shut & s.fresh
    names = np.unique(s.name[fresh])
    route = block_of(mix(names), blocks)
    names = names[np.argsort(route, kind="stable")]
    route = np.sort(route)
    sorted_names = np.argsort(names, kind="stable")
    which = np.zeros(len(s.name), np.uint32)
    place = sorted_names[np.searchsorted(names[sorted_names], s.name[fresh])] if len(names) else np.zeros(0, np.int64)
    which[fresh] = place
    several = np.bincount(place, minlength=len(names)) > 1
    old = ~s.shut & ~s.fresh
    known, at = np.unique(s.name[old], return_inverse=True)
    which[old] = len(names) + at
    rows = [{
        "kind": 0, "slice": slice_id, "n": len(names), "docs": squeeze(docs), "count": squeeze(count), "words": squeeze(words), "code": squeeze(code.astype(np.uint32)),
        "alive": squeeze(np.packbits(alive)), "anchor": squeeze(np.where(alive, anchor, U64(0))), "known": squeeze(known), "which": squeeze(which), "begin": squeeze(np.diff(s.begin, prepend=0).astype(np.uint32)),
        "left": squeeze((s.begin - s.left).astype(np.uint32)), "right": squeeze((s.right - s.begin).astype(np.uint32)), "shut": squeeze(s.shut.view(np.uint8)),
    }]
    at, size = runs(route)
    for a, m in zip(at, size):
        rows.append({"kind": 1, "slice": slice_id, "block": int(route[a]), "n": int(m), "known": names[a : a + m].tobytes(), "which": np.packbits(several[a : a + m]).tobytes()})
    return rows


def restored(row: dict, k: int):
    """(docs, count, tok, alive, anchor, symbols with their name's index, known names) of a state row."""
    docs, count, words, code = expand(row["docs"], np.int64), expand(row["count"], np.int64), expand(row["words"], U64), expand(row["code"], np.uint32)
    tok = words[code] if len(code) else np.zeros(0, U64)
    anchor = expand(row["anchor"], U64).copy()
    alive = np.unpackbits(expand(row["alive"], np.uint8), count=len(anchor)).astype(bool)
    begin = np.cumsum(expand(row["begin"], np.uint32).astype(np.int64))
    doc = np.searchsorted(np.cumsum(count), begin, side="right").astype(np.int32)
    left, right = begin - expand(row["left"], np.uint32), begin + expand(row["right"], np.uint32)
    shut = expand(row["shut"], np.uint8).astype(bool)
    return docs, count, tok, alive, anchor, Symbols(expand(row["which"], np.uint32).astype(np.int64), doc, begin, left, right, shut, np.zeros(len(begin), bool)), expand(row["known"], U64)


def cut(batches, blocks: int, k: int):
    """The first round's steps over texts."""
    turn = 0
    for b in slices(batches, SLICE):
        tok, doc = tokenize(b.column(1))
        ids, count = np.asarray(b.column(0)).astype(np.int64), np.bincount(doc, minlength=b.num_rows)
        ids, count = ids[count >= k], np.where(count >= k, count, 0)
        kept = count[doc] > 0 if len(doc) else np.zeros(0, bool)
        tok, doc, count = tok[kept], doc[kept], count[count > 0]
        if not len(tok):
            continue
        doc = np.repeat(np.arange(len(count), dtype=np.int32), count)
        alive = doc[: len(tok) - k + 1] == doc[k - 1 :]
        s = start(tok, doc)
        for j in range(FIRST):
            s = step(s, j)
        s.fresh[:] = True
        s = close(s, held(s, alive, k))
        yield from table_of(stored((TaskContext.get().partitionId() << 32) + turn, blocks, ids, count, tok, s, alive, np.zeros(len(alive), U64), k)).to_batches()
        turn += 1


def named(batches, turn: int):
    """A block's names: for each that occurs more than once in the corpus a number that no other has, 0 for the rest; by slice."""
    slice_of, keys, several, block = [], [], [], 0
    for b in batches:
        for s, m, data, often in zip(b.column("slice").to_pylist(), b.column("n").to_pylist(), b.column("known"), b.column("which")):
            slice_of.append(s)
            keys.append(np.frombuffer(data.as_buffer(), U64))
            several.append(np.unpackbits(np.frombuffer(often.as_buffer(), np.uint8), count=m))
        block = b.column("block")[0].as_py() if b.num_rows else block
    if not keys:
        return
    every, at = np.unique(np.concatenate(keys), return_inverse=True)
    shared = np.bincount(at, weights=1 + np.concatenate(several), minlength=len(every)) > 1
    name = np.where(shared, np.cumsum(shared).astype(U64) | U64((turn + 1) << 56) | U64(block << 36), U64(0))
    given, done = name[at], 0
    for s, x in zip(slice_of, keys):
        yield pa.RecordBatch.from_pydict({"slice": pa.array([s], pa.int64()), "block": pa.array([block], pa.int32()), "names": pa.array([squeeze(given[done : done + len(x)])], pa.binary())})
        done += len(x)
    trim()


def advance(state: pa.Table, answers: pa.Table, turn: int, blocks: int, k: int) -> pa.Table:
    """A slice after a round of naming, and the next round's steps."""
    row = {c: state.column(c)[0] for c in state.column_names}
    docs, count, tok, alive, anchor, s, known = restored(row, k)
    order = np.argsort(np.asarray(answers.column("block"))) if answers.num_rows else []
    given = [expand(answers.column("names")[int(i)], U64) for i in order]
    names = np.concatenate([*given, known]) if given or len(known) else np.zeros(1, U64)
    s.name = np.where(s.shut, U64(0), names[np.minimum(s.name, len(names) - 1)]) if len(s.name) else np.zeros(0, U64)
    s, alive = settle(s, alive, anchor, k)
    for j in range(STEPS):
        s = step(s, FIRST + turn * STEPS + j)
    s = close(s, held(s, alive, k))
    return table_of(stored(row["slice"].as_py(), blocks, docs, count, tok, s, alive, anchor, k))


def coded(tok: np.ndarray) -> bytes:
    words, code = np.unique(tok, return_inverse=True)
    words = squeeze(words)
    return len(words).to_bytes(8, "little") + words + squeeze(code.astype(np.uint32))


def decoded(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    return expand(data[8 : 8 + n], U64)[expand(data[8 + n :], np.uint32)]


def reveal(batches, blocks: int, k: int):
    """Windows still in question after the last round, to blocks by anchor, with their tokens."""
    for b in batches:
        for r in range(b.num_rows):
            docs, count, tok, alive, anchor, _, _ = restored({c: b.column(c)[r] for c in b.schema.names}, k)
            windows = np.flatnonzero(alive)
            if not len(windows):
                continue
            bare = windows[anchor[windows] == 0]
            if len(bare):
                anchor[bare] = least_in(mix(tok), bare, np.full(len(bare), k))
            doc = np.repeat(np.arange(len(count)), count)
            first, n, name = segments(anchor[windows], windows, doc)
            size = n + k - 1
            begins = np.cumsum(count) - count
            yield rows_by_block(blocks, name, docs[doc[first]], first - begins[doc[first]], n, np.zeros(len(first)), tok[spread(first, size)], size, coded)
    trim()


def equal_windows(tok: np.ndarray, a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """Whether the k tokens at a are those at b."""
    out = np.ones(len(a), bool)
    for at in range(0, len(a), 1 << 16):
        part = slice(at, at + (1 << 16))
        out[part] = (tok[a[part, None] + np.arange(k)] == tok[b[part, None] + np.arange(k)]).all(1)
    return out


def verified(anchor, doc, begin, count, tok, k: int, prints=window_prints):
    """Hits among segments: each window that has the tokens of an earlier one. Fingerprints only sort; tokens decide."""
    size = count + k - 1
    at = np.cumsum(size) - size
    where = spread(at, count)
    segment = np.repeat(np.arange(len(count), dtype=np.int64), count)
    place = begin[segment] + where - at[segment]
    content, salt = prints(tok, k)[where], np.zeros(len(where), np.int64)
    head = np.arange(len(where))
    order = np.argsort(content, kind="stable")
    _, lengths = runs(content[order])
    todo = order[np.repeat(lengths > 1, lengths)]  # windows that aren't alone
    while len(todo):
        s = segment[todo]
        todo = todo[np.lexsort((place[todo], doc[s], anchor[s], salt[todo], content[todo]))]
        s = segment[todo]
        new = np.concatenate([[True], (content[todo][1:] != content[todo][:-1]) | (salt[todo][1:] != salt[todo][:-1]) | (anchor[s][1:] != anchor[s][:-1])])
        lead = todo[np.flatnonzero(new)[np.cumsum(new) - 1]]
        same = equal_windows(tok, where[todo], where[lead], k)
        head[todo[same]] = lead[same]
        todo = todo[~same]  # another text of the same fingerprint: sorted anew among its like
        salt[todo] += 1
    later = (doc[segment] != doc[segment[head]]) | (place != place[head])
    keep = np.flatnonzero(later)
    return hits(doc[segment], place, later, segment, doc[segment[head]], place[head], np.full(len(where), k)) if len(keep) else None


def meet(batches, k: int):
    anchor, doc, begin, count, content = [], [], [], [], []
    for b in batches:
        for kind, into, column in ((U64, anchor, 1), (np.int64, doc, 2), (np.int64, begin, 3), (np.uint32, count, 4)):
            into += [np.frombuffer(c.as_buffer(), kind) for c in b.column(column)]
        content += [decoded(c.as_py()) for c in b.column(6)]
    if anchor:
        anchor, doc, begin, count, content = map(np.concatenate, (anchor, doc, begin, count, content))
        found = verified(anchor, doc, begin, count.astype(np.int64), content, k)
        if found is not None:
            yield found
    trim()


def find_repeats(docs: DataFrame, k: int = K) -> DataFrame:
    """Spans of at least k tokens that an earlier place has too: doc_id, start, n_tokens (in tokens of the
    document), first_doc_id and first_start, the earliest place of the k tokens at start. Earlier: of
    lower doc_id, or before it in the same document, overlap allowed. So the first copy has no span and
    stays; cutting the spans removes the rest.

    Texts of fewer than k tokens, null and empty ones have no span; rows without doc_id are left out.
    Rows that repeat a doc_id are taken at the same place, so neither is a later copy of the other.
    An empty table gives no rows. Extra columns aren't read.
    """
    blocks = n_blocks(docs.sparkSession)
    state = shared_table(id_and_text(docs).mapInArrow(lambda batches: cut(batches, blocks, k), STATE), "recompress")
    naming = lambda turn: lambda batches: named(batches, turn)
    advancing = lambda turn: lambda a, b: advance(a, b, turn, blocks, k)
    turn = 0
    while not state.where("kind = 1").isEmpty():  # each round joins symbols, and those that outgrow k tokens are closed, so rounds end
        names = to_blocks(state.where("kind = 1").select("slice", "block", "n", "known", "which")).mapInArrow(naming(turn), "slice long, block int, names binary")
        both = state.where("kind = 0").groupBy("slice").cogroup(names.groupBy("slice"))
        before, state = state, shared_table(both.applyInArrow(advancing(turn), STATE), "recompress")
        drop_table(before)
        turn += 1
    packed = state.where("kind = 0").mapInArrow(lambda batches: reveal(batches, blocks, k), ROW)
    return union_spans(to_blocks(packed).mapInArrow(lambda batches: meet(batches, k), HITS))
