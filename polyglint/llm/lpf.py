"""Suffix-array dedup by longest-previous-factor arrays.

Suffixes that share K tokens share the least hash of the short grams in them; by that hash they are
sent, in segments with their tokens, to one block. A block sorts its suffixes by prefix doubling and
walks their order: for each suffix the nearest ones before and after it that begin earlier in the
corpus (previous and next smaller positions) give its longest previous factor. Where that has K
tokens or more, the tokens are a later copy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import U64, id_and_text, mix, n_blocks, runs, slices, spread, to_blocks, tokenize
from .recompress import window_prints
from .spans import HITS, K, ROW, hits, rows_by_block, segments, union_spans

GRAM = 4
PIECE = 400_000  # tokens whose suffixes are sorted at once; bounds memory, not the input


def least_gram(tok: np.ndarray, k: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every gram, least of those within every k tokens)."""
    with np.errstate(over="ignore"):
        h = tok[: len(tok) - gram + 1].copy()
        for j in range(1, gram):
            h = mix(h * U64(0x9E3779B97F4A7C15) + tok[j : len(tok) - gram + 1 + j])
    width, low, size = k - gram + 1, h, 1
    while 2 * size <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    rest = width - size
    return h, np.minimum(low[: len(low) - rest], low[rest:])


def ranks(symbols: np.ndarray) -> dict[int, np.ndarray]:
    """Rank of each suffix by its first 1, 2, 4, ... symbols, until all ranks differ."""
    _, rank = np.unique(symbols, return_inverse=True)
    rank, size = rank.astype(np.int64), 1
    out = {1: rank.astype(np.int32)}
    while len(rank) and rank.max() < len(rank) - 1 and size < len(rank):
        following = np.zeros(len(rank), np.int64)
        following[:-size] = rank[size:] + 1
        key = (rank << 32) | following
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[False], key[order][1:] != key[order][:-1]])
        rank = np.empty(len(key), np.int64)
        rank[order] = np.cumsum(new)
        size *= 2
        out[size] = rank.astype(np.int32)
    return out


def common_prefix(rank: dict[int, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of what suffixes a and b share."""
    n, length = len(rank[1]), np.zeros(len(a), np.int64)
    for size in sorted(rank, reverse=True):
        x, y = np.minimum(a + length, n - 1), np.minimum(b + length, n - 1)
        length += np.where((rank[size][x] == rank[size][y]) & (a + length < n) & (b + length < n), size, 0)
    return length


def smaller_before(key: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Index of the nearest smaller key before each, within its group; -1 where there is none."""
    before = np.arange(len(key)) - 1
    if len(key):
        before[np.concatenate([[True], group[1:] != group[:-1]])] = -1
    open_ = np.flatnonzero(before >= 0)
    while len(open_):
        open_ = open_[key[before[open_]] >= key[open_]]
        before[open_] = before[before[open_]]
        open_ = open_[before[open_] >= 0]
    return before


def longest_previous(symbols: np.ndarray, suffixes: np.ndarray, place: np.ndarray, k: int):
    """LPF of the given suffixes: (length, 0 below k; the earliest suffix sharing k symbols). place: each suffix's order in the corpus.

    symbols: texts end to end, each closed by a symbol of its own, so factors are told in full length.
    """
    rank = ranks(symbols)
    order = np.argsort(rank[max(rank)][suffixes], kind="stable")
    s, p = suffixes[order], place[order]
    near = common_prefix(rank, s[:-1], s[1:]) if len(s) > 1 else np.zeros(0, np.int64)
    group = np.concatenate([[0], np.cumsum(near < k)]) if len(s) else np.zeros(0, np.int64)
    before = smaller_before(p, group)
    after = len(s) - 1 - smaller_before(p[::-1], group[::-1])[::-1]
    after[after == len(s)] = -1
    length = np.zeros(len(s), np.int64)
    for other in (before, after):
        has = np.flatnonzero(other >= 0)
        length[has] = np.maximum(length[has], common_prefix(rank, s[has], s[other[has]]))
    head, _ = runs(group)
    low = np.minimum.reduceat(p, head) if len(p) else p
    by = np.lexsort((p, group))
    first = s[by][head] if len(p) else s
    out, source = np.zeros(len(s), np.int64), np.zeros(len(s), np.int64)
    out[order], source[order] = length, first[group] if len(p) else s
    return out, source


def find_copies(docs: DataFrame, k: int = K) -> DataFrame:
    """Spans whose longest previous factor has k tokens or more: doc_id, start, n_tokens (in tokens of the
    document), first_doc_id and first_start, the earliest place of the k tokens at start. Previous: of
    lower doc_id, or before it in the same document, overlap allowed. The first copy has no span and
    stays; cutting the spans removes the later ones.

    Texts of fewer than k tokens, null and empty ones have no span; rows without doc_id are left out.
    Rows that repeat a doc_id are taken at the same place, so neither is a later copy of the other.
    An empty table gives no rows. Extra columns aren't read.
    """
    blocks = n_blocks(docs.sparkSession)

    def cut(batches):
        codec = pa.Codec("zstd", 1)
        for b in slices(batches, 4 << 20):
            tok, doc = tokenize(b.column(1))
            if len(tok) < k:
                continue
            windows = np.flatnonzero(doc[: len(tok) - k + 1] == doc[k - 1 :])
            if not len(windows):
                continue
            gram, low = least_gram(tok, k)
            first, count, anchor = segments(low[windows], windows, doc)
            begins = np.zeros(b.num_rows, np.int64)
            at, _ = runs(doc)
            begins[doc[at]] = at
            size = count + k - 1
            where = spread(first, size)
            again = np.add.reduceat(gram[np.minimum(where, len(gram) - 1)] == np.repeat(anchor, size), np.cumsum(size) - size, dtype=np.int64)
            yield rows_by_block(blocks, anchor, np.asarray(b.column(0))[doc[first]], first - begins[doc[first]], count, again > 1, (tok[where] >> U64(32)).astype(np.uint32), size, lambda x: codec.compress(x.tobytes(), asbytes=True))

    def meet(batches):
        codec = pa.Codec("zstd")
        anchor, doc, start, count, flag, content = [], [], [], [], [], []
        for b in batches:
            for kind, into, column in ((U64, anchor, 1), (np.int64, doc, 2), (np.int64, start, 3), (np.uint32, count, 4), (np.uint8, flag, 5)):
                into += [np.frombuffer(c.as_buffer(), kind) for c in b.column(column)]
            for c, n in zip(b.column(6), b.column(4)):
                size = np.frombuffer(n.as_buffer(), np.uint32).astype(np.int64) + k - 1
                content.append(np.frombuffer(codec.decompress(c.as_buffer(), int(4 * size.sum())), np.uint32))
        if not anchor:
            return
        anchor, doc, start, count, flag, content = map(np.concatenate, (anchor, doc, start, count, flag, content))
        count = count.astype(np.int64)
        size = count + k - 1
        begins = np.cumsum(size) - size
        order = np.argsort(anchor, kind="stable")
        at, lengths = runs(anchor[order])
        kept = np.repeat(lengths > 1, lengths) | (flag[order] > 0)
        order, group = order[kept], np.repeat(np.arange(len(at)), lengths)[kept]
        # whole anchors at a time, about PIECE tokens
        piece = (np.cumsum(size[order]) // PIECE).astype(np.int64)
        head, members = runs(group)
        piece = np.repeat(piece[head], members) if len(order) else piece
        for a, n in zip(*runs(piece)):
            part = np.sort(order[a : a + n])
            yield arrange(doc[part], start[part], count[part], content[spread(begins[part], size[part])])

    def arrange(doc, start, count, tokens):
        """Hits of one piece. Windows whose fingerprint is alone in it are trimmed off, what is left is told apart by
        content, and the different contents' suffixes are sorted: a hot passage is sorted once however often it is there."""
        size = count + k - 1
        at = np.cumsum(size) - size
        windows = spread(at, count)
        prints = window_prints(mix(tokens.astype(U64)), k)[windows]
        order = np.argsort(prints, kind="stable")
        _, lengths = runs(prints[order])
        often = np.zeros(len(windows), bool)
        often[order[np.repeat(lengths > 1, lengths)]] = True
        segment = np.repeat(np.arange(len(count), dtype=np.int64), count)
        w = np.flatnonzero(often)
        new = np.concatenate([[True], (np.diff(w) != 1) | (segment[w[1:]] != segment[w[:-1]])]) if len(w) else np.zeros(0, bool)
        head = np.flatnonzero(new)
        n = np.diff(np.append(head, len(w)))
        first = w[head]
        begin, sub_doc = windows[first], doc[segment[first]]
        sub_start = start[segment[first]] + begin - at[segment[first]]
        with np.errstate(over="ignore"):
            nth = np.arange(len(w)) - np.repeat(head, n)
            name = np.add.reduceat(mix(prints[w] + mix(nth.astype(U64) + U64(1))), head) if len(head) else np.zeros(0, U64)
        by = np.lexsort((sub_start, sub_doc, n, name))
        other = np.concatenate([[True], (name[by][1:] != name[by][:-1]) | (n[by][1:] != n[by][:-1])]) if len(by) else np.zeros(0, bool)
        lead = by[other]  # of each content the earliest place
        of = np.empty(len(by), np.int64)
        of[by] = np.cumsum(other) - 1
        size = n[lead] + k - 1
        to = np.cumsum(size + 1) - (size + 1)
        symbols = np.zeros(int((size + 1).sum()), np.int64)
        symbols[spread(to, size)] = tokens[spread(begin[lead], size)]
        symbols[to + size] = (np.int64(1) << 32) + np.arange(len(size))
        suffixes = spread(to, n[lead])
        own = np.repeat(np.arange(len(lead)), n[lead])
        place = sub_start[lead][own] + suffixes - to[own]
        d = sub_doc[lead][own]
        by = np.lexsort((place, d))
        turn = np.empty(len(by), np.int64)  # rows of one id at one position have one turn
        turn[by] = np.cumsum(np.concatenate([[False], (d[by][1:] != d[by][:-1]) | (place[by][1:] != place[by][:-1])])) if len(by) else by
        length, source = longest_previous(symbols, suffixes, turn, k)
        src = np.searchsorted(to, source, side="right") - 1
        first_doc, first_start = sub_doc[lead][src], sub_start[lead][src] + source - to[src]
        # back to all places: a copy of an earlier lead is repeated to its end
        offset = np.cumsum(n[lead]) - n[lead]
        at_lead = np.repeat(offset[of], n) + nth
        copy = (sub_doc != sub_doc[lead[of]]) | (sub_start != sub_start[lead[of]])
        rest = np.repeat(n, n) - nth + k - 1
        got = np.where(np.repeat(copy, n), np.maximum(rest, length[at_lead] if len(at_lead) else 0), length[at_lead] if len(at_lead) else 0)
        sub = np.repeat(np.arange(len(n), dtype=np.int64), n)
        return hits(sub_doc[sub], sub_start[sub] + nth, got >= k, sub, first_doc[at_lead], first_start[at_lead], got)

    packed = id_and_text(docs).mapInArrow(cut, ROW)
    return union_spans(to_blocks(packed).mapInArrow(meet, HITS))
