"""LM scoring with a causal self-attention model trained in numpy on subword ids.

A word is cut into subwords of a public byte-level BPE vocabulary (a parameter). P(token | before) =
P(class | before) P(token | class): classes part the vocabulary into bins of about equal mass, and
P(token | class) comes from counts over all documents. P(class | before) is one block of causal
self-attention over a window. Training data is all tokens of every document, in windows end to
end, stored in the shared folder; in each round every shard trains a copy of the model and the
copies are averaged. Ids are stored as 16 bits where the vocabulary allows it, in windows too. To score, a document's windows overlap: all but the first give their first
WINDOW - STRIDE tokens as context only, so each token is scored once, with that much context at
least; a mask hides later tokens, and windows go through attention in batches.
"""

from __future__ import annotations

import base64
import functools
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_batch, id_and_text, keep_memory, mix, shared_table, slices, spread, trim

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
WINDOW, STRIDE, WIDTH, CLASSES, HASHED = 32, 24, 16, 64, 4096
ROUNDS, RATE, BATCH, SCORED = 3, 0.01, 64, 96
SHARD = 64  # batches of training windows that one copy of the model sees in a round
COPIES = 16  # copies that a task trains one after another and adds up
_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CLOSED = _PATTERN.removesuffix(r"\s+(?!\S)|\s+") + r"\n"  # the same for closed words, which hold no other white space; without looking ahead it is faster


@functools.lru_cache(maxsize=2)
def encoder(path: str, pattern: str = _PATTERN):
    import tiktoken

    if os.path.isdir(path):
        path = os.path.join(path, os.path.basename(VOCABULARY))
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def closed(words: pa.Array) -> str:
    """Each word between a space and a line feed, end to end, without a Python string for each."""
    if not len(words):
        return ""
    _, offsets, data = pc.binary_join_element_wise(" ", words, "\n", "").buffers()
    return str(memoryview(data)[: np.frombuffer(offsets, np.int32)[len(words)]], "utf-8")


def subwords(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(subword ids end to end, number of ids of each text). Words are parted by white space; each is cut with one space before it."""
    split = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
    per_text = np.diff(np.asarray(split.offsets))
    coded = split.flatten().dictionary_encode()
    # one call for all words, each closed by a line feed, which is always a subword of its own here
    enc, words = encoder(path, _CLOSED), coded.dictionary
    full = np.asarray(pc.binary_length(words)) > 0  # splitting leaves empty words at a text's ends
    flat = np.array(enc.encode_ordinary(closed(words.filter(pa.array(full)))), np.int32)
    stops = flat == enc.encode_single_token(b"\n")
    size = np.zeros(len(words), np.int64)
    size[full] = np.diff(np.concatenate([[-1], np.flatnonzero(stops)])) - 1
    flat = flat[~stops]
    begin = np.cumsum(size) - size
    codes = np.asarray(coded.indices).astype(np.int64)
    if not len(codes):
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    n = size[codes]
    ids = flat[spread(begin[codes], n)]
    count = np.bincount(np.repeat(np.arange(len(texts)), per_text), weights=n, minlength=len(texts)).astype(np.int64)
    return ids, count


def vocabulary_size(path: str) -> int:
    return encoder(path).max_token_value + 1


class Classes:
    """Bins of the vocabulary by frequency and each id's log P(id | its class), from counts over the whole corpus, plus one each."""

    def __init__(self, counts: np.ndarray):
        mass = counts.astype(np.float64) + 1
        order = np.argsort(-mass, kind="stable")
        share = np.cumsum(mass[order]) / mass.sum()
        self.of = np.empty(len(mass), np.int64)
        self.of[order] = np.minimum((share - 1e-12) * CLASSES, CLASSES - 1).astype(np.int64)
        self.within = np.log(mass / np.bincount(self.of, weights=mass, minlength=CLASSES)[self.of]).astype(np.float32)


SHAPES = {"token": (HASHED, WIDTH), "class": (CLASSES + 1, WIDTH), "place": (WINDOW, WIDTH), "q": (WIDTH, WIDTH), "k": (WIDTH, WIDTH), "v": (WIDTH, WIDTH), "o": (WIDTH, WIDTH), "up": (WIDTH, 2 * WIDTH), "down": (2 * WIDTH, WIDTH), "out": (WIDTH, CLASSES), "bias": (1, CLASSES)}
SIZE = sum(a * b for a, b in SHAPES.values())
_PAIRS = np.arange(max(HASHED, CLASSES + 1) * (WIDTH // 2)).reshape(-1, WIDTH // 2)
_LOWER = np.tril(np.ones((WINDOW, WINDOW), np.float32))
_MASK = np.triu(np.full((WINDOW, WINDOW), -1e9, np.float32), 1)


def parts(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, (a, b) in SHAPES.items():
        out[name] = flat[at : at + a * b].reshape(a, b)
        at += a * b
    return out


def start_weights(seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    flat = np.concatenate([(rng.normal(size=a * b) * (0.1 if name in ("token", "class", "place", "out") else 1 / np.sqrt(a))).astype(np.float32) for name, (a, b) in SHAPES.items()])
    parts(flat)["bias"][:] = 0
    return flat


def forward(w: dict, before: np.ndarray, classes: np.ndarray):
    """Hidden states and log P(class) at each place. before: the id before each (-1: none), classes: that id's class (CLASSES: none). Both (windows, places)."""
    length = before.shape[1]
    x = w["token"][before % HASHED] + w["class"][classes] + w["place"][:length]
    q, k, v = x @ w["q"], x @ w["k"], x @ w["v"]
    a = q @ k.transpose(0, 2, 1)
    a *= np.float32(1 / np.sqrt(WIDTH))
    np.clip(a, -30, 30, out=a)
    a += _MASK[:length, :length]
    np.exp(a, out=a)
    a /= a.sum(2, keepdims=True)
    mixed = a @ v
    h = x + mixed @ w["o"]
    up = h @ w["up"]
    f = np.maximum(up, 0)
    z = h + f @ w["down"]
    logits = z @ w["out"] + w["bias"]
    logits -= logits.max(2, keepdims=True)
    e = np.exp(logits)
    total = e.sum(2, keepdims=True)
    return (x, q, k, v, a, mixed, h, f, z, e / total), logits - np.log(total)


def product_over_rows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a.T @ b of tall arrays, in stretches of rows, which is twice as fast."""
    if len(a) % 256:
        return a.T @ b
    return (a.reshape(-1, 256, a.shape[1]).transpose(0, 2, 1) @ b.reshape(-1, 256, b.shape[1])).sum(0)


def add_rows(to: np.ndarray, index: np.ndarray, rows: np.ndarray) -> None:
    """to[index] += rows, where indices repeat. Pairs of numbers are added as one complex number."""
    np.add.at(to.reshape(-1).view(np.complex64), _PAIRS.take(index, 0).ravel(), rows.reshape(-1).view(np.complex64))


def gradient(w: dict, before: np.ndarray, classes: np.ndarray, target: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean loss of the targets (classes; -1: no token there) and its gradient."""
    windows, length = before.shape
    token, kind, t = (before & (HASHED - 1)).ravel().astype(np.int64), classes.ravel(), target.ravel()
    real = t >= 0
    n = max(1, int(real.sum()))
    spot = np.arange(0, t.size * CLASSES, CLASSES)
    spot += np.maximum(t, 0)
    # forward(), in place; q is scaled with its weights, and attention is divided by its sums after it has met v
    x = w["token"].take(token, 0)
    x += w["class"].take(kind, 0)
    x.reshape(windows, -1)[:] += w["place"][:length].ravel()
    scale = np.float32(1 / np.sqrt(WIDTH))
    wide = np.concatenate([w["q"] * scale, w["k"], w["v"]], 1)
    qkv = (x @ wide).reshape(windows, length, 3, WIDTH)
    q, k, v = qkv[:, :, 0], qkv[:, :, 1], qkv[:, :, 2]
    a = q @ np.ascontiguousarray(k.transpose(0, 2, 1))  # products of small matrices take twice as long otherwise
    np.clip(a, -30, 30, out=a)
    np.exp(a, out=a)
    a *= _LOWER[:length, :length]
    over = 1 / (a.reshape(-1, length) @ np.ones(length, np.float32))[:, None]
    mixed = (a @ v).reshape(-1, WIDTH)
    mixed *= over
    h = mixed @ w["o"]
    h += x
    f = h @ w["up"]
    np.clip(f, 0, np.inf, out=f)  # faster than maximum
    z = f @ w["down"]
    z += h
    dl = z @ w["out"]
    dl.reshape(windows, -1)[:] += np.tile(w["bias"][0], length)
    if max(dl.max(), -dl.min()) > 60:  # keeps exp finite, and sums above zero
        dl -= dl.max(1, keepdims=True)
    each = dl.reshape(-1)
    hit = each.take(spot)
    np.exp(dl, out=dl)
    total = dl @ np.ones(CLASSES, np.float32)
    loss = float((np.log(total) - hit)[real].sum()) / n
    # dl times share is the loss's gradient; what it meets is multiplied, which is narrower
    each[spot] -= total
    share = real * np.float32(1 / n) / total
    flat = np.zeros(SIZE, np.float32)
    g = parts(flat)
    g["out"][:], g["bias"][:] = product_over_rows(z * share[:, None], dl), share @ dl
    dz = dl @ w["out"].T
    dz *= share[:, None]
    g["down"][:] = product_over_rows(f, dz)
    du = dz @ w["down"].T
    du *= f > 0
    g["up"][:] = product_over_rows(h, du)
    dh = du @ w["up"].T
    dh += dz
    g["o"][:] = product_over_rows(mixed, dh)
    dm = dh @ w["o"].T
    dm *= over
    away = ((dm * mixed) @ np.ones(WIDTH, np.float32)).reshape(windows, length, 1)
    dm = dm.reshape(windows, length, WIDTH)
    ds = dm @ np.ascontiguousarray(v.transpose(0, 2, 1))
    ds -= away
    ds *= a
    dqkv = np.empty((windows, length, 3, WIDTH), np.float32)
    np.matmul(ds, k, out=dqkv[:, :, 0])
    np.matmul(ds.transpose(0, 2, 1), q, out=dqkv[:, :, 1])
    np.matmul(a.transpose(0, 2, 1), dm, out=dqkv[:, :, 2])
    dqkv = dqkv.reshape(-1, 3 * WIDTH)
    dx = dqkv @ wide.T
    dx += dh
    g["q"][:], g["k"][:], g["v"][:] = np.split(product_over_rows(x, dqkv), 3, 1)
    g["q"][:] *= scale
    add_rows(g["token"], token, dx)
    add_rows(g["class"], kind, dx)
    g["place"][:length] = dx.reshape(windows, length, WIDTH).sum(0)
    return loss, flat


class Adam:
    """Steps by running means of the gradient and its square. The means are kept without the factors 0.1 and 0.01, all in place."""

    def __init__(self):
        self.m, self.v, self.work, self.step = np.zeros(SIZE, np.float32), np.zeros(SIZE, np.float32), np.empty(SIZE, np.float32), 0

    def take(self, flat: np.ndarray, g: np.ndarray, rate: float) -> None:
        """One step from flat, in place; overwrites g."""
        self.step += 1
        self.m *= np.float32(0.9)
        self.m += g
        np.multiply(g, g, out=g)
        self.v *= np.float32(0.99)
        self.v += g
        root = np.sqrt(0.01 / (1 - 0.99**self.step))
        np.sqrt(self.v, out=self.work)
        self.work += np.float32(1e-8 / root)
        np.divide(self.m, self.work, out=self.work)
        self.work *= np.float32(rate * 0.1 / (1 - 0.9**self.step) / root)
        flat -= self.work


def train_windows(ids: np.ndarray, count: np.ndarray):
    """Yields windows of WINDOW + 1 ids (-1: none), BATCH at a time: each text from end to end, each token once after the first id, which is
    the one before. In a mixed order, so that a batch is of many texts."""
    wanted = -(-count // WINDOW)
    text = np.repeat(np.arange(len(count)), wanted)
    nth = spread(np.zeros(len(count), np.int64), wanted)
    begin = np.cumsum(count) - count
    order = np.argsort(mix(np.arange(len(text), dtype=np.uint64)))
    for a in range(0, len(text), BATCH):
        part = order[a : a + BATCH]
        at = nth[part, None] * WINDOW + np.arange(-1, WINDOW)
        inside = (at >= 0) & (at < count[text[part], None])
        yield np.where(inside, ids[np.minimum(begin[text[part], None] + np.maximum(at, 0), len(ids) - 1)], -1).astype(np.int32)


def kept_as(size: int):
    """The type that ids are stored in. Its greatest value is no id, as it stands for none."""
    return np.uint16 if size < 1 << 16 else np.uint32


def gather(docs: DataFrame, path: str) -> tuple[np.ndarray, DataFrame, DataFrame]:
    """stored(), but windows of int32, -1: none."""
    counts, windows, tokens = stored(docs, path)
    kind = kept_as(len(counts))

    def widen(batches):
        for b in batches:
            rows = [np.frombuffer(c.as_buffer(), kind) for c in b.column(0)]
            yield pa.RecordBatch.from_pydict({"data": pa.array([np.where(r == np.iinfo(kind).max, -1, r.astype(np.int32)).astype(np.int32).tobytes() for r in rows], pa.binary())})

    return counts, windows.mapInArrow(widen, "data binary"), tokens


def stored(docs: DataFrame, path: str) -> tuple[np.ndarray, DataFrame, DataFrame]:
    """(counts of every id over all documents, table of training windows, table of the documents' ids: docs, count, data).

    Texts are cut into subwords once. Batches of training windows are dealt to the shards at random, as averaging wants.
    Ids are of the type kept_as() tells, in windows with its greatest value for none.
    """
    size = vocabulary_size(path)
    kind = kept_as(size)
    schema = pa.schema([("part", pa.int32()), ("docs", pa.binary()), ("count", pa.binary()), ("data", pa.binary())])

    def work(batches):
        total = np.zeros(size + 1, np.int64)  # the last: training windows
        for b in slices(batches):
            doc_ids = np.asarray(b.column(0)).astype(np.int64)
            ids, count = subwords(b.column(1), path)
            total += np.bincount(ids, minlength=size + 1)
            total[size] += int((-(-count // WINDOW)).sum())
            yield as_batch(schema, part=[2], docs=[doc_ids.tobytes()], count=[count.tobytes()], data=[ids.astype(kind).tobytes()])
        if total.any():
            yield as_batch(schema, part=[1], docs=[None], count=[None], data=[total.tobytes()])

    made = shared_table(id_and_text(docs).mapInArrow(work, "part int, docs binary, count binary, data binary"), "lm")

    def cut(batches):
        for b in batches:
            for n, i in zip(b.column(0), b.column(1)):
                rows = []
                for w in train_windows(np.frombuffer(i.as_buffer(), kind).astype(np.int32), np.frombuffer(n.as_buffer(), np.int64)):
                    rows.append(w.astype(kind).tobytes())
                    if len(rows) == SHARD:
                        yield pa.RecordBatch.from_pydict({"data": pa.array(rows, pa.binary())})
                        rows = []
                yield pa.RecordBatch.from_pydict({"data": pa.array(rows, pa.binary())})
        trim()

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(size + 1, np.int64)
        for c in t.column("data"):
            total += np.frombuffer(c.as_buffer(), np.int64)
        return pa.table({"data": pa.array([total.tobytes()], pa.binary())})

    # two steps, so that no task adds up more than the square root of all tables
    counts = made.where("part = 1").select(F.pmod(F.xxhash64("data"), F.lit(64)).alias("g"), "data").groupBy("g").applyInArrow(add, "data binary")
    rows = counts.withColumn("g", F.lit(0)).groupBy("g").applyInArrow(add, "data binary").collect()
    total = np.frombuffer(rows[0]["data"], np.int64) if rows else np.zeros(size + 1, np.int64)
    tokens = made.where("part = 2").select("docs", "count", "data")
    windows = tokens.select("count", "data").mapInArrow(cut, "data binary").repartition(max(1, -(-int(total[size]) // (BATCH * SHARD * COPIES))), F.xxhash64("data"))
    return total[:size], shared_table(windows, "windows"), tokens


def train(windows: DataFrame, classes: Classes, rounds: int = ROUNDS, rate: float = RATE) -> np.ndarray:
    """The model's weights. windows: stored()'s. A round: each shard goes once over its windows from the same weights, by Adam; weights are averaged by the shards' windows."""
    sc, weights, size = windows.sparkSession.sparkContext, start_weights(), len(classes.of)
    kind_of, target_of = (sc.broadcast(np.append(classes.of, none)) for none in (CLASSES, -1))

    def shard(batches, sent, k):
        keep_memory()
        total, seen, adam = np.zeros(SIZE, np.float64), 0, None
        for b in batches:
            for c in b.column(0):
                part = np.frombuffer(c.as_buffer(), kept_as(size)).reshape(-1, WINDOW + 1)
                known = np.minimum(part, size)
                if adam is None:  # a copy begins
                    flat, mine, adam = sent.value.copy(), 0, Adam()
                _, g = gradient(parts(flat), part[:, :-1], kind_of.value.take(known[:, :-1]), target_of.value.take(known[:, 1:]))
                adam.take(flat, g, rate / (1 + k))
                mine += len(part)
                if adam.step == SHARD:
                    total, seen, adam = total + mine * flat.astype(np.float64), seen + mine, None
        if adam:
            total, seen = total + mine * flat.astype(np.float64), seen + mine
        if seen:
            yield pa.RecordBatch.from_pydict({"g": pa.array([TaskContext.get().partitionId() % 64], pa.int32()), "n": pa.array([seen], pa.int64()), "data": pa.array([(total / seen).astype(np.float32).tobytes()], pa.binary())})
        trim()

    def average(t: pa.Table) -> pa.Table:
        n, total = np.asarray(t.column("n")), np.zeros(SIZE, np.float64)
        for k, c in zip(n, t.column("data")):
            total += k * np.frombuffer(c.as_buffer(), np.float32).astype(np.float64)
        return pa.table({"g": pa.array([0], pa.int32()), "n": pa.array([int(n.sum())], pa.int64()), "data": pa.array([(total / max(1, n.sum())).astype(np.float32).tobytes()], pa.binary())})

    for k in range(rounds):
        sent = sc.broadcast(weights)
        kind = "g int, n long, data binary"
        copies = windows.mapInArrow(lambda batches, sent=sent, k=k: shard(batches, sent, k), kind)
        rows = copies.groupBy("g").applyInArrow(average, kind).groupBy("g").applyInArrow(average, kind).collect()
        if not rows:
            break
        weights = np.frombuffer(rows[0]["data"], np.float32).copy()
    return weights


def target_log_probs(w: dict, before: np.ndarray, classes: np.ndarray, target: np.ndarray, skip: int = 0) -> np.ndarray:
    """log P(target class) at each place from skip on: forward() without what only training needs, as few passes over memory as will do.
    Products are by window, so that equal windows get equal numbers wherever they stand: how a large product rounds depends on a row's place."""
    windows, length = before.shape
    x = w["token"].take(before & (HASHED - 1), 0)
    x += w["class"].take(classes, 0)
    x.reshape(windows, -1)[:] += w["place"][:length].ravel()
    qkv = (x @ w["qkv"]).reshape(windows, length, 3, WIDTH)
    a = qkv[:, skip:, 0] @ np.ascontiguousarray(qkv[:, :, 1].transpose(0, 2, 1))  # q was scaled with its weights
    np.clip(a, -30, 30, out=a)
    np.exp(a, out=a)
    a *= _LOWER[skip:length, :length]
    mixed = a @ qkv[:, :, 2]
    mixed /= a @ np.ones((length, 1), np.float32)
    h = mixed @ w["o"]
    h += x[:, skip:]
    f = h @ w["up"]
    np.clip(f, 0, np.inf, out=f)
    z = f @ w["down"]
    z += h
    logits = z @ w["out"]
    logits.reshape(windows, -1)[:] += np.tile(w["bias"][0], length - skip)
    if logits.max() > 60:  # far from any trained model; keeps exp finite all the same
        logits -= np.maximum(logits.max(2, keepdims=True) - 60, 0)
    hit = logits.reshape(-1).take(np.arange(0, logits.size, CLASSES) + target[:, skip:].ravel())
    np.exp(logits, out=logits)
    return hit.reshape(windows, -1) - np.log(logits @ np.ones((CLASSES, 1), np.float32))[:, :, 0]


def for_scoring(w: dict) -> dict:
    """The weights with q, k and v side by side, q scaled."""
    return {**w, "qkv": np.concatenate([w["q"] / np.float32(np.sqrt(WIDTH)), w["k"], w["v"]], 1)}


def score_texts(ids: np.ndarray, count: np.ndarray, w: dict, classes: Classes) -> np.ndarray:
    """Sum of log P(token | before) of each text, each token scored once. w: for_scoring()'s."""
    if not len(ids):
        return np.zeros(len(count))
    context = WINDOW - STRIDE
    n_windows = np.where(count > 0, 1 + np.maximum(0, -(-(count - WINDOW) // STRIDE)), 0)
    text = np.repeat(np.arange(len(count)), n_windows)
    nth = spread(np.zeros(len(count), np.int64), n_windows)
    first = (np.cumsum(count) - count)[text]
    left = count[text] - nth * STRIDE  # tokens from the window's start to the text's end
    begin = first + nth * STRIDE
    cls = classes.of.astype(np.int32)[ids]
    value = classes.within[ids].astype(np.float64)
    steps = np.arange(WINDOW)
    for head in (True, False):  # first windows of their texts, all of which is new, and others
        chosen, skip = np.flatnonzero((nth == 0) == head), 0 if head else context
        for a in range(0, len(chosen), SCORED):
            part = chosen[a : a + SCORED]
            at = np.minimum(begin[part, None] + steps, len(ids) - 1)
            earlier = np.maximum(at - 1, 0)
            before, kind = ids.take(earlier), cls.take(earlier)
            if head:
                before[:, 0], kind[:, 0] = -1, CLASSES  # nothing is before a text's first token
            logp = target_log_probs(w, before, kind, cls.take(at), skip)
            new = steps[skip:] < left[part, None]
            value[at[:, skip:][new]] += logp[new]
    some = np.flatnonzero(count > 0)
    total = np.zeros(len(count))
    total[some] = np.add.reduceat(value, (np.cumsum(count) - count)[some])
    return total


def score(docs: DataFrame, vocabulary: str = VOCABULARY, rounds: int = ROUNDS) -> DataFrame:
    """One row for each row of docs with a doc_id: doc_id, n_tokens, log_prob (natural log, of the whole text), perplexity.

    Null, empty and blank texts have no token, log_prob 0 and a null perplexity. Rows that repeat are
    scored one by one and alike. An empty table gives no rows. Extra columns aren't read.
    """
    spark = docs.sparkSession
    counts, windows, tokens = stored(docs, vocabulary)
    kind = kept_as(len(counts))
    classes = Classes(counts)
    weights = train(windows, classes, rounds)
    sent = spark.sparkContext.broadcast((weights, classes.of.astype(np.int64), classes.within))
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("log_prob", pa.float64()), ("perplexity", pa.float64())])

    def work(batches):
        keep_memory()
        flat, of, within = sent.value
        w, classes = for_scoring(parts(flat)), Classes.__new__(Classes)
        classes.of, classes.within = of, within
        for b in batches:
            for d, n, i in zip(*(b.column(k) for k in range(3))):
                ids, count = np.frombuffer(i.as_buffer(), kind).astype(np.int32), np.frombuffer(n.as_buffer(), np.int64)
                total = score_texts(ids, count, w, classes)
                perplexity = pa.array(np.exp(np.minimum(700, -total / np.maximum(1, count))), mask=count == 0)
                yield as_batch(schema, doc_id=np.frombuffer(d.as_buffer(), np.int64), n_tokens=count, log_prob=total, perplexity=perplexity)

    return tokens.mapInArrow(work, "doc_id long, n_tokens long, log_prob double, perplexity double")
