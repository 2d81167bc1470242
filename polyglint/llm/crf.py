"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line gets a label, good or bad. A line's scores come from features of itself and of the
lines before and after it; neighbouring labels are tied by transition weights. Forward-backward
marginals P(good), weighted by line length, average to the document's quality. The field is fitted
in numpy on a bounded sample of labelled documents (max_train of each class, a documented
parameter); everything else covers all documents. Labels are of documents, so the sample's lines are labelled first: all
lines of a good document are good; a bad document's lines are bad where a model of the line alone says so, one at
least, and the model is fitted to the labels again until they stay. The quality from which a document is
kept is the one that parts the sample best.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_batch, id_and_text, runs, slices

MAX_TRAIN, TURNS = 1500, 5
_KINDS = np.zeros(256, np.uint8)  # of a byte: 0 other, 1 letter, 2 upper case, 3 digit, 4 space, 5 sentence mark, 6 other mark
for _c in range(256):
    ch = chr(_c)
    _KINDS[_c] = 1 if _c >= 128 or ch.islower() else 2 if ch.isupper() else 3 if ch.isdigit() else 4 if ch.isspace() else 5 if ch in ".,;:!?'\"()-" else 6 if _c > 32 else 0
LOCAL = 10
FEATURES = 3 * LOCAL + 1


def line_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each line, its length in bytes, index of its text); lines without a visible character are left out."""
    split = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    per_text = np.diff(np.asarray(split.offsets))
    lines, doc = split.flatten(), np.repeat(np.arange(len(texts)), per_text)
    full = np.asarray(pc.not_equal(pc.utf8_trim_whitespace(lines), "").to_numpy(zero_copy_only=False), bool)
    lines, doc = lines.filter(pa.array(full)), doc[full]
    count = len(lines)
    if not count:
        return np.zeros((0, FEATURES)), np.zeros(0), doc
    lines = pa.concat_arrays([lines])
    offsets = np.frombuffer(lines.buffers()[1], np.int32)[lines.offset : lines.offset + count + 1]
    kinds = _KINDS[np.frombuffer(lines.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]]
    starts = (offsets[:-1] - offsets[0]).astype(np.int64)
    length = np.diff(offsets).astype(np.float64)
    share = {k: np.add.reduceat((kinds == k).view(np.uint8), starts, dtype=np.int64) / length for k in (2, 3, 4, 5, 6)}
    words = pc.utf8_split_whitespace(lines)
    n_words = np.maximum(1, np.diff(np.asarray(words.offsets)))
    codes = np.asarray(words.flatten().dictionary_encode().indices).astype(np.int64)
    line_of = np.repeat(np.arange(count), np.diff(np.asarray(words.offsets)))
    distinct = np.zeros(count)
    if len(codes):
        pair = np.sort((line_of << 32) | codes)
        distinct = np.bincount(pair[runs(pair)[0]] >> 32, minlength=count).astype(float)
    same = np.zeros(count)
    if len(codes) > 1:
        again = (codes[1:] == codes[:-1]) & (line_of[1:] == line_of[:-1])
        same = np.bincount(line_of[1:][again], minlength=count).astype(float)
    one = np.column_stack([
        np.log1p(length) / 6, share[2], share[3], share[4], np.minimum(1, 5 * share[5]), share[6], np.minimum(1, 20 * share[6]),
        distinct / n_words, same / n_words, np.minimum(3, length / n_words / 8),
    ])
    before, after = np.zeros_like(one), np.zeros_like(one)
    linked = doc[1:] == doc[:-1]
    before[1:][linked], after[:-1][linked] = one[:-1][linked], one[1:][linked]
    return np.column_stack([one, before, after, np.ones(count)]), length, doc


def _steps(doc: np.ndarray):
    """Texts by falling number of lines: their first lines, their lengths, and how many texts have a k-th line."""
    starts, lengths = runs(doc)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    active = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right") if len(lengths) else []
    return starts, lengths, active


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis)
    return top + np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis))


def marginals(score: np.ndarray, doc: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward over all texts at once: (P(label) of each line, expected label pairs, log partition)."""
    starts, lengths, active = _steps(doc)
    if not len(starts):
        return np.zeros((0, 2)), np.zeros((2, 2)), 0.0
    alpha, beta = np.zeros_like(score), np.zeros_like(score)
    alpha[starts] = score[starts]
    for k in range(1, len(active)):
        at = starts[: active[k]] + k
        alpha[at] = score[at] + _logsum(alpha[at - 1][:, :, None] + trans, 1)
    for k in range(len(active) - 1, 0, -1):
        at = starts[: active[k]] + k
        beta[at - 1] = _logsum(trans + (score[at] + beta[at])[:, None, :], 2)
    z = _logsum(alpha[starts + lengths - 1], 1)
    whole = np.zeros(len(doc))
    whole[np.sort(starts)] = 1
    z_line = z[np.argsort(starts)][(np.cumsum(whole) - 1).astype(np.int64)]
    second = np.flatnonzero(doc[1:] == doc[:-1]) + 1
    pairs = np.exp(alpha[second - 1][:, :, None] + trans + (score[second] + beta[second])[:, None, :] - z_line[second][:, None, None]).sum(0)
    return np.exp(alpha + beta - z_line[:, None]), pairs, float(z.sum())


def fit(x: np.ndarray, doc: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 150, penalty: float = 1e-3):
    """Weights (features by label) and transitions that maximise the labelled lines' conditional likelihood, by Adam. weight: of each text."""
    w, trans = np.zeros((x.shape[1], 2)), np.zeros((2, 2))
    if not len(x) or y.min() == y.max():
        return w, trans
    hot = np.eye(2)[y]
    each = weight[doc][:, None]
    second = np.flatnonzero(doc[1:] == doc[:-1]) + 1
    groups = [(c, np.isin(doc, np.flatnonzero(weight == c))) for c in np.unique(weight)]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[second - 1], y[second]), weight[doc[second]])
    total = float(weight[doc].sum())
    m, v = np.zeros(w.size + 4), np.zeros(w.size + 4)
    for k in range(1, steps + 1):
        p, expected = np.zeros_like(hot), np.zeros((2, 2))
        for c, rows in groups:
            p[rows], e, _ = marginals(x[rows] @ w, doc[rows], trans)
            expected += c * e
        g = np.concatenate([(x.T @ (each * (p - hot)) / total + penalty * w).ravel(), ((expected - seen) / total + penalty * trans).ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9)
        w, trans = w - step[:-4].reshape(w.shape), trans - step[-4:].reshape(2, 2)
    return w, trans


def label_lines(x: np.ndarray, doc: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A label for each line. y: of its document; doc: 0, 1, ... in order; weight: of each document."""
    own, line, z = x[:, [*range(LOCAL), FEATURES - 1]], np.arange(len(x)), y
    for _ in range(TURNS):
        w, _ = fit(own, line, z, weight[doc])
        score = own @ w
        worse = score[:, 0] - score[:, 1]
        new = np.where((y == 1) | (worse <= 0), 1, 0)
        starts, lengths = runs(doc)
        worst = np.lexsort((-worse, doc))[starts]  # of each document
        new[worst[y[worst] == 0]] = 0
        if np.array_equal(new, z):
            break
        z = new
    return z


def best_cut(quality: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(the quality from which documents are kept that parts the classes best, the mean share of either class told right); of equals the one nearest to 0.5."""
    cuts = np.unique(np.append(quality, 0.5))
    cuts = np.append((cuts[1:] + cuts[:-1]) / 2, 0.5)
    good, bad = np.sort(quality[y == 1]), np.sort(quality[y == 0])
    right = (1 - np.searchsorted(good, cuts, side="left") / max(1, len(good)) + np.searchsorted(bad, cuts, side="left") / max(1, len(bad))) / 2
    best = np.flatnonzero(right >= right.max() - 1e-9)
    k = best[np.argmin(np.abs(cuts[best] - 0.5))]
    return float(cuts[k]), float(right[k])


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN):
    """(weights, transitions, quality to keep from), fitted on at most max_train documents of either class, taken in the order of a hash of their id.

    A label of null is ignored; a document labelled both ways counts as bad. Without both classes
    the weights are zero, every quality is 0.5 and nothing is rejected. Where lines with their documents' labels part the
    sample's documents better, by more than a hundredth, those are used.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("y"))
    there = known.join(id_and_text(docs).select("doc_id").distinct(), "doc_id", "left_semi")
    picked = [there.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train) for y in (0, 1)]
    sample = id_and_text(docs).join(F.broadcast(picked[0].union(picked[1])), "doc_id").select("doc_id", "text", "y")  # 2 max_train rows at most

    def work(batches):
        for b in slices(batches):
            x, size, doc = line_features(b.column(1))
            starts, lengths = runs(doc)
            ids, y = np.asarray(b.column(0)), np.asarray(b.column(2))
            for s, n in zip(starts, lengths):
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([ids[doc[s]]], pa.int64()), "y": pa.array([y[doc[s]]], pa.int32()), "x": pa.array([x[s : s + n].astype(np.float32).tobytes()], pa.binary()), "size": pa.array([size[s : s + n].tobytes()], pa.binary())})

    rows = sample.mapInArrow(work, "doc_id long, y int, x binary, size binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["x"])))
    nothing = np.zeros((FEATURES, 2)), np.zeros((2, 2)), 0.5
    if not rows:
        return nothing
    xs = [np.frombuffer(r["x"], np.float32).reshape(-1, FEATURES) for r in rows]
    lines = np.array([len(x) for x in xs])
    y = np.array([r["y"] for r in rows])
    if y.min() == y.max():
        return nothing
    x, doc, size = np.vstack(xs).astype(float), np.repeat(np.arange(len(xs)), lines), np.concatenate([np.frombuffer(r["size"], np.float64) for r in rows])
    share = np.array([max(1, lines[y == c].sum()) for c in (0, 1)], float)
    weight = (lines.sum() / 2 / share)[y]
    tried = []
    for z in (label_lines(x, doc, np.repeat(y, lines), weight), np.repeat(y, lines)):
        if tried and (tried[0][3] > 0.99 or np.array_equal(z, tried[0][4])):
            break
        w, trans = fit(x, doc, z, weight)
        p, _, _ = marginals(x @ w, doc, trans)
        cut, right = best_cut(np.bincount(doc, weights=size * p[:, 1]) / np.bincount(doc, weights=size), y)
        tried.append((w, trans, cut, right, z))
    use = tried[-1] if tried[-1][3] > tried[0][3] + 0.01 else tried[0]
    return use[:3]


def judge(texts: pa.Array, w: np.ndarray, trans: np.ndarray):
    """(lines, bad lines, quality) of each text; a text without a visible character has quality 0."""
    x, length, doc = line_features(texts)
    p, _, _ = marginals(x @ w, doc, trans)
    n = np.bincount(doc, minlength=len(texts))
    bad = np.bincount(doc[p[:, 1] < 0.5], minlength=len(texts))
    total = np.bincount(doc, weights=length, minlength=len(texts))
    quality = np.divide(np.bincount(doc, weights=length * p[:, 1], minlength=len(texts)), total, out=np.zeros(len(texts)), where=total > 0)
    return n, bad, quality


def classify(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, keep_from: float | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, n_lines, n_bad, quality, keep (quality >= keep_from, by default what train() found).

    Null, empty and blank texts have no line, quality 0, and aren't kept. Rows that repeat are judged
    one by one and alike; a null doc_id stays null. Empty tables give no rows. Extra columns aren't
    read. A tie, quality equal to keep_from, is kept.
    """
    w, trans, cut = train(docs, labels, max_train)
    cut = cut if keep_from is None else keep_from
    schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_bad", pa.int64()), ("quality", pa.float64()), ("keep", pa.bool_())])

    def work(batches):
        for b in slices(batches):
            n, bad, quality = judge(b.column(1), w, trans)
            yield as_batch(schema, doc_id=b.column(0), n_lines=n, n_bad=bad, quality=quality, keep=(quality >= cut) & (n > 0))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, "doc_id long, n_lines long, n_bad long, quality double, keep boolean")


def reject(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, keep_from: float | None = None) -> DataFrame:
    """The rows of docs that classify() keeps, all their columns unchanged; decided row by row, so no join is needed.

    Null, empty and blank texts go; rows of null doc_id and repeated rows are judged like others. An empty table stays empty.
    """
    w, trans, cut = train(docs, labels, max_train)
    cut = cut if keep_from is None else keep_from

    @F.pandas_udf("double")
    def quality(text):
        import pandas as pd

        out = np.zeros(len(text))
        column = pa.RecordBatch.from_pydict({"text": pa.array(text, pa.string(), from_pandas=True)})
        at = 0
        for piece in slices([column]):
            n, _, q = judge(piece.column(0), w, trans)
            out[at : at + piece.num_rows] = np.where(n > 0, q, -1.0)
            at += piece.num_rows
        return pd.Series(out)

    return docs.where(quality(F.col("text").cast("string")) >= cut)
