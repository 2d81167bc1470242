"""The language model: gradients by finite differences, scores token by token, learning, cases."""

import math
import os

import numpy as np
import pyarrow as pa
import pytest

from polyglint.llm import lm

pytestmark = pytest.mark.skipif(not os.path.exists(lm.VOCABULARY), reason="no vocabulary file")


def test_subwords_are_each_words_own():
    texts = pa.array(["Hello  world\nnew", None, "", "  ", "naïve 12,5% x y"])
    ids, count = lm.subwords(texts, lm.VOCABULARY)
    enc, at = lm.encoder(lm.VOCABULARY), 0
    for t, n in zip(texts.to_pylist(), count):
        want = [i for w in (t or "").split() for i in enc.encode_ordinary(" " + w)]
        assert ids[at : at + n].tolist() == want
        at += n
    assert at == len(ids)


def test_gradient():
    rng = np.random.default_rng(0)
    flat = (lm.start_weights() * 2).astype(np.float64)
    before = rng.integers(0, 9000, (3, 7))
    before[:, 0] = -1
    classes = np.where(before >= 0, before % lm.CLASSES, lm.CLASSES)
    target = rng.integers(-1, lm.CLASSES, (3, 7))
    _, g = lm.gradient(lm.parts(flat.astype(np.float32)), before, classes, target)
    spots, at = [], 0
    for name, (a, b) in lm.SHAPES.items():
        here = np.flatnonzero(np.abs(g[at : at + a * b]) > 1e-3)
        spots += [at + i for i in here[:3]]
        at += a * b
    assert len(spots) > 20
    for i in spots:
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-2
        down[i] -= 1e-2
        num = (lm.gradient(lm.parts(up.astype(np.float32)), before, classes, target)[0] - lm.gradient(lm.parts(down.astype(np.float32)), before, classes, target)[0]) / 2e-2
        assert abs(num - g[i]) < 2e-3 + 0.05 * abs(num)


def test_each_token_is_scored_once_with_its_context():
    rng = np.random.default_rng(3)
    size = 500
    counts = rng.integers(0, 50, size)
    classes = lm.Classes(counts)
    # P(token) sums to one within the classes
    assert np.allclose(np.bincount(classes.of, weights=np.exp(classes.within.astype(float)), minlength=lm.CLASSES)[np.unique(classes.of)], 1, atol=1e-4)
    w = lm.parts(lm.start_weights())
    count = np.array([0, 1, 5, lm.WINDOW, lm.WINDOW + 1, 0, 3 * lm.WINDOW + 7])
    ids = rng.integers(0, size, count.sum()).astype(np.int32)
    got = lm.score_texts(ids, count, lm.for_scoring(w), classes)
    at = 0
    for n, total in zip(count, got):
        text, want = ids[at : at + n].astype(np.int64), 0.0
        at += n
        for t in range(n):
            first = 0 if t < lm.WINDOW else lm.STRIDE * -(-(t - lm.WINDOW + 1) // lm.STRIDE)
            before = np.concatenate([[-1], text])[first : t + 1][None]
            _, logp = lm.forward(w, before, np.where(before >= 0, classes.of[np.maximum(before, 0)], lm.CLASSES))
            want += logp[0, -1, classes.of[text[t]]] + classes.within[text[t]]
        assert math.isclose(total, want, abs_tol=1e-3 * max(1, n))


def test_later_tokens_are_masked():
    w = lm.for_scoring(lm.parts(lm.start_weights()))
    rng = np.random.default_rng(1)
    before = rng.integers(0, 4000, (1, lm.WINDOW)).astype(np.int32)
    other = before.copy()
    other[0, 10:] = rng.integers(0, 4000, lm.WINDOW - 10)
    target = np.zeros((1, lm.WINDOW), np.int64)
    a, b = (lm.target_log_probs(w, x, x % lm.CLASSES, target) for x in (before, other))
    assert np.allclose(a[0, :10], b[0, :10], atol=1e-5) and not np.allclose(a[0, 10:], b[0, 10:], atol=1e-5)


def test_scores_of_a_corpus(spark, docs, clashing, empty):
    rows = lm.score(clashing, rounds=1).collect()
    assert len(rows) == docs.where("doc_id is not null").count()
    for r in rows:
        if r.n_tokens == 0:
            assert r.doc_id in (300, 301, 302) and r.log_prob == 0 and r.perplexity is None
        else:
            assert r.log_prob < 0 and math.isclose(r.perplexity, math.exp(-r.log_prob / r.n_tokens), rel_tol=1e-9)
    three = {r.log_prob for r in rows if r.doc_id == 3}
    assert len(three) == 1  # repeated rows score alike
    assert lm.score(empty, rounds=1).count() == 0


def test_it_learns_order(spark):
    """Text in a fixed cycle of words scores better than the same words shuffled."""
    import random

    rng = random.Random(2)
    cycle = ["red", "stone", "river", "cloud", "paper", "glass", "wheel", "night"]
    rows = [(k, " ".join(cycle[(k + i) % 8] for i in range(60))) for k in range(1500)]
    mixed = [(9000 + k, " ".join(rng.choice(cycle) for _ in range(60))) for k in range(20)]
    out = {r.doc_id: r.perplexity for r in lm.score(spark.createDataFrame(rows + mixed, "doc_id long, text string")).collect()}
    good, bad = sorted(out[k] for k in range(100))[50], sorted(out[9000 + k] for k in range(20))[10]
    assert good * 1.3 < bad


def test_it_trains_on_every_token(spark):
    """Of texts of all lengths, a very long one too, each token is a target once, after the one before it."""
    texts = ["one", "", None, " ".join(f"w{k}" for k in range(lm.WINDOW)), " ".join(f"v{k % 977}" for k in range(5000))]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids, count = lm.subwords(pa.array(texts), lm.VOCABULARY)
    start = np.cumsum(count) - count
    want = sorted((-1 if i in start[count > 0] else int(ids[i - 1]), int(ids[i])) for i in range(len(ids)))
    counts, windows, _ = lm.gather(frame, lm.VOCABULARY)
    got = np.concatenate([np.frombuffer(r.data, np.int32).reshape(-1, lm.WINDOW + 1) for r in windows.collect()])
    real = got[:, 1:] >= 0
    assert sorted(zip(got[:, :-1][real].tolist(), got[:, 1:][real].tolist())) == want and counts.sum() == len(ids)


def test_stored_windows_are_as_narrow_as_ids(spark):
    """An id takes two bytes in the table of windows, and so on the way there, as in that of documents; none is told apart from every id."""
    frame = spark.createDataFrame([(k, " ".join(f"w{k * i}" for i in range(50 * k))) for k in range(8)], "doc_id long, text string")
    _, count = lm.subwords(pa.array([r.text for r in frame.orderBy("doc_id").collect()]), lm.VOCABULARY)
    _, windows, _ = lm.gather(frame, lm.VOCABULARY)
    held = sum(len(r.data) for r in spark.read.parquet(*windows.inputFiles()).collect())
    assert held == 2 * (lm.WINDOW + 1) * int((-(-count // lm.WINDOW)).sum())
    assert lm.kept_as(65_535) is np.uint16 and lm.kept_as(65_536) is np.uint32


def test_gradient_of_a_full_batch_is_its_windows_mean():
    """Tall products go in stretches of rows and repeated ids add up, as they do window by window."""
    rng = np.random.default_rng(4)
    w = lm.parts(lm.start_weights() * np.float32(2))
    before = rng.integers(0, 300, (lm.BATCH, lm.WINDOW))
    target = rng.integers(-1, lm.CLASSES, before.shape)
    loss, got = lm.gradient(w, before, before % lm.CLASSES, target)
    real = (target >= 0).sum(1)
    each = [lm.gradient(w, before[i : i + 1], before[i : i + 1] % lm.CLASSES, target[i : i + 1]) for i in range(lm.BATCH)]
    assert math.isclose(loss, sum(n * x for n, (x, _) in zip(real, each)) / real.sum(), rel_tol=1e-5)
    want = sum(n * g.astype(float) for n, (_, g) in zip(real, each)) / real.sum()
    assert np.allclose(got, want, atol=1e-5 * abs(want).max())


def test_training_takes_no_fresh_memory():
    """A worker's batches reuse the pages of those before: getting new ones took half as long as the work."""
    import subprocess
    import sys

    code = """
import resource
import numpy as np
from polyglint.llm import lm
lm.keep_memory()
w, x = lm.parts(lm.start_weights()), np.random.default_rng(0).integers(0, 5000, (lm.BATCH, lm.WINDOW))
faults = []
for _ in range(60):
    lm.gradient(w, x, x % lm.CLASSES, x % lm.CLASSES)
    faults.append(resource.getrusage(resource.RUSAGE_SELF).ru_minflt)
print((faults[-1] - faults[9]) / 50)
"""
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(__file__))))
    assert float(said.stdout) < 50, said.stderr


def test_words_are_cut_alike_without_looking_ahead():
    """Whatever character isn't white space to Arrow, within a word, at its end or alone: the pattern for closed words gives what the vocabulary's own gives."""
    import pyarrow.compute as pc

    every = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    whole = pc.list_value_length(pc.utf8_split_whitespace(pa.array([f"a{c}b" for c in every]))).to_numpy() == 1
    rng = np.random.default_rng(5)
    mixed = rng.choice(["'s", "'", "'ll", "a", "é", "1", "٣", "!", "_", "中", "\u200b", "\u0301", "\0", "😀"], (20_000, 5))
    words = pa.array([w for c, one in zip(every, whole) if one for w in (f"a{c}b", f"1{c}", c)] + ["".join(m) for m in mixed])
    text = lm.closed(words)
    assert text == "".join(f" {w}\n" for w in words.to_pylist()) and lm.closed(words[3:5]) == f" {words[3]}\n {words[4]}\n" and lm.closed(words[:0]) == ""
    own, fast = (lm.encoder(lm.VOCABULARY, p).encode_ordinary(text) for p in (lm._PATTERN, lm._CLOSED))
    assert own == fast


def test_cutting_makes_no_python_string_of_a_word():
    """Words go to the encoder as one text: strings of each, made twice, took a third of the time of cutting."""
    import tracemalloc

    texts = pa.array([" ".join(f"{chr(97 + k % 26)}{k % 9}{chr(97 + k // 26 % 26)}{chr(97 + k // 676 % 26)}{chr(97 + k // 17576 % 26)}" for k in range(40_000))])
    lm.subwords(texts, lm.VOCABULARY)
    seen, own = [], lm.encoder

    class Encoder:
        def __init__(self, *args):
            self.own = own(*args)

        def encode_ordinary(self, text):
            seen.append(tracemalloc.get_traced_memory()[1])
            return self.own.encode_ordinary(text)

        def encode_single_token(self, token):
            return self.own.encode_single_token(token)

    lm.encoder = Encoder
    tracemalloc.start()
    try:
        lm.subwords(texts, lm.VOCABULARY)
    finally:
        tracemalloc.stop()
        lm.encoder = own
    assert len(seen) == 1 and seen[0] < 40 * 40_000  # bytes at the most, up to the encoder's call
