"""Operators against brute force on a small corpus with the awkward cases in it."""

import re

import pytest

from polyglint.llm import crf, decontam, exact, jaccard, license, lpf, mixing, recompress, warc
from tests_llm_helpers import corpus_rows, rows_of, tokens


def texts():
    """doc_id -> distinct texts."""
    out = {}
    for r in corpus_rows():
        if r[0] is not None and r[1] is not None:
            out.setdefault(r[0], r[1])
    return out


def grams(text, n=3):
    w = tokens(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_pairs(t=0.5, n=3):
    sets = {d: grams(x, n) for d, x in texts().items()}
    sets = {d: s for d, s in sets.items() if s}
    ids = sorted(sets)
    out = {}
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            o = len(sets[a] & sets[b])
            u = len(sets[a] | sets[b])
            if o >= t * u:
                out[a, b] = (o, u)
    return out


def brute_classes(pairs):
    parent = {d: d for d in texts()}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {d: find(d) for d in parent}


@pytest.mark.parametrize("threshold,n", [(0.5, 3), (0.8, 2), (0.3, 1)])
def test_jaccard_is_exact(docs, clashing, threshold, n):
    want = brute_pairs(threshold, n)
    pairs, members = jaccard.set_pairs(docs, n, threshold)
    holds = {}
    for r in members.where("sig is not null").collect():
        holds.setdefault(r.sig, set()).add(r.doc_id)
    got = {(min(a, b), max(a, b)): (r.overlap, r.n_union) for r in pairs.collect() for a in holds[r.sa] for b in holds[r.sb]}
    assert len(got) == sum(len(holds[r.sa]) * len(holds[r.sb]) for r in pairs.collect())
    equal = {(a, b) for h in holds.values() for a in h for b in h if a < b}
    assert not equal & set(got) and {k: v for k, v in want.items() if k not in equal} == got and equal <= set(want)
    classes, links = brute_classes(want), [x for pair in want for x in pair]
    everyone = {r[0] for r in corpus_rows() if r[0] is not None}
    for frame in (docs, clashing):
        rows = jaccard.ngram_jaccard_join(frame, n, threshold).collect()
        assert {r.doc_id: (r.class_id, r.n_links) for r in rows} == {d: (classes.get(d, d), links.count(d)) for d in everyone} and len(rows) == len(everyone)


def test_jaccard_of_a_hot_group(spark):
    """One group of near copies holds a third of all rows; another third is one text; all share a passage. None may be lost."""
    import random

    rng = random.Random(3)
    base, passage = [f"b{k}" for k in range(60)], " ".join(f"p{k}" for k in range(30))
    rows = []
    for d in range(200):
        w = list(base)
        w[rng.randrange(60)] = f"x{d}"
        rows.append((d, " ".join(w)))
    rows += [(d, "one text " + passage) for d in range(200, 400)] + [(d, " ".join(f"u{d}v{k}" for k in range(60)) + " " + passage) for d in range(400, 600)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {d: grams(t) for d, t in rows[:200]}
    for d in range(200):
        assert got[d] == (0, sum(2 * len(sets[d] & s) >= len(sets[d] | s) for e, s in sets.items() if e != d))
    assert all(got[d] == (200, 199) for d in range(200, 400)) and all(got[d] == (d, 0) for d in range(400, 600))


def test_jaccard_of_hot_columns(spark):
    """A group of alike sets beyond a chunk's rows, beside two smaller ones that share columns with it, and pairs between chunks."""
    import random

    rng = random.Random(5)
    base, rows = [f"b{k}" for k in range(40)], []
    for d in range(jaccard.CHUNK_ROWS + 700):
        w = list(base)
        for _ in range(rng.randrange(1, 6)):
            w[rng.randrange(40)] = f"x{d}" if rng.random() < 0.5 else f"y{rng.randrange(9)}"
        rows.append((d, " ".join(w)))
    for d in range(2000, 2000 + 2 * jaccard.HOT):
        rows.append((d, " ".join((base[:20] if d % 2 else []) + [f"c{k}" for k in range(30)] + [f"z{d}"])))
    rows += [(5000 + d, t) for d, t in rows[:40]]
    sets = {d: grams(t) for d, t in rows}
    ids = list(sets)
    links = {d: 0 for d in ids}
    for k, d in enumerate(ids):
        for e in ids[k + 1 :]:
            both = len(sets[d] & sets[e])
            if 2 * both >= len(sets[d]) + len(sets[e]) - both:
                links[d] += 1
                links[e] += 1
    got = {r.doc_id: r.n_links for r in jaccard.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == links and max(links.values()) > jaccard.CHUNK_ROWS


def test_jaccard_multiplies_hot_columns_in_bounds():
    """A column's pairs don't grow as the square of its rows: beyond HOT the rows are told, each once for each column."""
    import numpy as np
    import pyarrow as pa

    rows, columns = 6 * jaccard.HOT, 5
    row, h = np.repeat(np.arange(rows, dtype=np.uint16), columns), np.tile(np.arange(columns, dtype=np.uint32), rows)
    cells = {"h": h, "row": row, "sig": np.arange(rows, dtype=np.int64), "n": np.full(rows, 9, np.uint32)}
    batch = pa.RecordBatch.from_pydict({"block": pa.array([3], pa.int32()), **{k: pa.array([v.tobytes()], pa.binary()) for k, v in cells.items()}})
    made = [(n, m, d.as_buffer()) for b in jaccard._multiply(0.5, 4)([batch]) for n, m, d in zip(b["n_sets"].to_pylist(), b["n_pairs"].to_pylist(), b["data"])]
    assert sum(m for _, m, _ in made) <= rows * columns * jaccard.HOT // 2
    told = {(int(c), int(s)) for n, m, d in made if not m for s, _, c in zip(*jaccard.unpack_column(n, d))}
    assert told == {((3 << 32) | c, r) for c in range(columns) for r in range(rows)}


def test_jaccard_dense_overlaps():
    import numpy as np

    rng = np.random.default_rng(2)
    sets = [np.unique(np.concatenate([rng.choice(60, 40, replace=False), rng.integers(100, 400, 10)])).astype(np.uint64) for _ in range(500)]
    offset, columns = np.concatenate([[0], np.cumsum([len(s) for s in sets])]), np.concatenate(sets)
    left, right = np.arange(0, 260), np.arange(230, 500)
    a, b, got = jaccard.dense_overlaps(left, right, offset, columns, 0.5)
    want = {(int(x), int(y)): n for x in left for y in right if 3 * (n := len(np.intersect1d(sets[x], sets[y], assume_unique=True))) >= len(sets[x]) + len(sets[y])}
    assert dict(zip(zip(a.tolist(), b.tolist()), got.tolist())) == want and 0 < len(want) < 260 * 270


def test_jaccard_tiles_round_trip():
    import numpy as np

    rng = np.random.default_rng(1)
    sig, size = np.unique(rng.integers(-(2**62), 2**62, 50)), rng.integers(1, 9, 50)
    pair = np.unique(rng.integers(0, 50 * 50, 400))
    a, b, count = pair // 50, pair % 50, rng.integers(1, 300, len(pair))
    made = jaccard.pack(sig, size, a, b, count, 7)
    got = [np.stack(jaccard.unpack(n, m, d.as_buffer())) for n, m, d in zip(made["n_sets"].to_pylist(), made["n_pairs"].to_pylist(), made["data"])]
    assert sorted(np.hstack(got).T.tolist()) == sorted(np.stack([sig[a], sig[b], size[a], size[b], count]).T.tolist())


def test_jaccard_groups_keep_one(docs, clashing, empty):
    want = {d: r for d, r in brute_classes(brute_pairs()).items() if r != d}
    for frame in (docs, clashing):
        assert {r.doc_id: r.root for r in jaccard.near_duplicate_ids(frame).collect()} == want
    assert jaccard.ngram_jaccard_join(empty).count() == 0 and jaccard.near_duplicate_ids(empty).count() == 0


def brute_spans(k=50):
    first, hit = {}, {}
    for d in sorted(texts()):
        w = tokens(texts()[d])
        for p in range(len(w) - k + 1):
            g = tuple(w[p : p + k])
            if g in first:
                hit.setdefault(d, []).append((p, first[g]))
            else:
                first[g] = (d, p)
    out = set()
    for d, places in hit.items():
        start, stop, source = places[0][0], places[0][0] + k, places[0][1]
        for p, s in places[1:]:
            if p > stop:
                out.add((d, start, stop - start, *source))
                start, source = p, s
            stop = p + k
        out.add((d, start, stop - start, *source))
    return out


@pytest.mark.parametrize("find", [recompress.find_repeats, lpf.find_copies])
@pytest.mark.parametrize("k", [50, 12])
def test_repeats_are_exact(docs, clashing, empty, find, k):
    want = brute_spans(k)
    assert want
    for frame in (docs, clashing):
        got = [tuple(r) for r in find(frame, k).select("doc_id", "start", "n_tokens", "first_doc_id", "first_start").collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert find(empty, k).count() == 0


def test_repeats_in_a_hot_passage(spark):
    """Thousands of copies of one passage, each in other words."""
    rows = [(d, " ".join(f"x{d}y{k}" for k in range(8)) + " " + " ".join(f"p{k}" for k in range(60)) + f" z{d}") for d in range(1500)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for find in (recompress.find_repeats, lpf.find_copies):
        got = {tuple(r) for r in find(frame).select("doc_id", "start", "n_tokens", "first_doc_id", "first_start").collect()}
        assert got == {(d, 8, 60, 0, 8) for d in range(1, 1500)}


def test_equal_passages_have_equal_symbols():
    """Whatever surrounds it, a passage has the same symbols where it holds all that they depend on; so has what Spark names."""
    import numpy as np

    rng = np.random.default_rng(7)
    mix = lambda n: rng.integers(1, 9, n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    passage = np.concatenate([mix(120), np.full(30, 5, np.uint64), mix(120)])
    seen = []
    for _ in range(2):
        before = int(rng.integers(5, 90))
        tok = np.concatenate([mix(before), passage, mix(40)])
        s = recompress.start(tok, np.zeros(len(tok), np.int32))
        for j in range(6):
            s = recompress.step(s, j)
        inside = (s.left >= before) & (s.right < before + len(passage))
        seen.append([tuple(x) for x in np.stack([s.name[inside], s.begin[inside] - before]).T.tolist()])
    assert len(seen[0]) > 10 and seen[0] == seen[1]


def test_tokens_decide_where_fingerprints_collide():
    import numpy as np

    rng = np.random.default_rng(3)
    k, a, b = 6, rng.integers(1, 99, 20).astype(np.uint64), rng.integers(1, 99, 20).astype(np.uint64)
    tok = np.concatenate([a, b, a, b])
    args = (np.zeros(4, np.uint64), np.arange(4), np.zeros(4, np.int64), np.full(4, 15, np.int64), tok, k)
    want = recompress.verified(*args)
    got = recompress.verified(*args, prints=lambda t, n: np.zeros(len(t) - n + 1, np.uint64))
    assert got.equals(want) and [(r["doc_id"], r["first_doc_id"]) for r in got.to_pylist()] == [(2, 0), (3, 1)]


def test_repeats_over_rounds_and_blocks(spark, monkeypatch):
    """Long texts of few different words, runs among them, cut into many slices: nothing is lost in naming."""
    import random

    rng = random.Random(2)
    parts = [" ".join(rng.choice("abcd") if rng.random() < 0.7 else "a a a" for _ in range(rng.randint(20, 200))) for _ in range(12)]
    rows = [(d, " ".join(rng.choice(parts) for _ in range(rng.randint(1, 5)))) for d in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    k, first, hit = 50, {}, {}
    for d, t in rows:
        w = t.split()
        for p in range(len(w) - k + 1):
            if tuple(w[p : p + k]) in first:
                hit.setdefault(d, set()).update(range(p, p + k))
            else:
                first[tuple(w[p : p + k])] = d
    for find in (recompress.find_repeats, lpf.find_copies):
        got = {}
        for r in find(frame, k).collect():
            got.setdefault(r.doc_id, set()).update(range(r.start, r.start + r.n_tokens))
        assert got == hit


def test_lpf_by_hand():
    import numpy as np

    text = np.array([1, 2, 3, 1, 2, 3, 1, 9, 2, 3, 1, 100])
    at = np.arange(11)
    length, source = lpf.longest_previous(text, at, at, 1)
    brute = []
    for i in range(11):
        best = 0
        for j in range(i):
            n = 0
            while i + n < len(text) and text[i + n] == text[j + n]:
                n += 1
            best = max(best, n)
        brute.append(best)
    assert length.tolist() == brute
    assert all(text[s] == text[i] for i, s in zip(at, source))


def test_lpf_of_a_long_repeat():
    """Factors far longer than k are told in full."""
    import numpy as np

    rng = np.random.default_rng(1)
    part = rng.integers(0, 50, 700)
    text = np.concatenate([part, rng.integers(0, 50, 9), part, [1000]])
    at = np.arange(len(text))
    length, source = lpf.longest_previous(text, at, at, 50)
    assert length[709:].tolist()[:651] == list(range(700, 49, -1)) and source[709] == 0 and length[:709].max() == 0


def brute_matches(tests, coverage=decontam.COVERAGE, slack=decontam.SLACK):
    out = {}
    for d, x in texts().items():
        w = tokens(x)
        for item, y in tests:
            q = tokens(y or "")
            if not q:
                continue
            need = -(-coverage * len(q) // 1)
            for s in range(-len(q) - slack, len(w) + slack):
                met = sum(any(0 <= p < len(w) and w[p] == t for p in range(s + j - slack, s + j + slack + 1)) for j, t in enumerate(q))
                whole = all(0 <= s + j < len(w) and w[s + j] == t for j, t in enumerate(q))
                if met >= need:
                    key = (not whole, -met, s)
                    if (d, item) not in out or key < out[d, item]:
                        out[d, item] = key
    return {(d, i, "proximity" if k[0] else "exact", k[2], -k[1]) for (d, i), k in out.items()}


def test_decontamination_is_exact(spark, docs, clashing, empty):
    known = texts()
    cut = known[9].split()
    tests = [(1, " ".join(cut[:20]).upper() + "!"), (2, " ".join(cut[3:6] + ["other"] + cut[7:15])), (3, " ".join(cut[5:9] + ["put", "in"] + cut[9:20])), (4, "nothing of it"), (5, None), (6, ""), (7, "one"), (8, " ".join(["same"] * 6)), (None, "one")]
    bench = spark.createDataFrame(tests, "item_id long, text string")
    want = brute_matches([t for t in tests if t[0] is not None])
    for frame in (docs, clashing):
        got = {(r.doc_id, r.item_id, r.kind, r.start, r.met) for r in decontam.find(frame, bench).collect()}
        assert got == want
    assert {k for _, _, k, _, _ in want} == {"exact", "proximity"}
    assert decontam.find(empty, bench).count() == 0 and decontam.find(docs, bench.limit(0)).count() == 0
    hit = {d for d, *_ in want}
    kept = decontam.decontaminate(clashing, bench)
    assert kept.columns == clashing.columns and rows_of(kept) == rows_of(clashing.where(~clashing.doc_id.isin(*hit) | clashing.doc_id.isNull()))


def test_decontamination_in_turns(spark, docs, monkeypatch):
    tests = spark.createDataFrame([(k, t) for k, t in enumerate(x for x in texts().values() if 5 < len(x.split()) < 60)], "item_id long, text string")
    want = rows_of(decontam.find(docs, tests))
    monkeypatch.setattr(decontam, "ITEMS_AT_ONCE", 3)
    assert rows_of(decontam.find(docs, tests)) == want


def test_exact_dedup_and_its_index(spark, docs, clashing, empty, tmp_path):
    path = f"file://{tmp_path}/index"
    by_text = {}
    for r in corpus_rows():
        if r[1] is not None:
            by_text.setdefault(r[1], []).append(r[0])
    want = {(min(i for i in ids if i is not None), len(ids)) for ids in by_text.values()}
    half = docs.where("doc_id < 50")
    first = {r.doc_id for r in exact.exact_dedup(half, path, 4).collect()}
    assert first == {min(i for i in ids if i is not None) for t, ids in by_text.items() if any(i is not None and i < 50 for i in ids)}
    rest = exact.exact_dedup(docs, path).collect()
    assert not first & {r.doc_id for r in rest} and first | {r.doc_id for r in rest} == {d for d, _ in want}
    assert exact.exact_dedup(docs, path).count() == 0
    assert {(r.doc_id, r.n_copies) for r in exact.exact_dedup(docs).collect()} == want
    kept = exact.keep_first(clashing)
    assert kept.columns == clashing.columns
    assert sorted(r.doc_id for r in kept.where("text is not null").collect()) == sorted(d for d, _ in want)
    assert kept.where("text is null").count() == 1 and exact.keep_first(empty).count() == 0 and exact.exact_dedup(empty).count() == 0


def test_index_keeps_its_buckets(spark, tmp_path):
    """Reopened under another shuffle setting an index still knows every text; another number of buckets is refused."""
    path = f"file://{tmp_path}/index"
    frame = spark.range(400).selectExpr("id as doc_id", "concat('text ', id) as text")
    had = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        assert exact.exact_dedup(frame, path).count() == 400
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        assert exact.exact_dedup(frame.union(spark.range(400, 410).selectExpr("id as doc_id", "concat('text ', id) as text")), path).count() == 10
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", had)
    with pytest.raises(ValueError):
        exact.exact_dedup(frame, path, 5)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("digest_index_")]
    spark.range(1).write.parquet(f"{tmp_path}/other")
    with pytest.raises(ValueError):
        exact.exact_dedup(frame, f"file://{tmp_path}/other")


def test_a_load_may_be_repeated(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    frame = spark.range(50).selectExpr("id as doc_id", "concat('text ', id) as text")
    first = rows_of(exact.exact_dedup(frame.where("doc_id < 20"), path, batch="a"))
    assert len(first) == 20 and rows_of(exact.exact_dedup(frame.where("doc_id < 20"), path, batch="a")) == first
    assert exact.exact_dedup(frame, path, batch="b").count() == 30
    index = exact.DigestIndex(spark, path)
    assert index.table().count() == 50
    index.close()


def test_two_loads(docs, empty):
    odd = {r[1] for r in corpus_rows() if r[0] is not None and r[0] % 2}
    got = exact.two_loads(docs).collect()
    second = {r[1] for r in corpus_rows() if r[1] is not None} - odd
    assert sum(r.load == 1 for r in got) == len(odd - {None}) and sum(r.load == 2 for r in got) == len(second)
    assert exact.two_loads(empty).count() == 0


def test_index_plan_is_a_sort_merge_anti_join(spark, docs, tmp_path):
    index = exact.DigestIndex(spark, f"file://{tmp_path}/i", 4)
    exact.new_documents(docs, index)
    plan = index.unseen(docs.select(exact.digest().alias("digest"), "doc_id").where("digest is not null").repartition(4, "digest"))._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan and "Bucketed: true" in plan


def test_pivotal_rounds_by_hand():
    up, rest = mixing.pivotal([1, 2, 3, 4], [0.5, 0.5, 0.25, 0.75], 0, 1)
    assert sum(up) == 2 and min(up) == 0 and not rest.any()
    up, rest = mixing.pivotal([1, 2], [0.3, 0.3], 0, 1)
    assert sorted(up) == [-1, 0] and abs(rest.sum() - 0.6) < 1e-9
    assert mixing.pivotal([], [], 0, 1)[0].tolist() == [] and mixing.pivotal([1, 2], [0.0, 1.0], 0, 1)[0].tolist() == [0, 1]
    counts = [0] * 3
    for seed in range(4000):
        up, rest = mixing.pivotal([10, 11, 12], [0.2, 0.7, 0.1], 0, seed)
        assert sum(up) == 1 and min(up) == 0
        counts = [c + v for c, v in zip(counts, up)]
    assert all(abs(c / 4000 - p) < 0.03 for c, p in zip(counts, (0.2, 0.7, 0.1)))


def test_pivotal_expectations_over_many():
    import numpy as np

    rng = np.random.default_rng(1)
    p = rng.random(301)
    total = np.zeros(301)
    for seed in range(3000):
        up, rest = mixing.pivotal(np.arange(301), p, 2, seed)
        k = np.flatnonzero(up < 0)
        assert len(k) < 2 and abs(np.maximum(up, 0).sum() + rest.sum() - p.sum()) < 1e-6
        total += np.maximum(up, 0) + rest
    assert abs(total / 3000 - p).max() < 0.05 and abs((total / 3000 - p).mean()) < 1e-6


def test_mixing_meets_its_targets(spark, docs, clashing, empty, monkeypatch):
    monkeypatch.setattr(mixing, "LEAF", 6)  # several cells and levels
    monkeypatch.setattr(mixing, "FAN_IN", 2)
    weights = {"s0": 2.0, "s1": 1.0, "s2": 1.0, "absent": 4.0}
    out = mixing.mix_sources(docs, weights, 1.5).collect()
    assert len(out) == len({(r[0], r[3] or "") for r in corpus_rows() if r[0] is not None})
    by = {}
    for r in out:
        assert int(r.expected) <= r.copies <= int(r.expected) + 1
        by.setdefault(r.source, [0.0, 0])
        by[r.source][0] += r.expected
        by[r.source][1] += r.copies
    for source, (want, got) in by.items():
        assert abs(want - got) < 1 + 1e-6, source
    assert by[""] == [0.0, 0]
    assert abs(sum(w for w, _ in by.values()) - sum(g for _, g in by.values())) < 1 + 1e-6
    again = mixing.mix_sources(docs.repartition(7), weights, 1.5).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))
    assert mixing.mix_sources(empty).count() == 0
    kept = mixing.mixed(clashing, weights, 1.5)
    assert kept.columns == [*[c for c in clashing.columns if c != "mix_copies"], "mix_copies"]
    want = {(r.doc_id, r.source): r.copies for r in out if r.copies}
    assert {(r.doc_id, r.source or ""): r.mix_copies for r in kept.collect()} == want


def brute_licenses():
    out = {}
    for name, template in license.TEMPLATES.items():
        out[name] = re.compile(license.as_regex(template))
    return out


def test_license_scan(spark, empty):
    rows = [
        (1, "x Released under the MIT License. y"), (2, "Released under the terms of the MIT license, see the file COPYING for details"), (3, "Released under the BSD License"),
        (4, "This work is licensed under the GNU General Public License, version 3."), (5, "licensed under CC BY-NC 4.0 and Licensed under the Apache License, Version 2.0"),
        (6, "Copyright (c) 2020 Some Body Inc. All rights reserved."), (7, None), (8, ""), (9, "All rights. Reserved"), (10, "all right reserved"), (1, "nothing"), (None, "All rights reserved"),
        (11, "All rights reserved " * 3 + "word " * 5000 + "All rights reserved"), (12, "Licensed under the Apache License Version 3"), (13, "this work is this work is licensed under CC BY 4.0"),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.license): (r.first_token, r.n_tokens, r.n_places) for r in license.scan(frame).collect()}
    want = {}
    for d, t in rows:
        if d is None or not t:
            continue
        spaced = " " + "  ".join(tokens(t)) + " "
        for name, pattern in brute_licenses().items():
            m = pattern.search(spaced)
            if m:
                n = len(pattern.findall(spaced))
                want[d, name] = (spaced[: m.start()].count(" ") // 2, m[0].count(" ") // 2, n)
    assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in want.items()}
    assert got[11, "all-rights-reserved"] == (0, 3, 4) and (12, "Apache-2.0-notice") not in got and (3, "MIT-notice") not in got
    assert license.scan(empty).count() == 0


def test_license_regions_have_any_length(spark):
    years = "Copyright (c) 1982, 1986, 1990, 1991, 1993, 1994 The Regents of the University of California. All rights reserved"
    texts = [years, "Copyright " + "holder " * 200 + "All rights reserved", "Copyright " * 3 + "holder " * 13 + "All rights reserved. " * 2 + "end", "All rights reserved. Copyright " + "x " * 20, "Copyright All rights reserved"]
    texts += ["Released under the MIT License, see " + "the file " * 7 + "for details", "Released under the MIT License, see " + "x " * 200 + "for details", "copyright " * 20_000 + "all rights reserved"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.license): (r.first_token, r.n_tokens, r.n_places) for r in license.scan(frame).collect() if r.license in ("copyright-notice", "MIT-notice")}
    want = {}
    for d, t in enumerate(texts):
        spaced = " " + "  ".join(tokens(t)) + " "
        for name in ("copyright-notice", "MIT-notice"):
            pattern = re.compile(license.as_regex(license.TEMPLATES[name]).replace("{0,%d}" % license.MAX_VAR, "*"))
            if m := pattern.search(spaced):
                n = spaced[: spaced.rindex(" reserved ")].count(" copyright ") if name == "copyright-notice" else 1
                want[d, name] = (spaced[: m.start()].count(" ") // 2, m[0].count(" ") // 2, n)
    assert got == want and got[0, "copyright-notice"][1] == 18 and got[7, "copyright-notice"] == (0, 20_003, 20_000)


MIT_TEXT = """Copyright (c) 2020 A

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
WHOLE = ["BSD-2-Clause", "BSD-3-Clause", "MIT", "X11", "ISC", "Apache-2.0-header", "GPL", "LGPL", "AGPL"]


def plain(template):
    """The template's original wording, its optional regions in."""
    out = re.sub(r"<<\s*var.*?original=\"(.*?)\".*?>>", r" \1 ", template)
    return re.sub(r"<<.*?>>", " ", out)


def test_whole_licenses_and_late_changes(spark):
    late = {"MIT": "conditions", "X11": "advertising", "ISC": "tortious", "Apache-2.0-header": "limitations", "GPL": "merchantability", "LGPL": "received", "AGPL": "useful", "BSD-2-Clause": "procurement", "BSD-3-Clause": "endorse"}
    rows = [(name, plain(license.TEMPLATES[name])) for name in WHOLE]
    rows += [("not " + name, re.sub(rf"(?i)\b{late[name]}\b", "otherwise", text)) for name, text in rows]
    rows += [("MIT", MIT_TEXT), ("not MIT", MIT_TEXT.replace("substantial portions", "portions")), ("not MIT", MIT_TEXT[: MIT_TEXT.index("THE SOFTWARE IS")]), ("not MIT", MIT_TEXT.replace("THE SOFTWARE IS", "The Software shall be used for Good, not Evil. THE SOFTWARE IS", 1).replace("portions of the Software.", "portions."))]
    rows += [("not MIT", re.sub(r"subject to the following conditions:.*?Software\.", "", MIT_TEXT, count=1, flags=re.S)), ("not MIT", plain(license.TEMPLATES["X11"]))]
    rows += [("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program.")]
    frame = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {(r.doc_id, r.license) for r in license.scan(frame).collect()}
    for k, (name, _) in enumerate(rows):
        assert ((k, name.removeprefix("not ")) in got) == (not name.startswith("not ")), (k, name)


def test_license_templates_are_checked():
    for bad in ('a <<var;name="x";match="[0-9.]+">>', "a <<beginOptional>> b", "a <<endOptional>>", "<<beginOptional>>a<<endOptional>>", '<<var;name="x";match=".+">> a'):
        with pytest.raises(ValueError):
            license.Automaton(bad)


def test_warc_round_trip(spark):
    rows = [
        (1, "http://a.example/", "<html lang='de'><title>A &amp; B</title><script>x</p></script><p>One<br>two &lt;3 <!-- no --><a href=\"/x?a=1&amp;b=2\">link</a></p></html>", "x"),
        (2, None, "", "x"), (3, "u", None, "x"), (None, "u", "<p>lone <b", "x"), (4, "u", "plain\r\n\r\ntext é", "x"), (4, "u", "plain\r\n\r\ntext é", "x"), (5, "u", "<p>" + "long " * 300_000, "x"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, block string")
    got = [r.asDict() for r in warc.build(pages, with_responses=True).collect()]
    assert len(got) == 3 * 6
    responses = {r["record_id"]: r for r in got if r["warc_type"] == "response"}
    for r in got:
        assert warc.from_bytes(warc.to_bytes(r)) == [r]
        if r["warc_type"] != "response":
            source = responses[r["refers_to"]]
            assert all(r[k] == source[k] for k in ("target_uri", "warc_date", "payload_digest", "source_headers", "page_id"))
    one = {r["warc_type"]: r["block"] for r in got if r["page_id"] == 1}
    assert one["conversion"] == "A & B\nOne\ntwo <3 link"
    assert one["metadata"].split("\r\n")[:2] == ["title: A & B", "languages: de"] and "outlink: /x?a=1&b=2\r\n" in one["metadata"]
    whole = b"".join(warc.to_bytes(r) for r in got)
    assert warc.from_bytes(whole) == got
    with pytest.raises(ValueError):
        warc.from_bytes(whole.replace(b"two", b"tw0"))
    assert warc.build(pages.limit(0)).count() == 0


def test_warc_fields_stay_in_their_lines():
    r = warc.response(1, "http://a/\r\nWARC-Type: request\r\n\u2028x", "<p title='a>b' class=\"c>d\">it's <b>5 > 4</b>")
    back = warc.from_bytes(warc.to_bytes(r))
    assert len(back) == 1 and back[0]["warc_type"] == "response" and back[0]["target_uri"] == "http://a/%0D%0AWARC-Type: request%0D%0A%E2%80%A8x"
    assert warc.plain_text(r["block"].partition("\r\n\r\n")[2]) == "it's 5 > 4"


def test_warc_files_as_a_source(spark, tmp_path):
    """Files in gzip members or plain, with foreign fields, give the derivatives that the pages give."""
    import gzip

    pages = [(1, "http://a/", "<title>One</title>text"), (2, "http://b/", "<p>zwei ü</p>")]
    made = [warc.response(*p) for p in pages]
    info = b"WARC/1.0\r\nwarc-type: warcinfo\r\nContent-Length: 3\r\n\r\nx\ry\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(info) + gzip.compress(warc.to_bytes(made[0])))
    (tmp_path / "b.warc").write_bytes(info + warc.to_bytes(made[1]))
    latin = "caf\u00e9".encode("latin-1")
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=ISO-8859-1\r\n\r\n"
    (tmp_path / "c.warc").write_bytes(b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: %d\r\n\r\n" % (len(head) + len(latin)) + head + latin + b"\r\n\r\n")
    rows = {r.record_id: r for r in warc.read(spark, f"file://{tmp_path}").collect()}
    assert rows["<urn:x>"].block.endswith("caf\u00e9") and rows["<urn:x>"].page_id is None and len(rows) == 3
    got = {(r.refers_to, r.warc_type): r.block for r in warc.derive(warc.read(spark, f"file://{tmp_path}")).collect()}
    for r in made:
        assert [got[r["record_id"], d["warc_type"]] for d in warc.derivatives(r)] == [d["block"] for d in warc.derivatives(r)]
        assert rows[r["record_id"]].payload_digest == r["payload_digest"]
    with pytest.raises(ValueError):
        list(warc.parse(warc.to_bytes(made[0])[:-20]))


def test_crf_marginals_against_all_labellings():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    doc = np.array([0, 0, 0, 0, 2, 2, 3])
    score, trans = rng.normal(size=(7, 2)), rng.normal(size=(2, 2))
    p, _, z = crf.marginals(score, doc, trans)
    total = 0.0
    for d in (0, 2, 3):
        at = np.flatnonzero(doc == d)
        weight, mass = np.zeros((len(at), 2)), 0.0
        for y in itertools.product((0, 1), repeat=len(at)):
            e = np.exp(sum(score[a, k] for a, k in zip(at, y)) + sum(trans[a, b] for a, b in zip(y, y[1:])))
            mass += e
            for k, v in enumerate(y):
                weight[k, v] += e
        assert np.allclose(p[at], weight / mass)
        total += np.log(mass)
    assert np.isclose(z, total)


def _labelled(spark, n, seed):
    import random

    rng = random.Random(seed)
    rows, labels = [], []
    for d in range(n):
        good = rng.random() < 0.6
        lines = [" ".join("".join(rng.choice("aeioustrnl") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(6, 20))).capitalize() + "." for _ in range(rng.randint(1, 8))]
        if not good:
            lines = [" ".join(w.upper() + "###" for w in x.split()) if rng.random() < 0.9 or k == 0 else x for k, x in enumerate(lines)]
        rows.append((d, "\n".join(lines)))
        labels.append((d, int(good)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_classifier_on_held_out_documents(spark, docs, clashing, empty):
    train, labels = _labelled(spark, 300, 1)
    test, truth = _labelled(spark, 200, 2)
    both = train.union(test.selectExpr("doc_id + 1000 as doc_id", "text"))
    got = {r.doc_id: r for r in crf.classify(both, labels).collect()}
    right = sum(got[r.doc_id + 1000].keep == bool(r.quality) for r in truth.collect())
    assert right >= 195
    out = crf.classify(clashing, labels)
    assert out.count() == docs.count()
    blank = {r.doc_id: (r.n_lines, r.quality, r.keep) for r in out.where("doc_id in (300, 301, 302)").collect()}
    assert blank == {d: (0, 0.0, False) for d in (300, 301, 302)}
    assert crf.classify(empty, labels).count() == 0
    # nothing to learn from: everything with a line stays; a tie is kept
    assert all(r.quality == 0.5 and r.keep for r in crf.classify(clashing, labels.limit(0)).where("n_lines > 0").collect())
    kept = crf.reject(clashing, labels.limit(0))
    assert kept.columns == clashing.columns and kept.count() == docs.where("trim(text) <> ''").count() - docs.where("doc_id = 302").count()
    keep = {r.doc_id for r in crf.classify(both, labels).collect() if r.keep}
    assert {r.doc_id for r in crf.reject(both, labels).collect()} == keep


def test_lines_of_mixed_documents_get_mixed_labels(spark):
    """Bad documents of which half the lines are good: labels are learned by line, though given by document."""
    import random

    rng = random.Random(4)
    rows, labels, truth = [], [], {}
    for d in range(400):
        good = d % 2 == 0
        lines = [" ".join("".join(rng.choice("aeioustrnl") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(6, 20))).capitalize() + "." for _ in range(rng.randint(4, 10))]
        bad = set() if good else set(rng.sample(range(len(lines)), (len(lines) + 1) // 2))
        rows.append((d, "\n".join(" ".join(w.upper() + "###" for w in x.split()) if k in bad else x for k, x in enumerate(lines))))
        truth[d] = len(bad)
        if d < 300:
            labels.append((d, int(good)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.doc_id: r for r in crf.classify(docs, labels).collect()}
    assert sum(got[d].n_bad == truth[d] for d in range(300, 400)) >= 90
    assert sum(0 < got[d].n_bad < got[d].n_lines for d in range(301, 400, 2)) >= 45
    assert sum(got[d].keep == (d % 2 == 0) for d in range(300, 400)) >= 95


def test_a_text_of_very_many_lines(spark):
    docs, labels = _labelled(spark, 100, 5)
    long = spark.createDataFrame([(1000, "\n".join(["A line of words here."] * 20_000)), (1001, None), (1001, "\n" * 50_000)], "doc_id long, text string")
    got = {(r.doc_id, r.n_lines) for r in crf.classify(docs.union(long), labels).where("doc_id >= 1000").collect()}
    assert got == {(1000, 20_000), (1001, 0)}


def test_jaccard_frequency_table_grows(spark):
    """Common columns stay apart from others only where the table grows with the data, and its cells count all documents."""
    import numpy as np

    assert jaccard.n_cells(1) == jaccard.n_cells(4) and jaccard.n_cells(600) >= 32 * jaccard.n_cells(4)
    counts = np.zeros(jaccard.CELLS_PART, np.uint8)
    counts[[0, 5, 70_000, jaccard.CELLS_PART - 1]] = 1, 255, 7, 2
    at, times = jaccard.unpack_counts(jaccard.pack_counts(counts))
    assert at.tolist() == np.flatnonzero(counts).tolist() and times.tolist() == [1, 255, 7, 2]
    rows = [(d, "one and all " + " ".join(f"w{d}x{i}" for i in range(20))) for d in range(400)]
    _, rank = jaccard.profiles(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 3)
    assert len(rank) == jaccard.n_cells(4) and max(rank) >= round(16 * np.log2(401)) and sum(x > 100 for x in rank) == 1
    assert sum(x > 0 for x in rank) > 7900  # 400 x 20 and one, but for a few that share a cell
