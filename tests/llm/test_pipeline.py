"""The corpus pipeline, stage by stage and whole, against brute force."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from polyglint.llm import common, decontam
from test_llm_operators import brute_matches, brute_pairs
from tests_llm_helpers import rows_of


@pytest.fixture(scope="module")
def sf(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    docs.where("doc_id is not null").write.parquet(f"{path}/documents.parquet")
    text = docs.where("doc_id = 9").first().text.split()
    spark.createDataFrame([(1, " ".join(text[:12]))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    # bad: what has digits in every word is all this corpus is made of, so teach shouting as junk
    spark.createDataFrame([(k, 1, 0) for k in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_components(spark):
    chain = [(k, k + 1) for k in range(1, 40)] + [(100, 102), (102, 101), (100, 101), (7, 7)]
    edges = spark.createDataFrame(chain, "u long, v long")
    got = {r.node: r.root for r in common.components(edges).collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, 100: 100, 101: 100, 102: 100}
    assert common.components(edges.limit(0)).count() == 0


def test_join_checked_is_the_same_either_way(spark, docs):
    small = docs.where("doc_id < 10").select(F.col("doc_id").alias("k"), F.lit(1).alias("one")).distinct()
    a, b = (common.join_checked(docs, small, F.col("doc_id") == F.col("k"), "left_anti", n) for n in (0, 1000))
    assert rows_of(a) == rows_of(b)


def test_stages(spark, sf, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "benchmark_free", "mix"]
    at = spark.read.parquet(f"{sf}/documents.parquet")
    columns = at.columns
    # labels of one class: nothing to tell apart, so all but blank texts stay
    after = common.shared_table(corpus_pipeline.quality(spark, at, sf), "t")
    assert rows_of(after) == rows_of(at.where("text is not null and trim(text) <> '' and doc_id <> 302"))
    at = common.shared_table(corpus_pipeline.exact_dedup(spark, after, sf), "t")
    first = {}
    for r in after.collect():
        first[r.text] = min(first.get(r.text, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in at.collect()) == sorted(first.values())
    left = {r.doc_id for r in at.collect()}
    parent = {d: d for d in left}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in brute_pairs():
        if a in left and b in left:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    at = common.shared_table(corpus_pipeline.near_dedup(spark, at, sf), "t")
    assert {r.doc_id for r in at.collect()} == {d for d in left if find(d) == d}
    bench = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hit = {d for d, *_ in brute_matches(bench)}
    before = {r.doc_id for r in at.collect()}
    at = common.shared_table(corpus_pipeline.benchmark_free(spark, at, sf), "t")
    assert at.columns == columns and {r.doc_id for r in at.collect()} == before - hit and before & hit
    mixed = corpus_pipeline.mix(spark, at, sf).collect()
    whole = corpus_pipeline.run(spark, sf)
    assert rows_of(whole) == sorted((tuple(r) for r in mixed), key=repr)
    assert {r.doc_id for r in mixed} <= before - hit and all(r.mix_copies >= 1 for r in mixed)


def test_empty_tables(spark, sf, tmp_path):
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert decontam.find(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/benchmark.parquet")).count() == 0


def test_near_dedup_of_a_hot_group_writes_no_pairs(spark, monkeypatch):
    """One document of a group of alike texts stays, and what is written on the way doesn't grow as the square of the group."""
    import random

    from polyglint.llm import jaccard

    rng, size, written = random.Random(7), 600, {}
    rows = []
    for d in range(size):
        w = [f"b{k}" for k in range(40)]
        w[rng.randrange(40)] = f"x{d}"
        rows.append((d, " ".join(w)))
    rows += [(d, " ".join(f"u{d}v{k}" for k in range(40))) for d in range(size, size + 20)]
    keep = jaccard.shared_table
    monkeypatch.setattr(jaccard, "shared_table", lambda df, tag: written.setdefault(tag, keep(df, tag)))
    left = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in left.collect()) == [0, *range(size, size + 20)]
    assert written["pairs"].count() < size * (size - 1) / 4


def test_a_task_holds_a_part_of_its_texts(spark, tmp_path):
    """Batches, and the row groups and pages of the index, are cut by bytes: neither is all texts of a task."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    texts = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(1500)), lambda k: F.conv(F.xxhash64("id", k).cast("string"), 10, 36))).alias("text"))
    texts.write.parquet(f"{tmp_path}/texts")
    before, texts = spark.conf.get(name), spark.read.parquet(f"{tmp_path}/texts").coalesce(1)
    sizes = common.in_small_batches(lambda docs: docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": pa.array([b.nbytes], pa.int64())}) for b in batches), "n long").collect())(texts)
    assert sum(r.n for r in sizes) > 6 * common.SLICE_BYTES and max(r.n for r in sizes) < 1.5 * common.SLICE_BYTES
    index = decontam.build_index(texts)
    assert spark.conf.get(name) == before and index.count() > 6
    groups = [f.metadata.row_group(k) for f in (pq.ParquetFile(p.removeprefix("file://")) for p in index.inputFiles()) for k in range(f.metadata.num_row_groups)]
    assert len(groups) > 2 and max(g.total_byte_size for g in groups) < 6 * common.SLICE_BYTES
