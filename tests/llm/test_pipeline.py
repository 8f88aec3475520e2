"""Each stage on its own input, and all of them in a row."""

import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from kinweave.llm import mixing, ordinal_quality, positional_index, shared_keys
from kinweave.llm.batches import PIECE, pieces
from tests.llm.test_free_operators import shingle_links

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, docs, corpus, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    docs.write.parquet(f"{path}/documents.parquet")
    labels = [(r.doc_id, 1, 0) for r in corpus if r.doc_id is not None and r.doc_id < 240]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    text = next(r.text for r in corpus if r.doc_id == 302)
    spark.createDataFrame([(1, text), (2, None)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def rows(df):
    return Counter(tuple(r) for r in df.select(*COLUMNS).collect())


def test_classifier_keeps_documents_it_has_nothing_against(spark, docs, folder, corpus):
    out = pipeline.classify(spark, docs, folder)
    assert out.columns == COLUMNS and rows(out) == rows(docs)


def test_one_document_of_each_group_stays(spark, docs, folder, corpus):
    out = pipeline.deduplicate(spark, docs, folder)
    assert out.columns == COLUMNS
    expected = {(d, n) for (d, n, c, _), _ in shingle_links(corpus, 5, 80).items() if d is not None and (c == d or n == 0)}
    kept = [r.doc_id for r in out.collect() if r.doc_id is not None]
    assert Counter(kept) == Counter(d for d, _ in expected)
    assert out.where("doc_id is null").count() == 2


def test_contaminated_documents_go(spark, docs, folder):
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    bad = {r.doc_id for r in positional_index.contamination(docs, items).where("contaminated").collect()}
    out = pipeline.decontaminate(spark, docs, folder)
    assert bad and out.columns == COLUMNS
    assert rows(out) == rows(docs.where(~F.coalesce(F.col("doc_id"), F.lit(-1)).isin(*bad)))


def test_mix_repeats_documents(spark, docs, folder):
    out = pipeline.mix(spark, docs, folder)
    words = mixing.mix(docs.withColumn("_row_key", F.xxhash64(*[F.col(c) for c in sorted(COLUMNS)])))
    assert out.columns == COLUMNS
    taken = Counter({r.doc_id: r.n for r in words.groupBy("doc_id").agg(F.sum("copies").alias("n")).collect() if r.n})
    assert Counter(r.doc_id for r in out.collect()) == taken


def test_shards_hold_every_row(spark, docs, folder, corpus):
    out = pipeline.shard(spark, docs.unionByName(docs), folder)
    assert out.columns == [*COLUMNS, "shard", "slot"] and rows(out) == rows(docs.unionByName(docs))
    sizes = Counter(r.shard for r in out.collect())
    assert set(sizes) <= set(range(40)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert out.select("shard", "slot").distinct().count() == 2 * len(corpus)


def test_run_applies_all_stages(spark, docs, folder):
    out = pipeline.run(spark, folder)
    assert out.columns == [*COLUMNS, "shard", "slot"]
    known = set(rows(docs))
    assert out.count() and all(r in known for r in rows(out))
    assert [name for name, _ in pipeline.STAGES][:2] == ["quality classifier", "n-gram Jaccard join"]


@pytest.mark.parametrize("stage", [s for _, s in pipeline.STAGES], ids=[n for n, _ in pipeline.STAGES])
def test_stages_take_empty_and_wide_tables(spark, none, wide, folder, corpus, tmp_path, stage):
    assert stage(spark, none, folder).count() == 0
    named = wide.where("doc_id < 110").withColumns({"_row_key": F.lit("x"), "_row_key_too": F.lit(1), "_copy": F.lit(2)})
    path = str(tmp_path / "out")
    stage(spark, named, folder).write.parquet(path)
    out = spark.read.parquet(path)
    assert set(named.columns) <= set(out.columns) and out.count() > 0
    assert out.where("_row_key <> 'x' or size <> 'x0'").count() == 0
    if stage is pipeline.shard:
        assert out.where("shard < 0 or shard > 39").count() == 0 and out.columns[-2:] == ["shard", "slot"]
    else:
        assert out.columns == named.columns


def test_features_are_taken_in_small_pieces():
    text = pa.array([" ".join(f"word{(i * k) % 997}" for i in range(90)) for k in range(1, 900)])

    def taken(limit):
        tracemalloc.start()
        parts = [ordinal_quality.features(piece) for piece in pieces(text, limit)]
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), peak

    taken(PIECE)  # the tables of powers are kept
    large, small = taken(PIECE), taken(ordinal_quality.SMALL_PIECE)
    assert (large[0] == small[0]).all() and (large[1] == small[1]).all()
    assert small[2] < large[2] / 2


def test_the_classifier_sends_few_texts_at_a_time(spark, docs, folder, monkeypatch):
    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []

    def noted(write):
        def run(df):
            seen.append(int(spark.conf.get(name)))
            return write(df)

        return run

    for module, writer in ((ordinal_quality, "cut"), (pipeline, "stored")):
        monkeypatch.setattr(module, writer, noted(getattr(module, writer)))
    before = spark.conf.get(name)
    assert rows(pipeline.classify(spark, docs, folder)) == rows(docs)
    assert seen[-2:] == [ordinal_quality.ROWS] * 2  # features of the ratings, and the graded rows
    assert spark.conf.get(name) == before


def test_no_task_needs_two_workers_for_shared_keys(spark):
    def extract(batch):
        yield batch.column(0).to_numpy(), (batch.column(1).to_numpy() % 7).astype(np.uint64)

    many = spark.createDataFrame([(i, i) for i in range(700)], "doc bigint, key bigint").repartition(1)  # every key is frequent
    found = shared_keys.shared_keys(many, extract)
    assert Counter(r.owner for r in found.collect()) == Counter({i: 100 for i in range(7)})

    def check(node, above=False):
        python = node.nodeName() == "MapInArrow"
        assert not (above and python)
        children = node.children()
        for i in range(children.size()):
            check(children.apply(i), (above or python) and not node.nodeName().startswith(("Repartition", "Join")))

    check(found._jdf.queryExecution().optimizedPlan())
