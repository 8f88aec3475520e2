"""What steps leave behind: stored tables and shuffles."""

import os
import time

from pyspark.sql import functions as F

from kinweave.operators import discovery, documents, integrity, relationships
from kinweave.plans.lineage import stored
from tests.graphs import catalog_of, random_definitions


def _stored(spark):
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    return {f for f in os.listdir(folder) if f.startswith("stored-")}


def _shuffles(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {f for d in disk.localDirsString() for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}


def _exchanges(plan):
    return plan._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_the_index_leaves_one_table(spark):
    cat = catalog_of(spark, random_definitions(3))
    before = _stored(spark)
    assert cat.members.count() == 24
    assert len(_stored(spark) - before) == 1


def test_a_step_leaves_no_shuffle(spark):
    before = _shuffles(spark)
    table = stored(spark.range(1000).groupBy(F.col("id") % 100).count())
    until = time.time() + 30
    while (left := _shuffles(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left and table.count() == 100


def test_a_histogram_groups_its_datasets_once(spark):
    cat = catalog_of(spark, random_definitions(3), block_rows=100)
    found = discovery.entity_histogram(cat, spark.createDataFrame([(1, "e0"), (2, "e1")], "req_id bigint, identity_id string"))
    assert _exchanges(found) <= 4  # only ranks, totals and names are left; the groups are stored


def test_a_lookup_never_sends_the_members_to_every_task(spark):
    cat = catalog_of(spark, random_definitions(3))
    asked = spark.createDataFrame([("D1-D2", "n0", None), ("D2-D1", "n0", None)], "edge_id string, from_node_id string, from_dataset_columns array<string>")
    plan = relationships.looked_up(cat, asked)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") == 2


def test_repeated_datasets_are_told_without_a_shuffle(spark):
    names = ["b", "a", "b", None, "a", None, "c"]
    document = spark.createDataFrame([(1, ["edge"], [(n,) for n in names])], "doc_id bigint, edge_fields array<string>, datasets array<struct<node_id: string>>")
    rows = documents.document_datasets(document)
    assert _exchanges(rows) == 0
    assert {r.i: r.occurrence == 1 for r in rows.collect()} == {i: n not in names[:i] for i, n in enumerate(names)}
    assert [(r.i, r.node_id) for r in rows.sort("i").collect()] == list(enumerate(names))


def test_findings_are_there_before_they_are_read(spark):
    cat = catalog_of(spark, random_definitions(3), columns=spark.createDataFrame([("n0", "c0")], "node_id string, name string"))
    found = integrity.integrity(cat)
    assert _exchanges(found) <= 2  # annotations alone are looked up when the findings are read
    assert "missing_column" in {r.rule for r in found.collect()}
