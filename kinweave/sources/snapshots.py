"""Published catalogs: one folder per attempt, and a list of pointers that is appended to last.

A folder is complete and checked before a pointer names it, so a failed publication leaves the current
catalog as it was, and its version free for the next attempt. Definitions are written clustered by entity and columns by dataset.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinweave.catalog import TABLES, Catalog
from kinweave.operators.integrity import integrity
from kinweave.sources.collections import NODE, STATED, catalog_of

_CLUSTER = {"definitions": "identity_id", "columns": "node_id", "datasets": "node_id"}


def _attempt(version: str) -> str:
    return f"version={version.replace(':', '-')}/attempt={uuid.uuid4().hex}"


def publish(cat: Catalog, root: str, version: str | None = None) -> str:
    """Write, re-read and check a candidate, then make it current. Returns its version."""
    version = version or cat.snapshot.agg(F.max("version")).first()[0]
    if not version:
        raise ValueError("a snapshot needs a version")
    if _pointers(cat.spark, root).where(F.col("version") == version).limit(1).count():
        raise ValueError(f"version {version} is published already")
    place = _attempt(version)
    folder = f"{root.rstrip('/')}/{place}"
    for name in TABLES:
        table = getattr(cat, name)
        if name == "snapshot":
            table = cat.spark.range(1).select(F.lit(version).alias("version"))
        elif name in _CLUSTER:
            key = _CLUSTER[name]
            table = table.repartitionByRange(key).sortWithinPartitions(key)
        table.write.mode("errorifexists").parquet(f"{folder}/{name}")
    faults = integrity(_read(cat.spark, folder, cat.block_rows)).limit(5).collect()
    if faults:
        raise ValueError(f"candidate {version} is not sound: {[f.message for f in faults]}")
    number = (_pointers(cat.spark, root).agg(F.max("number")).first()[0] or 0) + 1
    pointer = cat.spark.range(1).select(F.lit(number).alias("number"), F.lit(version).alias("version"), F.lit(place).alias("place"))
    pointer.coalesce(1).write.mode("append").json(f"{root.rstrip('/')}/current")  # what is there stays until this is committed
    return version


def _pointers(spark: SparkSession, root: str) -> DataFrame:
    """(number, version, place) of every publication; the highest number is current."""
    folder = f"{root.rstrip('/')}/current"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "number int, version string, place string")
    return spark.read.schema("number int, version string, place string").json(folder)


def _read(spark: SparkSession, folder: str, block_rows: int) -> Catalog:
    return Catalog(spark, block_rows=block_rows, **{
        name: spark.read.schema(schema).parquet(f"{folder}/{name}") for name, schema in TABLES.items()
    })


def load(spark: SparkSession, root: str, version: str | None = None, block_rows: int = 100_000) -> Catalog:
    """The current catalog, or the one of a named version."""
    published = _pointers(spark, root)
    if version is not None:
        published = published.where(F.col("version") == version)
    place = published.agg(F.max_by("place", F.struct("number", "version"))).first()[0]
    if place is None:
        what = "nothing is" if version is None else f"version {version} is not"
        raise ValueError(f"{what} published below {root}")
    return _read(spark, f"{root.rstrip('/')}/{place}", block_rows)


# -- JSON artifacts --------------------------------------------------------------------------------


def artifact_versions(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``(path, version)`` of each JSON artifact file."""
    return spark.read.schema("version string").json(paths, multiLine=True).select(
        F.col("_metadata.file_path").alias("path"), "version"
    )


def load_artifact(spark: SparkSession, nodes: str, annotations: str | None = None, entity_relationships: str | None = None) -> Catalog:
    """A catalog from its JSON artifact files; the last two are optional. All must share a version."""
    paths = [p for p in (nodes, annotations, entity_relationships) if p]
    versions = [r.version for r in artifact_versions(spark, paths).select("version").distinct().limit(2).collect()]
    if len(versions) != 1:
        raise ValueError(f"artifact files do not share one version: {versions}")
    node_file = spark.read.schema(
        f"version string, logical_identities array<struct<identity_id: string, name: string, description: string, "
        f"synonyms: array<string>>>, nodes array<{NODE}>"
    ).json(nodes, multiLine=True)
    stated = None
    if entity_relationships:
        stated = spark.read.schema(f"entity_relationships array<{STATED}>").json(entity_relationships, multiLine=True)
    identities = node_file.select(F.explode("logical_identities").alias("i")).select("i.*")
    node_rows = node_file.select(F.posexplode("nodes").alias("pos", "n")).select("pos", "n.*")
    if stated is None:
        stated = spark.createDataFrame([], f"entity_relationships array<{STATED}>")
    cat = catalog_of(spark, node_rows, identities, stated.select(F.explode("entity_relationships").alias("r")), versions[0])
    if annotations:
        read = spark.read.schema(
            "annotations array<struct<edge_id: string, description: string, tags: array<string>>>"
        ).json(annotations, multiLine=True)
        cat.annotations = read.select(F.explode("annotations").alias("a")).select(
            "a.edge_id", F.coalesce("a.description", F.lit("")).alias("description"),
            F.coalesce("a.tags", F.array().cast("array<string>")).alias("tags"),
        )
    return cat


def envelope_findings(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Artifact files whose version differs from the first file's."""
    expected = artifact_versions(spark, paths[:1]).select(F.col("version").alias("expected")).limit(1)
    return artifact_versions(spark, paths).join(F.broadcast(expected)).where(~F.col("version").eqNullSafe(F.col("expected")))  # one row
