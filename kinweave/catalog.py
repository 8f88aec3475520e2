"""The catalog: a handful of tables, and the membership index every operator reads."""

from __future__ import annotations

from collections.abc import Mapping
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from kinweave.plans.lineage import cut, stored
from kinweave.plans.ordinals import (
    block_of,
    blocks_between,
    dense_ordinal,
    membership_index,
    table_fingerprint,
)

IDENTITIES = "identity_id string, name string, description string, synonyms array<string>"
GRAIN = (
    "struct<components: array<struct<dataset_columns: array<string>, identity_id: string, "
    "description: string>>, description: string>"
)
DATASETS = (
    "node_id string, pos int, "
    "descriptor struct<qualified_name: string, display_name: string, description: string, "
    "synonyms: array<string>, tags: array<string>>, "
    "accessor struct<kind: string, endpoint: string, labels: map<string,string>, properties: string>, "
    "accessor_canonical string, properties_canonical string, "
    f"grain {GRAIN}"
)
COLUMNS = (
    "node_id string, pos int, name string, description string, value_description string, "
    "synonyms array<string>"
)
DEFINITIONS = (
    "node_id string, pos int, identity_id string, dataset_columns array<string>, "
    "entity_universe string, unique boolean, total boolean, conforms boolean, "
    "entity_expression array<string>, entity_metadata string, description string"
)
ENTITY_RELATIONSHIPS = (
    "left_id string, right_id string, multiplicity string, me_left string, me_right string, "
    "descriptions array<string>"
)
ANNOTATIONS = "edge_id string, description string, tags array<string>"
SNAPSHOT = "version string"

TABLES = {
    "identities": IDENTITIES,
    "datasets": DATASETS,
    "columns": COLUMNS,
    "definitions": DEFINITIONS,
    "entity_relationships": ENTITY_RELATIONSHIPS,
    "annotations": ANNOTATIONS,
    "snapshot": SNAPSHOT,
}

DEFAULT_BLOCK_ROWS = 100_000
HUB_PARTS = 256  # keys that the rows of a hub are dealt by
MEMBER_COLUMNS = [
    "ord", "node_id", "identity_id", "dataset_columns", "entity_universe", "unique", "total",
    "conforms", "node_first", "node_size", "node_block", "pos", "size", "entity_block",
]


class Catalog:
    """Catalog tables plus lazily built indexes.

    Tables may be given with only the columns a job needs; absent ones are added as NULL, and absent
    tables are empty. A NULL boolean claim and a NULL grain mean ``unknown``.
    """

    def __init__(
        self, spark: SparkSession, *, block_rows: int = DEFAULT_BLOCK_ROWS,
        **tables: DataFrame | None,
    ) -> None:
        extra = set(tables) - set(TABLES)
        if extra:
            raise ValueError(f"unknown catalog tables: {sorted(extra)}")
        self.spark = spark
        self.block_rows = block_rows
        for name, schema in TABLES.items():
            setattr(self, name, _conform(spark, tables.get(name), schema))

    # -- indexes -----------------------------------------------------------------------------

    @cached_property
    def members(self) -> DataFrame:
        """The membership index: see :func:`kinweave.plans.ordinals.membership_index`."""
        return membership_index(self.definitions, self.block_rows)

    @cached_property
    def nodes(self) -> DataFrame:
        """One row per dataset: its definition span and its outgoing edge count.

        Counting ``size - 1`` per definition gives the degree with no pair join.
        """
        held = self.members.groupBy("node_id").agg(
            F.first("node_first").alias("node_first"),
            F.first("node_size").alias("node_size"),
            F.sum(F.col("size") - 1).alias("edge_count"),
        )
        listed = self.datasets.select("node_id").distinct()
        return stored(listed.join(held, "node_id", "full_outer").select(
            "node_id",
            F.coalesce("node_first", F.lit(0)).cast("bigint").alias("node_first"),
            F.coalesce("node_size", F.lit(0)).cast("bigint").alias("node_size"),
            F.coalesce("edge_count", F.lit(0)).cast("bigint").alias("edge_count"),
        ))

    @cached_property
    def edge_counts(self) -> DataFrame:
        """Outgoing edges of every dataset with definitions, from the sizes of entities alone: no index is built.

        Definitions meet the size of their entity by its ID. Hubs, of more than ``block_rows`` rows, are broadcast
        with their sizes, and their rows dealt by a number of their own, which matches nothing or the same size.
        """
        held = self.definitions.where("identity_id is not null").select(
            "node_id", "identity_id", F.pmod(F.xxhash64("node_id", "dataset_columns"), F.lit(HUB_PARTS)).alias("_part"))
        sizes = held.groupBy("identity_id").agg(F.count("*").alias("_size"))
        hubs = sizes.where(F.col("_size") > self.block_rows).withColumnRenamed("_size", "_hub")
        dealt = held.join(F.broadcast(hubs), "identity_id", "left").withColumn("_part", F.when(F.col("_hub").isNull(), 0).otherwise(F.col("_part")))
        sized = dealt.join(sizes.withColumn("_part", F.lit(0).cast("bigint")), ["identity_id", "_part"], "left")
        return sized.where("node_id is not null").groupBy("node_id").agg(F.sum(F.coalesce("_hub", "_size") - 1).alias("edge_count"))

    @cached_property
    def entities(self) -> DataFrame:
        """One row per logical entity that is registered or realised, with its posting size."""
        held = self.members.groupBy("identity_id").agg(F.first("size").alias("size"))
        listed = self.identities.groupBy("identity_id").agg(F.min("name").alias("name"))
        return cut(listed.join(held, "identity_id", "full_outer").select(
            "identity_id", "name", F.coalesce("size", F.lit(0)).cast("bigint").alias("size")
        ))

    @cached_property
    def entity_ordinals(self) -> DataFrame:
        """Every entity that is registered or related, with ``e_ord``, its ordinal by ID."""
        ends = self.entity_relationships.select(F.explode(F.array("left_id", "right_id")).alias("identity_id"))
        return dense_ordinal(self.entities.select("identity_id").unionByName(ends).distinct(), ["identity_id"], "e_ord")

    @cached_property
    def column_ids(self) -> DataFrame:
        """Columns with ``c_ord``, their ordinal by (dataset, name)."""
        keys = self.columns.select("node_id", "name").distinct()
        return dense_ordinal(keys, ["node_id", "name"], "c_ord")

    @cached_property
    def relationship_ids(self) -> DataFrame:
        """Stated entity pairs with ``x_ord``, their ordinal by (left, right)."""
        keys = self.entity_relationships.select("left_id", "right_id").distinct()
        return dense_ordinal(keys, ["left_id", "right_id"], "x_ord")

    def fingerprint(self, changes: Mapping[str, tuple[Column, dict[str, Column]]] | None = None) -> DataFrame:
        """One row per table with a content hash; equal catalogs give equal rows.

        ``changes`` names tables, conditions and columns with their values instead; ``changed_fingerprint`` is
        then that of the catalog changed so, from the same reading.
        """
        result = None
        for name in TABLES:
            if name == "snapshot":
                continue
            table = getattr(self, name)
            own, changed = _hashable(table), None
            if changes and name in changes:
                where, values = changes[name]
                changed = where, _hashable(table, values)
            row = table_fingerprint(table, own, changed).withColumn("table_name", F.lit(name))
            if changes:
                row = row.withColumn("changed_fingerprint", F.col("changed_fingerprint" if changed else "fingerprint"))
            row = row.select("table_name", "fingerprint", *["changed_fingerprint"] * bool(changes))
            result = row if result is None else result.unionByName(row)
        return result

    # -- skew-proof joins ----------------------------------------------------------------------

    def join_postings(self, left: DataFrame, prefix: str, key: str = "identity_id", size: str = "size") -> DataFrame:
        """Every definition of each row's entity, as ``prefix``-named columns.

        ``left`` carries the entity and its posting size, so it can name the posting blocks: a hub is
        joined block by block and no task holds more than ``block_rows`` of it.
        """
        blocked = left.where(F.col(size) > 0).withColumn(
            "_block", blocks_between(F.lit(1), F.col(size), self.block_rows)
        )
        right = self.prefixed(prefix)
        return blocked.join(
            right,
            (F.col(key) == right[f"{prefix}identity_id"])
            & (F.col("_block") == right[f"{prefix}entity_block"]),
        ).drop("_block")

    def join_definitions(
        self, left: DataFrame, prefix: str, key: str = "node_id",
        first: str = "node_first", size: str = "node_size",
    ) -> DataFrame:
        """Every definition on each row's dataset, as ``prefix``-named columns, block by block."""
        blocked = left.where(F.col(size) > 0).withColumn(
            "_block",
            blocks_between(F.col(first), F.col(first) + F.col(size) - 1, self.block_rows),
        )
        right = self.prefixed(prefix)
        return blocked.join(
            right,
            (F.col(key) == right[f"{prefix}node_id"])
            & (F.col("_block") == right[f"{prefix}node_block"]),
        ).drop("_block")

    def prefixed(self, prefix: str) -> DataFrame:
        return self.members.select(
            *(F.col(name).alias(prefix + name) for name in MEMBER_COLUMNS)
        )

    def counts(self) -> DataFrame:
        """The version and the size of each collection, one row."""
        sizes = [
            ("node_count", self.datasets.select("node_id")),
            ("entity_definition_count", self.definitions.select("node_id")),
            ("identity_count", self.identities.select("identity_id")),
            ("entity_relationship_count", self.entity_relationships.select("left_id")),
        ]
        result = self.snapshot.agg(F.max("version").alias("version"))
        for name, table in sizes:
            result = result.crossJoin(table.agg(F.count("*").alias(name)))  # one row each
        return result


def _conform(spark: SparkSession, table: DataFrame | None, schema: str) -> DataFrame:
    fields = T.StructType.fromDDL(schema).fields
    if table is None:
        # A constant false filter, so the optimizer drops the branches that read an absent table.
        absent = spark.range(1).where(F.lit(False))
        return absent.select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in fields))
    given = set(table.columns)
    return table.select(*(
        (F.col(f.name) if f.name in given else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in fields
    ))


def _hashable(table: DataFrame, instead: Mapping[str, Column] | None = None) -> list:
    """Columns for hashing, some of them ``instead``; maps become sorted entries, since a map has no defined order."""
    picked, instead = [], instead or {}
    for field in table.schema.fields:
        if field.name in instead:
            picked.append(instead[field.name].cast(field.dataType).alias(field.name))
        elif field.name == "accessor":
            picked.append(F.struct(
                "accessor.kind", "accessor.endpoint",
                F.array_sort(F.map_entries("accessor.labels")).alias("labels"), "accessor.properties",
            ).alias("accessor"))
        elif field.name != "pos":
            picked.append(F.col(field.name))
    return picked


__all__ = ["Catalog", "block_of"]
