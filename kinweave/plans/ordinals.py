"""Dense global ordinals and the membership index, without any single-task sort.

``dense_ordinal`` range-partitions on the key, sorts inside partitions and adds one offset per
partition. The rows are stored first, with their places: offsets and rows must see the same range bounds,
which two evaluations of a sampled range exchange do not promise.

``membership_index`` adds what makes later joins independent of skew. Every definition knows its
ordinal, the ordinal span of its dataset, its position among the definitions of its entity, and the
sizes of both. Spans and positions are dense, so a hub splits into equal blocks that both join sides
can name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from kinweave.plans.lineage import cut, passing, stored

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in its low 33 bits
_BUCKETS = 1 << 16  # counters of a table when hubs are looked for

DEFINITION_KEY = ["node_id", "identity_id", "dataset_columns"]
CLAIMS = ["entity_universe", "unique", "total", "conforms"]


def dense_ordinal(df: DataFrame, order_by: list[str], name: str = "ord") -> DataFrame:
    """``df`` plus ``name``: 1-based rank by ``order_by``, whose values must be unique."""
    keys = [F.col(c) for c in order_by]
    # No partition count is named, so adaptive execution fits it to the data before it is stored.
    return _numbered(df.repartitionByRange(*keys).sortWithinPartitions(*keys), name)


def _numbered(ranged: DataFrame, name: str) -> DataFrame:
    """``ranged``, whose partitions and rows lie in order, plus ``name``: the 1-based place of each row."""
    placed = stored(ranged.withColumn("_row", F.monotonically_increasing_id()))
    partition = F.shiftright("_row", _ROW_BITS)
    # One row per partition from here on, so the global window and the broadcast are bounded.
    counts = placed.groupBy(partition.alias("_part")).agg(F.count("*").alias("_n"))
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    )
    position = F.col("_row").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        placed.withColumn("_part", partition)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + position + 1)
        .drop("_part", "_row", "_before")
    )


def block_of(position: Column, block_rows: int) -> Column:
    """Block number of a 1-based dense position."""
    return F.floor((position - 1) / F.lit(block_rows)).cast("bigint")


def blocks_between(first: Column, last: Column, block_rows: int) -> Column:
    return F.explode(F.sequence(block_of(first, block_rows), block_of(last, block_rows)))


def _hubs(rows: DataFrame, key: str, most: int) -> DataFrame:
    """Values of ``key`` that more than ``most`` rows hold. Only buckets with that many rows are counted by value."""
    bucket = F.pmod(F.xxhash64(key), F.lit(_BUCKETS))
    heavy = rows.groupBy(bucket.alias("_bucket")).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select("_bucket")
    suspects = rows.select(key, bucket.alias("_bucket")).join(F.broadcast(heavy), "_bucket", "left_semi")
    return cut(suspects.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(key))


def membership_index(definitions: DataFrame, block_rows: int) -> DataFrame:
    """One narrow row per definition, with ordinals, positions and group sizes.

    Adds ``ord``; ``node_first``/``node_size`` (the dataset's ordinal span) and ``node_block``;
    ``pos``/``size`` (rank among, and number of, the entity's definitions) and ``entity_block``.

    Two shuffles of the rows: by dataset, in order, and by entity. Only hubs, of more than ``block_rows`` rows,
    are spread over tasks. The rows are stored first, as they are read for their hubs, bounds and order; that copy
    and the numbered one go once the index is there.
    """
    with passing(definitions.sparkSession):
        return stored(_indexed(definitions, block_rows), keep=True)


def _indexed(definitions: DataFrame, block_rows: int) -> DataFrame:
    rows = stored(definitions.select(*DEFINITION_KEY, *CLAIMS))

    # All rows of a dataset share a range and a window, but those of a hub stand alone; its span is added up later.
    hubs = _hubs(rows, "node_id", block_rows)
    rows = rows.join(F.broadcast(hubs.withColumn("_hub", F.lit(True))), "node_id", "left").withColumn(
        "_alone", F.when(F.col("_hub"), F.struct("identity_id", "dataset_columns"))
    )
    dataset = W.partitionBy("node_id", "_alone")
    rows = rows.repartitionByRange("node_id", "_alone").select(
        *DEFINITION_KEY, *CLAIMS, "_hub",
        F.row_number().over(dataset.orderBy("identity_id", "dataset_columns")).alias("_rank"),
        F.count("*").over(dataset).alias("node_size"),
    )
    rows = _numbered(rows, "ord").withColumn("node_first", F.col("ord") - F.col("_rank") + 1).drop("_rank")
    if not hubs.isEmpty():
        spans = rows.where("_hub").groupBy("node_id").agg(F.min("ord").alias("_first"), F.count("*").alias("_size"))
        rows = rows.join(F.broadcast(spans), "node_id", "left").withColumns(
            {"node_first": F.coalesce("_first", "node_first"), "node_size": F.coalesce("_size", "node_size")}
        )
    rows = rows.withColumn("node_block", block_of(F.col("ord"), block_rows))

    # Rank inside the entity, for a hub inside (entity, ordinal block) plus the rows of its earlier blocks.
    hubs = _hubs(rows, "identity_id", block_rows)
    rows = rows.drop("_hub").join(F.broadcast(hubs.withColumn("_hub", F.lit(True))), "identity_id", "left").withColumn(
        "_part", F.when(F.col("_hub"), F.col("node_block"))
    )
    entity = W.partitionBy("identity_id", "_part")
    rows = rows.withColumn("pos", F.row_number().over(entity.orderBy("ord")).cast("bigint")).withColumn("size", F.count("*").over(entity))
    if not hubs.isEmpty():
        hub = W.partitionBy("identity_id")
        earlier = hub.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
        blocks = rows.where("_hub").groupBy("identity_id", "_part").agg(F.count("*").alias("_n")).select(
            "identity_id", F.col("_part").alias("_of"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(hub).alias("_all"),
        )
        rows = rows.join(F.broadcast(blocks.withColumnRenamed("identity_id", "_entity")), (F.col("identity_id") == F.col("_entity")) & (F.col("_part") == F.col("_of")), "left").withColumns(
            {"pos": F.col("pos") + F.coalesce("_before", F.lit(0)), "size": F.coalesce("_all", "size")}
        )
    return rows.where("node_id is not null and identity_id is not null").withColumn("entity_block", block_of(F.col("pos"), block_rows)).select(
        "ord", *DEFINITION_KEY, *CLAIMS,
        "node_first", "node_size", "node_block", "pos", "size", "entity_block",
    )


def table_fingerprint(df: DataFrame, columns: list[str], changed: tuple[Column, list[Column]] | None = None) -> DataFrame:
    """One row whose hash depends only on the table's content, not on row order or layout.

    Row digests are summed as 128-bit integers, so the whole table folds with partial aggregation. With ``changed``,
    a condition and other columns, ``changed_fingerprint`` is that of the table whose rows under the condition hold
    those columns instead; both come from one pass, which digests only these rows twice.
    """
    def digest(picked: list) -> Column:
        return F.sha2(F.to_json(F.struct(*picked), {"ignoreNullFields": "false"}), 256)

    def sums(of: str) -> list[Column]:
        parts = [F.conv(F.substring(of, 1 + 14 * i, 14), 16, 10).cast("decimal(38,0)") for i in range(4)]
        return [F.coalesce(F.sum(part), F.lit(0)).alias(f"{of}{i}") for i, part in enumerate(parts)]

    def total(values: list[Column]) -> Column:
        return F.sha2(F.concat_ws(":", F.coalesce(F.sum("_c"), F.lit(0)).cast("string"), *[F.coalesce(F.sum(v), F.lit(0)).cast("string") for v in values]), 256)

    if changed is None:
        folded = df.select(digest(columns).alias("_d")).agg(F.count("*").alias("_c"), *sums("_d"))
        return folded.agg(total([F.col(f"_d{i}") for i in range(4)]).alias("fingerprint"))
    where, instead = changed
    rows = df.select(digest(columns).alias("_d"), F.when(where, digest(instead)).alias("_o"))
    folded = rows.groupBy(F.col("_o").isNotNull().alias("_other")).agg(F.count("*").alias("_c"), *sums("_d"), *sums("_o"))  # two rows
    return folded.agg(
        total([F.col(f"_d{i}") for i in range(4)]).alias("fingerprint"),
        total([F.when(F.col("_other"), F.col(f"_o{i}")).otherwise(F.col(f"_d{i}")) for i in range(4)]).alias("changed_fingerprint"))
