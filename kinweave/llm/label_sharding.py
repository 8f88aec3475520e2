"""Sharding by balanced label propagation.

Documents that share a link key (here: equal texts) want to be in one shard. Every linked document
starts in a shard drawn from its hash. In each round a link group votes with its members' labels, and
a join hands the winning label back to the members. A shard admits movers only up to its quota:
movers are counted per (shard, hash bucket), whole buckets are admitted while they fit, and the rest
ask another shard in the next round. The documents without links then fill what is free, so that row
counts differ by one at most.

A group of more than a quarter of a shard is placed before the rounds: there are fewer than four of
them a shard, so their sizes are packed on the driver, each into as few shards as the free room
allows. Its rows take their shards by their rank within the group, so a group that holds a third of
all rows is no hot key. Ranks come from a range sort with one offset per partition; the driver sees
the sizes of these groups and one row per shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window as W

from kinweave.plans.lineage import cut
from kinweave.plans.ordinals import dense_ordinal

BUCKETS = 1024
SPOT = {"_group": IntegerType(), "_ahead": LongType(), "_shards": ArrayType(IntegerType()), "_ends": ArrayType(LongType())}


def _packed(sizes: list[int], quota: list[int]) -> tuple[list[list[tuple[int, int]]], list[int]]:
    """(shard, rows) of each group, and what is left of the quotas.

    Groups come largest first. One takes the emptiest shards until the rest fits into a shard; that
    goes where it leaves the least room.
    """
    free, spans = list(quota), []
    for n in sizes:
        parts = []
        while n:
            fits = [s for s, room in enumerate(free) if room >= n]
            s = min(fits, key=lambda s: free[s]) if fits else max(range(len(free)), key=lambda s: free[s])
            parts.append((s, min(n, free[s])))
            n -= parts[-1][1]
            free[s] -= parts[-1][1]
        spans.append(parts)
    return spans, free


def _literals(values: list[int]) -> Column:
    return F.array(*[F.lit(int(v)) for v in values])


def balanced_shards(
    items: DataFrame, tie: str, link: str, shards: int, rounds: int = 4
) -> DataFrame:
    """``items`` plus ``shard`` (0 to ``shards`` - 1) and ``slot`` (0, 1, .. within the shard).

    ``tie`` is a BIGINT column that orders rows pseudo-randomly (a hash of the row); rows equal in
    all columns may swap places. ``link`` groups rows that belong together; NULL links nothing.
    Row counts of shards differ by at most one. An empty table gives an empty result.
    """
    columns = items.columns
    rows = items.withColumns({"_tie": F.col(tie), "_link": F.col(link)})
    total = rows.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    most = max(1, total // shards // 4)

    groups = cut(rows.where(F.col("_link").isNotNull()).groupBy("_link").agg(F.count("*").alias("_n")).where("_n > 1"))
    large = groups.where(F.col("_n") > most).orderBy(F.desc("_n"), F.xxhash64("_link"), "_link").collect()  # under 4 a shard
    spans, free = _packed([g["_n"] for g in large], quota)
    ahead, spots = 0, []
    for number, (g, parts) in enumerate(zip(large, spans)):
        spots.append((g["_link"], number, ahead, [s for s, _ in parts], [sum(n for _, n in parts[: i + 1]) for i in range(len(parts))]))
        ahead += g["_n"]
    schema = StructType([groups.schema["_link"], *[StructField(name, kind) for name, kind in SPOT.items()]])
    spots = F.broadcast(items.sparkSession.createDataFrame(spots, schema))
    rows = rows.join(spots, "_link", "left")
    packed = rows.where("_group is not null")
    if large:
        packed = dense_ordinal(packed, ["_group", "_tie", *columns], "_ord")
        part = F.size(F.filter("_ends", lambda end: end < F.col("_ord") - F.col("_ahead")))
        packed = packed.withColumn("_label", F.get("_shards", part))
    else:
        packed = packed.withColumn("_label", F.lit(None).cast("int"))

    rows = rows.where("_group is null").drop(*SPOT)
    rows = rows.join(groups.where(F.col("_n") <= most), "_link", "left").withColumn(
        "_unit", F.when(F.col("_n").isNotNull(), F.xxhash64("_link"))
    )
    rows = cut(rows.withColumn("_label", F.pmod(F.xxhash64("_tie", F.lit("start")), F.lit(shards)).cast("int")))

    singles = rows.where("_unit is null").withColumn("_label", F.lit(None).cast("int"))
    linked = rows.where("_unit is not null").withColumn("_settled", F.lit(False))
    quota_left = list(free)
    for turn in range(rounds):
        votes = linked.groupBy("_unit", "_label").agg(F.count("*").alias("_votes"), F.max("_settled").alias("_settled"))
        room = F.get(_literals(free), F.col("_label"))
        best = votes.groupBy("_unit").agg(
            F.max_by("_label", F.struct(F.col("_settled"), (room > 0), F.col("_votes"), F.xxhash64("_unit", "_label"))).alias("_best"),
            F.sum("_votes").alias("_size"), F.max("_settled").alias("_done"),
        )
        # A group whose wish was refused before asks one of the emptiest shards.
        roomy = sorted(range(shards), key=lambda s: -free[s])[: max(1, shards // 4)]
        other = F.get(_literals(roomy), F.pmod(F.xxhash64("_unit", F.lit(turn)), F.lit(len(roomy))).cast("int"))
        best = best.withColumn("_best", F.when(F.col("_done") | (F.lit(turn) == 0), F.col("_best")).otherwise(other))
        best = best.withColumn("_bucket", F.pmod(F.xxhash64("_unit", F.lit("bucket")), F.lit(BUCKETS)))

        asked = best.where(~F.col("_done")).groupBy("_best", "_bucket").agg(F.sum("_size").alias("_rows"))
        before = W.partitionBy("_best").orderBy("_bucket")  # at most BUCKETS rows a shard
        admitted = asked.withColumn("_sum", F.sum("_rows").over(before)).where(
            F.col("_sum") <= F.get(_literals(free), F.col("_best"))
        ).select("_best", "_bucket", F.lit(True).alias("_in"))
        moved = best.join(admitted, ["_best", "_bucket"], "left").select(
            "_unit", "_best", (F.col("_done") | F.coalesce("_in", F.lit(False))).alias("_now")
        )
        linked = cut(
            linked.join(moved, "_unit")
            .withColumn("_label", F.when(F.col("_now"), F.col("_best")).otherwise(F.col("_label")))
            .withColumn("_settled", F.col("_now")).drop("_best", "_now")
        )
        held = {r[0]: r[1] for r in linked.where("_settled").groupBy("_label").count().collect()}
        free = [q - held.get(s, 0) for s, q in enumerate(quota_left)]
        if not linked.where("not _settled").limit(1).count():
            break

    # Whatever has no shard yet fills the free places in one order, refused groups side by side.
    rest = singles.unionByName(linked.where("not _settled").drop("_settled"))
    rest = rest.withColumn("_order", F.coalesce("_unit", "_tie"))
    sums = [sum(free[: s + 1]) for s in range(shards)]
    rest = dense_ordinal(rest, ["_order", "_tie", *columns], "_ord").withColumn(
        "_label", F.size(F.filter(_literals(sums), lambda s: s < F.col("_ord"))).cast("int")
    )
    placed = linked.where("_settled").select(*columns, "_tie", "_label").unionByName(
        rest.select(*columns, "_tie", "_label")).unionByName(packed.select(*columns, "_tie", "_label"))
    starts = [sum(quota[:s]) for s in range(shards)]
    return dense_ordinal(placed, ["_label", "_tie", *columns], "_ord").select(
        *columns, F.col("_label").alias("shard"),
        (F.col("_ord") - 1 - F.get(_literals(starts), F.col("_label"))).cast("bigint").alias("slot"),
    )


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Documents with equal texts are linked; NULL texts (size 16) and NULL ids link nothing and are
    placed like any other row. Repeated rows are rows of their own. The law is ``rows``.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = cut(docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + 16).cast("bigint").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.md5(F.col("text").cast("binary")).alias("link"),
    ).withColumn("tie", F.xxhash64("doc_id", "link")))
    placed = balanced_shards(rows, "tie", "link", shards)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
