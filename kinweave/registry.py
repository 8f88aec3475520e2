"""Registered queries over the given tables, each with the SQL that checks it.

Requests are derived from the tables too, so every query's work grows with them: all parts, all users,
each customer's largest order, and so on.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window as W

from kinweave import oracles
from kinweave.catalog import Catalog
from kinweave.functions import text
from kinweave.operators import (
    connecting, discovery, documents, integrity, measure, paths, projection, relationships, search, traversal,
)
from kinweave.plans.lineage import cut, stored
from kinweave.sources import collections, membership
from kinweave.sources.membership import read_table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, sql in oracles.all_sql().items() if name in _QUERIES}


def _catalog(kind: str, spark: SparkSession, folder: str) -> Catalog:
    return _built(kind, spark.sparkContext.applicationId, folder)


@cache
def _built(kind: str, application: str, folder: str) -> Catalog:
    """One catalog per session and folder: its index serves every query, as a published one would."""
    blocks = {"block_rows": HUB_BLOCK} if kind == "status" else {}
    return getattr(membership, f"{kind}_catalog")(SparkSession.getActiveSession(), folder, **blocks)


def _joined(values: Column) -> Column:
    return F.array_join(values, "|")


# -- requests ------------------------------------------------------------------------------------


def _largest_orders(spark: SparkSession, folder: str, *by: str) -> DataFrame:
    """The order with the highest price per customer, nation or region."""
    orders = read_table(spark, folder, "orders")
    customer = read_table(spark, folder, "customer").join(
        read_table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    ).select("c_custkey", "n_nationkey", "n_regionkey")
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    best = F.max(F.struct(F.col("o_totalprice"), (-F.col("o_orderkey")).alias("k")))
    return rows.groupBy(*by).agg(best.alias("b")).select(
        *by, F.concat(F.lit("order:"), (-F.col("b.k")).cast("string")).alias("node_id")
    )


def _customer_requests(spark: SparkSession, folder: str) -> DataFrame:
    return _largest_orders(spark, folder, "c_custkey").withColumnRenamed("c_custkey", "req_id")


def _nation_seeds(spark: SparkSession, folder: str) -> DataFrame:
    return _largest_orders(spark, folder, "n_nationkey").withColumnRenamed("n_nationkey", "req_id")


def _part_requests(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "part").select(
        F.col("p_partkey").alias("req_id"), F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("identity_id"),
        F.when(F.col("p_size") > 10, F.array(F.lit("complete"), F.lit("partial"))).alias("universes"),
    )


def _type_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Each event type, with the types before it as targets."""
    kinds = read_table(spark, folder, "events").select("event_type").distinct()
    name = F.concat(F.lit("type:"), F.col("event_type"))
    earlier = W.orderBy("event_type").rowsBetween(W.unboundedPreceding, -1)  # one row per event type
    return kinds.select(
        F.col("event_type").alias("req_id"), name.alias("identity_id"), F.collect_list(name).over(earlier).alias("targets"),
        F.array(F.lit("complete"), F.lit("unknown")).alias("universes"),
    )


# -- sources -------------------------------------------------------------------------------------


@query
def ingest_findings(spark, folder):
    """One catalog file per customer, six of seven with a fault that depends on the key."""
    kind = F.col("c_custkey") % 7

    def when(fault: int, wrong: str, right: str) -> Column:
        return F.when(kind == fault, wrong).otherwise(right)

    json = F.concat(
        F.lit('{"schema_version":"1","logical_identities":{"k":{"name":"x"'), when(4, ',"synonyms":"oops"', ""),
        F.lit('}},"nodes":[{"node_id":"n","descriptor":{"qualified_name":"q","display_name":"d"},"accessor":{"kind":"t","endpoint":'),
        when(3, "7", '"e"'), when(2, ',"port":1', ""), F.lit("},"), when(1, "", '"grain":"unknown",'),
        F.lit('"columns":[{"name":"a"}],"entity_definitions":[{"identity_id":"k","dataset_columns":["a"],"entity_universe":"complete","unique":'),
        when(5, '"maybe"', "true"), F.lit(',"total":true,"conforms":true}]}]}'),
    )
    files = read_table(spark, folder, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit(".yaml")).alias("path"),
        F.when(kind != 0, json).alias("json"), F.when(kind == 0, "broken").alias("error"),
    )
    return collections.ingest_findings(files)


@query
def manifest_findings(spark, folder):
    """A manifest that lists one file per order, against a folder; what is wrong depends on the key."""
    orders = read_table(spark, folder, "orders").select(F.col("o_orderkey").alias("k"))
    kind, name = F.col("k") % 5, F.concat(F.lit("nodes/"), F.col("k").cast("string"))
    path = F.when(kind == 1, F.concat(name, F.lit(".json"))).when(kind == 2, F.concat(F.lit("../"), name)).otherwise(F.concat(name, F.lit(".yaml")))
    times = F.explode(F.sequence(F.lit(0), F.when(kind == 3, 1).otherwise(0)))
    place = F.col("k") * 2 + F.col("again")
    entries = orders.select("k", path.alias("path"), times.alias("again")).select(
        F.lit("1").alias("schema_version"), F.lit("nodes").alias("collection"), "path", place.alias("place"),
        F.concat(F.lit("$.nodes["), place.cast("string"), F.lit("]")).alias("location"),
    )
    there = orders.where(kind.isin(3, 4)).select(F.concat(name, F.lit(".yaml")).alias("path"))
    key = F.col("c_custkey").cast("string")
    extra, notes = F.concat(F.lit("extra/"), key, F.lit(".yml")), F.concat(F.lit("notes/"), key, F.lit(".txt"))
    other = read_table(spark, folder, "customer").select(F.when(F.col("c_custkey") % 2 == 0, extra).otherwise(notes).alias("path"))
    return collections.manifest_findings(entries, there.unionByName(other))


@query
def ownership_findings(spark, folder):
    """A collection file of nodes per customer; what is wrong with it depends on the key."""
    key = F.col("c_custkey")
    kind, text = key % 5, key.cast("string")
    json = F.concat(
        F.lit('{"schema_version":"'), F.when(kind == 2, "2").otherwise("1"), F.lit('"'), F.when(kind == 3, ',"logical_identities":{}').otherwise(""),
        F.when(kind == 1, "").otherwise(F.concat(F.lit(',"nodes":[{"node_id":"'), F.when(kind == 4, "shared").otherwise(F.concat(F.lit("n"), text)), F.lit('"}]'))), F.lit("}"))
    rows = read_table(spark, folder, "customer").select(key, F.concat(F.lit("c"), text, F.lit(".yaml")).alias("path"), json.alias("json"))
    files = rows.select("path", F.when(key % 7 != 0, F.col("json")).alias("json"), F.when(key % 7 == 0, "broken").alias("error"))
    entries = rows.select(F.lit("1").alias("schema_version"), F.lit("nodes").alias("collection"), "path", key.alias("place"), F.lit("$.nodes").alias("location"))
    return collections.ownership_findings(entries, cut(files))


# -- identifiers and relationships ---------------------------------------------------------------


@query
def membership_positions(spark, folder):
    cat = _catalog("order", spark, folder)
    return relationships.postings(cat).select("node_id", "identity_id", _joined(F.col("dataset_columns")).alias("columns"), "ord", "pos", "size")


@query
def column_ordinals(spark, folder):
    return _catalog("order", spark, folder).column_ids


@query
def relationship_ordinals(spark, folder):
    return _catalog("supply", spark, folder).relationship_ids


@query
def relationship_pages(spark, folder):
    """The first page of every user: the next 200 definitions of the type, how many follow, and whether more pages do."""
    cat = _catalog("event", spark, folder)
    return relationships.relationships(cat).select(
        "lo", "hi", "edge_id", "identity_id", "a_node_id", "b_node_id", "ab_multiplicity", "ab_existence",
        "ba_multiplicity", "ba_existence", _joined(F.col("unknown_fields")).alias("unknown_fields"), "pair_total", "more",
    )


@query
def relationship_profile(spark, folder):
    return relationships.relationship_profile(_catalog("order", spark, folder))


@query
def relationship_profile_hubs(spark, folder):
    return relationships.relationship_profile(_catalog("event", spark, folder))


@query
def dataset_degrees(spark, folder):
    return relationships.degrees(_catalog("order", spark, folder))


@query
def relationship_lookup(spark, folder):
    """A lookup per definition: its next peer, or an ID that names no relationship."""
    cat = _catalog("order", spark, folder)
    following = F.lead("ord").over(W.partitionBy("identity_id", F.floor((F.col("pos") - 1) / 64)).orderBy("pos"))
    peers = cat.members.select("ord", "node_id", following.alias("peer"))
    requests = peers.select(
        F.col("ord").alias("req_id"),
        F.concat(F.lit("D"), F.col("ord").cast("string"), F.lit("-D"), F.coalesce("peer", F.col("ord")).cast("string")).alias("edge_id"),
        F.when(F.col("ord") % 3 == 0, F.col("node_id")).when(F.col("ord") % 3 == 1, F.lit("order:none")).alias("from_node_id"),
        F.lit(None).cast("array<string>").alias("from_dataset_columns"),
    )
    return relationships.lookup_relationships(cat, requests).select(
        "req_id", "edge_id", "status", "lo", "hi", "ab_multiplicity", "ba_existence", "edge", "multiplicity", "match_existence",
        _joined(F.col("edge_unknown_fields")).alias("edge_unknown_fields"),
    )


@query
def effective_descriptions(spark, folder):
    return relationships.effective_descriptions(_catalog("order", spark, folder)).withColumn(
        "dataset_columns", _joined(F.col("dataset_columns"))
    )


@query
def stated_claims(spark, folder):
    rows = relationships.stated_claims(_catalog("supply", spark, folder))
    return rows.withColumn("descriptions", _joined(F.col("descriptions"))).withColumn("unknown_fields", _joined(F.col("unknown_fields")))


@query
def entity_relationship_pages(spark, folder):
    """The first 50 parts of every supplier, with the supplier's total."""
    cat = _catalog("supply", spark, folder)
    requests = read_table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("req_id"), F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("identity_id")
    )
    return relationships.entity_relationships(cat, requests, 0, 50, with_ids=False).select(
        "req_id", "status", "total", "rank", "other_id", "name", "multiplicity", "match_existence"
    )


# -- discovery -----------------------------------------------------------------------------------


@query
def entity_counts(spark, folder):
    cat = _catalog("order", spark, folder)
    return discovery.entity_counts(cat, _part_requests(spark, folder), threshold=25)


@query
def entity_histogram(spark, folder):
    cat = _catalog("order", spark, folder)
    return discovery.entity_histogram(cat, _part_requests(spark, folder))


@query
def entity_counts_with_targets(spark, folder):
    cat = _catalog("event", spark, folder)
    return discovery.entity_counts(cat, cut(_type_requests(spark, folder)))


@query
def entity_definition_page(spark, folder):
    cat = _catalog("event", spark, folder)
    return discovery.entity_definition_page(cat, cut(_type_requests(spark, folder)), 5, 30).withColumn(
        "dataset_columns", _joined(F.col("dataset_columns"))
    )


@query
def fan_out(spark, folder):
    cat = _catalog("order", spark, folder)
    return discovery.fan_out(cat, cut(_customer_requests(spark, folder)), threshold=100)


def _filtered_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Each customer's largest order with the part of its first line; every fourth names an order, a part or a target that is not there."""
    line = read_table(spark, folder, "lineitem").groupBy(F.concat(F.lit("order:"), F.col("l_orderkey").cast("string")).alias("node_id")).agg(F.min("l_partkey").alias("p"))
    kind = F.col("req_id") % 4
    return cut(_customer_requests(spark, folder).join(line, "node_id", "left").select(
        "req_id", F.when(kind == 0, "order:none").otherwise(F.col("node_id")).alias("node_id"),
        F.when(kind == 1, "part:none").otherwise(F.concat(F.lit("part:"), F.col("p").cast("string"))).alias("identity_id"),
        F.when(kind == 2, F.array(F.lit("part:none"))).alias("targets")))


@query
def edge_sources(spark, folder):
    """The definitions of one entity that the edges of each customer's largest order leave from."""
    cat = _catalog("order", spark, folder)
    return discovery.edge_sources(cat, _filtered_requests(spark, folder)).select("req_id", "s_ord", "s_node_id", "s_identity_id")


@query
def edge_statuses(spark, folder):
    """Whether each of these requests names what exists."""
    cat = _catalog("order", spark, folder)
    requests = _filtered_requests(spark, folder)
    return discovery.edge_request_status(cat, requests, discovery.edge_sources(cat, requests))


@query
def edge_histogram(spark, folder):
    cat = _catalog("order", spark, folder)
    return discovery.edge_histogram(cat, _nation_seeds(spark, folder))


@query
def edge_page(spark, folder):
    cat = _catalog("order", spark, folder)
    page = discovery.edge_page(cat, _customer_requests(spark, folder), 10, 10)
    rows = relationships.with_claims(page, "s_", "t_")
    return rows.select("req_id", "s_ord", "t_ord", "rank", "edge_count", "more", "truncated", "multiplicity", "match_existence")


@query
def edge_page_with_targets(spark, folder):
    cat = _catalog("event", spark, folder)
    kinds = read_table(spark, folder, "events").groupBy("user_id").agg(F.min("event_type").alias("t"))
    requests = cut(kinds.select(
        F.col("user_id").alias("req_id"), F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("node_id"),
        F.array(F.concat(F.lit("type:"), F.col("t"))).alias("targets"),
    ))
    return discovery.edge_page(cat, requests, 2, 5).select("req_id", "s_ord", "t_ord", "rank", "edge_count", "more", "truncated")


# Pages deep in a hub; blocks of 1,000 rows, so that several hold the ranks before the page.
HUB_BLOCK, DEEP = 1_000, 1_100


@query
def deep_entity_page(spark, folder):
    """Every status: its orders of partly known universe from rank 1,100 on."""
    cat = _catalog("status", spark, folder)
    statuses = read_table(spark, folder, "orders").select("o_orderstatus").distinct()
    requests = statuses.select(
        F.col("o_orderstatus").alias("req_id"), F.concat(F.lit("status:"), F.col("o_orderstatus")).alias("identity_id"),
        F.array(F.lit("partial")).alias("universes"))
    return discovery.entity_definition_page(cat, cut(requests), DEEP, 300).select("req_id", "dataset_rank", "node_id", "ord", "dataset_count", "truncated", "more")


@query
def deep_edge_page(spark, folder):
    """The first order of each status and priority: edges to orders of that priority, from rank 1,100 on."""
    cat = _catalog("status", spark, folder)
    first = read_table(spark, folder, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.min("o_orderkey").alias("k"))
    requests = cut(first.select(
        F.col("k").alias("req_id"), F.concat(F.lit("order:"), F.col("k").cast("string")).alias("node_id"),
        F.array(F.concat(F.lit("priority:"), F.col("o_orderpriority"))).alias("targets")))
    return discovery.edge_page(cat, requests, DEEP, 50).select("req_id", "s_ord", "t_ord", "rank", "edge_count", "more", "truncated")


@query
def deep_relationship_page(spark, folder):
    """The customers of every status from rank 1,100 on."""
    cat = _catalog("status", spark, folder)
    statuses = read_table(spark, folder, "orders").select("o_orderstatus").distinct()
    requests = cut(statuses.select(F.col("o_orderstatus").alias("req_id"), F.concat(F.lit("status:"), F.col("o_orderstatus")).alias("identity_id")))
    return relationships.entity_relationships(cat, requests, DEEP, 400).select("req_id", "status", "total", "rank", "other_id", "name", "id")


@query
def edge_groups(spark, folder):
    """Grouped listings of the nations' largest orders, flattened to one row per group."""
    cat = _catalog("order", spark, folder)
    page = relationships.describe_edges(cat, discovery.edge_page(cat, _nation_seeds(spark, folder), 0, 12))
    return projection.edge_groups(page).select("req_id", "node_id", "identity_id", F.explode("entity_definitions").alias("d")).select(
        "req_id", "node_id", "identity_id", "d.id", "d.edge_count", "d.truncated", _joined(F.col("d.edges.edge")).alias("edges"),
        _joined(F.transform("d.edges", lambda e: F.coalesce(e["from_description"], F.lit("-")))).alias("texts"),
    )


@query
def dataset_records(spark, folder):
    cat = _catalog("order", spark, folder)
    rows = projection.dataset_records(cat, detail="standard")
    return rows.select(
        "node_id", "qualified_name", "edge_count", F.col("accessor.kind").alias("kind"), F.col("accessor.labels")["status"].alias("label"),
        F.col("descriptor.description").alias("description"), _joined(F.col("unknown_fields")).alias("unknown_fields"), "status",
    )


# -- traversal -----------------------------------------------------------------------------------


@query
def neighbourhood(spark, folder):
    cat = _catalog("order", spark, folder)
    return traversal.expand(cat, _nation_seeds(spark, folder), 2, 1000).select("req_id", "node_id", "distance", "rank", "reached", "status")


@query
def customer_neighbourhood(spark, folder):
    """The 20 nearest orders within two steps of each customer's largest one, and how many there are."""
    cat = _catalog("order", spark, folder)
    return traversal.expand(cat, _customer_requests(spark, folder), 2, 20).select("req_id", "node_id", "distance", "rank", "reached", "status")


@query
def neighbourhood_edges(spark, folder):
    cat = _catalog("order", spark, folder)
    kept = cut(traversal.expand(cat, _nation_seeds(spark, folder), 2, 60))
    return traversal.expansion_edges(cat, kept, 2, 3).select("req_id", "s_ord", "t_ord", "rank", "edge_count", "listed")


@query
def shortest_paths(spark, folder):
    cat = _catalog("order", spark, folder)
    return paths.k_paths(cat, _region_pairs(spark, folder), 6, 3).withColumn(
        "edges", F.array_join(F.transform("edges", lambda e: F.concat_ws(":", e["lo"], e["hi"], e["start"])), "|")
    )


def _region_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """From each region's largest order to the next region's."""
    best = cut(_largest_orders(spark, folder, "n_regionkey"))
    return best.select(F.col("n_regionkey").alias("req_id"), F.col("node_id").alias("from_node_id")).join(
        best.select((F.col("n_regionkey") - 1).alias("req_id"), F.col("node_id").alias("to_node_id")), "req_id"
    )


@query
def customer_paths(spark, folder):
    """From each customer's largest order to the next customer's, over up to four edges."""
    cat = _catalog("order", spark, folder)
    return paths.k_paths(cat, _customer_pairs(spark, folder), 6, 4).withColumn(
        "edges", F.array_join(F.transform("edges", lambda e: F.concat_ws(":", e["lo"], e["hi"], e["start"])), "|")
    )


def _customer_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """From each customer's largest order to the next customer's."""
    best = cut(_largest_orders(spark, folder, "c_custkey"))
    return best.select(F.col("c_custkey").alias("req_id"), F.col("node_id").alias("from_node_id")).join(
        best.select((F.col("c_custkey") - 1).alias("req_id"), F.col("node_id").alias("to_node_id")), "req_id"
    )


@query
def shortest_paths_by_multiplicity(spark, folder):
    cat = _catalog("order", spark, folder)
    return paths.k_paths(cat, _region_pairs(spark, folder), 4, 3, ["1:1", "many:1", "1:many"]).withColumn(
        "edges", F.array_join(F.transform("edges", lambda e: F.concat_ws(":", e["lo"], e["hi"], e["start"])), "|")
    )


def _brand_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """From each brand's cheapest part to its dearest."""
    part = read_table(spark, folder, "part")
    key = F.struct("p_retailprice", "p_partkey")
    return part.groupBy("p_brand").agg(F.min(key).alias("a"), F.max(key).alias("b")).select(
        F.col("p_brand").alias("req_id"), F.concat(F.lit("part:"), F.col("a.p_partkey").cast("string")).alias("from_identity_id"),
        F.concat(F.lit("part:"), F.col("b.p_partkey").cast("string")).alias("to_identity_id"),
    )


@query
def entity_paths(spark, folder):
    cat = _catalog("supply", spark, folder)
    return paths.entity_paths(cat, _brand_pairs(spark, folder), 3, 3).withColumn("ids", _joined(F.col("ids")))


@query
def part_paths(spark, folder):
    """From each part to the next one, over up to four steps."""
    cat = _catalog("supply", spark, folder)
    part = read_table(spark, folder, "part").select(
        F.col("p_partkey").alias("req_id"), F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("from_identity_id"))
    following = part.select((F.col("req_id") - 1).alias("req_id"), F.col("from_identity_id").alias("to_identity_id"))
    return paths.entity_paths(cat, part.join(following, "req_id"), 3, 4).withColumn("ids", _joined(F.col("ids")))


@query
def entity_path_steps(spark, folder):
    cat = _catalog("supply", spark, folder)
    found = paths.entity_paths(cat, _brand_pairs(spark, folder), 3, 2)
    return paths.entity_path_steps(cat, found).select("req_id", "rank", "step", "from_id", "to_id", "multiplicity", "match_existence")


@query
def connecting_trees(spark, folder):
    """Trees joining the largest orders of each region's nations."""
    cat = _catalog("order", spark, folder)
    best = _largest_orders(spark, folder, "n_regionkey", "n_nationkey")
    nodes, edges = connecting.connecting_tree(cat, best.select(F.col("n_regionkey").alias("req_id"), "node_id"))
    listed = nodes.select("req_id", F.col("node_id").alias("item"), "status")
    used = edges.select("req_id", F.concat_ws("-", F.concat(F.lit("D"), F.col("lo")), F.concat(F.lit("D"), F.col("hi"))).alias("item"), F.lit("edge").alias("status"))
    return listed.unionByName(used)


@query
def order_components(spark, folder):
    """Connected orders of a customer, neighbours in key order with one status being linked."""
    orders = read_table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    own = W.partitionBy("o_custkey").orderBy("o_orderkey")
    linked = orders.withColumn("before", F.lag("o_orderkey").over(own)).withColumn("same", F.lag("o_orderstatus").over(own) == F.col("o_orderstatus"))
    nodes = orders.select(F.col("o_custkey").alias("group_id"), F.col("o_orderkey").alias("node"))
    edges = linked.where("same").select(F.col("o_custkey").alias("group_id"), F.col("before").alias("left"), F.col("o_orderkey").alias("right"))
    return traversal.components(nodes, edges)


# -- integrity -----------------------------------------------------------------------------------


def _faulty_catalog(spark: SparkSession, folder: str) -> Catalog:
    """The order catalog with faults that follow from the data."""
    cat = _catalog("order", spark, folder)
    key = F.regexp_extract("node_id", r"(\d+)$", 1).cast("bigint")
    part = F.regexp_extract("identity_id", r"(\d+)$", 1).cast("bigint")
    return Catalog(
        spark,
        datasets=cat.datasets.unionByName(cat.datasets.where(key % 50 == 1)),
        columns=cat.columns.where(~((F.col("name") == "line_7") & (key % 5 == 0))),
        identities=cat.identities.where(part % 10 != 3).withColumn("name", F.when(part % 100 == 7, "").otherwise(F.col("name"))),
        definitions=cat.definitions.withColumn("conforms", F.when(part % 20 == 5, F.lit(False)).otherwise(F.col("conforms")))
        .withColumn("entity_universe", F.when(part % 100 == 9, "most").otherwise(F.col("entity_universe"))),
    )


@query
def integrity_findings(spark, folder):
    return integrity.integrity(_faulty_catalog(spark, folder)).select("rule", "node_id", "identity_id")


def _broken_catalog(spark: SparkSession, folder: str) -> Catalog:
    """A dataset per customer and a stated pair per supplier; which rule each breaks depends on its key."""
    key, n = F.col("c_custkey"), F.col("c_nationkey")
    node, nation = F.concat(F.lit("c:"), key.cast("string")), F.concat(F.lit("nation:"), n.cast("string"))
    customer = read_table(spark, folder, "customer").select(key, n, node.alias("node_id"), nation.alias("nation"))
    empty = F.array().cast("array<string>")

    def component(columns: Column, identity: Column | None = None) -> Column:
        identity = F.lit(None).cast("string") if identity is None else identity
        part = F.struct(columns.cast("array<string>").alias("dataset_columns"), identity.alias("identity_id"), F.lit("").alias("description"))
        return F.struct(F.array(part).alias("components"), F.lit("").alias("description"))

    grain = F.when(key % 13 == 0, component(F.array(F.lit("gone")))).when(
        key % 13 == 1, component(F.array(F.lit("id")), F.lit("nation:x"))).when(key % 13 == 2, component(empty))
    name = F.concat(F.lit("q"), key.cast("string"))
    datasets = customer.select(
        "node_id", F.lit(0).alias("pos"), F.struct(
            F.when(key % 17 == 0, "").otherwise(name).alias("qualified_name"), name.alias("display_name"), F.lit("").alias("description"),
            empty.alias("synonyms"), empty.alias("tags")).alias("descriptor"),
        F.struct(F.lit("table").alias("kind"), F.when(key % 11 == 0, "shared").otherwise(name).alias("endpoint"),
                 F.create_map().cast("map<string,string>").alias("labels"), F.lit(None).cast("string").alias("properties")).alias("accessor"),
        grain.alias("grain"))

    def listed(twice: Column) -> Column:
        return F.explode(F.sequence(F.lit(1), F.when(twice, 2).otherwise(1))).alias("time")

    columns = customer.select("node_id", F.lit("id").alias("name"), listed(key % 7 == 0))
    used = F.when(key % 5 == 0, F.array(F.lit("id"), F.lit("id"))).when(key % 5 == 1, F.array(F.lit("b"), F.lit("a"))).otherwise(F.array(F.lit("id")))
    definitions = customer.select(
        "node_id", F.col("nation").alias("identity_id"), used.alias("dataset_columns"),
        F.when(key % 19 == 0, "most").otherwise("complete").alias("entity_universe"), F.when(key % 23 == 0, F.lit(False)).alias("conforms"),
        F.when(key % 29 == 0, F.array(F.lit(" "))).alias("entity_expression"), listed(key % 5 == 2))
    m = F.col("n_nationkey")
    identities = read_table(spark, folder, "nation").where(m % 6 != 0).select(
        F.concat(F.lit("nation:"), m.cast("string")).alias("identity_id"), F.when(m % 5 != 0, F.col("n_name")).alias("name"), listed(m % 4 == 1))
    s = F.col("s_suppkey")
    one = F.array(F.lit("x"))
    stated = read_table(spark, folder, "supplier").select(
        F.concat(F.lit("nation:"), F.col("s_nationkey").cast("string")).alias("left_id"),
        F.when(s % 31 == 0, " ").otherwise(F.concat(F.lit("nation:"), (s % 25).cast("string"))).alias("right_id"),
        F.when(s % 4 == 0, "few").otherwise("1:1").alias("multiplicity"), F.lit("always").alias("me_left"), F.when(s % 9 != 0, "optional").alias("me_right"),
        F.when(s % 3 == 0, empty).when(s % 3 == 1, F.array(F.lit(" "))).when(s % 8 == 2, F.array(F.lit("x"), F.lit("x"))).otherwise(one).alias("descriptions"))
    annotations = customer.where(key % 50 == 0).select(F.concat(F.lit("E"), key.cast("string")).alias("edge_id"), listed(key % 100 == 0))
    return Catalog(spark, datasets=datasets, columns=columns, definitions=definitions, identities=identities, entity_relationships=stated, annotations=annotations)


@query
def integrity_rules(spark, folder):
    """Findings of every rule, with their messages."""
    return integrity.integrity(_broken_catalog(spark, folder))


@query
def unknown_claims(spark, folder):
    return integrity.unknown_claims(_catalog("order", spark, folder)).select("object_kind", "claim", "location")


@query
def accessor_warnings(spark, folder):
    return integrity.accessor_warnings(_catalog("order", spark, folder), 87)


@query
def catalog_counts(spark, folder):
    return _catalog("order", spark, folder).counts()


@query
def catalog_fingerprint(spark, folder):
    return _catalog("order", spark, folder).fingerprint()


@query
def fingerprint_changes(spark, folder):
    """Which table's fingerprint a new layout changes (none), and which one changed row (that of the definitions)."""
    cat = _catalog("order", spark, folder)
    # Seven parts at least, and as many as the session has for a shuffle: no task's share grows with a fixed number.
    parts = max(7, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = {"identities": ["identity_id"], "datasets": ["node_id"], "columns": ["node_id", "name"], "definitions": ["node_id", "identity_id", "dataset_columns"]}
    dealt = Catalog(spark, **{name: getattr(cat, name).repartition(parts, *key) for name, key in keys.items()})
    first = F.col("node_id") == cat.definitions.agg(F.min("node_id")).first()[0]
    rows = cat.fingerprint({"definitions": (first, {"entity_universe": F.lit("other")})})
    again = dealt.fingerprint().select("table_name", F.col("fingerprint").alias("_f"))
    return rows.join(again, "table_name").select(
        "table_name", (F.col("_f") != F.col("fingerprint")).alias("layout_changes"),
        (F.col("changed_fingerprint") != F.col("fingerprint")).alias("row_changes"))


# -- text and search -----------------------------------------------------------------------------


@query
def normalized_documents(spark, folder):
    docs = read_table(spark, folder, "documents")
    return docs.select("doc_id", text.normalize_term(F.col("text")).alias("n")).select("doc_id", F.md5("n").alias("digest"), F.char_length("n").cast("bigint").alias("length"))


@query
def term_frequencies(spark, folder):
    """In how many documents each term occurs, the whole text counting as a term too."""
    docs = read_table(spark, folder, "documents").select("doc_id", text.normalize_term(F.col("text")).alias("n"))
    terms = docs.select("doc_id", F.explode(text.index_terms(F.col("n"))).alias("term"))
    return terms.groupBy(F.md5("term").alias("term")).agg(F.count("*").alias("document_count"))


@query
def search_corpus(spark, folder):
    cat = _catalog("library", spark, folder)
    return search.corpus(cat).select("kind", "key", "field", "value_idx", F.md5("normalized").alias("digest"))


def _search_queries(spark: SparkSession, folder: str) -> DataFrame:
    """Every part name, the names backwards, nations with their suppliers' common word, line numbers, and prefixes."""
    part = read_table(spark, folder, "part").select(F.col("p_name").alias("query")).distinct()
    backwards = part.select(F.array_join(F.reverse(F.split("query", " ")), " ").alias("query"))
    nation = read_table(spark, folder, "nation")
    both = nation.select(F.concat(F.col("n_name"), F.lit(" supplier")).alias("query"))
    swapped = nation.select(F.concat(F.lit("supplier "), F.col("n_name")).alias("query"))
    starts = part.select(F.left("query", F.lit(3)).alias("query")).distinct()
    number = read_table(spark, folder, "lineitem").select(F.col("l_linenumber").cast("string").alias("n"), F.col("l_returnflag").alias("f")).distinct()
    lines = number.select(F.explode(F.array(
        F.concat(F.lit("line_"), "n"), F.concat(F.lit("itemNo"), "n"), F.concat(F.lit("Lower(line_"), "n", F.lit(")")), F.concat(F.lit("sold together by "), "n"),
        F.concat(F.lit("worst "), "f"), F.col("f"), F.lit("accepted"), F.lit("finished"), F.lit("--"), F.lit(""),
    )).alias("query"))
    every = part.unionByName(backwards).unionByName(both).unionByName(swapped).unionByName(starts).unionByName(lines).distinct()
    return every.select(F.col("query").alias("query_id"), "query")


@query
def lexical_search(spark, folder):
    cat = _catalog("library", spark, folder)
    return search.search(cat, cut(_search_queries(spark, folder)), 5).withColumn(
        "matched_value", F.md5("matched_value")
    ).withColumn("matched_term", F.md5("matched_term"))


@query
def search_subjects(spark, folder):
    """What a search shows of every definition."""
    rows = search.subject_rows(_catalog("library", spark, folder), "entity_definition")
    return rows.withColumns({"dataset_columns": _joined(F.col("dataset_columns")), "unknown_fields": _joined(F.col("unknown_fields"))})


# -- documents -----------------------------------------------------------------------------------


def _order_documents(spark: SparkSession, folder: str, cat: Catalog) -> DataFrame:
    """One document per order: its definitions and the next peer of each, with faults from the data."""
    members = cat.members
    nxt = members.select(
        F.col("identity_id").alias("_e"), (F.col("pos") - 1).alias("_p"), F.col("ord").alias("t_ord"), F.col("node_id").alias("t_node"),
        F.col("dataset_columns").alias("t_columns"), *(F.col(c).alias(f"t_{c}") for c in ("entity_universe", "unique", "total", "conforms")),
    )
    own = members.select("identity_id", "pos", *(F.col(c).alias(f"s_{c}") for c in (
        "ord", "node_id", "dataset_columns", "entity_universe", "unique", "total", "conforms")))
    pairs = relationships.with_claims(own.join(nxt, (F.col("identity_id") == F.col("_e")) & (F.col("pos") == F.col("_p"))), "s_", "t_")
    label = F.concat(F.col("s_node_id"), F.lit("["), F.col("s_dataset_columns")[0], F.lit("] -> "), F.col("t_node"), F.lit("["), F.col("t_columns")[0], F.lit("]"))
    edge_id = F.concat(F.lit("D"), F.col("s_ord").cast("string"), F.lit("-D"), F.col("t_ord").cast("string"))
    # The edge key is reversed when the ordinals differ by a multiple of seven.
    broken = (F.col("t_ord") - F.col("s_ord")) % 7 == 0
    key = F.when(broken, F.concat(F.lit("D"), F.col("t_ord").cast("string"), F.lit("-D"), F.col("s_ord").cast("string"))).otherwise(edge_id)
    edge = F.array(label, F.col("multiplicity"), F.col("match_existence"), key)
    group = F.struct(
        F.col("identity_id"), F.array(F.struct(
            F.concat(F.lit("D"), F.col("s_ord").cast("string")).alias("id"), F.col("s_dataset_columns").alias("dataset_columns"), F.array(edge).alias("edges")
        )).alias("entity_definitions"),
    )
    groups = pairs.groupBy(F.col("s_node_id").alias("node_id")).agg(F.array_sort(F.collect_list(group)).alias("edge_groups"))
    order = cat.datasets.join(groups, "node_id", "left")
    number = F.regexp_extract("node_id", r"(\d+)$", 1).cast("bigint")
    accessor = F.struct("accessor.kind", "accessor.endpoint")
    dataset = F.struct(
        "node_id", F.when(number % 6 != 0, F.col("descriptor.qualified_name")).alias("qualified_name"), accessor.alias("accessor"),
        F.struct(F.col("descriptor.display_name").alias("display_name"), F.when(number % 4 == 0, "other").otherwise(F.col("descriptor.description")).alias("description")).alias("descriptor"),
        F.coalesce("edge_groups", F.array().cast(groups.schema["edge_groups"].dataType)).alias("edge_groups"),
        F.when(number % 9 == 0, F.lit(1)).alias("rows"),
    )
    payload = F.struct(
        F.lit("draft").alias("status"), F.concat(F.lit("What does "), F.col("node_id"), F.lit(" share?")).alias("question"),
        F.array(*map(F.lit, ("edge", "multiplicity", "match_existence", "edge_id"))).alias("edge_fields"), F.array(dataset).alias("datasets"),
    )
    return order.select(number.alias("doc_id"), F.to_json(payload).alias("payload"))


@query
def document_findings(spark, folder):
    cat = _catalog("order", spark, folder)
    found = documents.check_documents(stored(_order_documents(spark, folder, cat)))
    return found.select("doc_id", "location", "rule", "severity")


@query
def document_differences(spark, folder):
    cat = _catalog("order", spark, folder)
    found = documents.resolve_documents(stored(_order_documents(spark, folder, cat)), cat)
    return found.select("doc_id", "location", "rule", "severity")


@query
def document_sentences(spark, folder):
    cat = _catalog("order", spark, folder)
    docs = stored(_order_documents(spark, folder, cat))
    rows = documents.edge_sentences(docs)
    return rows.select("doc_id", "edge_id", "forward")


# -- measured claims -----------------------------------------------------------------------------

_KEYS = (
    ("lineitem", ["l_orderkey", "l_linenumber"]), ("lineitem", ["l_orderkey", "l_partkey"]), ("orders", ["o_orderkey"]),
    ("orders", ["o_custkey"]), ("part", ["p_name"]), ("events", ["user_id", "event_type"]), ("conversations", ["conv_id", "turn"]),
)
_POPULATIONS = (
    ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"), ("labels", "doc_id", "documents", "doc_id"),
)


@query
def measured_keys(spark, folder):
    result = None
    for table, keys in _KEYS:
        row = measure.measure_key(read_table(spark, folder, table), keys).withColumn("key", F.lit(f"{table}:{','.join(keys)}"))
        result = row if result is None else result.unionByName(row)
    return result


@query
def measured_containment(spark, folder):
    result = None
    for table, key, other, other_key in _POPULATIONS:
        row = measure.measure_containment(
            read_table(spark, folder, table), [key], read_table(spark, folder, other), [other_key]
        ).withColumn("key", F.lit(f"{table}:{key}"))
        result = row if result is None else result.unionByName(row)
    return result


def _all_definitions() -> list[measure.Measured]:
    return [measure.Measured(t, tuple(c.split(",")), e) for t, c, e in oracles.MEASURED]


@query
def measured_definitions(spark, folder):
    """Every definition of every table: records, keys, repeats and gaps."""
    tables = {d.table: read_table(spark, folder, d.table) for d in _all_definitions()}
    return measure.measure_catalog(tables, _all_definitions())[0]


@query
def measured_pairs(spark, folder):
    """Every two definitions of one entity: shared keys, keys of one side, and whether both can be complete."""
    tables = {d.table: read_table(spark, folder, d.table) for d in _all_definitions()}
    return measure.measure_catalog(tables, _all_definitions())[1]
