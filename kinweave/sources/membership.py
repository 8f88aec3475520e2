"""Catalogs over ordinary tables: any table saying what holds what is a membership table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinweave.catalog import DEFAULT_BLOCK_ROWS, Catalog
from kinweave.plans.lineage import dealt

LINES = 250_000  # order lines that one task folds


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _id(prefix: str, key: str):
    return F.concat(F.lit(prefix + ":"), F.col(key).cast("string"))


def order_definitions(spark: SparkSession, folder: str) -> DataFrame:
    """Orders hold parts through their lines; claims follow from the line's flags and supplier."""
    key = ["l_orderkey", "l_partkey", "l_linenumber"]  # hardly ever repeated: lines are dealt before they are folded, and sorted once
    line = dealt(read_table(spark, folder, "lineitem"), LINES, *key).groupBy(*key).agg(
        F.min("l_suppkey").alias("supp"), F.max("l_returnflag").alias("flag"),
        F.min("l_linestatus").alias("status"), F.max("l_quantity").alias("quantity"),
    )
    column = F.concat(F.lit("line_"), F.col("l_linenumber").cast("string"))
    complete = F.col("supp") % 3 == 0
    return line.select(
        _id("order", "l_orderkey").alias("node_id"), _id("part", "l_partkey").alias("identity_id"),
        F.array(column).alias("dataset_columns"),
        F.when(complete, "complete").when(F.col("supp") % 3 == 1, "partial").otherwise("unknown").alias("entity_universe"),
        F.when(F.col("flag") == "A", True).when(F.col("flag") == "R", False).alias("unique"),
        F.when(F.col("status") == "F", True).when(F.col("supp") % 5 != 0, False).alias("total"),
        F.when(complete, True).when(F.col("supp") % 4 == 0, False).when(F.col("supp") % 4 != 1, True).alias("conforms"),
        F.when(
            F.col("quantity") > 25, F.array(F.concat(F.lit("["), column, F.lit("]")))
        ).when(F.col("quantity") > 10, F.array(F.concat(F.lit("upper("), column, F.lit(")"))))
        .otherwise(F.array().cast("array<string>")).alias("entity_expression"),
        F.when(F.col("quantity") > 45, "bulk line").otherwise("").alias("description"),
    )


def order_catalog(spark: SparkSession, folder: str, block_rows: int = DEFAULT_BLOCK_ROWS) -> Catalog:
    """Datasets are orders, entities are parts, columns are order lines."""
    orders, part = read_table(spark, folder, "orders"), read_table(spark, folder, "part")
    line = read_table(spark, folder, "lineitem")
    key = F.col("o_orderkey").cast("string")
    has_lines = F.col("o_orderstatus") != "P"
    datasets = orders.select(
        _id("order", "o_orderkey").alias("node_id"),
        F.struct(
            F.concat(F.lit("sales.orders."), key).alias("qualified_name"),
            F.concat(F.lit("order "), key).alias("display_name"),
            F.col("o_orderpriority").alias("description"),
            F.array().cast("array<string>").alias("synonyms"), F.array("o_orderstatus").alias("tags"),
        ).alias("descriptor"),
        F.struct(
            F.lit("table").alias("kind"), F.lit("orders").alias("endpoint"),
            F.create_map(F.lit("status"), F.col("o_orderstatus")).alias("labels"),
            F.concat(F.lit('{"key":"'), key, F.lit('"}')).alias("properties"),
        ).alias("accessor"),
        F.when(has_lines, F.struct(
            F.array(F.struct(
                F.array(F.lit("line_1")).alias("dataset_columns"),
                F.lit(None).cast("string").alias("identity_id"), F.lit("").alias("description"),
            )).alias("components"),
            F.lit("").alias("description"),
        )).alias("grain"),
    )
    columns = line.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("flag")).select(
        _id("order", "l_orderkey").alias("node_id"),
        F.concat(F.lit("line_"), F.col("l_linenumber").cast("string")).alias("name"),
        F.when(F.col("flag") == "N", "").otherwise(F.concat(F.lit("line with flag "), F.col("flag"))).alias("description"),
    )
    identities = part.select(
        _id("part", "p_partkey").alias("identity_id"), F.col("p_name").alias("name"),
        F.col("p_type").alias("description"), F.array("p_brand").alias("synonyms"),
    )
    return Catalog(
        spark, block_rows=block_rows, definitions=order_definitions(spark, folder),
        datasets=datasets, columns=columns, identities=identities,
    )


def event_catalog(spark: SparkSession, folder: str, block_rows: int = DEFAULT_BLOCK_ROWS) -> Catalog:
    """Datasets are users, entities are event types: a few hubs that everything belongs to."""
    seen = read_table(spark, folder, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    definitions = seen.select(
        _id("user", "user_id").alias("node_id"), _id("type", "event_type").alias("identity_id"),
        F.array("event_type").alias("dataset_columns"),
        F.when(F.col("n") % 3 == 0, "complete").when(F.col("n") % 3 == 1, "partial").otherwise("unknown").alias("entity_universe"),
        F.when(F.col("n") % 4 == 0, True).when(F.col("n") % 4 != 1, False).alias("unique"),
        F.when(F.col("n") % 5 < 3, True).when(F.col("n") % 5 == 3, False).alias("total"),
        F.when(F.col("n") % 3 == 0, True).when(F.col("n") % 2 == 0, True).alias("conforms"),
    )
    names = seen.select("event_type").distinct().select(
        _id("type", "event_type").alias("identity_id"), F.col("event_type").alias("name")
    )
    return Catalog(spark, block_rows=block_rows, definitions=definitions, identities=names)


def supply_catalog(spark: SparkSession, folder: str, block_rows: int = DEFAULT_BLOCK_ROWS) -> Catalog:
    """Entities are parts and suppliers; every pair seen on a line is a stated relationship."""
    line = read_table(spark, folder, "lineitem")
    pairs = line.groupBy("l_partkey", "l_suppkey").agg(
        F.count_distinct("l_orderkey").alias("orders"), F.max("l_returnflag").alias("flag"),
        F.min("l_linestatus").alias("status"),
    )
    stated = pairs.select(
        _id("part", "l_partkey").alias("left_id"), _id("supplier", "l_suppkey").alias("right_id"),
        F.when(F.col("orders") == 1, "1:many").when(F.col("flag") == "R", "many:many")
        .when(F.col("flag") == "A", "many:1").otherwise("unknown").alias("multiplicity"),
        F.when(F.col("status") == "F", "always").otherwise("optional").alias("me_left"),
        F.when(F.col("flag") == "A", "unknown").otherwise("optional").alias("me_right"),
        F.array(F.concat(F.lit("ordered "), F.col("orders").cast("string"), F.lit(" times"))).alias("descriptions"),
    )
    identities = read_table(spark, folder, "part").select(
        _id("part", "p_partkey").alias("identity_id"), F.col("p_name").alias("name")
    ).unionByName(read_table(spark, folder, "supplier").select(
        _id("supplier", "s_suppkey").alias("identity_id"), F.col("s_name").alias("name")
    ))
    return Catalog(spark, block_rows=block_rows, identities=identities, entity_relationships=stated)


def status_catalog(spark: SparkSession, folder: str, block_rows: int = DEFAULT_BLOCK_ROWS) -> Catalog:
    """Datasets are orders, which hold their status and their priority: a few hubs. Customers relate to the statuses of their orders."""
    orders = read_table(spark, folder, "orders")
    held = orders.select(_id("order", "o_orderkey").alias("node_id"), F.col("o_orderkey").alias("key"), F.explode(F.array(
        F.struct(_id("status", "o_orderstatus").alias("identity_id"), F.lit("status").alias("column")),
        F.struct(_id("priority", "o_orderpriority").alias("identity_id"), F.lit("priority").alias("column")),
    )).alias("h"))
    definitions = held.select(
        "node_id", "h.identity_id", F.array("h.column").alias("dataset_columns"),
        F.when(F.col("key") % 3 == 0, "complete").otherwise("partial").alias("entity_universe"),
    )
    stated = orders.select(_id("customer", "o_custkey").alias("left_id"), _id("status", "o_orderstatus").alias("right_id")).distinct()
    names = definitions.select("identity_id").distinct().select("identity_id", F.col("identity_id").alias("name"))
    customers = read_table(spark, folder, "customer").select(_id("customer", "c_custkey").alias("identity_id"), F.col("c_name").alias("name"))
    return Catalog(
        spark, block_rows=block_rows, definitions=definitions, identities=names.unionByName(customers), entity_relationships=stated,
    )


def library_catalog(spark: SparkSession, folder: str, block_rows: int = DEFAULT_BLOCK_ROWS) -> Catalog:
    """A catalog to search: documents and parts are entities, suppliers are datasets.

    A supplier's line numbers are its columns, each of which realises its smallest part; parts that a
    supplier sells on its first two line numbers are related.
    """
    documents = read_table(spark, folder, "documents").select(
        _id("doc", "doc_id").alias("identity_id"),
        F.concat(F.col("lang"), F.lit(" "), F.col("source")).alias("name"),
        F.col("text").alias("description"), F.array("lang", "source").alias("synonyms"),
    )
    part = read_table(spark, folder, "part").select(
        _id("part", "p_partkey").alias("identity_id"), F.col("p_name").alias("name"),
        F.col("p_type").alias("description"), F.array("p_brand").alias("synonyms"),
    )
    nation = read_table(spark, folder, "nation")
    supplier = read_table(spark, folder, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    datasets = supplier.select(
        _id("supplier", "s_suppkey").alias("node_id"),
        F.struct(
            F.concat_ws(".", "n_name", "s_name").alias("qualified_name"), F.col("s_name").alias("display_name"),
            F.when(F.col("s_acctbal") < 0, "N/A").otherwise("active supplier").alias("description"),
            F.array("n_name").alias("synonyms"), F.array().cast("array<string>").alias("tags"),
        ).alias("descriptor"),
        F.struct(
            F.lit("table").alias("kind"), F.lit("supplier").alias("endpoint"),
            F.create_map().cast("map<string,string>").alias("labels"),
            F.lit(None).cast("string").alias("properties"),
        ).alias("accessor"),
    )
    line = read_table(spark, folder, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(
        F.min("l_partkey").alias("part"), F.max("l_returnflag").alias("flag"), F.min("l_linestatus").alias("status"), F.count("*").alias("n"),
    )
    node, number = _id("supplier", "l_suppkey").alias("node_id"), F.col("l_linenumber").cast("string")
    name = F.concat(F.lit("line_"), number)
    columns = line.select(
        node, name.alias("name"),
        F.when(F.col("flag") == "N", "TBD").when(F.col("flag") == "A", "accepted line").otherwise("returned line").alias("description"),
        F.when(F.col("status") == "F", F.concat(F.lit("finished "), F.col("n").cast("string"))).otherwise("").alias("value_description"),
        F.array(F.concat(F.lit("itemNo"), number)).alias("synonyms"),
    )
    metadata = F.concat(F.lit('{"flag":{"worst":"'), F.col("flag"), F.lit('","seen":["lineFlag","'), F.col("status"), F.lit('"]},"rows":'), F.col("n").cast("string"), F.lit("}"))
    definitions = line.select(
        node, _id("part", "part").alias("identity_id"), F.array(name).alias("dataset_columns"), F.lit("unknown").alias("entity_universe"),
        F.when(F.col("flag") == "R", F.array(F.concat(F.lit("lower("), name, F.lit(")")))).otherwise(F.array().cast("array<string>")).alias("entity_expression"),
        F.when(F.col("status") == "F", metadata).alias("entity_metadata"),
    )
    pairs = line.where("l_linenumber = 1").select("l_suppkey", _id("part", "part").alias("left_id")).join(
        line.where("l_linenumber = 2").select("l_suppkey", _id("part", "part").alias("right_id")), "l_suppkey").where("left_id <> right_id")
    stated = pairs.groupBy("left_id", "right_id").agg(
        F.array(F.concat(F.lit("sold together by "), F.count("*").cast("string")), F.lit("unknown")).alias("descriptions"))
    return Catalog(
        spark, block_rows=block_rows, datasets=datasets, identities=documents.unionByName(part),
        columns=columns, definitions=definitions, entity_relationships=stated,
    )
