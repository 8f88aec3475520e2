"""Integrity checks and reports over catalog tables: arrays of faults, one fold of keys, one join per referenced table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from kinweave.catalog import Catalog
from kinweave.functions import claims
from kinweave.functions.canonical import (
    ACCESSOR_SOFT_LIMIT,
    accessor_json,
    canonical_json,
    json_strings_array,
    quoted,
    quoted_list,
)
from kinweave.functions.labels import json_string
from kinweave.operators.relationships import resolve_edges
from kinweave.plans.lineage import stored

_SALTS = 32  # an accessor or identifier shared by very many rows is spread over this many keys
KEY = ["node_id", "identity_id", "dataset_columns"]


FINDING = "rule string, node_id string, identity_id string, message string"


def _finding(rows: DataFrame, rule: str, message: Column, node: str | None = None, entity: str | None = None) -> DataFrame:
    def name(column: str | None) -> Column:
        return F.col(column) if column else F.lit(None).cast("string")
    return rows.select(
        F.lit(rule).alias("rule"), name(node).alias("node_id"), name(entity).alias("identity_id"),
        message.alias("message"),
    )


def _text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _fault(rule: str, wrong: Column, message: Column | str, node: Column | None = None, entity: Column | None = None) -> Column:
    """A finding on a row, or NULL."""
    none = F.lit(None).cast("string")
    message = F.lit(message) if isinstance(message, str) else message
    return F.when(wrong, F.struct(
        F.lit(rule).alias("rule"), (none if node is None else node).alias("node_id"), (none if entity is None else entity).alias("identity_id"),
        message.alias("message")))


def _faults(rows: DataFrame, *lists: Column) -> DataFrame:
    """The findings in arrays of faults: one scan, whatever the number of rules."""
    return rows.select(F.explode(F.array_compact(F.concat(*lists))).alias("f")).select("f.*")


def integrity(cat: Catalog) -> DataFrame:
    """All findings: ``(rule, node_id, identity_id, message)``. A sound catalog gives no rows.

    Rules on single rows are one array of faults per table. Repeated keys of all tables fold in one
    aggregation, and the references to columns, entities and definitions each meet their table once.
    Definitions and columns are stored with what the rules read, as several do. The rules that shuffle store their
    findings one after the other, so that the shuffles of one are gone before the next begins.
    """
    listed = Catalog(
        cat.spark, datasets=cat.datasets, identities=cat.identities, entity_relationships=cat.entity_relationships, annotations=cat.annotations,
        definitions=stored(cat.definitions.select(*KEY, "entity_universe", "conforms", "entity_expression")),
        columns=stored(cat.columns.select("node_id", "name")),
    )
    rows = [rule(listed) for rule in (dataset_faults, column_faults, definition_faults, identity_faults, relationship_faults)]
    keys = [stored(rule(listed)) for rule in (repeated_keys, column_references, identity_references, grain_definitions, duplicate_accessors)]
    return reduce(DataFrame.unionByName, [*rows, *keys, annotation_targets(cat)])


# -- rules on single rows ------------------------------------------------------------------------


def _empty(value: Column) -> Column:
    return F.coalesce(value, F.lit("")) == ""


def _blank(fields: dict[str, Column], node: Column | None, entity: Column | None) -> Column:
    return F.array(*(_fault("blank", wrong, f"{name} must not be blank", node, entity) for name, wrong in fields.items()))


def _list_fault(columns: Column) -> Column:
    return (
        F.when(columns.isNull() | (F.size(columns) == 0), "is empty")
        .when(F.exists(columns, lambda c: c == ""), "contains an empty name")
        .when(F.size(F.array_distinct(columns)) < F.size(columns), "contains duplicates")
        .when(columns != F.array_sort(columns), "is not in ascending order")
    )


def dataset_faults(cat: Catalog) -> DataFrame:
    node, d, a = F.col("node_id"), "descriptor.", "accessor."
    labels = F.coalesce(F.map_keys(F.col(a + "labels")), F.array().cast("array<string>"))
    blanks = _blank({
        "node_id": _empty(node), "qualified_name": _empty(F.col(d + "qualified_name")), "display_name": _empty(F.col(d + "display_name")),
        "accessor.kind": ~claims.has_text(F.col(a + "kind")), "accessor.endpoint": ~claims.has_text(F.col(a + "endpoint")),
        "accessor.labels": F.exists(labels, lambda k: k == ""),
    }, node, None)

    def component(c: Column) -> Column:
        fault = _list_fault(c["dataset_columns"])
        return _fault("column_list", fault.isNotNull(), _text("grain dataset_columns ", fault), node, c["identity_id"])

    parts = F.coalesce(F.transform("grain.components", component), F.array().cast(f"array<struct<{_struct(FINDING)}>>"))
    return _faults(cat.datasets, blanks, parts)


def _struct(fields: str) -> str:
    return ", ".join(f.replace(" ", ": ") for f in fields.split(", "))


def column_faults(cat: Catalog) -> DataFrame:
    return _faults(cat.columns, _blank({"column name": _empty(F.col("name"))}, F.col("node_id"), None))


def definition_faults(cat: Catalog) -> DataFrame:
    node, entity = F.col("node_id"), F.col("identity_id")
    expressions = F.coalesce("entity_expression", F.array().cast("array<string>"))
    fault, universe = _list_fault(F.col("dataset_columns")), F.col("entity_universe")
    return _faults(cat.definitions, F.array(
        _fault("column_list", fault.isNotNull(), _text("entity definition dataset_columns ", fault), node, entity),
        _fault("complete_must_conform", (universe == "complete") & ~F.col("conforms"), "a complete entity definition conforms by definition", node, entity),
        _fault("claim_domain", universe.isNull() | ~universe.isin(*claims.ENTITY_UNIVERSES),
               f"entity_universe must be one of {', '.join(claims.ENTITY_UNIVERSES)}", node, entity),
    ), _blank({
        "identity_id": ~claims.has_text(entity), "entity_expression": F.exists(expressions, lambda e: ~claims.has_text(e)),
    }, node, entity))


def identity_faults(cat: Catalog) -> DataFrame:
    entity = F.col("identity_id")
    return _faults(cat.identities, _blank({"identity_id": ~claims.has_text(entity), "name": _empty(F.col("name"))}, None, entity))


def relationship_faults(cat: Catalog) -> DataFrame:
    """Endpoint order, claim domains, and the description lists of stated pairs."""
    left, right = F.col("left_id"), F.col("right_id")
    ends = quoted_list(F.array("left_id", "right_id"))
    texts = F.coalesce("descriptions", F.array().cast("array<string>"))
    fault = (
        F.when(F.size(texts) == 0, "descriptions must not be empty")
        .when(F.exists(texts, lambda t: ~claims.has_text(t)), "descriptions must not be blank")
        .when(F.size(F.array_distinct(texts)) < F.size(texts), "descriptions must be distinct")
    )
    domains = [
        _fault("claim_domain", F.col(name).isNull() | ~F.col(name).isin(*domain), f"{name} must be one of {', '.join(domain)}", None, left)
        for name, domain in (("multiplicity", claims.MULTIPLICITIES), ("me_left", claims.MATCH_EXISTENCES), ("me_right", claims.MATCH_EXISTENCES))
    ]
    return _faults(cat.entity_relationships, F.array(
        _fault("endpoints", ~claims.has_text(left) | ~claims.has_text(right), _text("endpoints must not be blank: ", ends), None, left),
        _fault("endpoints", left > right, _text("endpoints must be in ascending lexical order: ", ends), None, left),
        _fault("descriptions", fault.isNotNull(), fault, None, left), *domains,
    ))


# -- rules on keys -------------------------------------------------------------------------------


def repeated_keys(cat: Catalog) -> DataFrame:
    """Keys listed more than once, of all tables in one aggregation."""
    def keys(table: DataFrame, rule: str, *parts: Column) -> DataFrame:
        return table.select(F.lit(rule).alias("rule"), F.concat(*parts).alias("key"))

    own = lambda *names: F.array(*names)
    rows = reduce(DataFrame.unionByName, [
        keys(cat.datasets, "duplicate_node", own("node_id")), keys(cat.identities, "duplicate_identity", own("identity_id")),
        keys(cat.columns, "duplicate_column", own("node_id", "name")),
        keys(cat.definitions, "duplicate_definition", own("node_id", "identity_id"), F.coalesce("dataset_columns", F.array().cast("array<string>"))),
        keys(cat.entity_relationships, "duplicate_pair", own("left_id", "right_id")), keys(cat.annotations, "duplicate_annotation", own("edge_id")),
    ])
    found = rows.groupBy("rule", "key").agg(F.count("*").alias("n")).where("n > 1")
    rule, at = F.col("rule"), lambda i: F.get("key", F.lit(i))
    message = (
        F.when(rule == "duplicate_node", "node_id values must be unique").when(rule == "duplicate_identity", "identity_id values must be unique")
        .when(rule == "duplicate_column", _text("column ", quoted(at(1)), " is listed more than once"))
        .when(rule == "duplicate_definition", _text(
            "entity definition on ", quoted_list(F.slice("key", 3, F.greatest(F.size("key") - 2, F.lit(0)))), " is listed more than once"))
        .when(rule == "duplicate_pair", _text("cross-entity relationship ", quoted_list(F.col("key")), " is listed more than once"))
        .otherwise(_text("annotation edge_id ", at(0), " is listed more than once"))
    )
    entity = F.when(rule.isin("duplicate_identity", "duplicate_pair"), at(0)).when(rule == "duplicate_definition", at(1))
    node = F.when(rule.isin("duplicate_node", "duplicate_column", "duplicate_definition"), at(0))
    return found.select("rule", node.alias("node_id"), entity.alias("identity_id"), message.alias("message"))


def duplicate_definitions(cat: Catalog) -> DataFrame:
    return repeated_keys(cat).where("rule = 'duplicate_definition'")


def duplicate_accessors(cat: Catalog) -> DataFrame:
    """One finding per dataset whose accessor an earlier dataset has; labels are not compared."""
    place = F.struct(F.coalesce("pos", F.lit(0)).alias("pos"), F.col("node_id").alias("node_id"))
    rows = cat.datasets.where("accessor is not null").select(
        "node_id", place.alias("place"), F.col("accessor.kind").alias("kind"), F.col("accessor.endpoint").alias("endpoint"),
        F.coalesce("properties_canonical", canonical_json(F.col("accessor.properties")), F.lit("null")).alias("properties"),
    )
    key = ["kind", "endpoint", "properties"]
    owners = rows.groupBy(*key).agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    owners = owners.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("node_id"), F.lit(_SALTS)).cast("int"))
    later = salted.join(owners, [*key, "_salt"]).where("place > first")
    return _finding(later, "duplicate_accessor", _text(
        "datasets ", quoted(F.col("first.node_id")), " and ", quoted(F.col("node_id")),
        " have the same accessor kind, endpoint, and properties",
    ), node="node_id")


# -- references ----------------------------------------------------------------------------------


def _grain_components(cat: Catalog) -> DataFrame:
    return cat.datasets.select("node_id", F.explode("grain.components").alias("c")).select(
        "node_id", "c.identity_id", "c.dataset_columns"
    )


def column_references(cat: Catalog) -> DataFrame:
    """Columns that definitions and grains use and the dataset lacks; both meet the columns in one join."""
    used = cat.definitions.select(F.lit(False).alias("grain"), *KEY, F.explode("dataset_columns").alias("name")).unionByName(
        _grain_components(cat).select("node_id", F.explode("dataset_columns").alias("name")).withColumn("grain", F.lit(True)),
        allowMissingColumns=True)
    absent = used.join(cat.columns.select("node_id", "name"), ["node_id", "name"], "left_anti")
    # A grain names each missing column, a definition lists them.
    found = absent.groupBy("grain", *KEY, F.when(F.col("grain"), F.col("name")).alias("one")).agg(F.array_sort(F.collect_set("name")).alias("missing"))
    message = F.when(F.col("grain"), _text("grain uses missing column ", quoted(F.col("one")))).otherwise(_text(
        "entity definition ", quoted(F.col("identity_id")), " uses missing columns: ", quoted_list(F.col("missing"))))
    return found.select(F.when(F.col("grain"), "grain_column").otherwise("missing_column").alias("rule"), "node_id", "identity_id", message.alias("message"))


def identity_references(cat: Catalog) -> DataFrame:
    """Entities that definitions and stated pairs name and nobody registered; both meet the identities in one join."""
    ends = F.array("left_id", "right_id")
    used = cat.definitions.select(F.lit(None).cast("array<string>").alias("ends"), "node_id", "identity_id").unionByName(
        cat.entity_relationships.select(ends.alias("ends"), F.lit(None).cast("string").alias("node_id"), F.explode(F.array_distinct(ends)).alias("identity_id")))
    unknown = used.join(cat.identities.select("identity_id").distinct(), "identity_id", "left_anti")
    found = unknown.groupBy("ends", "node_id", F.when(F.col("ends").isNull(), F.col("identity_id")).alias("one")).agg(
        F.array_sort(F.collect_set("identity_id")).alias("unknown"))
    message = F.when(F.col("ends").isNull(), _text("node ", F.col("node_id"), " references unknown logical entity ", F.col("one"))).otherwise(_text(
        "cross-entity relationship ", quoted_list(F.col("ends")), " references unknown logical entities ", quoted_list(F.col("unknown"))))
    return found.select(
        F.lit("unknown_identity").alias("rule"), "node_id", F.coalesce("one", F.get("ends", F.lit(0))).alias("identity_id"), message.alias("message"))


def grain_definitions(cat: Catalog) -> DataFrame:
    named = _grain_components(cat).where("identity_id is not null").distinct()
    loose = named.join(cat.definitions.select(*KEY), KEY, "left_anti")
    return _finding(loose, "grain_definition", _text(
        "grain component does not resolve to an entity definition: ", quoted(F.col("identity_id")),
        ", ", quoted_list(F.col("dataset_columns")),
    ), node="node_id", entity="identity_id")


def annotation_targets(cat: Catalog) -> DataFrame:
    asked = cat.annotations.select("edge_id").distinct()
    unknown = resolve_edges(cat, asked).where("status <> 'ok'")
    return _finding(unknown, "unknown_edge", _text("annotation references unknown edge ", F.col("edge_id")))


# -- reports -------------------------------------------------------------------------------------


def accessor_warnings(cat: Catalog, limit: int = ACCESSOR_SOFT_LIMIT) -> DataFrame:
    """Accessors longer than the soft limit; a warning only."""
    canonical = F.coalesce("accessor_canonical", accessor_json(F.col("accessor")))
    return cat.datasets.where("accessor is not null").select(
        "node_id", F.char_length(canonical).cast("bigint").alias("length")
    ).where(F.col("length") > limit).withColumn(
        "message", _text("nodes[", F.col("node_id"), "].accessor: ", F.col("length").cast("string"),
                         f" characters exceeds the {limit}-character soft limit"),
    )


def unknown_claims(cat: Catalog) -> DataFrame:
    """One row per unknown claim of a dataset, a definition or a stated relationship."""
    none = F.lit(None).cast("string")
    node = _text("nodes[", json_string(F.col("node_id")), "]")
    grains = cat.datasets.where("grain is null").select(
        F.lit("dataset").alias("object_kind"), "node_id", none.alias("identity_id"),
        F.lit(None).cast("array<string>").alias("dataset_columns"), F.lit("grain").alias("claim"),
        _text(node, ".grain").alias("location"),
    )
    key = _text("[", json_string(F.col("identity_id")), ",", json_strings_array(F.col("dataset_columns")), "]")
    held = cat.definitions.select(
        *KEY, F.explode(claims.unknown_claims(claims.side())).alias("claim")
    ).select(
        F.lit("entity_definition").alias("object_kind"), *KEY, "claim",
        _text(node, ".entity_definitions[", key, "].", F.col("claim")).alias("location"),
    )
    values = {
        "multiplicity": F.col("multiplicity"), "match_existence.0": F.col("me_left"), "match_existence.1": F.col("me_right"),
    }
    pair = json_strings_array(F.array("left_id", "right_id"))
    stated = cat.entity_relationships.select(
        "left_id", "right_id", F.explode(claims.unknown_names(values)).alias("claim")
    ).select(
        F.lit("entity_relationship").alias("object_kind"), none.alias("node_id"), F.col("left_id").alias("identity_id"),
        F.lit(None).cast("array<string>").alias("dataset_columns"), "claim",
        _text("entity_relationships[", pair, "].", F.col("claim")).alias("location"),
    )
    return grains.unionByName(held).unionByName(stated)
