"""Catalog documents in YAML: one assembled file, or a folder of per-collection files and a manifest.

Spark lists and reads the files. One batch function turns YAML into JSON text; everything after that
is typed parsing, explodes and joins. Claims may be the word ``unknown`` in YAML, so a document is
read with every claim as text and typed afterwards.
"""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window as W

from kinweave.catalog import Catalog
from kinweave.functions.canonical import accessor_json, canonical_json
from kinweave.plans.lineage import cut
from kinweave.plans.shipping import ship_by_value

ship_by_value(__name__)

# Fixed values
COLLECTIONS = ("logical_identities", "nodes", "entity_relationships")
SUFFIXES = r"(?i)\.ya?ml\z"
SCHEMA_VERSION = "1"

_PARSED = StructType([StructField("json", StringType()), StructField("error", StringType())])

NODE = (
    "struct<node_id: string, "
    "descriptor: struct<qualified_name: string, display_name: string, description: string, "
    "synonyms: array<string>, tags: array<string>>, "
    "accessor: struct<kind: string, endpoint: string, labels: map<string,string>, properties: string>, "
    "grain: string, "
    "columns: array<struct<name: string, description: string, value_description: string, synonyms: array<string>>>, "
    "entity_definitions: array<struct<identity_id: string, dataset_columns: array<string>, entity_universe: string, "
    "unique: string, total: string, conforms: string, entity_expression: array<string>, entity_metadata: string, "
    "description: string>>>"
)
GRAIN = (
    "struct<components: array<struct<dataset_columns: array<string>, identity_id: string, description: string>>, "
    "description: string>"
)
IDENTITY = "struct<name: string, description: string, synonyms: array<string>>"
STATED = (
    "struct<endpoints: array<string>, multiplicity: string, match_existence: array<string>, descriptions: array<string>>"
)
DOCUMENT = (
    f"schema_version string, logical_identities map<string, {IDENTITY}>, nodes array<{NODE}>, "
    f"entity_relationships array<{STATED}>"
)
# The fields of catalog documents. `name!` is required; `list<x>` and `map<x>` hold x; an
# object's name opens it; a claim is true, false or the word unknown; a grain may be that word too.
OBJECTS = {
    "identity": {"name!": "string", "description": "string", "synonyms": "list<string>"},
    "node": {
        "node_id!": "string", "descriptor!": "descriptor", "accessor!": "accessor", "grain!": "grain",
        "columns!": "list<column>", "entity_definitions": "list<definition>",
    },
    "descriptor": {
        "qualified_name!": "string", "display_name!": "string", "description": "string", "synonyms": "list<string>",
        "tags": "list<string>",
    },
    "accessor": {"kind!": "string", "endpoint!": "string", "labels": "map<string>", "properties": "map<any>"},
    "grain": {"components!": "list<component>", "description": "string"},
    "component": {"dataset_columns!": "list<string>", "identity_id": "string", "description": "string"},
    "column": {"name!": "string", "description": "string", "value_description": "string", "synonyms": "list<string>"},
    "definition": {
        "identity_id!": "string", "dataset_columns!": "list<string>", "entity_universe!": "string", "unique!": "claim",
        "total!": "claim", "conforms!": "claim", "entity_expression": "list<string>", "entity_metadata": "map<any>",
        "description": "string",
    },
    "entity_relationship": {
        "endpoints!": "list<string>", "multiplicity!": "string", "match_existence!": "list<string>", "descriptions!": "list<string>",
    },
}


@F.pandas_udf(_PARSED)
def _yaml_to_json(content: pd.Series) -> pd.DataFrame:
    import yaml

    def one(data):
        try:  # dates outside the calendar, NaN, mapping keys that are no text, other encodings, deep nesting: whatever is wrong is the file's
            return json.dumps(yaml.safe_load(data), ensure_ascii=False, default=str, allow_nan=False), None
        except Exception as error:
            return None, (str(error).splitlines() or [type(error).__name__])[0]

    return pd.DataFrame([one(data) for data in content], columns=["json", "error"])


_yaml_to_json = _yaml_to_json.asNondeterministic()


def read_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(path, json, error)`` of YAML files; a file that cannot be read as YAML has its error, whatever is wrong with it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    return parse_files(files.select(F.col("_metadata.file_path").alias("path"), "content"))


def parse_files(files: DataFrame) -> DataFrame:
    """``(path, json, error)`` of YAML given as ``(path, content)``, bytes as they are in the file."""
    return cut(files.select("path", _yaml_to_json("content").alias("p")).select("path", "p.*"))


def catalog_from_files(spark: SparkSession, files: DataFrame, version: str | None = None, **options) -> Catalog:
    """Catalog tables of parsed files ``(path, json)``; together they make one catalog."""
    documents = files.select("path", F.from_json("json", DOCUMENT).alias("d")).select("path", "d.*")
    identities = documents.select(F.explode("logical_identities").alias("identity_id", "i")).select("identity_id", "i.*")
    nodes = documents.select("path", F.posexplode("nodes").alias("pos", "n")).select("path", "pos", "n.*")
    stated = documents.select(F.explode("entity_relationships").alias("r"))
    return catalog_of(spark, nodes, identities, stated, version, **options)


def _full_grain() -> Column:
    """The grain as the catalog serves it: a description left out is the empty text."""
    grain = F.from_json("grain", GRAIN)
    components = F.transform(grain["components"], lambda c: F.struct(
        c["dataset_columns"].alias("dataset_columns"), c["identity_id"].alias("identity_id"),
        F.coalesce(c["description"], F.lit("")).alias("description"),
    ))
    full = F.struct(components.alias("components"), F.coalesce(grain["description"], F.lit("")).alias("description"))
    return F.when(F.col("grain") != "unknown", full)


def catalog_of(
    spark: SparkSession, nodes: DataFrame, identities: DataFrame, stated: DataFrame, version: str | None = None, **options,
) -> Catalog:
    """Catalog tables of exploded nodes, identities and stated relationships ``(r)``. The version is fixed here."""
    held = nodes.select("node_id", F.posexplode("entity_definitions").alias("pos", "e")).select("node_id", "pos", "e.*")
    empty = F.array().cast("array<string>")
    accessor = F.struct(
        "accessor.kind", "accessor.endpoint",
        F.coalesce("accessor.labels", F.create_map().cast("map<string,string>")).alias("labels"), "accessor.properties",
    )
    datasets = nodes.select(
        "node_id", "pos", "descriptor", accessor.alias("accessor"),
        accessor_json(F.col("accessor")).alias("accessor_canonical"),
        F.coalesce(canonical_json(F.col("accessor.properties")), F.lit("null")).alias("properties_canonical"),
        _full_grain().alias("grain"),
    )
    columns = nodes.select("node_id", F.posexplode("columns").alias("pos", "c")).select("node_id", "pos", "c.*")
    definitions = held.select(
        "node_id", "pos", "identity_id", "dataset_columns", "entity_universe",
        *(_claim(name).alias(name) for name in ("unique", "total", "conforms")),
        F.coalesce("entity_expression", empty).alias("entity_expression"), "entity_metadata", "description",
    )
    stated = stated.select(
        F.get("r.endpoints", F.lit(0)).alias("left_id"), F.get("r.endpoints", F.lit(1)).alias("right_id"),
        "r.multiplicity", F.get("r.match_existence", F.lit(0)).alias("me_left"),
        F.get("r.match_existence", F.lit(1)).alias("me_right"), "r.descriptions",
    )
    version = version or spark.range(1).select(snapshot_version()).first()[0]
    return Catalog(
        spark, datasets=datasets, columns=columns, definitions=definitions, identities=identities,
        entity_relationships=stated, snapshot=spark.range(1).select(F.lit(version).alias("version")), **options,
    )


def snapshot_version() -> Column:
    """The build time in UTC, to the second."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _claim(name: str) -> Column:
    return F.when(F.col(name) == "true", True).when(F.col(name) == "false", False)


def ingest(spark: SparkSession, paths: str | list[str], version: str | None = None, **options) -> Catalog:
    """The catalog of one assembled file or of several collection files.

    A file that cannot be read whole refuses the catalog; ``ingest_findings`` lists everything that is
    wrong, and ``manifest_findings`` and ``ownership_findings`` check a folder against its manifest.
    """
    files = read_files(spark, paths)
    faults = ingest_findings(files).limit(5).collect()
    if faults:
        raise ValueError("catalog files are not sound: " + "; ".join(f"{f.location} {f.message}" for f in faults))
    return catalog_from_files(spark, files, version, **options)


def ingest_findings(files: DataFrame) -> DataFrame:
    """Everything in parsed files ``(path, json, error)`` that would not reach the catalog as it is written."""
    at = _at(F.col("path"), ":$")
    sound = files.where("error is null")
    unreadable = _finding(files.where("error is not null"), at, "yaml_syntax", F.col("error"))
    shapeless = _finding(sound.where(F.json_object_keys("json").isNull()), at, "mapping_type", "each file must contain a top-level mapping")
    fields = _field_findings(sound).select(_at(F.col("path"), ":", F.col("location")).alias("location"), "rule", "message")
    return unreadable.unionByName(shapeless).unionByName(fields)


# -- findings ------------------------------------------------------------------------------------


def _finding(rows: DataFrame, location: Column, rule: str | Column, message: Column | str) -> DataFrame:
    def lit(value):
        return F.lit(value) if isinstance(value, str) else value
    return rows.select(location.alias("location"), lit(rule).alias("rule"), lit(message).alias("message"))


def _at(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def manifest_entries(manifest: DataFrame) -> DataFrame:
    """``(collection, path, place, location)`` of a parsed manifest ``(json)``, in listing order."""
    read = manifest.select(F.from_json(
        "json", "schema_version string, logical_identities string, nodes array<string>, entity_relationships string"
    ).alias("m")).select("m.*")
    row = lambda collection, path, i, location: F.struct(
        F.lit(collection).alias("collection"), path.alias("path"), i.cast("int").alias("place"), location.alias("location")
    )
    nodes = F.transform("nodes", lambda p, i: row("nodes", p, i + 1, _at("$.nodes[", i.cast("string"), "]")))
    entries = F.concat(
        F.array(row("logical_identities", F.col("logical_identities"), F.lit(0), F.lit("$.logical_identities"))),
        nodes,
        F.array(row("entity_relationships", F.col("entity_relationships"), F.coalesce(F.size("nodes"), F.lit(0)) + 1, F.lit("$.entity_relationships"))),
    )
    return read.select("schema_version", F.explode(entries).alias("e")).select("schema_version", "e.*").where("path is not null")


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """Relative paths below ``folder``, from file metadata alone."""
    root = folder.rstrip("/")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    below = F.instr("path", f"{root}/") + F.lit(len(root) + 1)
    return listed.select(F.substr(F.col("path"), below).alias("path"))


def manifest_findings(entries: DataFrame, listing: DataFrame) -> DataFrame:
    """Differences between a manifest and the files of its folder ``listing(path)``."""
    unsafe = F.col("path").startswith("/") | F.array_contains(F.split("path", "/"), F.lit(".."))
    at = _at("manifest:", F.col("location"))
    order = W.partitionBy("path").orderBy("place")
    safe = entries.where(~unsafe).withColumn("_n", F.row_number().over(order)).withColumn(
        "_owner", F.first("collection").over(order)
    )
    first = safe.where("_n = 1")
    is_yaml = F.col("path").rlike(SUFFIXES)
    return reduce(DataFrame.unionByName, [
        _finding(entries.where(unsafe), at, "invalid_collection_path", "collection paths must be relative and must not contain '..'"),
        _finding(safe.where("_n > 1"), at, "duplicate_manifest_path", _at("collection path is already owned by ", F.col("_owner"))),
        _finding(first.where(~is_yaml), at, "unsupported_file", "collection paths must name .yaml or .yml files"),
        _finding(first.where(is_yaml).join(listing, "path", "left_anti"), at, "missing_file", _at(
            "listed collection file does not exist: ", F.col("path"))),
        _finding(listing.where(~is_yaml), F.col("path"), "unsupported_file", "the folder may contain only .yaml or .yml files"),
        _finding(listing.where(is_yaml).join(first, "path", "left_anti"), F.col("path"), "unlisted_file", "file is not listed in the manifest"),
    ])


def ownership_findings(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Whether each file holds its own collection alone, in the manifest's version, without repeats.

    ``files(path, json, error)`` with the manifest's relative paths.
    """
    owned = entries.join(files, "path")
    at = _at(F.col("path"), ":$")
    broken = owned.where("error is not null")
    sound = owned.where("error is null").withColumn("keys", F.json_object_keys("json"))
    mappings = sound.where("keys is not null")
    needed = F.array(F.lit("schema_version"), F.col("collection"))
    absent = mappings.withColumn("key", F.explode(F.array_except(needed, "keys")))
    extra = mappings.withColumn("key", F.explode(F.array_except("keys", needed)))
    foreign = F.col("key").isin(*COLLECTIONS)
    version = F.get_json_object("json", "$.schema_version")
    findings = [
        _finding(broken, at, "yaml_syntax", F.col("error")),
        _finding(sound.where("keys is null"), at, "mapping_type", "each YAML file must contain a top-level mapping"),
        _finding(absent, at, "missing", _at("collection file must contain ", F.col("key"))),
        _finding(
            extra, _at(at, ".", F.col("key")), F.when(foreign, "collection_ownership").otherwise("extra_forbidden"),
            F.when(foreign, _at("file is owned by ", F.col("collection"), ", not ", F.col("key"))).otherwise("unsupported top-level field"),
        ),
        _finding(mappings.where(~version.eqNullSafe(F.col("schema_version"))), _at(at, ".schema_version"), "conflicting_schema_version",
                 _at("schema_version conflicts with the manifest: ", F.coalesce(version, F.lit("null")))),
    ]
    body = F.parse_json(F.col("json"))
    collection = mappings.withColumn("_c", F.when(
        F.col("collection") == "logical_identities", F.variant_get(body, "$.logical_identities", "variant")
    ).when(F.col("collection") == "nodes", F.variant_get(body, "$.nodes", "variant")).otherwise(
        F.variant_get(body, "$.entity_relationships", "variant")
    )).withColumn("_shape", F.schema_of_variant("_c"))
    is_map = F.col("collection") == "logical_identities"
    findings.append(_finding(
        collection.where(F.col("_shape").isNotNull() & F.when(is_map, ~F.col("_shape").startswith("OBJECT")).otherwise(~F.col("_shape").startswith("ARRAY"))),
        _at(at, ".", F.col("collection")), F.when(is_map, "mapping_type").otherwise("list_type"), "collection has the wrong type",
    ))
    ids = collection.where(is_map & F.col("_shape").startswith("OBJECT")).select(
        "path", "place", F.lit(0).alias("i"), F.explode(F.map_keys(F.col("_c").cast("map<string,variant>"))).alias("key")
    ).withColumn("location", _at(at, ".logical_identities.", F.col("key")))
    nodes = collection.where((F.col("collection") == "nodes") & F.col("_shape").startswith("ARRAY")).select(
        "path", "place", F.posexplode(F.col("_c").cast("array<variant>")).alias("i", "n")
    ).select("path", "place", "i", F.try_variant_get("n", "$.node_id", "string").alias("key")).where("key is not null").withColumn(
        "location", _at(at, ".nodes[", F.col("i").cast("string"), "].node_id")
    )
    for rows in (ids, nodes):
        # min_by folds on the map side; only repeated keys are joined back.
        owner = rows.groupBy("key").agg(
            F.min(F.struct("place", "i", "path")).alias("first"), F.count("*").alias("n")
        ).where("n > 1")
        later = rows.join(owner, "key").where(F.struct("place", "i") > F.struct("first.place", "first.i"))
        findings.append(_finding(later, F.col("location"), "duplicate_definition", _at("already defined in ", F.col("first.path"))))
    return reduce(DataFrame.unionByName, findings)


def _violation(kind: str, value: Column) -> Column:
    """The rule that ``value`` breaks as a ``kind``, or NULL; an absent or null value breaks none here."""
    shape = F.schema_of_variant(value)
    given = shape.isNotNull() & (shape != "VOID")
    if kind == "string":
        return F.when(given & (shape != "STRING"), "string_type")
    if kind == "claim":
        unknown = (shape == "STRING") & (F.try_variant_get(value, "$", "string") == "unknown")
        return F.when(given & (shape != "BOOLEAN") & ~F.coalesce(unknown, F.lit(False)), "claim_domain")
    if kind.startswith("list<"):
        odd = F.exists(F.when(shape.startswith("ARRAY"), value.cast("array<variant>")), lambda v: F.schema_of_variant(v) != "STRING")
        items = F.when(odd, "string_type") if kind == "list<string>" else F.lit(None).cast("string")
        return F.when(given & ~shape.startswith("ARRAY"), "list_type").otherwise(items)
    fits = shape.startswith("OBJECT")
    if kind == "grain":
        fits = fits | F.coalesce(F.try_variant_get(value, "$", "string") == "unknown", F.lit(False))
    if kind == "map<string>":
        held = F.map_values(F.when(shape.startswith("OBJECT"), value.cast("map<string,variant>")))
        return F.when(given & ~fits, "dict_type").when(F.exists(held, lambda v: F.schema_of_variant(v) != "STRING"), "string_type")
    return F.when(given & ~fits, "dict_type")


def _field_findings(files: DataFrame) -> DataFrame:
    """(path, location, rule, message): missing, extra and mistyped fields, object by object."""
    body = files.where("json is not null").select("path", F.lit("$").alias("location"), F.parse_json("json").alias("o"))
    body = body.where(F.schema_of_variant("o").startswith("OBJECT"))

    def opened(rows: DataFrame, field: str, holder: str) -> DataFrame:
        """The objects in ``field`` of ``rows``; what is no object there is reported with the field itself."""
        value = F.variant_get("o", f"$.{field}", "variant")
        shape = F.schema_of_variant(value)
        if holder == "list":
            items = F.when(shape.startswith("ARRAY"), value.cast("array<variant>"))
            each = rows.select("path", "location", F.posexplode(items).alias("i", "v")).withColumn("step", _at("[", F.col("i").cast("string"), "]"))
        elif holder == "map":
            items = F.when(shape.startswith("OBJECT"), value.cast("map<string,variant>"))
            each = rows.select("path", "location", F.explode(items).alias("i", "v")).withColumn("step", _at(".", F.col("i")))
        else:
            each = rows.select("path", "location", value.alias("v"), F.lit("").alias("step"))
        return each.select("path", _at(F.col("location"), f".{field}", F.col("step")).alias("location"), F.col("v").alias("o"))

    def reported(rows: DataFrame, location: Column, rule: Column | str, message: str) -> DataFrame:
        rule = F.lit(rule) if isinstance(rule, str) else rule
        return rows.select("path", location.alias("location"), rule.alias("rule"), F.lit(message).alias("message"))

    findings = []

    def check(rows: DataFrame, kind: str) -> None:
        shape = F.schema_of_variant("o")
        whole = rows.where(shape.startswith("OBJECT"))
        if kind not in ("grain", "descriptor", "accessor"):  # those three are reported with the field that holds them
            findings.append(reported(rows.where(~shape.startswith("OBJECT")), F.col("location"), "dict_type", "must be a mapping"))
        fields = {name.rstrip("!"): (k, name.endswith("!")) for name, k in OBJECTS[kind].items()}
        given = F.map_keys(F.col("o").cast("map<string,variant>"))
        absent = F.array_except(F.array(*[F.lit(f) for f, (_, needed) in fields.items() if needed]), given)
        extra = F.array_except(given, F.array(*map(F.lit, fields)))
        broken = F.filter(F.array(*[
            F.struct(F.lit(f).alias("key"), _violation(k, F.variant_get("o", f"$.{f}", "variant")).alias("rule")) for f, (k, _) in fields.items()
        ]), lambda x: x["rule"].isNotNull())
        faults = F.concat(
            F.transform(absent, lambda f: F.struct(f.alias("key"), F.lit("missing").alias("rule"), F.lit("field required").alias("message"))),
            F.transform(extra, lambda f: F.struct(f.alias("key"), F.lit("extra_forbidden").alias("rule"), F.lit("unsupported field").alias("message"))),
            F.transform(broken, lambda x: F.struct(x["key"].alias("key"), x["rule"].alias("rule"), F.lit("value has the wrong type").alias("message"))),
        )
        found = whole.select("path", "location", F.explode(faults).alias("f"))
        findings.append(found.select("path", _at(F.col("location"), ".", F.col("f.key")).alias("location"), "f.rule", "f.message"))
        for field, (k, _) in fields.items():
            inner, holder = (k[5:-1], "list") if k.startswith("list<") else (k, "one")
            if inner in OBJECTS:
                check(opened(whole, field, holder), inner)

    for field, holder, kind in (("logical_identities", "map", "identity"), ("nodes", "list", "node"), ("entity_relationships", "list", "entity_relationship")):
        value = F.variant_get("o", f"$.{field}", "variant")
        wrong = _violation("map<any>" if holder == "map" else "list<object>", value)
        findings.append(reported(body.withColumn("wrong", wrong).where("wrong is not null"), F.lit(f"$.{field}"), F.col("wrong"), "collection has the wrong type"))
        check(opened(body, field, holder), kind)
    return reduce(DataFrame.unionByName, findings)


def field_findings(files: DataFrame) -> DataFrame:
    """Missing, extra and mistyped fields at every level of raw documents ``(path, json, error)``."""
    return _field_findings(files.where("error is null")).select("location", "rule", "message")


def read_documents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``docs(doc_id, payload)`` from JSON files, or YAML files by suffix; the path is the ID.

    A YAML file that cannot be parsed keeps its text, which the document check then reports.
    """
    text = spark.read.text(paths, wholetext=True, recursiveFileLookup=True).select(
        F.col("_metadata.file_path").alias("doc_id"), "value"
    )
    is_yaml = F.col("doc_id").rlike(SUFFIXES)
    as_json = text.where(~is_yaml).select("doc_id", F.col("value").alias("payload"))
    parsed = text.where(is_yaml).select("doc_id", "value", _yaml_to_json(F.col("value").cast("binary")).alias("p"))
    return as_json.unionByName(parsed.select("doc_id", F.coalesce("p.json", "value").alias("payload")))
