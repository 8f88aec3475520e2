import json

import pytest
import yaml
from pyspark.sql import functions as F

from kinweave import Catalog
from kinweave.functions.canonical import canonical_json
from kinweave.operators import discovery, documents, integrity, measure, paths, projection, relationships
from kinweave.plans.lineage import cut
from kinweave.sources import collections, snapshots
from tests import observatory as obs


def parsed(spark, source):
    return spark.createDataFrame([("f", json.dumps(source), None)], "path string, json string, error string")


@pytest.fixture(scope="module")
def cat(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("yaml") / "observatory.yaml"
    path.write_text(yaml.safe_dump(obs.catalog(), sort_keys=False))
    return collections.ingest(spark, str(path), obs.VERSION, block_rows=4)


def test_ingest_matches_brute_force(cat):
    got = {r.edge_id: (r.ab_multiplicity, r.ab_existence, r.ba_multiplicity, r.ba_existence) for r in relationships.relationships(cat).collect()}
    assert got == obs.edges()
    g = obs.graph()
    degrees = {r.node_id: r.edge_count for r in relationships.degrees(cat).collect()}
    assert degrees == {n: len({frozenset((g.ord[d], g.ord[t])) for d in g.on(n) for t in g.edges_from(d)}) for n in g.nodes}
    assert tuple(cat.counts().first()) == (obs.VERSION, len(obs.TABLES), len(g.defs), 5, len(obs.STATED))
    assert integrity.integrity(cat).count() == 0
    locations = {r.location for r in integrity.unknown_claims(cat).collect()}
    assert 'nodes["obs/night_log"].grain' in locations
    assert 'nodes["obs/camera"].entity_definitions[["key:site",["site_code"]]].conforms' in locations
    assert 'entity_relationships[["key:camera","key:site"]].match_existence.1' in locations
    unknown = sum((d.universe == "unknown") + (d.unique is None) + (d.total is None) + (d.conforms is None) for d in g.defs)
    stated = sum(s[2:5].count("unknown") for s in obs.STATED)
    assert len(locations) == 1 + unknown + stated


def test_ingestion_refuses_or_reports(spark, tmp_path):
    source = obs.catalog()
    source["logical_identities"]["key:site"]["synonyms"] = "oops"
    source["nodes"][0]["columns"][1]["colour"] = "red"
    (tmp_path / "good.yaml").write_text(yaml.safe_dump(source))
    (tmp_path / "bad.yaml").write_text("a: [")
    paths_ = [str(tmp_path / "good.yaml"), str(tmp_path / "bad.yaml")]
    with pytest.raises(ValueError, match="bad.yaml"):
        collections.ingest(spark, paths_)
    found = collections.ingest_findings(collections.read_files(spark, paths_)).collect()
    assert {(r.location.rpartition("/")[2], r.rule) for r in found} == {
        ("bad.yaml:$", "yaml_syntax"), ("good.yaml:$.logical_identities.key:site.synonyms", "list_type"),
        ("good.yaml:$.nodes[0].columns[1].colour", "extra_forbidden")}


def test_any_broken_file_is_a_finding(spark, tmp_path):
    broken = {
        "date.yaml": b"a: 2024-13-45", "nan.yaml": b"a: .nan", "key.yaml": b"2024-01-01: x", "latin.yaml": b"a: \xe9\xff", "tab.yaml": b"a:\n\t- b",
        "deep.yaml": b"[" * 5000, "tag.yaml": b"a: !!python/object:os.system {}", "two.yaml": b"a: 1\n---\nb: 2",
    }
    for name, data in broken.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "wide.yaml").write_bytes('{"schema_version": "1", "logical_identities": {"k": {"name": "naïve"}}}'.encode("utf-16"))
    files = collections.read_files(spark, str(tmp_path))
    errors = {r.path.rsplit("/", 1)[1]: r.error for r in files.collect()}
    assert {name for name, error in errors.items() if error} == set(broken)
    found = collections.ingest_findings(files).collect()
    assert {(r.location.rsplit("/", 1)[1], r.rule) for r in found} == {(f"{name}:$", "yaml_syntax") for name in broken}
    assert all(r.message for r in found)


def test_publish_and_load(cat, tmp_path, spark):
    root = str(tmp_path / "store")
    snapshots.publish(cat, root)
    again = snapshots.load(spark, root)
    assert {tuple(r) for r in again.fingerprint().collect()} == {tuple(r) for r in cat.fingerprint().collect()}
    assert again.counts().first() == cat.counts().first()
    broken = Catalog(spark, datasets=cat.datasets.unionByName(cat.datasets), columns=cat.columns, definitions=cat.definitions,
                     identities=cat.identities, snapshot=cat.snapshot)
    with pytest.raises(ValueError):
        snapshots.publish(broken, root, "2027-01-01T00:00:00Z")
    assert snapshots.load(spark, root).counts().first()["version"] == obs.VERSION
    snapshots.publish(cat, root, "2026-02-01T00:00:00Z")  # the last one published is current, not the greatest text
    assert snapshots.load(spark, root).counts().first()["version"] == "2026-02-01T00:00:00Z"
    snapshots.publish(cat, root, "2027-01-01T00:00:00Z")  # a refused candidate does not take its version
    assert snapshots.load(spark, root, "2027-01-01T00:00:00Z").counts().first()["version"] == "2027-01-01T00:00:00Z"
    with pytest.raises(ValueError, match="already"):
        snapshots.publish(cat, root, "2027-01-01T00:00:00Z")
    with pytest.raises(ValueError, match="not published"):
        snapshots.load(spark, root, "1999-01-01T00:00:00Z")


def test_version_is_fixed_when_built(spark, tmp_path):
    import time

    cat = collections.catalog_from_files(spark, parsed(spark, obs.catalog()))
    first = cat.snapshot.first()[0]
    time.sleep(1.2)
    assert cat.snapshot.first()[0] == first


def test_json_artifact(spark, tmp_path):
    source = obs.catalog()
    identities = [{"identity_id": k, **v} for k, v in source["logical_identities"].items()]
    edge_id = obs.edge("field", "obs/exposure", "obs/field")[-1]
    bodies = {
        "nodes": {"version": "v1", "nodes": source["nodes"], "logical_identities": identities},
        "annotations": {"version": "v1", "annotations": [{"edge_id": edge_id, "description": "check"}]},
        "entity_relationships": {"version": "v1", "entity_relationships": source["entity_relationships"]},
    }

    def write(**changed):
        for name, body in {**bodies, **changed}.items():
            (tmp_path / f"{name}.json").write_text(json.dumps(body, indent=2))
        return [str(tmp_path / f"{name}.json") for name in bodies]

    cat = snapshots.load_artifact(spark, *write())
    req = spark.createDataFrame([(1, edge_id, "obs/exposure", None)], "req_id bigint, edge_id string, from_node_id string, from_dataset_columns array<string>")
    row = relationships.lookup_relationships(cat, req).first()
    expected = obs.edge("field", "obs/exposure", "obs/field")
    assert row.annotation.description == "check" and (row.edge, row.multiplicity) == (expected[0], expected[1])
    assert cat.entity_relationships.count() == len(obs.STATED) and integrity.integrity(cat).count() == 0
    names = write(annotations={"version": "v2", "annotations": []})
    with pytest.raises(ValueError):
        snapshots.load_artifact(spark, *names)
    assert [r.version for r in snapshots.envelope_findings(spark, names).collect()] == ["v2"]
    twice = {**bodies["nodes"], "logical_identities": identities + identities[:1]}
    assert "duplicate_identity" in {r.rule for r in integrity.integrity(snapshots.load_artifact(spark, *write(nodes=twice))).collect()}


def test_folder_manifest(spark, tmp_path):
    source = obs.catalog()
    folder = tmp_path / "fin(a)l"
    (folder / "nodes").mkdir(parents=True)
    def write(path, **body):
        (folder / path).write_text(yaml.safe_dump(body))
    write("ids.yaml", schema_version="1", logical_identities=source["logical_identities"])
    write("nodes/a.yaml", schema_version="1", nodes=source["nodes"][:3])
    write("nodes/b.yaml", schema_version="2", nodes=source["nodes"][2:], logical_identities={})
    write("nodes/c.yaml", schema_version="1", nodez=[])
    (folder / "nodes/bad.yaml").write_text("a: [")
    (folder / "readme.txt").write_text("x")
    manifest = {"schema_version": "1", "logical_identities": "ids.yaml", "nodes": ["nodes/a.yaml", "nodes/b.yaml", "nodes/a.yaml", "nodes/gone.yaml", "../x.yaml", "nodes/d.json", "nodes/bad.yaml"]}
    mdf = spark.createDataFrame([(json.dumps(manifest),)], "json string")
    entries = collections.manifest_entries(mdf)
    found = {(r.location, r.rule) for r in collections.manifest_findings(entries, collections.list_files(spark, str(folder))).collect()}
    assert found == {
        ("manifest:$.nodes[2]", "duplicate_manifest_path"), ("manifest:$.nodes[3]", "missing_file"), ("manifest:$.nodes[4]", "invalid_collection_path"),
        ("manifest:$.nodes[5]", "unsupported_file"), ("readme.txt", "unsupported_file"), ("nodes/c.yaml", "unlisted_file"),
    }
    files = collections.read_files(spark, [str(folder / p) for p in ("ids.yaml", "nodes/a.yaml", "nodes/b.yaml", "nodes/c.yaml", "nodes/bad.yaml")])
    files = files.withColumn("path", F.regexp_replace("path", ".*/fin.a.l/", ""))
    own = spark.createDataFrame([(json.dumps({"schema_version": "1", "logical_identities": "ids.yaml", "nodes": ["nodes/a.yaml", "nodes/b.yaml", "nodes/c.yaml", "nodes/bad.yaml"]}),)], "json string")
    found = {(r.location, r.rule) for r in collections.ownership_findings(collections.manifest_entries(own), files).collect()}
    assert found == {
        ("nodes/b.yaml:$.schema_version", "conflicting_schema_version"), ("nodes/b.yaml:$.logical_identities", "collection_ownership"),
        ("nodes/b.yaml:$.nodes[0].node_id", "duplicate_definition"), ("nodes/c.yaml:$", "missing"), ("nodes/c.yaml:$.nodez", "extra_forbidden"),
        ("nodes/bad.yaml:$", "yaml_syntax"),
    }


def test_raw_field_findings(spark):
    source = obs.catalog()
    nodes = source["nodes"]
    del nodes[0]["grain"]
    nodes[1]["rows"] = 5
    nodes[1]["entity_definitions"][0]["unique"] = "maybe"
    nodes[1]["descriptor"]["owner"] = "me"
    nodes[2]["accessor"]["endpoint"] = 7
    nodes[2]["grain"]["components"][0]["dataset_columns"] = "camera_no"
    nodes[3]["columns"][0].pop("name")
    nodes[3]["grain"] = "none"
    source["logical_identities"]["key:log"].pop("name")
    source["entity_relationships"][1]["match_existence"] = "optional"
    assert {(r.location, r.rule) for r in collections.field_findings(parsed(spark, source)).collect()} == {
        ("$.nodes[0].grain", "missing"), ("$.nodes[1].rows", "extra_forbidden"), ("$.nodes[1].entity_definitions[0].unique", "claim_domain"),
        ("$.nodes[1].descriptor.owner", "extra_forbidden"), ("$.nodes[2].accessor.endpoint", "string_type"),
        ("$.nodes[2].grain.components[0].dataset_columns", "list_type"), ("$.nodes[3].columns[0].name", "missing"),
        ("$.nodes[3].grain", "dict_type"), ("$.logical_identities.key:log.name", "missing"),
        ("$.entity_relationships[1].match_existence", "list_type")}


def test_integrity_finds_each_fault(spark):
    source = obs.catalog()
    by_name = {n["node_id"]: n for n in source["nodes"]}
    log, exposure, camera, field = (by_name[f"obs/{n}"] for n in ("night_log", "exposure", "camera", "field"))
    source["nodes"].append(json.loads(json.dumps(field)))  # node, accessor, columns and definition twice
    camera["entity_definitions"][0]["dataset_columns"] = ["lens", "camera_no"]
    camera["entity_definitions"][1]["dataset_columns"] = ["zenith"]
    exposure["entity_definitions"][0]["identity_id"] = "key:none"
    log["entity_definitions"][1]["conforms"] = False
    log["accessor"]["endpoint"] = "  "
    log["entity_definitions"][2]["entity_universe"] = "most"
    stated = source["entity_relationships"]
    for a, b, m, texts in (("site", "camera", "2:1", ["x", "x"]), ("camera", "site", "1:1", []), ("camera", "moon", "1:1", [" "])):
        stated.append({"endpoints": [obs.key(a), obs.key(b)], "multiplicity": m, "match_existence": ["always", "always"], "descriptions": texts})
    cat = collections.catalog_from_files(spark, parsed(spark, source), "v")
    cat.annotations = spark.createDataFrame([("D1-D2", "", []), ("D1-D2", "", []), ("D3-D7", "", [])], "edge_id string, description string, tags array<string>")
    cat.definitions = cat.definitions.dropDuplicates(["node_id", "identity_id", "dataset_columns"])
    assert {r.rule for r in integrity.integrity(cat).collect()} >= {
        "duplicate_node", "duplicate_accessor", "duplicate_column", "missing_column", "column_list", "unknown_identity",
        "complete_must_conform", "blank", "claim_domain", "endpoints", "duplicate_pair", "descriptions", "grain_definition",
        "duplicate_annotation", "unknown_edge"}
    assert integrity.duplicate_definitions(collections.catalog_from_files(spark, parsed(spark, source), "v")).count() == 1


def test_accessor_warning_and_canonical_json(spark):
    samples = ['{"b":1,"a":{"d":[1,"é\\n"],"c":null}}', '{"z":"\\u00e9","A":true,"a":1.5}']
    got = [r[0] for r in spark.createDataFrame([(s,) for s in samples], "s string").select(canonical_json(F.col("s"))).collect()]
    assert got == [json.dumps(json.loads(s), ensure_ascii=False, separators=(",", ":"), sort_keys=True) for s in samples]
    source = obs.catalog()
    long = source["nodes"][2]["accessor"]
    long["properties"]["long"], long["labels"] = "x" * 300, {"b": "1", "a": 'q"'}
    rows = integrity.accessor_warnings(collections.catalog_from_files(spark, parsed(spark, source), "v")).collect()
    assert [(r.node_id, r.length) for r in rows] == [
        (source["nodes"][2]["node_id"], len(json.dumps(long, ensure_ascii=False, separators=(",", ":"), sort_keys=True)))]


def test_records_and_groups(cat, spark):
    req = spark.createDataFrame([("obs/exposure",), ("nowhere",)], "node_id string")
    rows = {r.status: r for r in projection.dataset_records(cat, req).collect()}
    record, columns = rows["ok"], obs.TABLES["obs/exposure"][0]
    assert [(c.id, c.name) for c in record.columns] == [(obs.column_id("obs/exposure", c), c) for c in columns]
    own = [(f"D{obs.graph().ord[d]}", obs.described("obs/exposure", d.columns[0]), "column") for d in obs.graph().on("obs/exposure")]
    assert [(d.id, d.effective_description, d.description_source) for d in record.entity_definitions] == own
    assert rows["unknown_dataset"].qualified_name is None
    small = projection.dataset_records(cat, req, "essential", {"dataset": ["grain"]})
    assert {"qualified_name", "edge_count", "accessor", "grain", "status"} <= set(small.columns) and "columns" not in small.columns
    with pytest.raises(ValueError):
        projection.chosen_fields("edge", "full", {"edge": ["nope"]})
    assert projection.chosen_fields("dataset", "essential", {"entity_definition": ["total"]})[-1] == "entity_definitions"
    assert "identity_id" in projection.chosen_fields("edge", "essential", paths=True)
    fields = projection.chosen_fields("dataset", "standard")
    flat = projection.flattened(projection.dataset_records(cat, detail="standard"), [f for f in fields if f != "distance"])
    assert "accessor.kind" in flat.columns

    ask = spark.createDataFrame([(1, "obs/camera")], "req_id bigint, node_id string")
    page = relationships.describe_edges(cat, discovery.edge_page(cat, ask))
    groups = {r.identity_id: r.entity_definitions for r in projection.edge_groups(page).collect()}
    first = groups[obs.key("camera")][0]
    expected = sorted([obs.edge("camera", "obs/camera", t) for t in ("obs/exposure", "obs/night_log")], key=lambda e: int(e[-1].split("-D")[1]))
    assert (first.id, first.edge_count, first.truncated) == (f"D{obs.ordinal('obs/camera', 'camera')}", 2, False)
    assert [(e.edge_id, e.multiplicity, e.to_description) for e in first.edges] == [(e[7], e[1], e[6]) for e in expected]
    assert projection.edge_rows(page, "essential").columns == ["req_id", "s_ord", "rank", "edge", "multiplicity", "match_existence", "edge_id"]


def test_entity_relationships_and_paths(cat, spark):
    req = spark.createDataFrame([(1, "key:exposure"), (2, "key:log"), (3, "key:none")], "req_id bigint, identity_id string")
    rows = sorted(relationships.entity_relationships(cat, req).collect(), key=lambda r: (r.req_id, r["rank"] or 0))
    assert [(r.other_id, r.id, r.multiplicity, r.match_existence, r.unknown_fields) for r in rows if r.req_id == 1] == [
        ("key:exposure", "X2", "unknown", "optional", ["multiplicity"]), ("key:field", "X3", "many:1", "unknown", ["match_existence"])]
    assert [(r.status, r.total) for r in rows if r.req_id > 1] == [("ok", 0), ("unknown_identity", 0)]
    req = spark.createDataFrame([(1, "key:camera", "key:exposure"), (2, "key:camera", "key:log")], "req_id bigint, from_identity_id string, to_identity_id string")
    found = paths.entity_paths(cat, req, 2, 4)
    way = ["key:camera", "key:site", "key:field", "key:exposure"]
    assert [(r.req_id, r.ids, r.truncated) for r in found.collect()] == [(1, way, False)]
    steps = sorted(paths.entity_path_steps(cat, found).collect(), key=lambda r: r.step)
    assert [(r.from_id, r.multiplicity, r.id) for r in steps] == [(way[0], "many:1", "X1"), (way[1], "many:many", "X4"), (way[2], "1:many", "X3")]


def start(doc):
    """The exposure's first definition with an edge, and the exposure."""
    exposure = doc["datasets"][1]
    return exposure["edge_groups"][1]["entity_definitions"][0], exposure


#: One fault per rule: what is done to a sound document, how severe that is, and where it must be seen.
FAULTS = [
    ("missing", "error", "$.edge_fields", lambda d: d.pop("edge_fields")),
    ("missing", "error", "$.datasets[2].accessor.endpoint", lambda d: d["datasets"][2]["accessor"].pop("endpoint")),
    ("list_type", "error", "$.datasets[0].columns", lambda d: d["datasets"][0].update(columns="all")),
    ("dict_type", "error", "$.datasets[0].stats", lambda d: d["datasets"][0].update(stats="many")),
    ("dict_type", "error", "$.datasets[2].accessor.properties", lambda d: d["datasets"][2]["accessor"].update(properties=[1])),
    ("dict_type", "error", "$.datasets[2].grain", lambda d: d["datasets"][2].update(grain=5)),
    ("literal_error", "error", "$.datasets[0].usage.role", lambda d: d["datasets"][0]["usage"].update(role="hero")),
    ("edge_fields", "error", "$.edge_fields", lambda d: d.update(edge_fields=d["edge_fields"][:-1] + ["colour"])),
    ("edge_length", "error", None, lambda d: start(d)[0]["edges"][0].pop()),
    ("edge_label", "error", None, lambda d: start(d)[0]["edges"][0].__setitem__(0, "field to exposure")),
    ("edge_start", "error", None, lambda d: start(d)[0].update(dataset_columns=["taken_at"])),
    ("edge_key", "error", None, lambda d: start(d)[0]["edges"][0].__setitem__(7, "D9-D4")),
    ("usage_key", "error", None, lambda d: start(d)[0].update(usage={"D1-D2": {"note": "other"}})),
    ("not_an_endpoint", "error", None, lambda d: start(d)[0]["usage"][start(d)[0]["edges"][0][7]].update(keep=["obs/camera"])),
    ("dangling_reference", "warning", None, lambda d: d["datasets"].pop(2)),
    ("dangling_reference", "warning", "$.gaps['unseen'].datasets[0]", lambda d: d["gaps"]["unseen"].update(datasets=["obs/moon"])),
    ("unlisted_column", "warning", "$.datasets['obs/exposure'].usage.columns['exposure_no']", lambda d: d["datasets"][1]["columns"].pop(0)),
    ("unknown_key", "info", "$.datasets[0].altitude", lambda d: d["datasets"][0].update(altitude=1)),
    ("duplicate_dataset", "error", "$.datasets[2]", lambda d: d["datasets"][2].update(node_id="obs/field")),
]


def test_document_checks(spark):
    rows = [(0, json.dumps(obs.document())), (99, "{")]
    for i, (*_, change) in enumerate(FAULTS, 1):
        doc = obs.document()
        change(doc)
        rows.append((i, json.dumps(doc)))
    docs = spark.createDataFrame(rows, "doc_id bigint, payload string").cache()
    checked = cut(documents.check_documents(docs))
    found = checked.collect()
    assert not [f for f in found if f.doc_id == 0], [f for f in found if f.doc_id == 0]
    assert [f.rule for f in found if f.doc_id == 99] == ["parse_error"]
    for i, (rule, severity, location, _) in enumerate(FAULTS, 1):
        own = [f for f in found if f.doc_id == i]
        assert any(f.rule == rule and f.severity == severity and location in (None, f.location) for f in own), (rule, location, own)
    gone = 1 + next(i for i, f in enumerate(FAULTS) if f[0] == "dangling_reference")
    final = documents.check_references(docs.where(f"doc_id = {gone}"), final=True).collect()
    assert {f.severity for f in final if f.rule == "dangling_reference"} == {"error"}
    ready = {r.doc_id: r.finalisable for r in documents.finalisable(docs, checked).collect()}
    assert ready[0] and ready[gone] and not ready[1] and not ready[99]


def test_documents_against_catalog(spark, cat):
    differing = [
        ("graph_mismatch", ".multiplicity", lambda d: start(d)[0]["edges"][0].__setitem__(1, "1:1")),
        ("graph_mismatch", ".id", lambda d: start(d)[0].update(id="D9")),
        ("unknown_element", "moon']", lambda d: d["datasets"][2].update(node_id="obs/moon")),
        ("graph_mismatch", "columns['field_no'].description", lambda d: d["datasets"][0]["columns"][0].update(description="else")),
        ("unknown_element", "columns['nope']", lambda d: d["datasets"][0]["columns"][1].update(name="nope")),
        ("graph_mismatch", ".descriptor.tags", lambda d: d["datasets"][2]["descriptor"].update(tags=[])),
        ("graph_mismatch", ".accessor.properties", lambda d: d["datasets"][2]["accessor"].update(properties={"layout": "flat"})),
        ("graph_mismatch", ".grain", lambda d: d["datasets"][2].update(grain={"components": []})),
        ("graph_mismatch", "$.graph.snapshot.api_version", lambda d: d.update(graph={"snapshot": {"api_version": "1", "version": obs.VERSION}})),
        ("unknown_element", "entity_definitions[['taken_at']]", lambda d: start(d)[0].update(dataset_columns=["taken_at"])),
        ("unknown_element", "edges['D1-D9']", lambda d: start(d)[0]["edges"][0].__setitem__(7, "D1-D9")),
    ]
    served = obs.document()  # as the catalog serves it: defaults written out
    served["datasets"][2]["grain"] = {"description": "", "components": [
        {"dataset_columns": ["camera_no"], "identity_id": "key:camera", "description": ""}]}
    rows = [(0, served)]
    for i, (*_, change) in enumerate(differing, 1):
        doc = obs.document()
        change(doc)
        rows.append((i, doc))
    docs = spark.createDataFrame([(i, json.dumps(d)) for i, d in rows], "doc_id bigint, payload string")
    found = documents.resolve_documents(docs, cat).collect()
    assert not [f for f in found if f.doc_id == 0], [f for f in found if f.doc_id == 0]
    for i, (rule, end, _) in enumerate(differing, 1):
        own = [f for f in found if f.doc_id == i]
        assert any(f.rule == rule and f.location.endswith(end) for f in own), (rule, end, own)


def test_document_rendering_parts(spark):
    doc, other = obs.document(), obs.document()
    other["datasets"][1]["qualified_name"] = "archive.field"
    del other["datasets"][2]
    docs = spark.createDataFrame([(1, json.dumps(doc)), (2, json.dumps(other))], "doc_id bigint, payload string")
    names = {(r.doc_id, r.node_id): r.alias for r in documents.aliases(docs).collect()}
    assert names[(1, "obs/field")] == "field" and names[(2, "obs/field")] == "obs.field" and names[(2, "obs/exposure")] == "archive.field"
    said = {r.edge_id: (r.forward, r.backward) for r in documents.edge_sentences(docs.where("doc_id = 1")).collect()}
    assert len(said) == 2 and all("exposure" in a and "exposure" in b for a, b in said.values())
    assert {r.doc_id: r.components for r in documents.component_counts(docs).collect()} == {1: 1, 2: 1}


def test_measured_claims(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (None, 3), (4, 4)], "a int, b int")
    pop = spark.createDataFrame([(1,), (2,), (3,), (4,)], "k int")
    assert tuple(measure.measure_key(df, ["a"]).first())[1:] == (2, 1, False, False)
    key = measure.measure_key(df, ["b"]).first()
    assert key.unique and key.total
    a = measure.measure_containment(df, ["a"], pop, ["k"]).first()
    assert (a.conforms, a.entity_universe, a.absent_count) == (True, "partial", 2)
    assert measure.measure_containment(df, ["b"], pop, ["k"]).first().entity_universe == "complete"
    e = measure.containment_evidence(df, ["a"], pop, ["k"]).first()
    assert (e.shared_count, e.left_only_count, e.right_only_count, e.conflict_if_complete) == (2, 0, 2, True)


def test_measured_catalog_matches_brute_force(spark):
    from itertools import combinations

    from kinweave.operators import measure

    rows = {"a": [(i % 5, "x" if i % 3 else None) for i in range(20)] + [(None, "y"), (0, "x")] * 3, "b": [(i, "x") for i in range(3, 9)], "c": []}
    tables = {name: spark.createDataFrame(held, "k int, t string") for name, held in rows.items()}
    wanted = [measure.Measured("a", ("k",), "e"), measure.Measured("b", ("k",), "e"), measure.Measured("c", ("k",), "e"),
              measure.Measured("a", ("k", "t"), "f"), measure.Measured("b", ("k", "t"), "f"), measure.Measured("a", ("t",), "g")]
    each, pairs = measure.measure_catalog(tables, wanted)

    def keys(d):
        at = [("k", "t").index(c) for c in d.columns]
        return [tuple(r[i] for i in at) for r in rows[d.table]]

    whole = {d: [k for k in keys(d) if None not in k] for d in wanted}
    assert {tuple(r) for r in each.collect()} == {
        (d.name, d.entity, len(keys(d)), len(set(whole[d])), len(keys(d)) - len(whole[d]), len(set(whole[d])) == len(whole[d]), len(whole[d]) == len(keys(d)))
        for d in wanted}
    expected = set()
    for a, b in combinations(wanted, 2):
        if a.entity == b.entity:
            x, y = set(whole[a]), set(whole[b])
            expected.add((a.entity, a.name, b.name, len(x & y), len(x - y), len(y - x), x <= y, y <= x, x != y))
    assert {tuple(r) for r in pairs.collect()} == expected
    assert measure.measure_catalog({"a": tables["a"]}, wanted[:1])[1].count() == 0


def test_relationship_pages_need_no_index(spark):
    from kinweave import Catalog

    pairs = [(f"a{i % 4}", f"b{i:02d}") for i in range(30)] + [("a0", "a0"), ("b01", "a1")]  # a self pair, and a pair stated from both ends
    stated = spark.createDataFrame([(x, y, "1:many", "always", "optional", ["t"]) for x, y in pairs], "left_id string, right_id string, multiplicity string, me_left string, me_right string, descriptions array<string>")
    names = spark.createDataFrame([(n, n.upper()) for n in sorted({x for p in pairs for x in p})], "identity_id string, name string")
    place = {p: f"X{i}" for i, p in enumerate(sorted(pairs), 1)}
    ends = [(x, y, place[x, y], "1:many") for x, y in pairs] + [(y, x, place[x, y], "many:1") for x, y in pairs if x != y]
    for block_rows in (2, 1000):
        for offset, limit in ((0, 3), (3, 4), (7, 100)):
            cat = Catalog(spark, block_rows=block_rows, identities=names, entity_relationships=stated)
            asked = spark.createDataFrame([(i, f"a{i}") for i in range(5)], "req_id bigint, identity_id string")
            got = relationships.entity_relationships(cat, asked, offset, limit).collect()
            for i in range(5):
                own = sorted((e[1], e[2], e[3]) for e in ends if e[0] == f"a{i}")
                rows = [r for r in got if r.req_id == i]
                assert {(r.status, r.total) for r in rows} == {("ok" if i < 4 else "unknown_identity", len(own))}
                shown = [r for r in rows if r["rank"] is not None]
                assert sorted(r["rank"] for r in shown) == [n + 1 for n in range(len(own))][offset:offset + limit]
                assert [r.other_id for r in sorted(shown, key=lambda r: r["rank"])] == [o for o, _, _ in own][offset:offset + limit]
                assert {(r.other_id, r.id, r.multiplicity) for r in shown} <= set(own)
            assert not {"members", "entities", "entity_ordinals"} & set(vars(cat))
    bare = relationships.entity_relationships(cat, asked, 0, 3, with_ids=False).collect()
    assert {r.id for r in bare} == {None} and max(r["rank"] or 0 for r in bare) == 3


def test_measured_keys_keep_their_types(spark, monkeypatch):
    from kinweave.operators import measure

    tables = {"a": spark.createDataFrame([(1, 7), (2, 7), (2, None)], "k int, n int"), "b": spark.createDataFrame([(2, "7"), (3, "x")], "k bigint, n string")}
    wanted = [measure.Measured(t, c, e) for c, e in ((("k",), "e"), (("n",), "g"), (("k", "n"), "h")) for t in "ab"]
    planned = []
    monkeypatch.setattr(measure, "cut", lambda df: planned.append(df) or df)
    each, pairs = measure.measure_catalog(tables, wanted)
    got = {(r.entity, r.shared_count, r.left_only_count, r.right_only_count) for r in pairs.collect()}
    assert got == {("e", 1, 1, 1), ("g", 1, 0, 1), ("h", 1, 1, 1)}  # whole numbers meet whole numbers, and text as text
    assert {(r.definition, r.record_count, r.key_count, r.null_count) for r in each.collect()} == {
        ("a:k", 3, 2, 0), ("b:k", 2, 2, 0), ("a:n", 3, 1, 1), ("b:n", 2, 2, 0), ("a:k,n", 3, 2, 1), ("b:k,n", 2, 2, 0)}
    plan = planned[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "array(cast(" not in plan  # no row per definition, no list of texts as a key


def test_stored_tables_keep_rows_and_ordinals(spark):
    """Rows come back from columns below the checkpoint folder, in compressed form, with their ordinals."""
    from pyspark.sql import functions as F

    from kinweave.plans.lineage import stored
    from kinweave.plans.ordinals import dense_ordinal

    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("id"), F.lit("x" * 200).alias("t"), F.parse_json(F.lit('{"a":[1]}')).alias("v"))
    kept = stored(rows)
    assert kept.columns == rows.columns and kept.where("to_json(v) = '{\"a\":[1]}'").count() == 5000
    assert all("/stored-" in name for name in kept.inputFiles())
    assert dense_ordinal(rows.select("id", "t").repartition(9), ["id"]).where("ord <> id + 1").count() == 0


def test_documents_are_walked_without_a_table_per_level(spark, monkeypatch):
    """Only findings are materialised, however deep a document nests."""
    made = []
    cut = documents.cut
    monkeypatch.setattr(documents, "cut", lambda df: made.append(df.columns) or cut(df))
    docs = spark.createDataFrame([(1, '{"status":"draft","question":"q","edge_fields":["edge","edge_id"],"datasets":[{"node_id":7}],"odd":1}')], "doc_id int, payload string")
    errors, unknown = documents._walk(documents._parse(docs))
    assert made == [["doc_id", "location", "rule", "severity", "message"]]
    assert {(r.location, r.rule) for r in errors.collect()} == {
        ("$.datasets[0].node_id", "string_type"), ("$.datasets[0].qualified_name", "missing"), ("$.datasets[0].accessor", "missing")}
    assert [(r.location, r.rule) for r in unknown.collect()] == [("$.odd", "unknown_key")]


def test_a_changed_row_is_fingerprinted_in_the_same_pass(cat, spark):
    first = F.col("node_id") == cat.definitions.agg(F.min("node_id")).first()[0]
    other = Catalog(spark, datasets=cat.datasets, columns=cat.columns, identities=cat.identities, entity_relationships=cat.entity_relationships,
                    annotations=cat.annotations, definitions=cat.definitions.withColumn("entity_universe", F.when(first, "other").otherwise(F.col("entity_universe"))))
    before, after = (dict(tuple(r) for r in c.fingerprint().collect()) for c in (cat, other))
    both = cat.fingerprint({"definitions": (first, {"entity_universe": F.lit("other")})}).collect()
    assert {r.table_name: r.fingerprint for r in both} == before and {r.table_name: r.changed_fingerprint for r in both} == after
    assert [name for name in before if before[name] != after[name]] == ["definitions"]
    none = cat.fingerprint({"definitions": (F.lit(None).cast("boolean"), {"entity_universe": F.lit("other")})}).collect()
    assert all(r.fingerprint == r.changed_fingerprint == before[r.table_name] for r in none)
