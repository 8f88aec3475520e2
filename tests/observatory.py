"""A small observatory: who points which camera at which field, and what the night logs say.

Expected ordinals, edges and claims are not written down; they are read off the catalog by the plain
Python of ``tests.graphs``.
"""

from __future__ import annotations

from tests.graphs import Def, Graph, existence, multiplicity

VERSION = "2026-03-01T22:15:00Z"

#: dataset: columns, then its definitions as (entity, column, universe, unique, total, conforms), and its grain
TABLES = {
    "obs/night_log": (
        ("log_no", "note", "site_code", "camera_no"),
        [("log", "log_no", "complete", True, True, True), ("site", "site_code", "complete", False, True, True),
         ("camera", "camera_no", "unknown", False, False, None)],
        None,
    ),
    "obs/exposure": (
        ("exposure_no", "taken_at", "camera_no", "field_no"),
        [("exposure", "exposure_no", "unknown", True, True, None), ("camera", "camera_no", "partial", False, True, True),
         ("field", "field_no", "partial", False, False, True)],
        ("exposure", "exposure_no"),
    ),
    "obs/camera": (
        ("camera_no", "site_code", "lens"),
        [("camera", "camera_no", "complete", True, True, True), ("site", "site_code", "partial", False, True, None)],
        ("camera", "camera_no"),
    ),
    "obs/field": (("field_no", "declination"), [("field", "field_no", "complete", True, True, True)], ("field", "field_no")),
}
STATED = [
    ("camera", "site", "many:1", "always", "unknown", ["Cameras stand at sites."]),
    ("exposure", "exposure", "unknown", "optional", "optional", ["An exposure repeats another.", "Exposures are stacked."]),
    ("exposure", "field", "many:1", "unknown", "optional", ["tbd"]),
    ("field", "site", "many:many", "optional", "always", ["Fields rise over sites."]),
]


def key(entity):
    return f"key:{entity}"


def described(dataset, column):
    return "" if column == "lens" else "N/A" if column == "note" else f"{column} as {dataset.split('/')[1]} records it"


def accessor(dataset):
    return {"kind": "parquet", "endpoint": f"/data/{dataset}", "properties": {"layout": "hive", "table": dataset[4:]}}


def descriptor(dataset):
    return {"display_name": dataset[4:], "description": f"Rows of {dataset}.", "synonyms": [dataset[4:].upper()], "tags": ["night"]}


def catalog():
    def tri(value):
        return "unknown" if value is None else value

    nodes = []
    for name, (columns, definitions, grain) in TABLES.items():
        nodes.append({
            "node_id": name,
            "descriptor": {"qualified_name": name.replace("/", "."), **descriptor(name)},
            "accessor": accessor(name),
            "grain": {"components": [{"identity_id": key(grain[0]), "dataset_columns": [grain[1]]}]} if grain else "unknown",
            "columns": [{"name": c, "description": described(name, c)} for c in columns],
            "entity_definitions": [
                {"identity_id": key(e), "dataset_columns": [c], "entity_universe": u, "unique": tri(a), "total": tri(b), "conforms": tri(x),
                 "entity_expression": [f"trim([{c}])" if e == "site" else f"[{c}]"], "entity_metadata": {"origin": name}}
                for e, c, u, a, b, x in definitions],
        })
    entities = sorted({e for _, ds, _ in TABLES.values() for e, *_ in ds})
    return {
        "schema_version": "1", "nodes": nodes,
        "logical_identities": {key(e): {"name": f"{e} key", "description": f"Names one {e}."} for e in entities},
        "entity_relationships": [
            {"endpoints": [key(a), key(b)], "multiplicity": m, "match_existence": [x, y], "descriptions": texts} for a, b, m, x, y, texts in STATED],
    }


def graph():
    return Graph([Def(name, key(e), (c,), *claims) for name, (_, ds, _) in TABLES.items() for e, c, *claims in ds])


def edges():
    g = graph()
    return {
        f"D{g.ord[a]}-D{g.ord[b]}": (multiplicity(a, b), existence(a, b), multiplicity(b, a), existence(b, a)) for a, b in g.pairs()}


def ordinal(dataset, entity):
    g = graph()
    return next(i for d, i in g.ord.items() if d.node == dataset and d.entity == key(entity))


def column_id(dataset, column):
    names = sorted((d, c) for d, (columns, _, _) in TABLES.items() for c in columns)
    return f"C{names.index((dataset, column)) + 1}"


FIELDS = ["edge", "multiplicity", "match_existence", "reverse_multiplicity", "reverse_match_existence", "from_description", "to_description", "edge_id"]


def edge(entity, source, target):
    """An edge of a document, from dataset ``source`` to ``target``."""
    g = graph()
    s, t = (g.by_ord[ordinal(d, entity)] for d in (source, target))
    low, high = sorted((g.ord[s], g.ord[t]))
    return [
        f"{source}[{s.columns[0]}] -> {target}[{t.columns[0]}]", multiplicity(s, t), existence(s, t), multiplicity(t, s), existence(t, s),
        described(source, s.columns[0]), described(target, t.columns[0]), f"D{low}-D{high}"]


def document():
    """A sound document: exposures per field and camera, and what is not known about them."""

    def part(name, columns, usage, groups=()):
        out = {
            "node_id": name, "qualified_name": name.replace("/", "."), "accessor": accessor(name), "descriptor": descriptor(name), "usage": usage,
            "columns": [{"id": column_id(name, c), "name": c, "description": described(name, c)} for c in columns],
        }
        if groups:
            out["edge_groups"] = [
                {"identity_id": key(e), "entity_definitions": [{
                    "id": f"D{ordinal(name, e)}", "dataset_columns": [c], "edges": [edge(e, name, target)],
                    **({"usage": {edge(e, name, target)[-1]: {"keep": [target], "note": "also those without exposures"}}} if e == "field" else {})}]}
                for e, c, target in groups]
        return out

    return {
        "status": "draft", "question": "How many exposures does each field have, by camera?", "edge_fields": FIELDS,
        "datasets": [
            part("obs/field", ["field_no", "declination"], {"role": "grouping", "columns": {"declination": {"as": "group"}}}),
            part("obs/exposure", ["exposure_no", "field_no"], {"role": "anchor", "columns": {"exposure_no": {"as": "count"}}},
                 [("camera", "camera_no", "obs/camera"), ("field", "field_no", "obs/field")]),
            part("obs/camera", ["camera_no"], {"role": "bridge"}),
        ],
        "gaps": {"unseen": {"description": "Fields without exposures are not listed anywhere.", "datasets": ["obs/field"]}},
    }
