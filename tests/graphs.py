"""Small random membership graphs and a plain-Python reading of every pair of them."""

from __future__ import annotations

import itertools
import random
from collections import namedtuple

from kinweave import Catalog
from kinweave.catalog import DEFINITIONS

Def = namedtuple("Def", "node entity columns universe unique total conforms")


def random_definitions(seed, nodes=9, entities=5, count=24):
    rng = random.Random(seed)
    keys = set()
    while len(keys) < count:
        # A third of all definitions fall on one entity.
        entity = 0 if rng.random() < 0.33 else rng.randrange(entities)
        keys.add((f"n{rng.randrange(nodes)}", f"e{entity}", (f"c{rng.randrange(3)}",)))
    rows = []
    for node, entity, columns in sorted(keys):
        universe = rng.choice(["complete", "partial", "unknown"])
        conforms = rng.choice([True, None]) if universe == "complete" else rng.choice([True, False, None])
        rows.append(Def(
            node, entity, columns, universe, rng.choice([True, False, None]), rng.choice([True, False, None]), conforms,
        ))
    return rows


def catalog_of(spark, defs, block_rows=3, nodes=None, **tables):
    rows = [
        (d.node, i, d.entity, list(d.columns), d.universe, d.unique, d.total, d.conforms, None, None, None)
        for i, d in enumerate(defs)
    ]
    rng = random.Random(1)
    rng.shuffle(rows)
    names = sorted({d.node for d in defs} | set(nodes or ()))
    entities = sorted({d.entity for d in defs})
    tables.setdefault("datasets", spark.createDataFrame([(n,) for n in names], "node_id string"))
    tables.setdefault("identities", spark.createDataFrame([(e, e.upper()) for e in entities], "identity_id string, name string"))
    return Catalog(
        spark, block_rows=block_rows, definitions=spark.createDataFrame(rows, DEFINITIONS), **tables
    )


class Graph:
    """Every definition with its ordinal, and every directed edge."""

    def __init__(self, defs):
        self.defs = sorted(defs, key=lambda d: (d.node, d.entity, d.columns))
        self.ord = {d: i for i, d in enumerate(self.defs, 1)}
        self.by_ord = {i: d for d, i in self.ord.items()}
        self.nodes = sorted({d.node for d in defs})

    def on(self, node):
        return [d for d in self.defs if d.node == node]

    def edges_from(self, definition):
        return [t for t in self.defs if t.entity == definition.entity and t != definition]

    def pairs(self):
        return [(a, b) for a, b in itertools.combinations(self.defs, 2) if a.entity == b.entity]

    def neighbours(self, node):
        return {t.node for d in self.on(node) for t in self.edges_from(d)}

    def distances(self, seeds, depth):
        found = {s: 0 for s in seeds}
        layer = set(seeds)
        for level in range(1, depth + 1):
            layer = {t for n in layer for t in self.neighbours(n)} - set(found)
            found.update(dict.fromkeys(layer, level))
        return found


def multiplicity(s, t):
    if s.unique is None or t.unique is None:
        return "unknown"
    return f"{'1' if s.unique else 'many'}:{'1' if t.unique else 'many'}"


def existence(s, t):
    inside = None
    if (s.universe == "complete" or s.conforms is True) and t.universe == "complete":
        inside = True
    elif s.universe == "complete" and t.universe == "partial":
        inside = False
    if s.total is False or inside is False:
        return "optional"
    return "always" if s.total and inside else "unknown"
