"""Exact near-duplicate vectors with cover trees and a dual traversal.

Vectors of length one are at Euclidean distance sqrt(2 - 2 cosine), so a cosine threshold is a radius e.

1. Vectors go to the nearest of some chosen ones, and homes of many vectors are dealt into blocks by hash,
   so no block grows with a group of near copies.
2. Each block becomes a tree of nested levels with halving radii (1, 1/2, 1/4, ...), from the first that is at
   most 2 e: the vectors of a node are covered by centres among them, each of which becomes a child with what
   it covers. A node knows its covering radius and the range of its vectors, which are stored in the order of
   the tree. Levels above would join vectors that only other directions are farther from.
3. Blocks are balls as well: two meet in a task only if their balls come within e of one another.
4. The task walks both trees at once. A pair of nodes with centres further apart than both radii and e holds
   no link and is dropped; one whose farthest vectors are within e links all of its pairs without looking at
   them; of the rest the wider node is replaced by its children, until a few vectors are compared in double
   precision.
5. Links become connected components. Link counts and spanning edges leave a task, never all pairs.

Vectors without direction in common (random ones in many dimensions) are far apart at the first level
already, where nothing but their distances tells them apart: then every two blocks meet.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from kinweave.llm.common import small
from kinweave.llm.components import components
from kinweave.llm.shared_keys import starts_of
from kinweave.llm.token_codes import shared_folder
from kinweave.plans.lineage import cut
from kinweave.plans.shipping import ship_by_value

ship_by_value(__name__)

BLOCK = 8192  # vectors of a tree, about
LEAF = 64  # vectors of a node that is not split
SPARSE = 64  # pairs of vectors of two nodes that are listed together with those of other nodes
DENSE = 1 << 20  # pairs of vectors that are compared at once rather than by the nodes' children
SLACK = 1e-6  # of distances, for rounding; what is within it is compared itself
HOMES, PORTION = 4096, 32 << 20
PACKED = "rid bigint, vec_id bigint, dim int, data binary"
TREE = "block bigint, dim int, n int, radius double, middle binary, rids binary, data binary, nodes binary"


def unit_rows(raw: np.ndarray) -> np.ndarray:
    """Rows in double precision and of length one."""
    x = raw.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _packed(kind: str):
    """Vectors as bytes; those without a direction get dimension 0 and no bytes."""

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_iter:
            column = batch.column(2)
            at = column.offsets.to_numpy().astype(np.int64)
            values = np.ascontiguousarray(column.values.fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(kind))
            running = lambda flags: np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[at]
            bad = np.diff(running(~np.isfinite(values))) > 0
            some = np.diff(running(values != 0)) > 0
            dim = np.where(some & ~bad & column.is_valid().to_numpy(zero_copy_only=False), np.diff(at), 0)
            data, width = values.tobytes(), values.itemsize
            yield pa.RecordBatch.from_pydict({
                "rid": batch.column(0), "vec_id": batch.column(1), "dim": pa.array(dim, pa.int32()),
                "data": pa.array([data[a * width : b * width] if d else None for a, b, d in zip(at.tolist(), at[1:].tolist(), dim.tolist())], pa.binary())})

    return run


def _matrix(data: list[bytes], dim: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(data), dtype=kind).reshape(-1, dim)


def _homes(centres: dict[int, np.ndarray], kind: str):
    """Every vector with the nearest of the chosen ones of its dimension, or -1."""

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_iter:
            dims, data = batch.column(1).to_numpy(), batch.column(2).to_pylist()
            home = np.full(len(dims), -1, dtype=np.int32)
            for dim in np.unique(dims).tolist():
                if dim in centres:
                    rows = np.flatnonzero(dims == dim)
                    x = unit_rows(_matrix([data[i] for i in rows.tolist()], dim, kind)).astype(np.float32)
                    for part in np.array_split(np.arange(len(rows)), -(-len(rows) // 2048)):
                        home[rows[part]] = (x[part] @ centres[dim].T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home)], names=[*batch.schema.names, "home"])

    return run


def _net(x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """(centres, owner): chosen rows of ``x`` further than ``radius`` apart, and for each row one within it."""
    least = 1 - radius * radius / 2
    owner, centres, left = np.zeros(len(x), dtype=np.int64), [], np.arange(len(x))
    while len(left):
        head = left[:256]
        close = x[head] @ x[head].T >= least
        chosen, covered = [], np.zeros(len(head), dtype=bool)
        for i in range(len(head)):
            if not covered[i]:
                chosen.append(i)
                covered |= close[i]
        near = x[left] @ x[head[chosen]].T
        best = near.argmax(axis=1)
        inside = near[np.arange(len(left)), best] >= least
        inside[chosen], best[chosen] = True, np.arange(len(chosen))  # a centre covers itself whatever rounding says
        owner[left[inside]] = len(centres) + best[inside]
        centres += head[chosen].tolist()
        left = left[~inside]
    return np.array(centres, dtype=np.int64), owner


@dataclass
class Tree:
    """Vectors in the order of the tree, and its nodes; the first ``top`` nodes are the first level, single vectors last."""

    x: np.ndarray
    rids: np.ndarray
    nodes: np.ndarray  # centre, radius, low, high, first child, children

    def __post_init__(self) -> None:
        self.centre, self.low, self.high, self.child, self.children = (self.nodes[:, i].astype(np.int64) for i in (0, 2, 3, 4, 5))
        self.radius = self.nodes[:, 1]
        self.top = int(np.argmax(self.high == len(self.x))) + 1  # the first level comes first and ends with the last vector
        self.several = int((self.high - self.low > 1)[: self.top].sum())


def grown(raw: np.ndarray, rids: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """(order, nodes) of the tree over some vectors."""
    x = unit_rows(raw)
    x32 = x.astype(np.float32)
    order, nodes = np.arange(len(x)), []

    def split(low: int, high: int, radius: float) -> int:
        """Appends the children of a range, larger ones first; how many."""
        rows = order[low:high].copy()
        centres, owner = _net(x32[rows], radius)
        sizes = np.bincount(owner)
        rank = np.argsort(-sizes, kind="stable")
        place = np.empty(len(rank), dtype=np.int64)
        place[rank] = np.arange(len(rank))
        order[low:high] = rows[np.argsort(place[owner], kind="stable")]
        ends = low + np.cumsum(sizes[rank])
        for c, a, b in zip(rows[centres[rank]].tolist(), (ends - sizes[rank]).tolist(), ends.tolist()):
            away = 0.0 if b - a == 1 else math.sqrt(max(0.0, 2 - 2 * float((x[order[a:b]] @ x[c]).min())))
            nodes.append([c, away, a, b, 0, 0, radius / 2])
        return len(rank)

    split(0, len(x), min(1.0, 2.0 ** math.floor(math.log2(2 * reach))))
    i = 0
    while i < len(nodes):
        _, away, low, high, _, _, radius = nodes[i]
        while away <= radius and radius >= reach / 8:
            radius /= 2
        if high - low > LEAF and radius >= reach / 8:
            nodes[i][4] = len(nodes)
            nodes[i][5] = split(low, high, radius)
        i += 1
    found = np.array([n[:6] for n in nodes], dtype=np.float64)
    position = np.empty(len(x), dtype=np.int64)
    position[order] = np.arange(len(x))
    found[:, 0] = position[found[:, 0].astype(np.int64)]
    return order, found


def _trees(kind: str, reach: float):
    """One row per block; rows come block by block."""

    def tree(rows: list[tuple]) -> dict:
        block, dim = rows[0][0], rows[0][1]
        raw, rids = _matrix([r[3] for r in rows], dim, kind), np.array([r[2] for r in rows], dtype=np.int64)
        order, nodes = grown(raw, rids, reach)
        x = unit_rows(raw)
        middle = x.mean(axis=0)
        return {"block": block, "dim": dim, "n": len(rows), "radius": float(np.sqrt(((x - middle) ** 2).sum(axis=1)).max()),
                "middle": middle.astype("<f8").tobytes(), "rids": rids[order].astype("<i8").tobytes(),
                "data": np.ascontiguousarray(raw[order]).tobytes(), "nodes": nodes.astype("<f8").tobytes()}

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("n", pa.int32()), ("radius", pa.float64()), *[
            (c, pa.binary()) for c in ("middle", "rids", "data", "nodes")]])
        held: list[tuple] = []
        for batch in batch_iter:
            columns = [c.to_pylist() for c in batch.columns]
            bounds = [*starts_of(batch.column(0).to_numpy()).tolist(), batch.num_rows] if batch.num_rows else []
            for a, b in zip(bounds, bounds[1:]):
                if held and held[0][0] != columns[0][a]:
                    yield pa.RecordBatch.from_pylist([tree(held)], schema=schema)
                    held = []
                held += zip(*[c[a:b] for c in columns])
        if held:
            yield pa.RecordBatch.from_pylist([tree(held)], schema=schema)

    return run


def _meeting(blocks: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], reach: float):
    """(a, b): blocks whose balls come within ``reach``, each pair once. Which one comes first is mixed, so that none is first in all."""

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_iter:
            first, second = [], []
            for r in batch.to_pylist():
                if r["dim"] not in blocks:
                    continue
                ids, middles, radii = blocks[r["dim"]]
                away = np.sqrt(((middles - np.frombuffer(r["middle"], "<f8")) ** 2).sum(axis=1))
                near = ids[(away <= radii + r["radius"] + reach + SLACK) & (ids >= r["block"])]
                swap = (near ^ r["block"]) & 1 == 1
                first += np.where(swap, near, r["block"]).tolist()
                second += np.where(swap, r["block"], near).tolist()
            yield pa.RecordBatch.from_pydict({"a": pa.array(first, pa.int64()), "b": pa.array(second, pa.int64())})

    return run


class Links:
    """Link counts of the vectors of two trees, and which of them are connected."""

    def __init__(self, n: int):
        self.counts, self.label = np.zeros(n, dtype=np.int64), np.arange(n)

    def connect(self, u: np.ndarray, v: np.ndarray) -> None:
        label = self.label
        while True:
            open_ = np.flatnonzero(label[u] != label[v])
            if not len(open_):
                return
            u, v = u[open_], v[open_]
            p, q = label[u], label[v]
            low = np.minimum(p, q)
            np.minimum.at(label, p, low)
            np.minimum.at(label, q, low)
            while (further := label[label]).tobytes() != label.tobytes():
                label[:] = further

    def pairs(self, u: np.ndarray, v: np.ndarray) -> None:
        self.counts += np.bincount(u, minlength=len(self.counts)) + np.bincount(v, minlength=len(self.counts))
        self.connect(u, v)


def traverse(a: Tree, b: Tree, cosine: float) -> Links:
    """All links between two trees, or within one given twice. Vectors of ``b`` are numbered after those of ``a``."""
    same = a is b
    reach, shift = math.sqrt(2 - 2 * cosine), 0 if same else len(a.x)
    links = Links(len(a.x) + (0 if same else len(b.x)))
    a32, b32 = a.x.astype(np.float32), b.x.astype(np.float32)

    def compared(a0: int, a1: int, b0: int, b1: int, itself: bool) -> None:
        step = max(1, (1 << 20) // (b1 - b0))
        for r in range(a0, a1, step):
            close = a.x[r : min(r + step, a1)] @ b.x[b0:b1].T >= cosine
            u, v = np.nonzero(close)
            u, v = u + r, v + b0
            if itself:
                u, v = u[u < v], v[u < v]
            else:
                links.counts[r : r + len(close)] += close.sum(axis=1)
                links.counts[shift + b0 : shift + b1] += close.sum(axis=0)
            if itself:
                links.pairs(u, v)
            else:
                links.connect(u, v + shift)

    def linked(a0: int, a1: int, b0: int, b1: int, itself: bool) -> None:
        left, right = np.arange(a0, a1), np.arange(b0, b1) + shift
        if itself:
            links.counts[left] += len(left) - 1
        else:
            links.counts[left] += len(right)
            links.counts[right] += len(left)
            links.connect(np.full(len(right), left[0]), right)
        links.connect(np.full(len(left), left[0]), left)

    def listed(p: np.ndarray, q: np.ndarray, itself: np.ndarray) -> None:
        """Pairs of small nodes, all at once."""
        wide, high = (b.high - b.low)[q], (a.high - a.low)[p]
        n = wide * high
        for part in np.array_split(np.arange(len(p)), -(-int(n.sum()) // 65_536)):
            each = np.repeat(part, n[part])
            k = np.arange(len(each)) - np.repeat(np.cumsum(n[part]) - n[part], n[part])
            u, v = a.low[p[each]] + k // wide[each], b.low[q[each]] + k % wide[each]
            keep = ~itself[each] | (u < v)
            u, v = u[keep], v[keep]
            close = np.einsum("ij,ij->i", a.x[u], b.x[v]) >= cosine
            links.pairs(u[close], v[close] + shift)

    # Single vectors against single vectors: one product, nothing to descend into.
    first_a, first_b = (int(t.low[t.several]) if t.several < t.top else len(t.x) for t in (a, b))
    for r in range(first_a, len(a.x), 1024):
        start = r if same else first_b
        u, v = np.nonzero(a32[r : r + 1024] @ b32[start:].T >= np.float32(cosine - 1e-4))
        u, v = u + r, v + start
        if same:
            u, v = u[u < v], v[u < v]
        exact = np.einsum("ij,ij->i", a.x[u], b.x[v]) >= cosine
        links.pairs(u[exact], v[exact] + shift)
    # Nodes of several vectors against all, and single ones against those.
    frontier: list[tuple[np.ndarray, np.ndarray]] = []
    for (a0, a1), (b0, b1) in (((0, a.several), (0, b.top)), ((a.several, a.top), (0, 0 if same else b.several))):
        for r in range(a0, a1, 1024):
            rows = slice(r, min(r + 1024, a1))
            wide = np.minimum(a.radius[rows, None] + b.radius[None, b0:b1] + reach, 2).astype(np.float32)
            u, v = np.nonzero(a32[a.centre[rows]] @ b32[b.centre[b0:b1]].T >= 1 - wide * wide / 2 - np.float32(1e-4))
            u, v = u + r, v + b0
            frontier.append((u[u <= v], v[u <= v]) if same else (u, v))
    while frontier:
        i, j = frontier.pop()
        if len(i) > 65_536:
            half = len(i) // 2
            frontier += [(i[:half], j[:half]), (i[half:], j[half:])]
            continue
        dots = np.einsum("ij,ij->i", a.x[a.centre[i]], b.x[b.centre[j]])
        itself = (i == j) & same
        away = np.where(itself, 0, np.sqrt(np.maximum(2 - 2 * dots, 0)))
        both = a.radius[i] + b.radius[j]
        near = away <= both + reach + SLACK
        sure = near & (away + both <= reach - SLACK)
        few = near & ~sure & (((a.high - a.low)[i] * (b.high - b.low)[j] <= DENSE) | ((a.children[i] == 0) & (b.children[j] == 0)))
        small = few & ((a.high - a.low)[i] * (b.high - b.low)[j] <= SPARSE)
        if small.any():
            listed(i[small], j[small], itself[small])
        for which, act in ((sure, linked), (few & ~small, compared)):
            for p, q, own in zip(i[which].tolist(), j[which].tolist(), itself[which].tolist()):
                act(int(a.low[p]), int(a.high[p]), int(b.low[q]), int(b.high[q]), own)
        i, j, itself = (x[near & ~sure & ~few] for x in (i, j, itself))
        for p in i[itself].tolist():
            own = np.arange(a.child[p], a.child[p] + a.children[p])
            u, v = np.triu_indices(len(own))
            frontier.append((own[u], own[v]))
        i, j = i[~itself], j[~itself]
        left = (a.children[i] > 0) & ((a.radius[i] >= b.radius[j]) | (b.children[j] == 0))
        for side, own, other, t in ((left, i, j, a), (~left, j, i, b)):
            n = t.children[own[side]]
            if len(n):
                parts = np.repeat(t.child[own[side]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                rest = np.repeat(other[side], n)
                frontier.append((parts, rest) if t is a and own is i else (rest, parts))
    return links


def _links(kind: str, cosine: float):
    """(x, y, links): link counts, and edges that connect linked vectors."""

    def loaded(r: dict, side: str) -> Tree:
        x = unit_rows(np.frombuffer(r[f"data_{side}"], dtype=kind).reshape(-1, r["dim"]))
        return Tree(x, np.frombuffer(r[f"rids_{side}"], "<i8"), np.frombuffer(r[f"nodes_{side}"], "<f8").reshape(-1, 6))

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_iter:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                a = loaded(r, "a")
                b = a if r["a"] == r["b"] else loaded(r, "b")
                links = traverse(a, b, cosine)
                rids = a.rids if a is b else np.concatenate([a.rids, b.rids])
                some = np.flatnonzero(links.counts)
                yield pa.RecordBatch.from_pydict({
                    "x": pa.array(rids[some]), "y": pa.array(rids[links.label[some]]), "links": pa.array(links.counts[some])})

    return run


def _block_pairs(trees: DataFrame, reach: float) -> DataFrame:
    """Pairs of blocks that may hold links, found with portions of about 32 MB of block centres."""
    meta = cut(trees.select("block", "dim", "radius", "middle"))
    portions = max(1, math.ceil((meta.agg(F.sum(F.octet_length("middle"))).first()[0] or 0) / PORTION))
    pairs = None
    for k in range(portions):
        blocks: dict[int, list] = {}
        for r in meta.where(F.pmod(F.xxhash64("block"), F.lit(portions)) == k).collect():
            blocks.setdefault(r["dim"], []).append((r["block"], np.frombuffer(bytes(r["middle"]), "<f8"), r["radius"]))
        packed = {d: tuple(np.array(c) for c in zip(*rows)) for d, rows in blocks.items()}
        found = meta.mapInArrow(_meeting(packed, reach), "a bigint, b bigint")
        pairs = found if pairs is None else pairs.unionByName(found)
    return pairs


def near_vectors(vectors: DataFrame, cosine: float = 0.95, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors`` (vec_id, embedding).

    Two rows link when their cosine, in double precision, is at least ``cosine`` (above 0); ``n_links``
    counts the rows a row links with, ``component_id`` is the smallest vec_id that links lead to, and
    ``kept`` says that it is the row's own. Vectors that are NULL, empty or zero or hold NULL, infinite or
    NaN components link with nothing, and neither do vectors of different lengths. Rows with one vec_id
    are rows of their own; one without an id counts as a neighbour, names no component and is not kept.
    Other columns are left aside.
    """
    spark = vectors.sparkSession
    reach = math.sqrt(2 - 2 * cosine)
    single = vectors.schema["embedding"].dataType == T.ArrayType(T.FloatType(), vectors.schema["embedding"].dataType.containsNull)
    kind, cast = ("<f4", "array<float>") if single else ("<f8", "array<double>")
    path = shared_folder(spark, "vectors")
    typed = vectors.select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast(cast).alias("v"))
    typed.mapInArrow(_packed(kind), PACKED).write.parquet(path)
    rows = spark.read.schema(PACKED).parquet(path)
    usable = rows.where("dim > 0")

    n, longest = usable.agg(F.count("*"), F.max(F.octet_length("data"))).first()
    homes = min(math.ceil(n / block), HOMES, PORTION // max(longest or 1, 1))
    centres: dict[int, list[bytes]] = {}
    if homes > 1:
        for r in usable.orderBy(F.xxhash64("rid"), "rid").limit(homes).collect():
            centres.setdefault(r["dim"], []).append(bytes(r["data"]))
    packed = {d: unit_rows(_matrix(c, d, kind)).astype(np.float32) for d, c in centres.items()}
    usable.select("rid", "dim", "data").mapInArrow(_homes(packed, kind), "rid bigint, dim int, data binary, home int").write.parquet(path + "-homes")
    placed = spark.read.schema("rid bigint, dim int, data binary, home int").parquet(path + "-homes")
    parts = placed.groupBy("dim", "home").agg(F.ceil(F.count("*") / block).alias("parts"))
    number = F.xxhash64("dim", "home", F.pmod(F.xxhash64("rid", F.lit("part")), F.col("parts")))
    dealt = placed.join(small(cut(parts), 100_000), ["dim", "home"]).select(number.alias("block"), "dim", "rid", "data")
    dealt = dealt.repartition(min(2 * math.ceil(n / block) + 1, 10_000), "block").sortWithinPartitions("block", "rid")
    dealt.mapInArrow(_trees(kind, reach), TREE).write.parquet(path + "-trees")
    trees = spark.read.schema(TREE).parquet(path + "-trees")

    side = lambda s: trees.select(F.col("block").alias(s), "dim", *[F.col(c).alias(f"{c}_{s}") for c in ("rids", "data", "nodes")])
    pairs = cut(_block_pairs(trees, reach)).join(side("a"), "a").join(side("b").drop("dim"), "b")
    found = cut(pairs.mapInArrow(_links(kind, cosine), "x bigint, y bigint, links bigint"))

    links = found.groupBy(F.col("x").alias("rid")).agg(F.sum("links").alias("links"))
    linked = components(found.select("x", "y")).select(F.col("node").alias("rid"), "root")
    lowest = linked.join(rows.select("rid", "vec_id"), "rid").groupBy("root").agg(F.min("vec_id").alias("least"))
    linked = linked.join(lowest, "root").select("rid", "least", F.lit(True).alias("has"))
    named = rows.select("rid", "vec_id").join(links, "rid", "left").join(linked, "rid", "left")
    return named.select("vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), F.when(F.col("has"), F.col("least")).otherwise(
        F.col("vec_id")).alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
