"""Discovery: which datasets hold an entity, what else they hold, and what a dataset connects to.

Requests are tables, so one plan serves many. Selection, counts and histograms come from memberships
alone; a pair is only formed for the page that lists it.

Optional request columns may be left out: ``targets`` (entities every selected dataset must also
hold), ``universes``, ``identity_id`` and ``from_dataset_columns`` for edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from kinweave.catalog import MEMBER_COLUMNS, Catalog
from kinweave.operators.relationships import _check_page
from kinweave.plans.lineage import stored
from kinweave.plans.ordinals import block_of, blocks_between
from kinweave.plans.paging import counted_blocks, group_totals, page_of

HISTOGRAM_ROWS = 20  # fixed value
STRINGS = "array<string>"


def _optional(requests: DataFrame, **types: str) -> DataFrame:
    for name, kind in types.items():
        if name not in requests.columns:
            requests = requests.withColumn(name, F.lit(None).cast(kind))
    return requests


def _wanted_targets() -> Column:
    return F.array_distinct(F.coalesce("targets", F.array().cast(STRINGS)))


def _target_set(requests: DataFrame) -> list[Column]:
    """The request's targets as one key that rows carry along; nothing when requests name none."""
    return [F.array_sort(_wanted_targets()).alias("_targets")] if "targets" in requests.columns else []


def _datasets_with_all(cat: Catalog, requests: DataFrame) -> DataFrame:
    """(_targets, node_id): the datasets holding every target, once per distinct set of targets."""
    sets = requests.select(*_target_set(requests)).where(F.size("_targets") > 0).distinct()
    wanted = sets.select("_targets", F.explode("_targets").alias("identity_id")).join(
        cat.entities.select("identity_id", "size"), "identity_id"
    )
    held = cat.join_postings(wanted, "t_").select("_targets", "t_node_id", "identity_id").distinct()
    counted = held.groupBy("_targets", F.col("t_node_id").alias("node_id")).agg(F.count("*").alias("_n"))
    return counted.where(F.col("_n") == F.size("_targets")).select("_targets", "node_id")


def _keep_targets(cat: Catalog, requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """``nodes(req_id, node_id, _targets, ..)`` restricted to datasets holding the request's targets."""
    if "targets" not in requests.columns:
        return nodes
    passing = _datasets_with_all(cat, requests).withColumn("_pass", F.lit(True))
    return (
        nodes.join(passing, ["_targets", "node_id"], "left")
        .where((F.size("_targets") == 0) | F.coalesce("_pass", F.lit(False)))
        .drop("_targets", "_pass")
    )


# -- by entity -----------------------------------------------------------------------------------


def entity_primaries(cat: Catalog, requests: DataFrame) -> DataFrame:
    """Qualifying definitions of each requested entity, on datasets that hold every target.

    ``requests(req_id, identity_id, universes, targets)``. A NULL ``universes`` accepts all; the
    filter applies to these definitions only, before anything is counted.
    """
    sized = requests.join(cat.entities.select("identity_id", "size"), "identity_id")
    filtered = "universes" in requests.columns
    held = cat.join_postings(
        sized.select("req_id", "identity_id", "size", *_target_set(requests), *(["universes"] if filtered else [])), "p_"
    )
    if filtered:
        held = held.where(
            F.col("universes").isNull() | F.array_contains("universes", F.col("p_entity_universe"))
        )
    primaries = held.select(
        "req_id", F.col("p_node_id").alias("node_id"), F.col("p_ord").alias("ord"),
        F.col("p_node_first").alias("node_first"), F.col("p_node_size").alias("node_size"),
        F.col("identity_id").alias("_primary"), *(["_targets"] if "targets" in requests.columns else []),
    )
    return _keep_targets(cat, requests, primaries)


def request_status(cat: Catalog, requests: DataFrame) -> DataFrame:
    """``status`` per request: an unregistered entity or target differs from an empty selection."""
    known = cat.entities.where("name is not null").select("identity_id", F.lit(True).alias("_known"))
    named = _optional(requests, targets=STRINGS).select(
        "req_id", F.explode(F.concat(
            F.array("identity_id"), F.coalesce("targets", F.array().cast(STRINGS))
        )).alias("identity_id")
    ).where("identity_id is not null")
    missing = named.join(known, "identity_id", "left").groupBy("req_id").agg(
        F.bool_or(F.col("_known").isNull()).alias("_missing")
    )
    return requests.select("req_id").join(missing, "req_id", "left").select(
        "req_id", F.when(F.coalesce("_missing", F.lit(False)), "unknown_identity").otherwise("ok").alias("status")
    )


def entity_counts(cat: Catalog, requests: DataFrame, view: str = "auto", threshold: int = 200) -> DataFrame:
    """Exact dataset and definition counts per request, and the view they lead to."""
    per_node = entity_primaries(cat, requests).groupBy("req_id", "node_id").agg(F.count("*").alias("_n"))
    counts = per_node.groupBy("req_id").agg(
        F.count("*").alias("dataset_count"), F.sum("_n").alias("primary_definition_count")
    )
    return (
        requests.select("req_id", "identity_id").join(counts, "req_id", "left")
        .na.fill(0, ["dataset_count", "primary_definition_count"])
        .join(request_status(cat, requests), "req_id")
        .withColumn("view", choose_view(F.col("dataset_count"), view, threshold))
    )


def choose_view(count: Column, view: str = "auto", threshold: int = 200, first_page: bool = True) -> Column:
    """``aggregated`` when asked for, or when a first page would list more than ``threshold``."""
    if view not in ("auto", "detailed", "aggregated"):
        raise ValueError(f"unknown view: {view}")
    if not 1 <= threshold <= 10_000:
        raise ValueError("threshold must be between 1 and 10000")
    if view == "aggregated":
        return F.lit("aggregated")
    if view == "auto" and first_page:
        return F.when(count > threshold, "aggregated").otherwise("detailed")
    return F.lit("detailed")


def _histogram(cat: Catalog, held: DataFrame) -> DataFrame:
    """Top entities of ``held(req_id, node_id, identity_id)`` by definitions, then ID."""
    return _top_entities(cat, held.groupBy("req_id", "identity_id", "node_id").agg(F.count("*").alias("_n")))


def _top_entities(cat: Catalog, per_node: DataFrame) -> DataFrame:
    """Top entities of ``per_node(req_id, identity_id, _n)``, one row per dataset with its definitions of the entity.

    The groups are stored, as ranks and totals both read them; the shuffles that lead to them end there.
    """
    groups = stored(per_node.groupBy("req_id", "identity_id").agg(
        F.sum("_n").alias("entity_definition_count"), F.count("*").alias("dataset_count")
    ))
    totals = groups.groupBy("req_id").agg(F.count("*").alias("logical_entity_count"))
    order = W.partitionBy("req_id").orderBy(F.desc("entity_definition_count"), "identity_id")
    top = groups.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= HISTOGRAM_ROWS)
    names = cat.entities.select("identity_id", "name")
    return (
        top.join(totals, "req_id").join(names, "identity_id", "left")
        .select(
            "req_id", F.col("rank").cast("bigint").alias("rank"), "identity_id", "name",
            "entity_definition_count", "dataset_count", "logical_entity_count",
            (F.col("logical_entity_count") > HISTOGRAM_ROWS).alias("truncated"),
        )
    )


def entity_histogram(cat: Catalog, requests: DataFrame) -> DataFrame:
    """The other entities on the selected datasets."""
    nodes = stored(entity_primaries(cat, requests).select("req_id", "node_id", "node_first", "node_size", "_primary").distinct())
    first, last = (block_of(place, cat.block_rows) for place in (F.col("node_first"), F.col("node_first") + F.col("node_size") - 1))

    def counted(some: DataFrame, *block: str) -> DataFrame:
        held = cat.join_definitions(some, "d_").where("d_identity_id <> _primary")
        return held.groupBy("req_id", "d_identity_id", "d_node_id", *block).agg(F.count("*").alias("_n")).select(
            "req_id", F.col("d_identity_id").alias("identity_id"), "_n")

    # A dataset that lies in one block has all its definitions in one task already; few lie in several.
    return _top_entities(cat, counted(nodes.where(first == last), "d_node_block").unionByName(counted(nodes.where(first < last))))


def entity_definition_page(
    cat: Catalog, requests: DataFrame, offset: int = 0, limit: int = 100,
) -> DataFrame:
    """Definitions on ``limit`` whole datasets from ``offset``, in dataset order.

    Lists the qualifying definitions of the entity and every definition of the targets.
    ``truncated`` compares the page with the whole selection; ``more`` says a later page exists.
    """
    _check_page(offset, limit)
    primaries = entity_primaries(cat, requests)
    nodes = primaries.select("req_id", "node_id", "node_first", "node_size").distinct()
    # Spans of datasets lie in the order of their IDs, so blocks of ordinals are blocks of datasets.
    block = block_of(F.col("node_first"), cat.block_rows)
    counts = counted_blocks(nodes, ["req_id"], block)
    totals = group_totals(counts, ["req_id"], "dataset_count")
    page = page_of(nodes, counts, ["req_id"], block, ["node_id"], offset, limit, "dataset_rank")
    asked = _optional(requests, targets=STRINGS).select(
        "req_id", F.col("identity_id").alias("_primary"), "targets"
    )
    held = cat.join_definitions(page.join(asked, "req_id"), "d_")
    qualifying = primaries.select("req_id", F.col("ord").alias("d_ord"), F.lit(True).alias("_qualifies"))
    rows = held.join(qualifying, ["req_id", "d_ord"], "left")
    as_target = F.coalesce(F.array_contains("targets", F.col("d_identity_id")), F.lit(False)) & (
        F.col("d_identity_id") != F.col("_primary")
    )
    return rows.where(F.coalesce("_qualifies", F.lit(False)) | as_target).join(totals, "req_id").select(
        "req_id", F.col("dataset_rank").cast("bigint").alias("dataset_rank"), "node_id",
        F.col("d_ord").alias("ord"), F.col("d_identity_id").alias("identity_id"),
        F.col("d_dataset_columns").alias("dataset_columns"),
        F.coalesce("_qualifies", F.lit(False)).alias("is_primary"), "dataset_count",
        (F.least(F.col("dataset_count"), F.lit(offset + limit)) - offset < F.col("dataset_count")).alias("truncated"),
        (F.col("dataset_count") > offset + limit).alias("more"),
    )


# -- by dataset ----------------------------------------------------------------------------------


def edge_sources(cat: Catalog, requests: DataFrame) -> DataFrame:
    """Definitions a dataset's edges leave from.

    ``requests(req_id, node_id, identity_id, from_dataset_columns, targets)``; the filters may be NULL.
    """
    filters = [
        (asked, held) for asked, held in (
            ("identity_id", "s_identity_id"), ("from_dataset_columns", "s_dataset_columns")
        ) if asked in requests.columns
    ]
    spanned = requests.select("req_id", "node_id", *(asked for asked, _ in filters)).join(
        cat.nodes.select("node_id", "node_first", "node_size"), "node_id"
    )
    rows = cat.join_definitions(spanned, "s_")
    for asked, held in filters:
        rows = rows.where(F.col(asked).isNull() | (F.col(asked) == F.col(held)))
    return rows.select("req_id", *(f"s_{name}" for name in MEMBER_COLUMNS))


def edge_request_status(cat: Catalog, requests: DataFrame, sources: DataFrame) -> DataFrame:
    """``unknown_dataset``, ``unknown_identity``, ``no_definition`` or ``ok`` per request."""
    known = cat.nodes.select("node_id", F.lit(True).alias("_node"))
    targets = request_status(cat, requests.withColumn("identity_id", F.lit(None).cast("string")))
    counted = sources.groupBy("req_id").agg(F.count("*").alias("_sources"))
    return (
        _optional(requests, identity_id="string").select("req_id", "node_id", "identity_id")
        .join(known, "node_id", "left").join(targets, "req_id").join(counted, "req_id", "left")
        .select(
            "req_id",
            F.when(F.col("_node").isNull(), "unknown_dataset")
            .when(F.col("status") != "ok", F.col("status"))
            .when(F.col("identity_id").isNotNull() & F.col("_sources").isNull(), "no_definition")
            .otherwise("ok").alias("status"),
        )
    )


def _source_entities(requests: DataFrame, sources: DataFrame) -> DataFrame:
    """Entities of each request's sources, with what later steps need to know of the request."""
    asked = requests.select("req_id", F.col("node_id").alias("_own"), *_target_set(requests))
    return sources.select(
        "req_id", F.col("s_identity_id").alias("identity_id"), F.col("s_size").alias("size")
    ).distinct().join(asked, "req_id")


def _connected(cat: Catalog, requests: DataFrame, sources: DataFrame) -> DataFrame:
    """Other datasets sharing a source entity, after the target filter."""
    entities = _source_entities(requests, sources)
    carried = [c for c in entities.columns if c == "_targets"]
    nodes = cat.join_postings(entities, "t_").where("t_node_id <> _own").select(
        "req_id", F.col("t_node_id").alias("node_id"), F.col("t_node_first").alias("node_first"),
        F.col("t_node_size").alias("node_size"), *carried,
    ).distinct()
    return _keep_targets(cat, requests, nodes)


def fan_out(cat: Catalog, requests: DataFrame, view: str = "auto", threshold: int = 200) -> DataFrame:
    """Distinct datasets each request connects to, from two hops over memberships."""
    sources = edge_sources(cat, requests)
    counts = _connected(cat, requests, sources).groupBy("req_id").agg(F.count("*").alias("fan_out_count"))
    return (
        requests.select("req_id", "node_id").join(counts, "req_id", "left")
        .na.fill(0, ["fan_out_count"])
        .join(edge_request_status(cat, requests, sources), "req_id")
        .withColumn("view", choose_view(F.col("fan_out_count"), view, threshold))
    )


def edge_histogram(cat: Catalog, requests: DataFrame) -> DataFrame:
    """All entities on the connected datasets, the connecting ones included."""
    nodes = _connected(cat, requests, edge_sources(cat, requests))
    held = cat.join_definitions(nodes, "d_").select(
        "req_id", "node_id", F.col("d_identity_id").alias("identity_id")
    )
    return _histogram(cat, held)


def edge_page(cat: Catalog, requests: DataFrame, offset: int = 0, limit: int = 200) -> DataFrame:
    """Edges ``offset .. offset + limit`` of every source definition, in target order.

    ``edge_count`` covers the definition's whole selection. ``rank`` is 1-based over it. Without
    targets the positions of the page are known, so only they are joined; with targets
    the selected postings are counted by block, and only blocks that hold the page are ranked.
    """
    _check_page(offset, limit)
    if "targets" in requests.columns:
        named = F.size(_wanted_targets()) > 0
        rows = _page_by_position(cat, requests.where(~named), offset, limit).unionByName(
            _page_by_rank(cat, requests.where(named), offset, limit)
        )
    else:
        rows = _page_by_position(cat, requests, offset, limit)
    shown = F.least(F.col("edge_count") - offset, F.lit(limit))
    return rows.withColumn("truncated", F.greatest(shown, F.lit(0)) < F.col("edge_count"))


def _with_more(sources: DataFrame, end: int) -> DataFrame:
    """Whether any source definition of the request has edges after ``end``."""
    more = sources.groupBy("req_id").agg((F.max("edge_count") > end).alias("more"))
    return sources.join(more, "req_id")


def _page_by_position(cat: Catalog, requests: DataFrame, offset: int, limit: int) -> DataFrame:
    sources = _with_more(
        edge_sources(cat, requests).withColumn("edge_count", F.col("s_size") - 1).where("edge_count > 0"),
        offset + limit,
    )
    # Every source of an entity looks at the same positions, one more than a page for the source's own. Only these
    # are read, and a hub's are repeated for each of its blocks.
    t = cat.prefixed("t_").where(F.col("t_pos").between(offset + 1, offset + limit + 1)).withColumn(
        "_block", blocks_between(F.lit(1), F.col("t_size"), cat.block_rows)
    )
    paired = sources.where(F.col("edge_count") > offset).join(
        t, (F.col("s_identity_id") == t.t_identity_id) & (F.col("s_entity_block") == t["_block"])
    ).where("s_pos <> t_pos")
    rank = F.col("t_pos") - (F.col("t_pos") > F.col("s_pos")).cast("bigint")
    return paired.withColumn("rank", rank).where(F.col("rank").between(offset + 1, offset + limit)).drop("_block")


def _page_by_rank(cat: Catalog, requests: DataFrame, offset: int, limit: int) -> DataFrame:
    sources = edge_sources(cat, requests).join(requests.select("req_id", *_target_set(requests)), "req_id")
    # What passes depends on the targets and the entity alone, so requests with the same ones share it.
    entities = sources.select("_targets", F.col("s_identity_id").alias("identity_id"), F.col("s_size").alias("size")).distinct()
    held = cat.join_postings(entities, "t_").drop("identity_id", "size")
    passing = _datasets_with_all(cat, requests)
    chosen = held.join(passing, (held["_targets"] == passing["_targets"]) & (held["t_node_id"] == passing["node_id"]), "left_semi")
    group = ["_targets", "t_identity_id"]
    blocks = counted_blocks(chosen, group, F.col("t_entity_block"))
    counts = group_totals(blocks, group, "_n").withColumnRenamed("t_identity_id", "s_identity_id")
    top = page_of(chosen, blocks, group, F.col("t_entity_block"), ["t_ord"], offset, limit + 1, "_rank")
    # A source that passes its own target filter leaves its slot to the next definition.
    own = passing.select("_targets", F.col("node_id").alias("s_node_id"), F.lit(1).alias("_self"))
    counted = _with_more(
        sources.join(counts, ["_targets", "s_identity_id"])
        .join(own, ["_targets", "s_node_id"], "left")
        .withColumn("_self", F.coalesce("_self", F.lit(0)))
        .withColumn("edge_count", F.col("_n") - F.col("_self"))
        .where("edge_count > 0").drop("_n"),
        offset + limit,
    )
    paired = counted.join(
        top.withColumnRenamed("_targets", "_of"),
        (F.col("_targets") == F.col("_of")) & (F.col("s_identity_id") == F.col("t_identity_id")),
    ).where("s_ord <> t_ord")
    rank = F.col("_rank") - (F.col("s_ord") < F.col("t_ord")).cast("int") * F.col("_self")
    return (
        paired.withColumn("rank", rank.cast("bigint"))
        .where(F.col("rank").between(offset + 1, offset + limit))
        .drop("_rank", "_self", "_of", "_targets")
    )


def page_datasets(cat: Catalog, requests: DataFrame, page: DataFrame) -> DataFrame:
    """Datasets a page refers to: the source at distance 0, the page's targets at distance 1."""
    own = requests.select("req_id", "node_id", F.lit(0).alias("distance"))
    others = page.select(
        "req_id", F.col("t_node_id").alias("node_id"), F.lit(1).alias("distance")
    ).distinct()
    best = own.unionByName(others).groupBy("req_id", "node_id").agg(F.min("distance").alias("distance"))
    return best.join(cat.nodes.select("node_id", "edge_count"), "node_id", "left")
