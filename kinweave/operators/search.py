"""Lexical search over five kinds of catalog objects, for a table of queries at once.

Postings hold one row per (term, subject, value). A query matches a term exactly or as a prefix; a
query of several words also matches names in which every word starts some word of the same value.
Distinct terms are sorted once together with where each query word's terms begin and end, so a prefix is
an interval of ordinals. Words meet terms by the blocks of their intervals, and postings by the term.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from kinweave.catalog import Catalog
from kinweave.functions import claims, ids, text
from kinweave.plans.lineage import cut, stored
from kinweave.plans.ordinals import block_of, blocks_between, dense_ordinal

# Kinds in output order, field order within a subject, match types by rank
KINDS = ("column", "dataset", "entity_definition", "entity_relationship", "identity")
FIELDS = (
    "stable_id", "column", "canonical_name", "synonym", "tag", "qualified_name", "accessor",
    "dataset_columns", "entity_expression", "entity_metadata", "description", "value_description",
)
MATCH_TYPES = ("exact", "prefix", "phrase", "all_words")
_ORDER = {name: i for i, name in enumerate(FIELDS, 1)}
# (kind, field) whose values a query of several words may match word by word
_WORD_FIELDS = (("dataset", "qualified_name"), ("dataset", "canonical_name"), ("identity", "canonical_name"))

LAST = "\U0010ffff"  # behind every character of a term
TERM_BLOCK = 256  # ordinals
_RANK = 1 << 60  # above every ordinal: what a prefix match adds to it

_ENTRY = "array<struct<field: int, value: string, descriptive: boolean>>"


def field_name(kind: Column, field: Column) -> Column:
    """The caller's name of a matched field."""
    names = F.element_at(F.array(*(F.lit("column_name" if f == "column" else f) for f in FIELDS)), field)
    stable, canonical = field == _ORDER["stable_id"], field == _ORDER["canonical_name"]
    return (
        F.when(stable & (kind == "dataset"), "node_id").when(stable, "identity_id")
        .when(canonical & (kind == "dataset"), "display_name").when(canonical, "name")
        .otherwise(names)
    )


def _one(field: str, value: Column, descriptive: bool = False) -> Column:
    return F.array(F.struct(
        F.lit(_ORDER[field]).alias("field"), value.alias("value"), F.lit(descriptive).alias("descriptive")
    )).cast(_ENTRY)


def _many(field: str, values: Column, descriptive: bool = False) -> Column:
    given = F.coalesce(values, F.array().cast("array<string>"))
    return F.transform(given, lambda v: F.struct(
        F.lit(_ORDER[field]).alias("field"), v.alias("value"), F.lit(descriptive).alias("descriptive")
    )).cast(_ENTRY)


def subjects(cat: Catalog, kinds: list[str] | None = None) -> DataFrame:
    """One row per searchable object: its key, tie-break, label and ordered field values."""
    if kinds is not None and set(kinds) - set(KINDS):
        raise ValueError(f"unknown kinds: {sorted(set(kinds) - set(KINDS))}")
    builders = {
        "column": _columns, "dataset": _datasets, "entity_definition": _definitions,
        "entity_relationship": _stated, "identity": _identities,
    }
    result = None
    for kind in KINDS if kinds is None else kinds:
        part = builders[kind](cat).withColumn("kind", F.lit(kind))
        result = part if result is None else result.unionByName(part)
    return result


def _identities(cat: Catalog) -> DataFrame:
    return cat.identities.select(
        F.col("identity_id").alias("key"), F.lit(None).cast("bigint").alias("ord"), F.col("name").alias("label"),
        F.concat(
            _one("stable_id", F.col("identity_id")), _one("canonical_name", F.col("name")),
            _one("description", F.col("description"), True), _many("synonym", F.col("synonyms")),
        ).alias("entries"),
    )


def _datasets(cat: Catalog) -> DataFrame:
    d, a = "descriptor.", "accessor."
    return cat.datasets.select(
        F.col("node_id").alias("key"), F.lit(None).cast("bigint").alias("ord"),
        F.col(d + "display_name").alias("label"),
        F.concat(
            _one("stable_id", F.col("node_id")), _one("canonical_name", F.col(d + "display_name")),
            _one("qualified_name", F.col(d + "qualified_name")),
            _one("description", F.col(d + "description"), True),
            _many("synonym", F.col(d + "synonyms")), _many("tag", F.col(d + "tags")),
            _one("accessor", F.col(a + "kind")), _one("accessor", F.col(a + "endpoint")),
            _many("accessor", text.map_strings(F.col(a + "labels"))),
            _many("accessor", text.json_strings(F.col(a + "properties"))),
        ).alias("entries"),
    )


def _definitions(cat: Catalog) -> DataFrame:
    key = ["node_id", "identity_id", "dataset_columns"]
    first = F.get("entity_expression", F.lit(0))
    return cat.definitions.join(cat.members.select("ord", *key), key).select(
        ids.definition_id(F.col("ord")).alias("key"), "ord",
        F.when(F.coalesce(first, F.lit("")) != "", first).otherwise(F.col("identity_id")).alias("label"),
        F.concat(
            _one("stable_id", F.col("identity_id")), _many("dataset_columns", F.col("dataset_columns")),
            _many("entity_expression", F.col("entity_expression")),
            _many("entity_metadata", text.json_strings(F.col("entity_metadata"))),
        ).alias("entries"),
    )


def _columns(cat: Catalog) -> DataFrame:
    return cat.columns.join(cat.column_ids, ["node_id", "name"]).select(
        ids.column_id(F.col("c_ord")).alias("key"), F.col("c_ord").alias("ord"), F.col("name").alias("label"),
        F.concat(
            _one("column", F.col("name")), _one("description", F.col("description"), True),
            _one("value_description", F.col("value_description"), True), _many("synonym", F.col("synonyms")),
        ).alias("entries"),
    )


def _stated(cat: Catalog) -> DataFrame:
    return cat.entity_relationships.join(cat.relationship_ids, ["left_id", "right_id"]).select(
        ids.relationship_id(F.col("x_ord")).alias("key"), F.col("x_ord").alias("ord"),
        F.concat_ws(" ", "left_id", "right_id").alias("label"),
        _many("description", F.col("descriptions"), True).alias("entries"),
    )


def corpus(cat: Catalog, kinds: list[str] | None = None) -> DataFrame:
    """Indexed values: ``(kind, key, ord, sort_label, field, value_idx, value, normalized)``.

    A description that is only a placeholder is dropped, and so is a value without terms; dropped
    values take no index.
    """
    labelled = subjects(cat, kinds).withColumn("sort_label", text.normalize_term(F.coalesce("label", F.lit(""))))
    # A subject's values are its own few fields: they are numbered inside their row, with no shuffle.
    named = text.with_normalized_list(labelled, F.transform("entries", lambda e: e["value"]), "_normalized")
    values = F.zip_with("entries", "_normalized", lambda e, n: F.struct(
        e["field"].alias("field"), e["value"].alias("value"), e["descriptive"].alias("descriptive"), n.alias("normalized")))
    kept = F.filter(values, lambda v: v["value"].isNotNull() & (v["normalized"] != "") & ~(v["descriptive"] & text.is_placeholder(v["normalized"])))
    return named.select("kind", "key", "ord", "sort_label", F.posexplode(kept).alias("_at", "_v")).select(
        "kind", "key", "ord", "sort_label", "_v.field", "_v.value", "_v.normalized", F.col("_at").cast("bigint").alias("value_idx"))


def build_postings(values: DataFrame) -> DataFrame:
    """``(term, kind, key, value_idx, field)``, one row per distinct term of a value.

    Written out, sort it by term: exact and prefix filters then skip row groups.
    """
    return values.select(
        F.explode(text.index_terms(F.col("normalized"))).alias("term"), "kind", "key", "value_idx", "field"
    )


def write_postings(postings: DataFrame, path: str) -> None:
    postings.repartitionByRange("term").sortWithinPartitions("term").write.mode("errorifexists").parquet(path)


def search(
    cat: Catalog, queries: DataFrame, limit: int = 50, kinds: list[str] | None = None,
    values: DataFrame | None = None,
) -> DataFrame:
    """Match rows of the best ``limit`` subjects per query and kind.

    ``queries(query_id, query)``. ``rank`` is the subject's place in its kind: best match type, then
    label, then ordinal or ID. ``match_rank`` orders a subject's matched values. ``total`` counts the
    kind's matching subjects and ``truncated`` says whether some are left out.
    """
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be between 1 and 1000")
    values = stored(corpus(cat, kinds)) if values is None else values
    asked = queries.select("query_id", text.normalize_term(F.col("query")).alias("q")).where("q <> ''")
    best, terms = _best_per_value(asked, values)
    best = stored(best)

    subject = ["query_id", "kind", "key"]
    ranked = best.groupBy(*subject).agg(F.min("rank").alias("best")).join(
        values.select("kind", "key", "sort_label", "ord").distinct(), ["kind", "key"])
    totals = ranked.groupBy("query_id", "kind").agg(F.count("*").alias("total"))
    order = W.partitionBy("query_id", "kind").orderBy("best", "sort_label", "ord", "key")
    top = ranked.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)
    # Texts and terms are read for what is shown only: a query can match most values of a catalog.
    value = ["kind", "key", "value_idx"]
    rows = top.select(*subject, "place").join(totals, ["query_id", "kind"]).join(best, subject).join(
        values.select(*value, "field", "value"), value).join(terms, "ord", "left")
    inside = W.partitionBy(*subject).orderBy("rank", "field", "value_idx")
    return rows.withColumn("term", F.coalesce("words", "term")).select(
        *subject, F.col("place").cast("bigint").alias("rank"),
        F.row_number().over(inside).cast("bigint").alias("match_rank"),
        F.element_at(F.array(*map(F.lit, MATCH_TYPES)), F.col("rank") + 1).alias("match_type"),
        field_name(F.col("kind"), F.col("field")).alias("match_field"),
        F.col("term").alias("matched_term"), F.col("value").alias("matched_value"),
        "total", (F.col("total") > limit).alias("truncated"),
    )


def _best_per_value(asked: DataFrame, values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The best match of each value for each query, and the terms by ordinal.

    ``(query_id, kind, key, value_idx, rank, ord, words)``: the lowest rank, and the first term by its ordinal in the
    vocabulary; ``words`` is what a match word by word shows instead. Both are folded as one number. Word by word,
    the names that a query's rarest word starts in are tested for its other words.
    """
    value = ["kind", "key", "value_idx"]
    postings = build_postings(values)
    words = asked.where(F.col("q").contains(" "))
    each = words.select("query_id", "q", F.explode(F.array_distinct(F.split("q", " "))).alias("word"))
    # A name's words are terms as well, so one pass over the vocabulary serves both kinds of match.
    started = cut(_started(postings.select("term"), asked.select(F.col("q").alias("word")).unionByName(each.select("word"))))
    code = F.when(F.col("term") == F.col("word"), 0).otherwise(_RANK) + F.col("ord")
    whole = postings.join(started.join(asked, F.col("word") == F.col("q")).select("query_id", "term", code.alias("code")), "term").groupBy(
        "query_id", *value).agg(F.min("code").alias("code"))
    names = values.where(_is_word_field()).select(*value, "normalized", F.explode(F.array_distinct(F.split("normalized", " "))).alias("term"))
    reach = names.groupBy("term").agg(F.count("*").alias("n")).join(started, "term").groupBy("word").agg(F.sum("n").alias("n"))
    rarest = each.join(reach, "word").groupBy("query_id", "q").agg(F.min(F.struct("n", "word"))["word"].alias("word"))
    tried = rarest.join(started.select("word", "term"), "word").join(names, "term")
    every = tried.where(F.forall(F.split("q", " "), lambda w: F.exists(F.split("normalized", " "), lambda h: F.startswith(h, w))))
    by_words = every.groupBy("query_id", *value).agg(F.min(_word_match(F.col("normalized"), F.col("q"))).alias("_m"))
    both = whole.join(by_words, ["query_id", *value], "full_outer")
    best = both.select(
        "query_id", *value, F.coalesce((F.col("code") >= _RANK).cast("int"), "_m.rank").alias("rank"),
        (F.col("code") % _RANK).alias("ord"), F.when(F.col("code").isNull(), F.col("_m.term")).alias("words"))
    return best, started.select("ord", "term").distinct()


def _is_word_field() -> Column:
    result = F.lit(False)
    for kind, field in _WORD_FIELDS:
        result = result | ((F.col("kind") == kind) & (F.col("field") == _ORDER[field]))
    return result


def matched_terms(terms: DataFrame, words: DataFrame) -> DataFrame:
    """(word, term): which of the distinct terms start with which of the distinct words."""
    return _started(terms, words).select("word", "term")


def _started(terms: DataFrame, words: DataFrame) -> DataFrame:
    """(word, term, ord): as :func:`matched_terms`, with the term's place in the sorted vocabulary.

    Two marks per word enter the sorted vocabulary, one before and one after its terms; the terms between
    them are found by blocks of ordinals. Terms are normalised, so none holds the last code point.
    """
    marked = words.select("word").distinct()
    rows = terms.select("term").distinct().select(F.col("term").alias("text"), F.lit(1).alias("is_term"), F.lit(None).cast("string").alias("word"))
    for text_ in (F.col("word"), F.concat("word", F.lit(LAST))):
        rows = rows.unionByName(marked.select(text_.alias("text"), F.lit(0).alias("is_term"), "word"))
    ordered = dense_ordinal(rows, ["text", "is_term"])
    spans = ordered.where("is_term = 0").groupBy("word").agg(F.min("ord").alias("first"), F.max("ord").alias("last"))
    spans = spans.where("last > first + 1").withColumn("block", blocks_between(F.col("first"), F.col("last"), TERM_BLOCK))
    listed = ordered.where("is_term = 1").select(F.col("text").alias("term"), "ord", block_of(F.col("ord"), TERM_BLOCK).alias("block"))
    return spans.join(listed, "block").where((F.col("ord") > F.col("first")) & (F.col("ord") < F.col("last"))).select("word", "term", "ord")


def _word_match(normalized: Column, query: Column) -> Column:
    """Rank and matched words of a value in which every query word starts some word.

    A phrase is the first run of consecutive words that the query words start in order.
    """
    have, want = F.split(normalized, " "), F.split(query, " ")
    width = F.size(want)

    def runs_from(start: Column) -> Column:
        return F.forall(
            F.sequence(F.lit(0), width - 1),
            lambda i: F.startswith(F.get(have, start + i), F.get(want, i)),
        )

    starts = F.when(
        F.size(have) >= width,
        F.filter(F.sequence(F.lit(0), F.size(have) - width), runs_from),
    )
    start = F.get(starts, F.lit(0))
    phrase = F.struct(
        F.lit(2).alias("rank"), F.array_join(F.slice(have, start + 1, width), " ").alias("term")
    )
    picked = F.transform(
        want, lambda w: F.get(F.filter(have, lambda h: F.startswith(h, w)), F.lit(0))
    )
    scattered = F.struct(F.lit(3).alias("rank"), F.array_join(picked, " ").alias("term"))
    return F.when(start.isNotNull(), phrase).otherwise(scattered)


def subject_rows(cat: Catalog, kind: str) -> DataFrame:
    """The descriptive row of each subject of a kind, with its unknown claims where it has claims."""
    if kind == "identity":
        return cat.identities.select(F.col("identity_id").alias("key"), "name")
    if kind == "dataset":
        return cat.datasets.select(
            F.col("node_id").alias("key"), F.col("descriptor.qualified_name").alias("qualified_name"),
            grain_unknown().alias("unknown_fields"),
        )
    if kind == "column":
        return cat.column_ids.select(
            ids.column_id(F.col("c_ord")).alias("key"), "node_id", F.col("name").alias("column_name")
        )
    if kind == "entity_relationship":
        return cat.relationship_ids.select(
            ids.relationship_id(F.col("x_ord")).alias("key"), F.array("left_id", "right_id").alias("endpoints")
        )
    if kind == "entity_definition":
        key = ["node_id", "identity_id", "dataset_columns"]
        return cat.definitions.join(cat.members.select("ord", *key), key).select(
            ids.definition_id(F.col("ord")).alias("key"),
            F.get("entity_expression", F.lit(0)).alias("entity_expression"), *key,
            claims.unknown_claims(claims.side()).alias("unknown_fields"),
        )
    raise ValueError(f"unknown kind: {kind}")


def grain_unknown() -> Column:
    return F.when(F.col("grain").isNull(), F.array(F.lit("grain"))).otherwise(F.array().cast("array<string>"))
