"""Claims measured on rows, by the definitions the declared claims have.

The catalog declares claims and reads no data. A Spark user holds the data, so the same definitions
can be checked: every function is one aggregation over the keys, or an anti-join of distinct keys.

``measure_catalog`` checks all definitions at once: keys are dealt by entity and value, once, with one counter
per definition that they can be found in, and folded to the few combinations of definitions that keys are found in. Everything about
single definitions and pairs of them follows from those combinations.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from kinweave.catalog import Catalog
from kinweave.plans.lineage import cut


def _complete(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))


def distinct_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.where(_complete(keys)).select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys))).distinct()


@dataclass(frozen=True)
class Measured:
    """A definition to measure: the columns of a table that hold keys of an entity."""

    table: str
    columns: tuple[str, ...]
    entity: str

    @property
    def name(self) -> str:
        return f"{self.table}:{','.join(self.columns)}"


def _shapes(tables: Mapping[str, DataFrame], definitions: Sequence[Measured]) -> dict[tuple[str, ...], list[list[int]]]:
    """Definitions whose keys can meet (one entity, as many columns), by the types their keys are compared in.

    A column that is a whole number in all of them stays one; others are compared as text, as whole numbers would
    be against them.
    """
    together: dict[tuple[str, int], list[int]] = {}
    for i, d in enumerate(definitions):
        together.setdefault((d.entity, len(d.columns)), []).append(i)
    shapes: dict[tuple[str, ...], list[list[int]]] = {}
    for group in together.values():
        whole = [
            all(isinstance(tables[d.table].schema[d.columns[at]].dataType, T.IntegralType) for d in (definitions[i] for i in group))
            for at in range(len(definitions[group[0]].columns))
        ]
        shapes.setdefault(tuple("bigint" if w else "string" for w in whole), []).append(group)
    return shapes


def key_combinations(tables: Mapping[str, DataFrame], definitions: Sequence[Measured]) -> DataFrame:
    """One row per entity, number of columns and combination of definitions that keys are found in.

    ``b<i>`` is 0, 1 or 2 if definition i holds such a key in no, one or several records, ``s<i>`` counts its
    records, ``keys`` the keys; ``absent`` marks records whose key is not complete. Every definition reads its own
    columns only; keys travel in their types with one counter per definition that they can be found in. The
    counters are added up before the shuffle, so a key that most records hold travels as one row a task.
    """
    numbers = range(len(definitions))
    found = []
    for types, groups in _shapes(tables, definitions).items():
        keys, places = [f"k{at}" for at in range(len(types))], range(max(map(len, groups)))
        parts = []
        for number, group in enumerate(groups):
            for place, i in enumerate(group):
                columns = definitions[i].columns
                whole = _complete(list(columns))
                parts.append(tables[definitions[i].table].select(
                    F.lit(number).alias("group"), (~whole).alias("absent"),
                    *[F.when(whole, F.col(c).cast(t)).alias(k) for k, c, t in zip(keys, columns, types)],
                    *[F.lit(1 if p == place else 0).cast("bigint").alias(f"n{p}") for p in places]))
        held = reduce(DataFrame.unionByName, parts).groupBy("group", "absent", *keys).agg(*[F.sum(f"n{p}").alias(f"c{p}") for p in places])
        folded = held.groupBy("group", "absent", *[F.least(F.col(f"c{p}"), F.lit(2)).alias(f"h{p}") for p in places]).agg(
            F.count("*").alias("keys"), *[F.sum(f"c{p}").alias(f"t{p}") for p in places])
        # From here on one row per combination: back to the numbers of all definitions.
        own = {i: (number, place) for number, group in enumerate(groups) for place, i in enumerate(group)}
        named = F.element_at(F.array(*[F.lit(definitions[group[0]].entity) for group in groups]), F.col("group") + 1)

        def of(i: int, kind: str) -> Column:
            if i not in own:
                return F.lit(0).cast("bigint").alias(f"{'b' if kind == 'h' else 's'}{i}")
            number, place = own[i]
            return F.when(F.col("group") == number, F.col(f"{kind}{place}")).otherwise(0).cast("bigint").alias(f"{'b' if kind == 'h' else 's'}{i}")

        found.append(folded.select(named.alias("entity"), "absent", *[of(i, "h") for i in numbers], "keys", *[of(i, "t") for i in numbers]))
    return cut(reduce(DataFrame.unionByName, found))


def measure_catalog(tables: Mapping[str, DataFrame], definitions: Sequence[Measured]) -> tuple[DataFrame, DataFrame]:
    """What ``measure_key`` says of every definition, and ``containment_evidence`` of every pair on one entity.

    ``(definition, entity, record_count, key_count, null_count, unique, total)`` and ``(entity, left, right,
    shared_count, left_only_count, right_only_count, left_conforms, right_conforms, conflict_if_complete)``.
    Definitions of empty tables have zeros. Pairs come once, in the order of ``definitions``.
    """
    found = key_combinations(tables, definitions)
    spark = found.sparkSession
    single = F.explode(F.array(*[
        F.struct(F.lit(i).alias("def"), F.col(f"b{i}").alias("b"), F.col(f"s{i}").alias("s")) for i in range(len(definitions))]))
    held = found.select("absent", "keys", single.alias("d")).select("absent", "keys", "d.*").where("b > 0")
    counted = held.groupBy("def").agg(
        F.sum("s").alias("record_count"), F.sum(F.when(~F.col("absent"), F.col("keys"))).alias("key_count"),
        F.sum(F.when(F.col("absent"), F.col("s"))).alias("null_count"), F.max(F.when(~F.col("absent"), F.col("b"))).alias("most"),
    )
    names = spark.createDataFrame([(i, d.name, d.entity) for i, d in enumerate(definitions)], "def int, definition string, entity string")
    zero = lambda name: F.coalesce(name, F.lit(0)).cast("bigint")
    each = names.join(counted, "def", "left").select(
        "definition", "entity", *[zero(c).alias(c) for c in ("record_count", "key_count", "null_count")],
        (zero("most") <= 1).alias("unique"), (zero("null_count") == 0).alias("total"))

    paired = [(i, j) for i, j in combinations(range(len(definitions)), 2) if definitions[i].entity == definitions[j].entity]
    listed = spark.createDataFrame(
        [(i, j, definitions[i].entity, definitions[i].name, definitions[j].name) for i, j in paired],
        "i int, j int, entity string, left string, right string")
    if not paired:
        evidence = found.select(F.lit(0).alias("i"), F.lit(0).alias("j"), *[F.lit(0).alias(c) for c in ("both", "one", "other")]).limit(0)
    else:
        pair = F.explode(F.array(*[F.struct(
            F.lit(i).alias("i"), F.lit(j).alias("j"), (F.col(f"b{i}") > 0).alias("l"), (F.col(f"b{j}") > 0).alias("r")) for i, j in paired]))
        sides = found.where("not absent").select("keys", pair.alias("p")).select("keys", "p.*").where("l or r")
        evidence = sides.groupBy("i", "j").agg(
            F.sum(F.when(F.expr("l and r"), F.col("keys"))).alias("both"), F.sum(F.when(F.expr("l and not r"), F.col("keys"))).alias("one"),
            F.sum(F.when(F.expr("r and not l"), F.col("keys"))).alias("other"))
    pairs = listed.join(evidence, ["i", "j"], "left").select(
        "entity", "left", "right", zero("both").alias("shared_count"), zero("one").alias("left_only_count"), zero("other").alias("right_only_count"))
    return each, pairs.withColumns({
        "left_conforms": F.col("left_only_count") == 0, "right_conforms": F.col("right_only_count") == 0,
        "conflict_if_complete": F.col("left_only_count") + F.col("right_only_count") > 0})


def measure_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: ``unique`` (no key in two records), ``total`` (no record without a key), and counts."""
    per_key = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    held = F.when(_complete(keys), F.col("_n"))
    return per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("record_count"), F.count(held).alias("key_count"),
        F.coalesce(F.sum(F.when(~_complete(keys), F.col("_n"))), F.lit(0)).alias("null_count"),
        (F.coalesce(F.max(held), F.lit(0)) <= 1).alias("unique"),
    ).withColumn("total", F.col("null_count") == 0)


def measure_containment(df: DataFrame, keys: list[str], population: DataFrame, population_keys: list[str]) -> DataFrame:
    """One row: ``conforms`` (no key outside the population) and ``entity_universe``."""
    own, all_keys = distinct_keys(df, keys), distinct_keys(population, population_keys)
    names = own.columns
    outside = own.join(all_keys, names, "left_anti").agg(F.count("*").alias("orphan_count"))
    absent = all_keys.join(own, names, "left_anti").agg(F.count("*").alias("absent_count"))
    counts = outside.crossJoin(absent)  # one row each
    conforms = F.col("orphan_count") == 0
    universe = F.when(conforms & (F.col("absent_count") == 0), "complete").otherwise("partial")
    return counts.withColumn("conforms", conforms).withColumn("entity_universe", universe)


def containment_evidence(df: DataFrame, keys: list[str], other: DataFrame, other_keys: list[str]) -> DataFrame:
    """One row on a pair of definitions: shared and unmatched keys, and whether two ``complete`` claims conflict."""
    a = distinct_keys(df, keys).withColumn("_a", F.lit(1))
    b = distinct_keys(other, other_keys).withColumn("_b", F.lit(1))
    both = a.join(b, a.columns[:-1], "full_outer")
    return both.agg(
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("shared_count"),
        F.count_if(F.col("_b").isNull()).alias("left_only_count"),
        F.count_if(F.col("_a").isNull()).alias("right_only_count"),
    ).withColumn("conflict_if_complete", F.col("left_only_count") + F.col("right_only_count") > 0)


def composite_without_description(cat: Catalog) -> DataFrame:
    """Columns of composite definitions that no text describes."""
    used = cat.definitions.where(F.size("dataset_columns") > 1).select(
        "node_id", "identity_id", "dataset_columns", F.explode("dataset_columns").alias("name")
    )
    described = cat.columns.where(F.trim(F.coalesce("description", F.lit(""))) != "").select("node_id", "name")
    return used.join(described, ["node_id", "name"], "left_anti")
