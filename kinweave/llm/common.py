"""Shared pieces of the corpus operators: reading, word rules, and keys that tell rows apart."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Separators between words, as a regular expression and as bytes: blank and the five ASCII controls 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Words between separators; NULL and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def small(df: DataFrame, most_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most_rows`` rows, else as it is.

    Call it on a materialised table: the size is counted, not estimated.
    """
    return F.broadcast(df) if df.count() <= most_rows else df


@contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """Batches of at most ``most`` rows for the jobs that run inside: whole texts are long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(most, int(before)) if int(before) > 0 else most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def carried(docs: DataFrame, keep: list[str] | None, own: tuple[str, ...] = ("doc_id", "text")) -> tuple[DataFrame, dict[str, str]]:
    """The ``own`` columns of ``docs``, and those of ``keep`` under names that no operator uses, with their real names."""
    names = {f"_kept_{i}": c for i, c in enumerate(dict.fromkeys(c for c in keep or [] if c not in own))}
    return docs.select(*own, *[F.col(f"`{c}`").alias(a) for a, c in names.items()]), names


def uncarried(result: DataFrame, names: dict[str, str]) -> DataFrame:
    """``result`` with its carried columns under their real names; one that has the name of a result column gives way."""
    taken = set(result.columns)
    return result.select(*[c for c in result.columns if c not in names], *[F.col(a).alias(c) for a, c in names.items() if c not in taken])
