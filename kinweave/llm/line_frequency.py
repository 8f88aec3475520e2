"""Quality rules by cross-document line frequency.

Lines are normalised and hashed; per host (``source``) the documents that hold a line are counted. A
line in more than ``max(min_docs, share x documents of the host)`` documents is boilerplate and is
removed; a document that keeps less than ``left`` of its words is depleted and rejected. A host has at
most (mean distinct lines per document) / ``share`` such lines, so they fit beside the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kinweave.llm.common import bound, small, words
from kinweave.plans.lineage import cut

#: Characters that count as symbols, and the separators between words (fixed values).
SYMBOLS, SEPARATORS = "#*$%&|<>", " \t\n\x0b\f\r"
MOST_ROWS = 100_000


def normal_line(line: Column) -> Column:
    """Lower case, one blank between words, every digit as 0."""
    return F.translate(F.lower(F.array_join(words(line), " ")), "123456789", "000000000")


def _without(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def repeated_words(tokens: Column, n: int = 3) -> Column:
    """Words inside n-word windows that occur twice or more in the same document."""

    def covered(starts: Column) -> Column:
        step = F.transform(starts, lambda p, i: F.least(F.lit(n), F.coalesce(F.get(starts, i + 1) - p, F.lit(n))))
        return F.aggregate(step, F.lit(0), lambda a, b: a + b)

    def repeats(ordered: Column) -> Column:
        same = lambda x, i: F.coalesce(x["h"] == F.get(ordered, i)["h"], F.lit(False))
        twice = F.filter(ordered, lambda x, i: same(x, i - 1) | same(x, i + 1))
        return bound(F.array_sort(F.transform(twice, lambda x: x["p"])), covered)

    def windows(hashes: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(hashes) - n)
        each = F.transform(at, lambda i: F.struct(
            F.xxhash64(*[F.get(hashes, i + k) for k in range(n)]).alias("h"), i.alias("p")))
        return F.when(F.size(hashes) >= n, bound(F.sort_array(each), repeats)).otherwise(0)

    return bound(F.transform(tokens, lambda w: F.xxhash64(w)), windows)


def frequent_lines(docs: DataFrame, min_docs: int, share: float) -> DataFrame:
    """(source, lines): hashes of the lines above the host's limit, one row per host that has any."""
    lines = F.filter(F.transform(F.split(F.col("text"), "\n"), normal_line), lambda x: x != "")
    held = docs.where(F.col("text").isNotNull()).select(
        "source", F.explode(F.array_distinct(F.transform(lines, lambda x: F.xxhash64(x)))).alias("line"))
    counts = held.groupBy("source", "line").agg(F.count("*").alias("n")).where(F.col("n") > min_docs)
    hosts = docs.groupBy(F.col("source").alias("host")).agg(F.count("*").alias("docs"))
    return counts.join(hosts, F.col("source").eqNullSafe(F.col("host"))).where(F.col("n") > F.col("docs") * share).groupBy(
        "source").agg(F.collect_set("line").alias("lines"))


def quality_rules(
    docs: DataFrame, min_docs: int = 20, share: float = 0.05, left: float = 0.5, keep: list[str] | None = None
) -> DataFrame:
    """Base counts, ``base_failed``, ``kept``, ``n_removed`` and ``clean_text`` of every document.

    NULL and empty texts have no words and fail the base rule. NULL is a host of its own. Repeated rows
    count as documents of their own. ``clean_text`` is the text without its boilerplate lines.
    """
    frequent = cut(frequent_lines(docs, min_docs, share)).select(F.col("source").alias("_host"), F.col("lines").alias("_often"))
    text = F.coalesce(F.col("text"), F.lit(""))
    split = F.split(text, "\n")
    rows = docs.select(
        "doc_id", "source", *[c for c in keep or [] if c not in ("doc_id", "source")], text.alias("_text"),
    ).join(small(frequent, MOST_ROWS), F.col("source").eqNullSafe(F.col("_host")), "left")
    text, split = F.col("_text"), F.split(F.col("_text"), "\n")
    often = F.coalesce("_often", F.array().cast("array<bigint>"))
    boiler = lambda line: F.array_contains(often, F.xxhash64(normal_line(line)))
    removed = F.when(F.size(often) > 0, F.aggregate(
        F.filter(split, boiler), F.lit(0), lambda n, line: n + F.size(words(line)))).otherwise(0)
    worded = F.filter(split, lambda line: F.length(F.translate(line, SEPARATORS, "")) > 0)
    tokens = words(text)
    rows = rows.select(
        *[c for c in rows.columns if c not in ("_often", "_host")],
        F.size(tokens).cast("bigint").alias("n_words"),
        F.length(F.translate(text, SEPARATORS, "")).cast("bigint").alias("word_chars"),
        _without(text, SYMBOLS).cast("bigint").alias("n_symbols"),
        bound(worded, lambda lines: F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        repeated_words(tokens).cast("bigint").alias("n_repeat_words"),
        removed.cast("bigint").alias("n_removed"),
        F.when(F.size(often) > 0, F.array_join(F.filter(split, lambda line: ~boiler(line)), "\n")).otherwise(text).alias("clean_text"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    kept = ~failed & (F.col("n_words") - F.col("n_removed") >= left * F.col("n_words"))
    return rows.drop("_text").withColumns({"base_failed": failed, "kept": kept})
