"""Language identification by rank-order profiles.

A profile is the list of the most frequent letter n-grams (one to three letters, a word's edge counts
as a letter) in descending frequency. Profiles of languages are counted over all learning texts; a
document's own list is compared with each by the out-of-place distance: the sum, over the document's
n-grams, of how far each stands from its place in the profile, with the list length for absent ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from kinweave.plans.shipping import ship_by_value

ship_by_value(__name__)

LENGTH = 300  # entries of a profile
RUN = 1 << 20  # characters counted at once
UNKNOWN = "und"


class _Letters:
    """Which code points are letters; built once in each worker."""

    table: np.ndarray | None = None

    def __call__(self) -> np.ndarray:
        if self.table is None:
            self.table = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
        return self.table

    def __reduce__(self):
        return _Letters, ()


_letters = _Letters()


def grams(text: str) -> np.ndarray:
    """Codes of all letter n-grams of a text in lower case, repeats included."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[points]
    codes = np.where(letter, (points & np.uint32(0xFFFF)) | np.uint32(0x10000), 0).astype(np.int64)
    edged = np.concatenate([[0], codes, [0]])
    keep = (edged != 0) | (np.concatenate([[1], edged[:-1]]) != 0)
    x = edged[keep]  # words with one 0 between them, and perhaps one at the start
    one = x[x != 0]
    a, b = x[:-1], x[1:]
    two = ((a << 17) | b)[(a != 0) | (b != 0)] | (1 << 60)
    a, b, c = x[:-2], x[1:-1], x[2:]
    three = ((a << 34) | (b << 17) | c)[b != 0] | (1 << 61)
    return np.concatenate([one, two, three])


def ranked(codes: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The most frequent codes, most frequent first, ties by code."""
    unique, counts = np.unique(codes, return_counts=True)
    return unique[np.argsort(-counts, kind="stable")[:length]]


def _count(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[np.ndarray]] = {}  # per language: unique codes and their counts so far

    def fold(lang: str, texts: list[str]) -> None:
        unique, counts = np.unique(grams("\n".join(texts)), return_counts=True)
        if lang in held:
            old, n = held[lang]
            both, inverse = np.unique(np.concatenate([old, unique]), return_inverse=True)
            unique, counts = both, np.bincount(inverse, weights=np.concatenate([n, counts])).astype(np.int64)
        held[lang] = [unique, counts]

    for batch in batch_iter:
        waiting: dict[str, list[str]] = {}
        size: dict[str, int] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            waiting.setdefault(lang, []).append(text)
            size[lang] = size.get(lang, 0) + len(text)
            if size[lang] > RUN:
                fold(lang, waiting.pop(lang))
                size[lang] = 0
        for lang, texts in waiting.items():
            fold(lang, texts)
    for lang, (codes, counts) in held.items():
        yield pa.RecordBatch.from_pydict({
            "lang": pa.array([lang] * len(codes), pa.string()), "code": pa.array(codes, pa.int64()), "n": pa.array(counts, pa.int64())})


def language_profiles(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(lang, place, code): the profile of every non-NULL ``lang``, counted over all its texts."""
    texts = docs.where("lang is not null and text is not null").select("lang", "text")
    counts = texts.mapInArrow(_count, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = W.partitionBy("lang").orderBy(F.desc("n"), "code")
    return counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= length).select("lang", "place", "code")


def identify(docs: DataFrame, profiles: DataFrame, keep: list[str], length: int = LENGTH) -> DataFrame:
    """``keep``, lang_pred and score (1: every n-gram in its place, 0: none found) of every document.

    Texts that are NULL or hold no letter are ``und`` with score 0, and so is everything when there are
    no profiles. Ties go to the first language in code point order. The profiles travel to every task:
    ``length`` entries per language. Columns of ``keep`` with the name of a result column give way to it.
    """
    own = [c for c in dict.fromkeys(keep) if c not in ("lang_pred", "score")]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"_kept_{i}") for i, c in enumerate(own)], F.col("text").alias("_text"))
    table: dict[str, dict[int, int]] = {}
    for row in profiles.collect():
        table.setdefault(row["lang"], {})[row["code"]] = row["place"] - 1
    langs = sorted(table, key=lambda x: x.encode("utf-8"))
    known = np.array(sorted({c for p in table.values() for c in p}), dtype=np.int64)
    places = np.full((len(langs), len(known) + 1), -1, dtype=np.int64)
    for i, lang in enumerate(langs):
        codes = np.array(list(table[lang]), dtype=np.int64)
        places[i, np.searchsorted(known, codes)] = np.array(list(table[lang].values()))

    def best(text: str | None) -> tuple[str, float]:
        own = ranked(grams(text), length) if text and langs else ()
        if not len(own):
            return UNKNOWN, 0.0
        at = np.searchsorted(known, own)
        at[(at >= len(known)) | (known[np.minimum(at, len(known) - 1)] != own)] = len(known)
        theirs = places[:, at]
        away = np.where(theirs < 0, length, np.abs(theirs - np.arange(len(own)))).sum(axis=1)
        i = int(np.argmin(away))
        return langs[i], 1.0 - float(away[i]) / (length * len(own))

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_iter:
            found = [best(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())],
                names=[*batch.schema.names[:-1], "lang_pred", "score"])

    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema[:-1])
    return rows.mapInArrow(run, f"{schema}lang_pred string, score double").toDF(*own, "lang_pred", "score")


def held_out(doc_id: Column) -> Column:
    """One document in four, by its id; a NULL id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def predict_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned on the documents not held out, applied to all."""
    profiles = language_profiles(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs, profiles, ["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
