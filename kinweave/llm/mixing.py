"""Mixing sources to target weights by pivotal dependent rounding.

Each source has a target number of words; a document of a source should be taken target / source size
times. The whole part is taken for certain. The fractional parts are rounded in dependence: two
documents exchange words of probability mass until one of them is taken or not, so the words of the
source stay at their target and only one document is left open. Blocks of documents are rounded in
parallel; each leaves one open document, and blocks of open documents are rounded again, level by
level, until one document per source is left, which a draw decides.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from kinweave.llm.common import carried, uncarried, words
from kinweave.plans.lineage import cut
from kinweave.plans.ordinals import dense_ordinal
from kinweave.plans.shipping import ship_by_value

ship_by_value(__name__)

BLOCK, FAN = 2048, 64


def source_targets(sizes: DataFrame, cap: float = 3.0, cycle: int = 3) -> DataFrame:
    """``sizes`` (source, source_size) plus ``number`` and ``target``.

    Sources in code point order, NULL last, weigh 1 .. ``cycle`` in turn and share the total. A target
    never exceeds ``cap`` times the source's size; the excess is shared by weight among the others.
    """
    numbered = dense_ordinal(sizes.withColumn("_null", F.col("source").isNull()), ["_null", "source"], "number")
    table = cut(numbered.drop("_null").withColumn("weight", (F.col("number") - 1) % cycle + 1))
    most, level, full = F.col("source_size") * cap, 0.0, -1
    while True:  # each turn caps at least one more source
        over = F.col("weight") * level > most
        row = table.agg(
            F.sum("source_size").alias("total"), F.sum(over.cast("int")).alias("n"),
            F.sum(F.when(over, most).otherwise(0.0)).alias("held"), F.sum(F.when(over, 0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        if not row["open"] or row["n"] == full:
            break
        full, level = row["n"], (row["total"] - row["held"]) / row["open"]
    return table.withColumn("target", F.least(most, F.col("weight") * F.lit(float(level))))


def _round(size: np.ndarray, part: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int, float]:
    """0 / 1 for every element but one; that one's place and its remaining fraction."""
    out = np.zeros(len(size), dtype=np.int8)
    draws = rng.random(len(size))
    held, p = 0, float(part[0])
    for i in range(1, len(size)):
        q, a, b = float(part[i]), float(size[held]), float(size[i])
        up, down = min(a * (1 - p), b * q), min(a * p, b * (1 - q))
        if up + down <= 0:  # both are integral already
            out[i], q = int(q >= 0.5), 0.0
            continue
        if draws[i] * (up + down) < down:
            p, q, fixed = p + up / a, q - up / b, a * (1 - p) <= b * q
        else:
            p, q, fixed = p - down / a, q + down / b, a * p <= b * (1 - q)
        if fixed:  # the held document became integral
            out[held] = int(p >= 0.5)
            held, p = i, min(1.0, max(0.0, q))
        else:
            out[i] = int(q >= 0.5)
            p = min(1.0, max(0.0, p))
    return out, held, p


def _level(rows: DataFrame, level: int, seed: int) -> DataFrame:
    """Rounds every (number, block); ``add`` is NULL for the document that stays open, ``part`` its fraction."""

    def block(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tie", "size"], kind="stable").reset_index(drop=True)
        rng = np.random.default_rng([seed, level, int(key[0]), int(key[1])])
        add, held, part = _round(pdf["size"].to_numpy(), pdf["part"].to_numpy(), rng)
        pdf["add"] = pd.array(add, dtype="Int8")
        pdf.loc[held, "add"] = pd.NA
        pdf.loc[held, "part"] = part
        return pdf

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", add tinyint"
    return rows.groupBy("number", "block").applyInPandas(block, schema)


def pivotal_rounding(items: DataFrame, seed: int = 7) -> DataFrame:
    """``items`` (number, tie, size > 0, part in [0, 1), any others) plus ``add`` 0 or 1.

    Per ``number`` the sum of size x add differs from the sum of size x part by less than one
    document. ``tie`` orders rows; reruns agree.
    """
    counts = items.groupBy("number").agg(F.count("*").alias("_n"))
    rows = items.join(F.broadcast(counts) if counts.count() <= 10_000 else counts, "number")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("tie", F.lit("block")), F.ceil(F.col("_n") / BLOCK))).drop("_n")
    first = cut(_level(rows, 0, seed))
    open_ = first.where("add is null").select("number", "tie", "size", "part", F.col("block").alias("leaf"), "block")
    decided, level = None, 0
    while (open_.agg(F.max("block")).first()[0] or 0) > 0:
        level += 1
        done = cut(_level(open_.withColumn("block", F.floor(F.col("block") / FAN)), level, seed))
        part = done.where("add is not null").select("number", "leaf", "add")
        decided = part if decided is None else decided.unionByName(part)
        open_ = done.where("add is null").drop("add")
    draw = F.pmod(F.xxhash64("number", "tie", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    last = open_.select("number", "leaf", (draw < F.col("part")).cast("tinyint").alias("add"))
    decided = (last if decided is None else decided.unionByName(last)).select(
        "number", F.col("leaf").alias("block"), F.col("add").alias("_late")
    )
    opened = first.where("add is null").join(decided, ["number", "block"]).withColumn("add", F.col("_late")).drop("_late")
    return first.where("add is not null").unionByName(opened).drop("block")


def mix(docs: DataFrame, cap: float = 3.0, keep: list[str] | None = None, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken and the columns ``keep`` of every document.

    ``size`` counts words; NULL and empty texts have size 0 and are taken 0 times. NULL is a source of
    its own, the last one. Repeated rows are rows of their own. No row is taken more than ``cap`` times.
    Columns of ``keep`` with the name of a result column give way to it.
    """
    plain, names = carried(docs, keep, ("doc_id", "text", "source"))
    base = cut(plain.select(
        "doc_id", "source", F.size(words(F.col("text"))).cast("bigint").alias("size"),
        F.xxhash64("doc_id", "text").alias("tie"), *names,
    ))
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = cut(source_targets(sizes, cap).select(F.col("source").alias("_source"), "number", "source_size", "target"))
    near = F.broadcast(targets) if targets.count() <= 10_000 else targets
    rows = base.join(near, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("whole", F.floor(times)).withColumn("part", times - F.col("whole"))
    fractional = (F.col("size") > 0) & (F.col("part") > 0)
    rounded = pivotal_rounding(rows.where(fractional), seed)
    certain = rows.where(~fractional).withColumn("add", F.lit(0).cast("tinyint"))
    copies = F.when(F.col("size") > 0, F.col("whole") + F.col("add")).otherwise(0).cast("bigint")
    return uncarried(rounded.unionByName(certain.select(*rounded.columns)).select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"),
        (F.col("size") * copies).alias("taken"), *names,
    ), names)
