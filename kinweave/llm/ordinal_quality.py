"""Quality classifier: ordinal cumulative-link regression on graded ratings.

All grades share one weight per hashed feature; ordered thresholds cut the score into grades:
P(grade >= k) = sigmoid(score - threshold_k). Features are a document's distinct words, word beginnings
and word shapes, hashed to a fixed number of weights and scaled to length 1. The sum of the tail
probabilities is the expected grade; the tail of the highest grade selects.

Fitting: one task runs a few epochs of stochastic gradients over the bounded sample (``PARTS`` = 1), round by
round. With more parts each runs them from the common weights, and the results are averaged on the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F

from kinweave.llm.batches import Piece, lowered, mix, pieces, span_hashes, split
from kinweave.llm.common import arrow_rows
from kinweave.plans.lineage import cut
from kinweave.plans.shipping import ship_by_value

ship_by_value(__name__)

BITS, PREFIXES = 17, (5, 7)
#: More parts fit faster; on samples of this size one part is markedly more accurate.
PARTS, SLICES, ROUNDS, EPOCHS, BATCH = 1, 16, 2, 5, 32
SAMPLE = 20_000  # labelled documents to fit on, about
ROWS = 1000  # rows sent to a worker at a time: workers keep the memory of their largest batch
SMALL_PIECE = 1 << 16  # bytes of text at a time: the arrays of features are many times as large


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one per grade above the lowest


def _kind(byte: np.ndarray) -> np.ndarray:
    """Letters by case, digits and non-ASCII bytes as classes, anything else as itself."""
    out = byte.astype(np.uint64)
    for low, high, name in ((97, 122, 1), (65, 90, 2), (48, 57, 3), (128, 255, 4)):
        out[(byte >= low) & (byte <= high)] = name
    return out


def features(piece: Piece, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of the rows, row after row, and how many each row has."""
    words = split(piece, lower=True)
    first, last = _kind(piece.data[words.starts]), _kind(piece.data[words.ends - 1])
    before = _kind(piece.data[np.maximum(words.ends - 2, words.starts)])
    middle = _kind(piece.data[np.minimum(words.starts + 1, words.ends - 1)])
    size = np.minimum((words.ends - words.starts) // 8, 7).astype(np.uint64)
    shape = mix((((first * np.uint64(256) + middle) * np.uint64(256) + before) * np.uint64(256) + last) * np.uint64(8) + size)
    row = words.row.astype(np.uint64) << np.uint64(bits)
    low = np.uint64((1 << bits) - 1)
    kinds, data = [words.hashes, shape], lowered(piece.data)
    for n in PREFIXES:  # bytes
        kinds.append(mix(span_hashes(data, words.starts, np.minimum(words.ends, words.starts + n)) + np.uint64(n)))
    keys = np.unique(np.concatenate([row | (kind & low) for kind in kinds]))
    counts = np.bincount((keys >> np.uint64(bits)).astype(np.int64), minlength=len(piece.bounds) - 1)
    return (keys & low).astype(np.int32), counts


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def tails(score: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """P(grade >= k) for k = 1, 2, .. in columns."""
    return 1 / (1 + np.exp(-np.clip(score[:, None] - thresholds[None, :], -40, 40)))


def _gradients(score: np.ndarray, grade: np.ndarray, thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the log likelihood, by score (per row) and by threshold (sums)."""
    t = tails(score, thresholds)
    one, zero = np.ones((len(score), 1)), np.zeros((len(score), 1))
    full = np.hstack([one, t, zero])  # tail of grade 0 is 1, beyond the last 0
    slope = full * (1 - full)
    at = np.arange(len(score))
    p = np.maximum(full[at, grade] - full[at, grade + 1], 1e-9)
    up, down = slope[at, grade] / p, slope[at, grade + 1] / p
    k = len(thresholds)
    by_threshold = np.bincount(grade, weights=-up, minlength=k + 1)[1:] + np.bincount(grade, weights=down, minlength=k + 1)[:-1]
    return up - down, by_threshold


def _epochs(model: Model, grade: np.ndarray, index: np.ndarray, counts: np.ndarray, seed: int) -> Model:
    w, th = model.weights.copy(), model.thresholds.copy()
    seen, seen_th = np.full(len(w), 1e-6), np.full(len(th), 1e-6)
    ends, rng = np.cumsum(counts), np.random.default_rng(seed)
    for _ in range(EPOCHS):
        order = rng.permutation(len(grade))
        for low in range(0, len(order), BATCH):
            rows = order[low : low + BATCH]
            n = counts[rows]
            at = np.repeat(ends[rows] - np.cumsum(n), n) + np.arange(n.sum())
            scale = 1 / np.sqrt(np.maximum(n, 1))
            score = _sums(w[index[at]], n) * scale
            by_score, by_th = _gradients(score, grade[rows], th)
            g = np.bincount(index[at], weights=np.repeat(by_score * scale, n), minlength=len(w))
            g -= 1e-4 * w
            seen += g * g
            w += 0.5 * g / np.sqrt(seen)
            seen_th += by_th * by_th
            th += 0.5 * by_th / np.sqrt(seen_th)
            th = np.maximum.accumulate(th)  # the order of grades holds at every step
    return Model(w, th)


def _average(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Means over parts, weighted by their rows; rows come by slice and part."""
    sums: dict[int, list] = {}
    for batch in batch_iter:
        for r in batch.to_pylist():
            held = sums.setdefault(r["slice"], [0.0, 0])
            held[0], held[1] = held[0] + r["n"] * np.frombuffer(r["w"]), held[1] + r["n"]
    for number, (total, n) in sums.items():
        yield pa.RecordBatch.from_pydict({"slice": pa.array([number], pa.int32()), "w": [(total / n).tobytes()]})


def fit(rated: DataFrame, grades: int, bits: int = BITS) -> Model:
    """Fits on ``rated`` (doc_id, text, grade in 0 .. ``grades`` - 1); no rows give a model that keeps all."""
    with arrow_rows(rated.sparkSession, ROWS):
        return _fit(rated, grades, bits)


def _fit(rated: DataFrame, grades: int, bits: int) -> Model:

    def extract(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_iter:
            for piece in pieces(batch.column(1), SMALL_PIECE):
                index, counts = features(piece, bits)
                part = batch.slice(piece.first, piece.last - piece.first)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.ListArray.from_arrays(pa.array(offsets), pa.array(index))], ["doc_id", "grade", "index"])

    rows = rated.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.col("grade").cast("int").alias("grade"))
    table = rows.mapInArrow(extract, "doc_id bigint, grade int, index array<int>")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int")
    table = table.withColumn("part", part).repartition("part").sortWithinPartitions("part", "doc_id", F.xxhash64("index"))
    table = cut(table.select("part", "grade", "index"))
    model = Model(np.zeros(1 << bits), np.linspace(-1.0, -0.5, grades - 1))
    for turn in range(ROUNDS):

        def train(batch_iter: Iterator[pa.RecordBatch], start: Model = model, seed: int = turn) -> Iterator[pa.RecordBatch]:
            """Each part from the common model; the result is dealt in slices, to be averaged slice by slice."""
            held: dict[int, list[pa.RecordBatch]] = {}
            for batch in batch_iter:
                numbers = batch.column(0).to_numpy()
                for number in np.unique(numbers).tolist():
                    held.setdefault(number, []).append(batch if (numbers == number).all() else batch.filter(pa.array(numbers == number)))
            for number in list(held):
                batches = held.pop(number)  # the rows are held once while the model is fitted
                grade = np.concatenate([b.column(1).to_numpy() for b in batches])
                counts = np.concatenate([pa.compute.list_value_length(b.column(2)).to_numpy() for b in batches]).astype(np.int64)
                index = np.concatenate([b.column(2).flatten().to_numpy() for b in batches])
                batches.clear()
                new = _epochs(start, grade, index, counts, seed)
                vector = np.concatenate([new.weights, new.thresholds])
                yield pa.RecordBatch.from_pydict({
                    "slice": pa.array(range(SLICES), pa.int32()), "part": pa.array([number] * SLICES, pa.int32()),
                    "n": pa.array([len(grade)] * SLICES, pa.int64()), "w": pa.array([x.tobytes() for x in np.array_split(vector, SLICES)])})

        slices = table.mapInArrow(train, "slice int, part int, n bigint, w binary").repartition("slice").sortWithinPartitions("slice", "part")
        averaged = slices.mapInArrow(_average, "slice int, w binary").collect()  # one model in SLICES rows
        if not averaged:
            break
        vector = np.concatenate([np.frombuffer(r["w"]) for r in sorted(averaged, key=lambda r: r["slice"])])
        model = Model(vector[: 1 << bits], vector[1 << bits :])
    return model


def ratings(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text, grade) of about ``sample`` labelled documents: toxic 0, low quality 1, else 2.

    Labels without an id are left out, and so are those without a quality unless they are toxic; several labels of one id count by the worst.
    The chosen labels are at most a little over ``sample`` rows, so they are broadcast.
    """
    grade = F.when(F.coalesce("toxic", F.lit(0)) == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    graded = labels.where("doc_id is not null and (quality is not null or toxic = 1)").groupBy("doc_id").agg(F.min(grade).alias("grade"))
    graded = cut(graded)
    n = graded.count()
    within = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(int(1_000_000 * min(1.0, sample / max(1, n))))
    return docs.select("doc_id", "text").join(F.broadcast(graded.where(within)), "doc_id")


def grade_documents(docs: DataFrame, model: Model, keep: list[str], at_least: float = 0.5) -> DataFrame:
    """``keep`` plus expected_grade, tail (probability of the highest grade) and kept.

    NULL and empty texts have no features; the thresholds alone grade them. Columns of ``keep`` with the name
    of a result column give way to it.
    """
    bits = int(len(model.weights)).bit_length() - 1
    own = [c for c in dict.fromkeys(keep) if c not in ("expected_grade", "tail", "kept")]
    rows = docs.select(F.col("text").alias("_text"), *[F.col(f"`{c}`").alias(f"_kept_{i}") for i, c in enumerate(own)])

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_iter:
            for piece in pieces(batch.column(0), SMALL_PIECE):
                index, counts = features(piece, bits)
                t = tails(_sums(model.weights[index], counts) / np.sqrt(np.maximum(counts, 1)), model.thresholds)
                part = batch.slice(piece.first, piece.last - piece.first)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[1:], pa.array(t.sum(axis=1)), pa.array(t[:, -1]), pa.array(t[:, -1] >= at_least)],
                    names=[*part.schema.names[1:], "expected_grade", "tail", "kept"])

    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema[1:])
    return rows.mapInArrow(run, f"{schema}expected_grade double, tail double, kept boolean").toDF(*own, "expected_grade", "tail", "kept")


def quality_model(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    return fit(ratings(docs, labels, sample), 3)
