"""Substring deduplication with suffix automata of reference shards.

A run of ``width`` words is removed from a document if it also starts in a document with a smaller id.

1. Every window of ``width`` words has an anchor, the least hash of its short word runs; equal windows
   have equal anchors. An anchor's owner is the smallest document that holds it. Windows whose anchor
   occurs in one document only are unique and go no further.
2. Neighbouring windows of one owner form a span. Spans are the reference passages as well as the
   queries; equal spans are one passage, whose first document is its smallest.
3. Passages are dealt to shards by owner, so texts that can match meet, and no shard is larger than a
   bound: an owner with more than that is dealt by anchor, and an anchor with more than that by window.
   Each shard's passages are streamed in document order through the shard's automaton, which holds the
   passages of smaller documents: the matching statistics give the words to remove. Then the passage is
   added.
4. Later occurrences of a passage go as a whole; its first one loses what the automaton found.

Sending every automaton to every document would cost shards x documents; with the anchors a document
only meets the shards that can match it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kinweave.llm.batches import Piece, mix, pieces, split
from kinweave.llm.common import small
from kinweave.llm.shared_keys import shared_keys
from kinweave.llm.token_codes import shared_folder
from kinweave.plans.lineage import cut
from kinweave.plans.shipping import ship_by_value

ship_by_value(__name__)

GRAM = 6  # words of an anchor
SHARD = 200_000  # distinct windows of a reference shard
SAMPLE, LONG = 16, 20


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbouring values."""
    span = 1
    while span * 2 <= width:
        values, span = np.minimum(values[:-span], values[span:]), span * 2
    if span < width:
        values = np.minimum(values[: len(values) - (width - span)], values[width - span :])
    return values


def _grams(hashes: np.ndarray, n: int) -> np.ndarray:
    m = len(hashes) - n + 1
    out = np.zeros(max(m, 0), dtype=np.uint64)
    for k in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + max(m, 0)]
    return mix(out) >> np.uint64(1)


def window_anchors(hashes: np.ndarray, width: int) -> np.ndarray:
    """The anchor of each window of one document's word hashes."""
    if len(hashes) < width:
        return np.zeros(0, dtype=np.uint64)
    return _least(_grams(hashes, GRAM), width - GRAM + 1)


def _piece_anchors(piece: Piece, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) of a piece's windows, without neighbours that agree."""
    words = split(piece)
    if len(words.hashes) < width:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    anchors = _least(_grams(words.hashes, GRAM), width - GRAM + 1)
    same = words.row[: len(anchors)] == words.row[width - 1 :]
    anchors, row = anchors[same], words.row[: len(same)][same]
    fresh = np.ones(len(anchors), dtype=bool)
    fresh[1:] = (anchors[1:] != anchors[:-1]) | (row[1:] != row[:-1])
    return row[fresh], anchors[fresh]


def _anchors(width: int):
    def extract(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for piece in pieces(batch.column(1)):
            row, anchors = _piece_anchors(piece, width)
            if len(row):
                yield ids[piece.first : piece.last][row], anchors

    return extract


SPANS = "array<struct<owner: bigint, start: int, n: int>>"
STAGED = f"doc_id bigint, text_key bigint, n_words bigint, kept_sha256 string, text string, spans {SPANS}"


def _runs(keys: np.ndarray, live: np.ndarray) -> list[tuple[int, int]]:
    """[start, end) of equal neighbouring keys where ``live``."""
    if not live.any():
        return []
    edge = np.ones(len(keys) + 1, dtype=bool)
    edge[1:-1] = (keys[1:] != keys[:-1]) | (live[1:] != live[:-1])
    at = np.flatnonzero(edge)
    return [(a, b) for a, b in zip(at[:-1].tolist(), at[1:].tolist()) if live[a]]


def _spans(width: int):
    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_type = pa.list_(pa.struct([("owner", pa.int64()), ("start", pa.int32()), ("n", pa.int32())]))
        for batch in batch_iter:
            ids, keys, hits = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)
            for piece in pieces(batch.column(2)):
                words = split(piece)
                ends = np.cumsum(words.per_row)
                out = {k: [] for k in ("doc_id", "text_key", "n_words", "kept_sha256", "text", "spans")}
                for i in range(piece.last - piece.first):
                    at = piece.first + i
                    data = piece.data[piece.bounds[i] : piece.bounds[i + 1]].tobytes()
                    own = words.hashes[ends[i] - words.per_row[i] : ends[i]]
                    known, found = hits[at].values if hits[at].is_valid else None, []
                    if known is not None and len(own) >= width:
                        anchor = known.field(0).to_numpy().astype(np.uint64)
                        order = np.argsort(anchor)
                        anchor, owner = anchor[order], known.field(1).to_numpy()[order]
                        mine = mix(window_anchors(own, width))
                        place = np.minimum(np.searchsorted(anchor, mine), len(anchor) - 1)
                        live = anchor[place] == mine
                        for a, b in _runs(np.where(live, owner[place], 0), live):
                            found.append({"owner": int(owner[place[a]]), "start": a, "n": b - a + width - 1})
                    out["doc_id"].append(ids[at])
                    out["text_key"].append(keys[at])
                    out["n_words"].append(len(own))
                    out["kept_sha256"].append(None if found else hashlib.sha256(b" ".join(data.split())).hexdigest())
                    out["text"].append(data.decode("utf-8") if found else None)
                    out["spans"].append(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out["doc_id"], pa.int64()), pa.array(out["text_key"], pa.int64()), pa.array(out["n_words"], pa.int64()),
                     pa.array(out["kept_sha256"], pa.string()), pa.array(out["text"], pa.string()), pa.array(out["spans"], spans_type)],
                    names=list(out))

    return run


class SuffixAutomaton:
    """Of the windows of several word sequences; each state knows the document that brought it.

    Strings up to ``width`` words are exact. After each word the state falls back to the one of the last
    ``width`` words, so texts that agree again after a difference share states: their number follows the
    distinct windows, not the length of all passages.
    """

    def __init__(self, width: int) -> None:
        self.width = width
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [-1]

    def _state(self, step: dict[int, int], link: int, length: int, first: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.link) - 1

    def _split(self, p: int, word: int) -> int:
        """The state of exactly ``p`` + ``word``, cut off from a longer one if need be."""
        q = self.step[p][word]
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(dict(self.step[q]), self.link[q], self.length[p] + 1, self.first[q])
        self.link[q] = copy
        while p != -1 and self.step[p].get(word) == q:
            self.step[p][word] = copy
            p = self.link[p]
        return copy

    def add(self, words: list[int], doc: int) -> None:
        """Documents must come in ascending order."""
        last = 0
        for word in words:
            while self.length[last] > self.width and self.length[self.link[last]] >= self.width:
                last = self.link[last]
            if word in self.step[last]:
                last = self._split(last, word)
                continue
            new, p = self._state({}, 0, self.length[last] + 1, doc), last
            while p != -1 and word not in self.step[p]:
                self.step[p][word] = new
                p = self.link[p]
            if p != -1:
                self.link[new] = self._split(p, word)
            last = new

    def matches(self, words: list[int], doc: int) -> np.ndarray:
        """Which windows occur in a document before ``doc``."""
        width = self.width
        found = np.zeros(max(len(words) - width + 1, 0), dtype=bool)
        step, link, length = self.step, self.link, self.length
        state = held = 0
        for i, word in enumerate(words):
            while state and word not in step[state]:
                state = link[state]
                held = length[state]
            state = step[state].get(word, 0)
            held = held + 1 if state else 0
            while held > width and length[link[state]] >= width:  # the rest of a longer match is not needed
                state = link[state]
                held = length[state]
            if held >= width and self.first[state] < doc:
                found[i - width + 1] = True
        return found


OCCURRENCE = "doc_id bigint, place bigint, place_key bigint, place_n int, start int, key bigint, words binary"


def _span_words(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The spans of documents (doc_id, text_key, text, spans), one row each, with their word hashes."""
    for batch in batch_iter:
        ids, keys, spans = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()
        for piece in pieces(batch.column(2)):
            words = split(piece)
            first = np.cumsum(words.per_row) - words.per_row
            rows = [
                (ids[i], keys[i], s["start"], s["owner"], words.hashes[(at := first[i - piece.first] + s["start"]) : at + s["n"]].tobytes())
                for i in range(piece.first, piece.last) for s in spans[i]
            ]
            doc, key, start, owner, data = zip(*rows) if rows else ((),) * 5
            none = pa.nulls(len(rows), pa.int64())
            yield pa.RecordBatch.from_arrays([
                pa.array(doc, pa.int64()), pa.array(key, pa.int64()), none, none.cast(pa.int32()), pa.array(start, pa.int32()),
                pa.array(owner, pa.int64()), pa.array(data, pa.binary())],
                names=["doc_id", "place", "place_key", "place_n", "start", "key", "words"])


def _recut(width: int, by_window: bool):
    """Passages (key, sid, n, first, words) cut where the anchor changes, or into single windows, as occurrences in them."""

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_iter:
            out = []
            for r in batch.to_pylist():
                words = np.frombuffer(r["words"], "<u8")
                keys = _grams(words, width) if by_window else window_anchors(words, width)
                cuts = [(i, i + 1) for i in range(len(keys))] if by_window else _runs(keys, np.ones(len(keys), bool))
                out += [{"doc_id": r["first"], "place": r["key"], "place_key": r["sid"], "place_n": r["n"], "start": a, "key": int(keys[a]),
                         "words": words[a : b + width - 1].tobytes()} for a, b in cuts]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([
                ("doc_id", pa.int64()), ("place", pa.int64()), ("place_key", pa.int64()), ("place_n", pa.int32()), ("start", pa.int32()),
                ("key", pa.int64()), ("words", pa.binary())]))

    return run


PASSAGE = "key bigint, sid bigint, n int, first bigint, words binary"
KNOWN = "key bigint, sid bigint, n int, first bigint, runs array<struct<at: int, size: int>>"


def _automata(width: int, by_owner: bool):
    """Passages come by shard, and within a shard by first document; an owner's own passage asks for nothing."""

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, automaton = None, SuffixAutomaton(width)
        for batch in batch_iter:
            out = []
            for r in batch.to_pylist():
                if r["shard"] != shard:
                    shard, automaton = r["shard"], SuffixAutomaton(width)
                words = np.frombuffer(r["words"], "<u8").tolist()
                runs = []
                if not (by_owner and r["key"] == r["first"]):
                    found = automaton.matches(words, r["first"])
                    runs = [{"at": a, "size": b - a + width - 1} for a, b in _runs(found, found)]
                automaton.add(words, r["first"])
                out.append({"key": r["key"], "sid": r["sid"], "n": r["n"], "first": r["first"], "runs": runs})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([
                ("key", pa.int64()), ("sid", pa.int64()), ("n", pa.int32()), ("first", pa.int64()),
                ("runs", pa.list_(pa.struct([("at", pa.int32()), ("size", pa.int32())])))]))

    return run


def _sampled(width: int):
    """(key, window): one window hash in SAMPLE of each passage."""

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_iter:
            keys, out_keys, out = batch.column(0).to_pylist(), [], []
            for key, words in zip(keys, batch.column(1).to_pylist()):
                windows = _grams(np.frombuffer(words, "<u8"), width)
                windows = windows[windows % np.uint64(SAMPLE) == 0]
                out_keys.append(np.full(len(windows), key, dtype=np.int64))
                out.append(windows.astype(np.int64))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_keys)), pa.array(np.concatenate(out))], names=["key", "window"])

    return run


def _beyond(passages: DataFrame, width: int, shard_words: int) -> DataFrame:
    """Keys whose automaton would be too large: by distinct windows, or by LONG times as many words.

    The windows of keys with many words are counted on a hash sample; the count only chooses how finely
    a key is dealt, never what is found.
    """
    words = passages.groupBy("key").agg(F.sum("n").alias("w")).where(F.col("w") > shard_words)
    words = cut(words)
    near = small(words, 100_000)
    windows = passages.join(near.select("key"), "key", "left_semi").select("key", "words").mapInArrow(_sampled(width), "key bigint, window bigint")
    many = windows.distinct().groupBy("key").agg((F.count("*") * SAMPLE).alias("v")).where(F.col("v") > shard_words)
    return words.where(F.col("w") > shard_words * LONG).select("key").unionByName(many.select("key")).distinct()


def _resolve(occurrences: DataFrame, width: int, shard_words: int, folder: str, level: int = 0) -> DataFrame:
    """Which words of ``occurrences`` to remove: their place and document with ``cover``, runs of words.

    ``level`` 0 deals passages by owner, 1 by anchor, 2 by window.
    """
    spark = occurrences.sparkSession
    occurrences = occurrences.withColumns({"sid": F.xxhash64("words"), "n": (F.octet_length("words") / 8).cast("int")})
    path = f"{folder}-{level}"
    occurrences.groupBy("key", "sid", "n").agg(F.min("doc_id").alias("first"), F.first("words").alias("words")).write.option(
        "compression", "zstd").parquet(path)
    passages = spark.read.schema(PASSAGE).parquet(path)
    nothing = F.array().cast("array<struct<at: int, size: int>>")
    if level == 2:  # one window each, so equal windows are one passage
        known = passages.select("key", "sid", "n", "first", nothing.alias("runs"))
    else:
        heavy = cut(_beyond(passages, width, shard_words))
        near = small(heavy, 100_000)
        light = passages.join(near, "key", "left_anti")
        total = passages.agg(F.sum("n")).first()[0] or 0
        shards = max(1, 2 * math.ceil(total / shard_words))
        dealt = light.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")).repartition("shard")
        dealt = dealt.sortWithinPartitions("shard", "first", "key", "sid").select("shard", "key", "sid", "n", "first", "words")
        known = dealt.mapInArrow(_automata(width, level == 0), KNOWN)
        if heavy.limit(1).count():
            large = passages.join(near, "key", "left_semi").select("key", "sid", "n", "first", "words")
            finer = _resolve(large.mapInArrow(_recut(width, level == 1), OCCURRENCE), width, shard_words, folder, level + 1)
            runs = finer.groupBy("place", "place_key", "place_n").agg(F.flatten(F.collect_list("cover")).alias("runs"))
            ids = large.select("key", "sid", "n", "first")
            same = (F.col("key") == F.col("place")) & (F.col("sid") == F.col("place_key")) & (F.col("n") == F.col("place_n"))
            known = known.unionByName(ids.join(runs, same, "left").select("key", "sid", "n", "first", F.coalesce("runs", nothing).alias("runs")))
    whole = F.array(F.struct(F.lit(0).alias("at"), F.col("n").alias("size")))
    gone = F.when(F.col("doc_id") > F.col("first"), whole).otherwise(F.col("runs"))
    cover = F.transform(gone, lambda r: F.struct((F.col("start") + r["at"]).alias("at"), r["size"].alias("size")))
    places = occurrences.select("doc_id", "place", "place_key", "place_n", "start", "key", "sid", "n")
    return places.join(known, ["key", "sid", "n"]).where(F.size(gone) > 0).select("doc_id", "place", "place_key", "place_n", cover.alias("cover"))


def _remove(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batch_iter:
        out = {"doc_id": batch.column(0), "n_words": [], "n_removed": [], "kept_text": []}
        for text, cover in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            words = text.encode("utf-8").split()
            keep = np.ones(len(words), dtype=bool)
            for c in cover or []:
                keep[c["at"] : c["at"] + c["size"]] = False
            out["n_words"].append(len(words))
            out["n_removed"].append(int(len(words) - keep.sum()))
            out["kept_text"].append(b" ".join(compress(words, keep.tolist())).decode("utf-8"))
        yield pa.RecordBatch.from_arrays(
            [out["doc_id"], pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["kept_text"], pa.string())],
            names=list(out))


def remove_repeats(docs: DataFrame, width: int = 13, shard_words: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """(changed, untouched): changed rows have doc_id, n_words, n_removed, kept_text; untouched ones
    doc_id, n_words, kept_sha256 of their words joined by blanks.

    Rows with one doc_id are one document when smaller ids are asked for. Rows with a NULL id are
    compared with nothing. NULL and empty texts have no words; texts under ``width`` words stay whole.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    hits = shared_keys(docs.where("doc_id is not null").select("doc_id", "text"), _anchors(width), size // 16).groupBy(
        F.col("doc").alias("doc_id")).agg(F.collect_list(F.struct("key", "owner")).alias("hits"))
    path = shared_folder(spark, "spans")
    docs.join(hits, "doc_id", "left").select("doc_id", "text_key", "text", "hits").mapInArrow(_spans(width), STAGED).write.option(
        "compression", "zstd").parquet(path)
    staged = spark.read.schema(STAGED).parquet(path)

    spans = staged.where("text is not null").select("doc_id", "text_key", "text", "spans").mapInArrow(_span_words, OCCURRENCE)
    covers = _resolve(spans, width, shard_words, path + "-passages").groupBy("doc_id", F.col("place").alias("text_key")).agg(
        F.flatten(F.collect_list("cover")).alias("cover"))
    pending = staged.where("text is not null").select("doc_id", "text_key", "text")
    changed = pending.join(covers, ["doc_id", "text_key"], "left").select("doc_id", "text", "cover").mapInArrow(
        _remove, "doc_id bigint, n_words bigint, n_removed bigint, kept_text string")
    return changed, staged.where("text is null").select("doc_id", "n_words", "kept_sha256")
