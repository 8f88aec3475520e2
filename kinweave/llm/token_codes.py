"""Token ids as directly addressable codes.

An id is split into 8-bit chunks, lowest first. Level k holds chunk k of every id that has one, a bitmap
that says which of them go on to level k + 1, and a rank directory: the set bits before every 512th
entry. The entry of an id in the next level is the rank of its bit, so any token is found by one
look-up per level, without decoding what stands before it.

A shard file holds segments: rows of a Parquet table with the levels as binary columns, the documents
they hold and where each begins. Shards follow the order of doc_id. Spark's writer commits them, so a
lost executor or a repeated task leaves no half file.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window as W

from kinweave.llm.batches import Piece, lowered, pieces, span_hashes, split
from kinweave.llm.common import small
from kinweave.plans.lineage import ensure_checkpoint_dir
from kinweave.plans.shipping import ship_by_value

ship_by_value(__name__)

SEGMENT = 1 << 18  # tokens; a longer document is a segment of its own
BLOCK = 512  # entries of a bitmap between two entries of its rank directory
SLOTS = 1 << 21  # of the words a task knows
LINE = 128  # words of letters encoded at a time
LEVELS = "levels array<struct<chunks: binary, more: binary, ranks: binary>>"
FILE = f"part int, seg int, n_tokens bigint, doc_ids array<bigint>, doc_starts array<bigint>, {LEVELS}"


def encode_levels(ids: np.ndarray) -> list[dict[str, bytes]]:
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 0xFF
        counts = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.uint64) if len(more) else np.zeros(0, np.uint64)
        levels.append({
            "chunks": (rest & 0xFF).astype(np.uint8).tobytes(),
            "more": np.packbits(more, bitorder="little").tobytes(),
            "ranks": np.concatenate([[0], np.cumsum(counts)[:-1]]).astype("<u8").tobytes() if len(more) else b"",
        })
        rest = rest[more] >> np.uint32(8)
        if not len(rest):
            return levels


def access(levels: list[dict[str, bytes]], at: np.ndarray) -> np.ndarray:
    """The tokens at positions ``at`` of a segment."""
    at = np.asarray(at, dtype=np.int64)
    out = np.zeros(len(at), dtype=np.uint32)
    live = np.arange(len(at))
    for k, level in enumerate(levels):
        chunks, bits = np.frombuffer(level["chunks"], np.uint8), np.frombuffer(level["more"], np.uint8)
        out[live] |= chunks[at].astype(np.uint32) << np.uint32(8 * k)
        goes_on = (bits[at >> 3] >> (at & 7)) & 1 == 1
        live, at = live[goes_on], at[goes_on]
        if not len(live):
            break
        block = at // BLOCK
        inside = np.arange(BLOCK // 8)[None, :] + (block * (BLOCK // 8))[:, None]
        full = np.bitwise_count(np.where(inside < (at >> 3)[:, None], bits[np.minimum(inside, len(bits) - 1)], 0)).sum(axis=1, dtype=np.int64)
        last = np.bitwise_count(bits[at >> 3] & ((1 << (at & 7)) - 1).astype(np.uint8)).astype(np.int64)
        at = np.frombuffer(level["ranks"], "<u8")[block].astype(np.int64) + full + last
    return out


def decode_levels(levels: list[dict[str, bytes]]) -> np.ndarray:
    """All tokens of a segment, from the highest level down."""
    rest = np.zeros(0, dtype=np.uint32)
    for level in reversed(levels):
        chunks = np.frombuffer(level["chunks"], np.uint8).astype(np.uint32)
        more = np.unpackbits(np.frombuffer(level["more"], np.uint8), count=len(chunks), bitorder="little").astype(bool)
        chunks[more] |= rest << np.uint32(8)
        rest = chunks
    return rest


_MARK = np.zeros(256, dtype=bool)
_MARK[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_PLAIN = np.zeros(256, dtype=bool)
_PLAIN[[c for c in range(128) if chr(c).isalnum()]] = True


def _units(piece: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes, row) of the parts to encode: words without the ASCII marks after a last ASCII letter or digit, and those."""
    words, data = split(piece, hashed=False), lowered(piece.data)
    cut = words.ends.copy()
    special = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))  # "<|" may begin a special token: keep such words whole
    whole = np.searchsorted(words.starts, special, "right") - 1
    for _ in range(4):
        again = (cut > words.starts + 1) & _MARK[data[cut - 1]]
        if not again.any():
            break
        cut[again] -= 1
    # The tokenizer joins marks with symbols and combining characters before them. So whole, too: words of
    # nothing but marks or with more of them, and words with anything but an ASCII letter or digit there.
    joined = ~_PLAIN[data[cut - 1]]
    cut[joined] = words.ends[joined]
    cut[whole] = words.ends[whole]
    parts = 1 + (cut < words.ends)
    starts, row = np.repeat(words.starts, parts), np.repeat(words.row, parts)
    ends = np.repeat(words.ends, parts)
    first = np.cumsum(parts) - parts
    two = parts == 2
    ends[first[two]] = cut[two]
    starts[first[two] + 1] = cut[two]
    return starts, ends, span_hashes(data, starts, ends), row


class WordEncoder:
    """Ids of texts by the tokenizer file, each distinct word encoded once per task.

    Right for tokenizers that put A-Z in lower case, drop ASCII white space, never join characters
    across it, nor ASCII letters or digits with the ASCII marks that end a word, and make ASCII letters alone
    one piece whose last id, and no other, carries ``</w>``.
    Words are found by their hashes in a table with open addressing; a full table is begun anew.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        vocabulary = self.model.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends_word[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.words, self.used = 0, 0
        self.ids = np.zeros(1 << 16, dtype=np.uint32)
        self.start, self.length = np.zeros(1 << 12, dtype=np.int64), np.zeros(1 << 12, dtype=np.int32)
        self.slot_key, self.slot_place = np.zeros(SLOTS, dtype=np.uint64), np.full(SLOTS, -1, dtype=np.int32)

    def _places(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash, -1 where it is unknown."""
        slot = (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
        place = self.slot_place[slot].astype(np.int64)
        open_ = np.flatnonzero((place >= 0) & (self.slot_key[slot] != hashes))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (SLOTS - 1)
            place[open_] = self.slot_place[slot[open_]]
            open_ = open_[(place[open_] >= 0) & (self.slot_key[slot[open_]] != hashes[open_])]
        return place

    def _insert(self, hashes: np.ndarray, places: np.ndarray) -> None:
        """Distinct unknown hashes into the next free slot each; of several that want a slot the first gets it."""
        slot = (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
        left = np.arange(len(hashes))
        while len(left):
            _, first = np.unique(slot[left], return_index=True)
            first = first[self.slot_place[slot[left[first]]] < 0]
            won = left[first]
            self.slot_key[slot[won]], self.slot_place[slot[won]] = hashes[won], places[won]
            left = np.delete(left, first)
            slot[left] = (slot[left] + 1) & (SLOTS - 1)

    def _encoded(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words, and how many each has. Words of ASCII letters go in lines: their ids end in a known way."""
        plain = np.fromiter((t.isalpha() for t in texts), dtype=bool, count=len(texts))
        letters = [t for t, p in zip(texts, plain.tolist()) if p]
        lines = [b" ".join(letters[i : i + LINE]).decode() for i in range(0, len(letters), LINE)]
        joined = self._ids(self.model.encode_batch_fast(lines, add_special_tokens=False))[0]
        ends = np.flatnonzero(self.ends_word[joined]) + 1
        if len(ends) != len(letters):
            raise ValueError("the tokenizer does not encode words of letters one by one")
        others, their = self._ids(self.model.encode_batch_fast(
            [t.decode("utf-8", "replace") for t, p in zip(texts, plain.tolist()) if not p], add_special_tokens=False))
        lengths = np.zeros(len(texts), dtype=np.int64)
        lengths[plain], lengths[~plain] = np.diff(ends, prepend=0), their
        which = np.repeat(plain, lengths)
        ids = np.zeros(len(which), dtype=np.uint32)
        ids[which], ids[~which] = joined, others
        return ids, lengths

    @staticmethod
    def _ids(coded: list) -> tuple[np.ndarray, np.ndarray]:
        each = [e.ids for e in coded]
        lengths = np.fromiter(map(len, each), dtype=np.int64, count=len(each))
        return np.fromiter(chain.from_iterable(each), dtype=np.uint32, count=int(lengths.sum())), lengths

    def _learn(self, hashes: np.ndarray, texts: list[bytes]) -> np.ndarray:
        """Places of new words."""
        ids, lengths = self._encoded(texts)
        places = np.arange(self.words, self.words + len(hashes))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.words + len(hashes) > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        self._insert(hashes, places)
        self.start[places], self.length[places] = self.used + np.cumsum(lengths) - lengths, lengths
        self.ids[self.used : self.used + len(ids)] = ids
        self.used, self.words = self.used + len(ids), self.words + len(hashes)
        return places

    def encode(self, piece: Piece) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the piece's rows, and how many each row has."""
        starts, ends, hashes, row = _units(piece)
        rows = len(piece.bounds) - 1
        if not len(starts):
            return np.zeros(0, dtype=np.uint32), np.zeros(rows, dtype=np.int64)
        if self.words > SLOTS // 2:
            self.clear()
        place = self._places(hashes)
        missed = np.flatnonzero(place < 0)
        if len(missed):
            unique, first, number = np.unique(hashes[missed], return_index=True, return_inverse=True)
            data, word = piece.data.tobytes(), missed[first]
            if self.words + len(unique) > SLOTS - SLOTS // 4:  # one long text may hold more words than fit: encode it as it is
                return self._ids(self.model.encode_batch_fast(
                    [data[a:b].decode("utf-8", "replace") for a, b in zip(piece.bounds[:-1].tolist(), piece.bounds[1:].tolist())], add_special_tokens=False))
            texts = [data[a:b] for a, b in zip(starts[word].tolist(), ends[word].tolist())]
            place[missed] = self._learn(unique, texts)[number]
        length = self.length[place].astype(np.int64)
        last = np.cumsum(length)
        ids = self.ids[np.repeat(self.start[place] - (last - length), length) + np.arange(last[-1])]
        return ids, np.bincount(row, weights=length, minlength=rows).astype(np.int64)


def _segments(path: str, end_id: int):
    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seg = WordEncoder(path), TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        docs: list = []
        starts: list[int] = []
        size = 0

        def flush() -> pa.RecordBatch:
            row = {"part": part, "seg": seg, "n_tokens": size, "doc_ids": docs, "doc_starts": starts,
                   "levels": encode_levels(np.concatenate(ids))}
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([
                ("part", pa.int32()), ("seg", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                ("doc_starts", pa.list_(pa.int64())),
                ("levels", pa.list_(pa.struct([("chunks", pa.binary()), ("more", pa.binary()), ("ranks", pa.binary())]))),
            ]))

        for batch in batch_iter:
            keys = batch.column(0).to_pylist()
            for piece in pieces(batch.column(1)):
                flat, counts = encoder.encode(piece)
                ends = np.cumsum(counts)
                flat = np.insert(flat, ends, end_id)
                ends += np.arange(1, len(ends) + 1)
                low = 0
                for key, end in zip(keys[piece.first : piece.last], ends.tolist()):
                    if size and size + end - low > SEGMENT:
                        yield flush()
                        ids, docs, starts, size, seg = [], [], [], 0, seg + 1
                    docs.append(key)
                    starts.append(size)
                    ids.append(flat[low:end])
                    size, low = size + end - low, end
        if docs:
            yield flush()

    return run


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the session's checkpoints, which driver and executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int = 1) -> None:
    """Writes the ids of all documents, in ascending doc_id order, as shard files below ``path``.

    NULL ids come first; rows of one id are ordered by text. NULL and empty texts are the end id alone.
    """
    ordered = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").repartitionByRange("doc_id", F.xxhash64("text"))
    ordered.sortWithinPartitions("doc_id", F.xxhash64("text")).mapInArrow(_segments(tokenizer, end_id), FILE).write.parquet(path)


def segment_starts(files: DataFrame) -> DataFrame:
    """(part, seg, before): tokens of the whole corpus before each segment."""
    sizes = files.select("part", "seg", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row per shard
    ahead = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(ahead, F.lit(0)).alias("a"))
    inside = F.sum("n_tokens").over(W.partitionBy("part").orderBy("seg").rowsBetween(W.unboundedPreceding, -1))
    return sizes.withColumn("b", F.coalesce(inside, F.lit(0))).join(F.broadcast(parts), "part").select(
        "part", "seg", (F.col("a") + F.col("b")).alias("before"))


def _documents(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batch_iter:
        for row in batch.to_pylist():
            ids = decode_levels(row["levels"]).astype("<u4")
            starts = row["doc_starts"]
            ends = [*starts[1:], len(ids)]
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(row["doc_ids"], pa.int64()),
                "part": pa.array([row["part"]] * len(starts), pa.int32()), "seg": pa.array([row["seg"]] * len(starts), pa.int32()),
                "at": pa.array(starts, pa.int64()), "n_tokens": pa.array([b - a for a, b in zip(starts, ends)], pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends)], pa.int64()),
            })


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the checksum of every document, from the files."""
    files = spark.read.schema(FILE).parquet(path)
    rows = files.mapInArrow(_documents, "doc_id bigint, part int, seg int, at bigint, n_tokens bigint, ids_crc32 bigint")
    starts = segment_starts(files)
    return rows.join(small(starts, 500_000), ["part", "seg"]).select(
        "doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def tokens_at(spark: SparkSession, path: str, positions: DataFrame) -> DataFrame:
    """(position, token) for positions counted over the whole corpus; only their segments are touched."""
    files = spark.read.schema(FILE).parquet(path)
    spans = files.join(segment_starts(files), ["part", "seg"]).withColumn("cell", F.explode(F.sequence(
        F.floor(F.col("before") / SEGMENT), F.floor((F.col("before") + F.col("n_tokens") - 1) / SEGMENT))))
    asked = positions.select(F.col("position").cast("bigint").alias("position")).withColumn("cell", F.floor(F.col("position") / SEGMENT))
    hits = asked.join(spans, "cell").where((F.col("position") >= F.col("before")) & (F.col("position") < F.col("before") + F.col("n_tokens")))

    def look_up(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_iter:
            rows = batch.to_pylist()
            found = [int(access(r["levels"], np.array([r["position"] - r["before"]]))[0]) for r in rows]
            yield pa.RecordBatch.from_pydict({"position": pa.array([r["position"] for r in rows], pa.int64()), "token": pa.array(found, pa.int64())})

    return hits.select("position", "before", "levels").mapInArrow(look_up, "position bigint, token bigint")
