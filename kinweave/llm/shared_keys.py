"""Which 64-bit keys do several documents share, and which is the smallest document of each?

Tasks send their (key, document) pairs in packed, sorted blocks, one per bucket of keys, which is a
fraction of what rows would take. A key that many documents of one task hold is sent once, with the
smallest and largest of them; those documents then meet the key's owner in a join that Spark can
split, so no task gathers the documents of a frequent key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kinweave.llm.batches import mix
from kinweave.plans.shipping import ship_by_value

ship_by_value(__name__)

FREQUENT = 64  # documents of one task that make a key frequent
BUCKETS = 1024  # at least
PAIRS = 1 << 20  # of a bucket, about
FLUSH = 1 << 19
PACKED = "bucket int, keys binary, docs binary, tops binary, frequent boolean"

Extract = Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray]]]


def starts_of(values: np.ndarray) -> np.ndarray:
    """Where runs of equal neighbours begin."""
    new = np.ones(len(values), dtype=bool)
    new[1:] = values[1:] != values[:-1]
    return np.flatnonzero(new)


def _blocks(keys: np.ndarray, docs: np.ndarray, bits: int) -> list[dict]:
    order = np.lexsort((docs, keys))
    keys, docs = keys[order], docs[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
    keys, docs = keys[new], docs[new]
    first = starts_of(keys)
    counts = np.diff(np.append(first, len(keys)))
    often = counts > FREQUENT
    apart = np.repeat(often, counts)

    def row(bucket: int, k: np.ndarray, d: np.ndarray, t: np.ndarray, frequent: bool) -> dict:
        return {"bucket": bucket, "keys": k.astype("<u8").tobytes(), "docs": d.astype("<i8").tobytes(),
                "tops": t.astype("<i8").tobytes(), "frequent": frequent}

    rows = [row(-1, keys[apart], docs[apart], docs[:0], True)] if apart.any() else []
    lead, last = first[often], first[often] + counts[often] - 1
    for k, d, t, frequent in ((keys[~apart], docs[~apart], None, False), (keys[lead], docs[lead], docs[last], True)):
        bounds = np.searchsorted((k >> np.uint64(64 - bits)).astype(np.int64), np.arange((1 << bits) + 1))
        for b in np.flatnonzero(np.diff(bounds)):
            s = slice(bounds[b], bounds[b + 1])
            rows.append(row(int(b), k[s], d[s], d[:0] if t is None else t[s], frequent))
    return rows


def _pack(extract: Extract, bits: int):
    schema = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("docs", pa.binary()), ("tops", pa.binary()), ("frequent", pa.bool_())])

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batch_iter:
            for docs, keys in extract(batch):
                held.append((mix(keys), docs))
                size += len(keys)
                if size > FLUSH:
                    yield pa.RecordBatch.from_pylist(_blocks(*map(np.concatenate, zip(*held)), bits), schema=schema)
                    held, size = [], 0
        if size:
            yield pa.RecordBatch.from_pylist(_blocks(*map(np.concatenate, zip(*held)), bits), schema=schema)

    return run


def _owners(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, key, owner) of keys with several documents; doc NULL for the frequent ones. Blocks come bucket by bucket."""

    def found(blocks: list) -> pa.RecordBatch:
        keys, docs, tops, often = map(np.concatenate, zip(*blocks))
        blocks.clear()
        order = np.argsort(keys, kind="stable")
        keys, docs, tops, often = keys[order], docs[order], tops[order], often[order]
        first = starts_of(keys)
        counts = np.diff(np.append(first, len(keys)))
        low = np.minimum.reduceat(docs, first)
        shared = low < np.maximum.reduceat(tops, first)
        hot = np.logical_or.reduceat(often, first) & shared
        each = np.repeat(shared, counts) & ~often
        none = np.repeat([False, True], [each.sum(), hot.sum()])
        return pa.RecordBatch.from_pydict({
            "doc": pa.array(np.concatenate([docs[each], np.zeros(hot.sum(), np.int64)]), pa.int64(), mask=none),
            "key": pa.array(np.concatenate([keys[each], keys[first][hot]]).astype(np.int64)),
            "owner": pa.array(np.concatenate([np.repeat(low, counts)[each], low[hot]])),
        })

    bucket, blocks = None, []
    for batch in batch_iter:
        for r in batch.to_pylist():
            if r["bucket"] != bucket and blocks:
                yield found(blocks)
            bucket = r["bucket"]
            docs = np.frombuffer(r["docs"], "<i8")
            tops = np.frombuffer(r["tops"], "<i8") if r["frequent"] else docs
            blocks.append((np.frombuffer(r["keys"], "<u8"), docs, tops, np.full(len(docs), r["frequent"])))
    if blocks:
        yield found(blocks)


def _unpack(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batch_iter:
        for r in batch.to_pylist():
            yield pa.RecordBatch.from_pydict({
                "key": pa.array(np.frombuffer(r["keys"], "<u8").astype(np.int64)), "doc": pa.array(np.frombuffer(r["docs"], "<i8"))})


def shared_keys(rows: DataFrame, extract: Extract, pairs: int = 0) -> DataFrame:
    """(doc, key, owner) for every key that at least two different documents hold.

    ``extract`` turns a batch of ``rows`` into (documents, keys) arrays. ``key`` is the
    given key after ``batches.mix``. ``pairs`` says about how many pairs there are; the number of
    buckets follows it, so what a task holds at a time does not grow with the input.
    """
    bits = max(BUCKETS - 1, pairs // PAIRS).bit_length()
    packed = rows.mapInArrow(_pack(extract, bits), PACKED)
    found = packed.where("bucket >= 0").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        _owners, "doc bigint, key bigint, owner bigint")
    # Dealt anew, so that no task needs two workers at a time: they keep their memory, and doubled what an executor's workers held.
    often = packed.where("bucket < 0").repartition(F.xxhash64("keys", "docs")).mapInArrow(_unpack, "key bigint, doc bigint")
    often = often.join(found.where("doc is null").select("key", "owner"), "key").select("doc", "key", "owner")
    return found.where("doc is not null").unionByName(often)
