"""Spelling variants over a variable-length gram index.

1. Words of all texts are counted; what follows works on distinct words.
2. The gram dictionary holds every gram of two characters, and a longer one only if the gram without its
   last character is frequent. So it is described by its frequent grams, whose number has a fixed bound.
3. A word, with a mark before and behind it, is cut into the longest gram of the dictionary at each place;
   grams inside an earlier one are left out. Grams carry their place.
4. One edit may change the grams that hold the edited place, and those to its right that a new gram can
   cover. The most that any edit changes, taken off the number of grams, is the word's bound: near words
   have at least as many grams in common, at places that agree up to the shift of the edit.
5. So two near words share one of their rarest (grams - bound + 1) grams. These lists are merged in a join
   keyed by gram, length and place, in which a pair goes on only if what is left of both words can still
   reach the greater bound; edit distance decides.
6. Words without a positive bound meet each other once more, with shorter grams; grams of two characters
   always give one.

The form of a word is its most frequent near word; forms are followed to the last by doubling.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kinweave.llm.batches import Piece, lowered, pieces, span_hashes
from kinweave.llm.token_codes import shared_folder
from kinweave.plans.lineage import cut
from kinweave.plans.shipping import ship_by_value

ship_by_value(__name__)

LONGEST = (5, 3, 2)  # characters of a gram at most, by level
FREQUENT = 50_000  # grams of a length that can be frequent at most
RARE = 8
HELD = 300_000  # distinct words a task gathers before it hands them on
POSTING = "level int, code bigint, size int, pos int, word string, n bigint, i int, grams int, bound int"

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), 0xC3]] = True  # 0xC3 begins U+00C0 to U+00FF


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def word_spans(piece: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of the runs of A-Z, a-z and U+00C0 to U+00FF."""
    data, n = piece.data, len(piece.data)
    inside = _LETTER[data]
    inside[1:] |= data[:-1] == 0xC3
    edge = piece.bounds[:-1][np.diff(piece.bounds) > 0]
    before, after = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[edge], after[edge[1:] - 1] = False, False
    starts = np.flatnonzero(inside & ~before)
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(piece.bounds, starts, "right") - 1


def run_checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, begun: np.ndarray) -> np.ndarray:
    """The crc32 of each stretch of bytes, continued from the values of ``begun``."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    at, left = starts[order], size[order]
    state = begun[order].astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    long = int(np.searchsorted(-left, -64, "left"))  # longer runs one by one
    for k in range(int(left[long]) if long < len(left) else 0):
        m = int(np.searchsorted(-left, -k, "left"))
        part = state[long:m]
        state[long:m] = _CRC[(part ^ data[at[long:m] + k]) & 0xFF] ^ (part >> np.uint32(8))
    out = np.zeros(len(starts), dtype=np.uint32)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    for k in order[:long].tolist():
        out[k] = zlib.crc32(data[starts[k] : ends[k]].tobytes(), int(begun[k]))
    return out


def _tally(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> dict[bytes, int]:
    """How often each stretch of bytes occurs."""
    hashes, text = span_hashes(data, starts, ends), data.tobytes()
    _, first, same, counts = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    rep = first[same]
    size = ends - starts
    if ((size != size[rep]) | (data[starts] != data[starts[rep]]) | (data[ends - 1] != data[ends[rep] - 1])
            | (data[starts + size // 2] != data[starts[rep] + size // 2])).any():
        return Counter(text[a:b] for a, b in zip(starts.tolist(), ends.tolist()))  # two words with one hash
    return {text[a:b]: c for a, b, c in zip(starts[first].tolist(), ends[first].tolist(), counts.tolist())}


def _counted(noise: int | None):
    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pydict({"word": pa.array(list(held), pa.binary()).cast(pa.string()), "n": pa.array(list(held.values()), pa.int64())})
            held.clear()
            return batch

        for batch in batch_iter:
            ids = batch.column(0).to_pylist()
            for piece in pieces(batch.column(1)):
                starts, ends, row = word_spans(piece)
                if not len(starts):
                    continue
                data = lowered(piece.data)
                if noise:
                    begun = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids[piece.first : piece.last]], dtype=np.uint32)
                    sums = run_checksums(data, starts, ends, begun[row])
                    hit = sums % np.uint32(noise) == 0
                    for a, b, h in zip(starts[hit].tolist(), ends[hit].tolist(), sums[hit].tolist()):
                        word = data[a:b].tobytes().decode()
                        at = h % len(word)
                        if less := (word[:at] + word[at + 1 :]).encode():
                            held[less] = held.get(less, 0) + 1
                    starts, ends = starts[~hit], ends[~hit]
                    if not len(starts):
                        continue
                for word, count in _tally(data, starts, ends).items():
                    held[word] = held.get(word, 0) + count
                if len(held) > HELD:
                    yield out()
        if held:
            yield out()

    return run


def word_counts(docs: DataFrame, noise: int | None = None) -> DataFrame:
    """(word, n) over all texts: runs of letters, with A-Z as a-z.

    With ``noise``, a run loses a character where the crc32 h of ``<doc_id>:<run>`` is divisible by it: the
    one at h % length. A NULL id counts as an empty one. NULL texts have no words.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(_counted(noise), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _marked(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(characters, bounds) of all words, each between two marks. All characters are below U+0100."""
    text = "".join(f"\x01{w}\x02" for w in words).encode("latin-1")
    bounds = np.concatenate([[0], np.cumsum([len(w) + 2 for w in words])]).astype(np.int64)
    return np.frombuffer(text, dtype=np.uint8).astype(np.uint64), bounds


def _codes(chars: np.ndarray, longest: int) -> list[np.ndarray]:
    """Codes of the grams of 1 to ``longest`` characters at every place; those past the end are 0."""
    codes = [chars]
    for q in range(2, longest + 1):
        code = np.zeros_like(chars)
        if len(chars) >= q:
            code[: len(chars) - q + 1] = codes[-1][: len(chars) - q + 1] * np.uint64(256) + chars[q - 1 :]
        codes.append(code)
    return codes


def _within(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), dtype=bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _gram_counts(longest: int):
    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_iter:
            if not batch.num_rows:
                continue
            chars, bounds = _marked(batch.column(0).to_pylist())
            end = np.repeat(bounds[1:], np.diff(bounds))
            place = np.arange(len(chars))
            grams = [c[place + q <= end] for q, c in enumerate(_codes(chars, longest), 1) if q > 1]
            code, n = np.unique(np.concatenate(grams), return_counts=True)
            yield pa.RecordBatch.from_pydict({"code": pa.array(code.astype(np.int64)), "n": pa.array(n.astype(np.int64))})

    return run


def frequent_grams(words: DataFrame, longest: int = LONGEST[0], most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts) of the grams that occur more often than once in ``most`` places: at most so many of each length."""
    places = words.agg(F.sum(F.length("word") + 2)).first()[0] or 0
    counts = words.select("word").mapInArrow(_gram_counts(longest), "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))
    rows = counts.where(F.col("n") > max(RARE, places // most)).orderBy("code").collect()
    return np.array([r["code"] for r in rows], dtype=np.uint64), np.array([r["n"] for r in rows], dtype=np.int64)


def decomposed(words: list[str], frequent: np.ndarray, longest: int) -> tuple[np.ndarray, ...]:
    """(word, place, code) of the grams of each word, and the word's number of grams and bound."""
    chars, bounds = _marked(words)
    size = np.diff(bounds)
    end, place = np.repeat(bounds[1:], size), np.arange(len(chars))
    codes = _codes(chars, longest)
    frequent = frequent[frequent < np.uint64(256) ** np.uint64(longest - 1)]  # those that can be longer
    tails = np.unique(np.concatenate([np.zeros(0, np.uint64), *[  # proper ends of frequent grams
        frequent[frequent >= np.uint64(256) ** np.uint64(k)] % np.uint64(256) ** np.uint64(k) for k in range(1, longest - 1)]]))
    q = np.where(place + 2 <= end, 2, 0)
    for k in range(2, longest):
        q[(q == k) & (place + k + 1 <= end) & _within(codes[k - 1], frequent)] = k + 1
    last = place + q - 1
    covered = np.maximum.accumulate(np.where(q > 0, last, -1))
    kept = (q > 0) & (last > np.concatenate([[-1], covered[:-1]]))
    # How many grams hold each place, and how many to its right a new gram may cover.
    step = np.zeros(len(chars) + 1, dtype=np.int64)
    step[place[kept]] += 1
    np.subtract.at(step, last[kept] + 1, 1)
    holding = np.cumsum(step)[:-1]
    begins = np.full(len(chars) + longest + 1, -1, dtype=np.int64)
    begins[last[kept]] = place[kept]
    right = np.zeros(len(chars), dtype=np.int64)  # for an edit at a place: of the grams behind it
    for m in range(1, longest - 1):
        known = np.concatenate([_within(codes[m - 1], tails)[1:], [False]])
        right += (begins[place + 1 + m] > place) & known & (place + 1 + m < end)
    changed = holding + right
    inserted = holding - kept + np.concatenate([[0], right[:-1]])
    first, behind = place == np.repeat(bounds[:-1], size), place == end - 1
    most = np.where(first, 0, np.where(behind, inserted, np.maximum(changed, inserted)))
    grams = np.add.reduceat(kept.astype(np.int64), bounds[:-1])
    bound = grams - np.maximum.reduceat(most, bounds[:-1])
    word = np.repeat(np.arange(len(words)), size)[kept]
    code = np.zeros(len(word), dtype=np.uint64)
    for k in range(2, longest + 1):
        here = q[kept] == k
        code[here] = codes[k - 1][place[kept]][here]
    return word, place[kept] - bounds[word], code, grams, bound


def _postings(frequent: np.ndarray, counts: np.ndarray, levels: tuple[int, ...]):
    """The rarest grams of each word that a near word must share one of, at each level that the word needs."""

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_iter:
            names, n = np.array(batch.column(0).to_pylist(), dtype=object), batch.column(1).to_numpy()
            for level, longest in enumerate(levels):
                if not len(names):
                    break
                word, place, code, grams, bound = decomposed(names.tolist(), frequent, longest)
                known = _within(code, frequent)
                often = np.zeros(len(code), dtype=np.int64)
                often[known] = counts[np.searchsorted(frequent, code[known])]
                order = np.lexsort((place, code, often, word))
                word, place, code = word[order], place[order], code[order]
                rank = np.arange(len(word)) - np.repeat(np.cumsum(grams) - grams, grams)
                short = rank <= (grams - np.maximum(bound, 1))[word]
                word, place, code, rank = word[short], place[short], code[short], rank[short]
                size = np.fromiter(map(len, names), dtype=np.int64, count=len(names))
                yield pa.RecordBatch.from_pydict({
                    "level": pa.array(np.full(len(word), level), pa.int32()), "code": pa.array(code.astype(np.int64)),
                    "size": pa.array(size[word], pa.int32()), "pos": pa.array(place, pa.int32()),
                    "word": pa.array(names[word].tolist(), pa.string()), "n": pa.array(n[word], pa.int64()),
                    "i": pa.array(rank, pa.int32()), "grams": pa.array(grams[word], pa.int32()), "bound": pa.array(bound[word], pa.int32())})
                again = bound <= 0
                names, n = names[again], n[again]

    return run


def near_pairs(words: DataFrame, levels: tuple[int, ...] = LONGEST, most: int = FREQUENT) -> DataFrame:
    """(x, nx, y, ny): all pairs of ``words`` (word, n) one inserted, deleted or replaced character apart, once each.

    Words have two characters or more, all of them below U+0100 and none below U+0003.
    """
    frequent, counts = frequent_grams(words, levels[0], most)
    path = shared_folder(words.sparkSession, "grams")
    words.select("word", "n").mapInArrow(_postings(frequent, counts, levels), POSTING).write.parquet(path)
    lists = words.sparkSession.read.schema(POSTING).parquet(path)
    key = lambda size, pos: F.xxhash64("level", "code", size.cast("int"), pos.cast("int"))
    size, pos = F.col("size"), F.col("pos")
    asked = F.explode(F.array(key(size, pos), key(size + 1, pos), key(size + 1, pos + 1)))
    left = lists.select(asked.alias("key"), F.col("word").alias("x"), F.col("n").alias("nx"), F.col("size").alias("size_x"),
                        (F.col("grams") - F.col("i")).alias("rest_x"), F.col("bound").alias("bound_x"), F.col("level").alias("level_x"))
    right = lists.select(key(size, pos).alias("key"), F.col("word").alias("y"), F.col("n").alias("ny"), F.col("size").alias("size_y"),
                         (F.col("grams") - F.col("i")).alias("rest_y"), F.col("bound").alias("bound_y"))
    bound = F.greatest("bound_x", "bound_y")
    meet = ((F.col("size_x") < F.col("size_y")) | (F.col("x") < F.col("y"))) & (F.least("rest_x", "rest_y") >= bound) & (bound > 0)
    found = left.join(right, "key").where(meet).where(F.levenshtein("x", "y", 1) == 1)
    return found.select("x", "nx", "y", "ny").distinct()


def _followed(forms: DataFrame) -> DataFrame:
    """(word, root): where forms (word, form) end. A form occurs at least twice as often as its word, so chains are short."""
    jumps = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = jumps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumps = cut(jumps.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        moved = jumps.where("moved").limit(1).count()
        jumps = jumps.select("word", "root")
        if not moved:
            return jumps


def spelling_variants(docs: DataFrame, shortest: int = 5, fewest: int = 3, noise: int | None = None) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of ``shortest`` characters and ``fewest`` occurrences or more.

    Near words differ by one inserted, deleted or replaced character. The form of a word is its near word
    of most occurrences, the smallest in code-point order of several, if it occurs twice as often at least;
    else NULL, and so is ``form_n``. ``root`` follows forms to the last and is the word itself without one.
    NULL and empty texts have no words; repeated rows count as often as they stand; an empty table has no words.
    """
    if shortest < 2:
        raise ValueError("words of one character have no grams to spare")
    spark = docs.sparkSession
    path = shared_folder(spark, "words")
    word_counts(docs, noise).where((F.length("word") >= shortest) & (F.col("n") >= fewest)).write.parquet(path)
    words = spark.read.schema("word string, n bigint").parquet(path)
    pairs = cut(near_pairs(words))
    both = pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("ny").alias("nx"), F.col("x").alias("y"), F.col("nx").alias("ny")))
    best = both.groupBy(F.col("x").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("ny")).alias("k"), F.col("y").alias("form"))).alias("f"))
    near = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(-F.col("f.k") >= 2 * F.col("n"), F.col("f.form")).alias("form"),
        F.when(-F.col("f.k") >= 2 * F.col("n"), -F.col("f.k")).alias("form_n"))
    near = cut(near)
    roots = _followed(near.where("form is not null"))
    return near.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
