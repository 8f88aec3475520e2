"""Fill-in-middle transformation with a wavelet matrix over character classes.

The bytes of a piece of texts become symbols of eight classes: UTF-8 continuation, blank, newline, the
first character of a word, other letters and digits, sentence marks and other marks. A wavelet matrix of
three levels answers how often a class occurs before any byte. Sums of such ranks count the boundaries of
any unit (code points, words, lines, sentences), and bisection on them finds the byte of the n-th one, so
both cuts of every text of a piece are located at once, without looking at its characters one by one.

Rows depend on nothing but themselves: nothing is shuffled, and memory follows the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from kinweave.llm.batches import Piece, pieces
from kinweave.llm.common import carried, uncarried
from kinweave.plans.shipping import ship_by_value

ship_by_value(__name__)

LEVELS = 3
INSIDE, BLANK, NEWLINE, FIRST, LETTER, DIGIT, SENTENCE, MARK = range(1 << LEVELS)
#: What begins a unit; a line or sentence begins behind its mark.
STARTS = {"char": (BLANK, NEWLINE, FIRST, LETTER, DIGIT, SENTENCE, MARK), "word": (FIRST,)}
ENDS = {"line": (NEWLINE,), "sentence": (SENTENCE,)}
SENTINELS = ("<P>", "<S>", "<M>")


def _class_table() -> np.ndarray:
    table = np.full(256, MARK, dtype=np.uint8)
    table[0x80:0xC0], table[0xC0:] = INSIDE, LETTER
    for symbol, characters in ((BLANK, " \t\v\f\r"), (NEWLINE, "\n"), (SENTENCE, ".!?"), (DIGIT, "0123456789")):
        table[[ord(c) for c in characters]] = symbol
    table[[c for c in range(128) if chr(c).isalpha()]] = LETTER
    return table


_CLASS = _class_table()


def classes(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The class of every byte; words begin anew with every text."""
    symbols = _CLASS[data]
    lead = np.flatnonzero(symbols != INSIDE)
    in_word = (symbols[lead] == LETTER) | (symbols[lead] == DIGIT)
    before = np.zeros(len(lead), dtype=bool)
    before[1:] = in_word[:-1]
    edges = bounds[:-1][np.diff(bounds) > 0]
    before[np.searchsorted(lead, edges)] = False
    symbols[lead[in_word & ~before]] = FIRST
    return symbols


class WaveletMatrix:
    """Ranks of small symbols: one bit vector a level, zeros of a level before its ones."""

    def __init__(self, symbols: np.ndarray, levels: int = LEVELS):
        self.levels, self.bits, self.before, self.zeros = levels, [], [], []
        for level in reversed(range(levels)):
            bit = (symbols >> level) & 1 == 1
            packed = np.packbits(bit, bitorder="little")
            packed = np.concatenate([packed, np.zeros(8 + -len(packed) % 8, dtype=np.uint8)]).view("<u8")
            self.bits.append(packed)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1]]))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])
            self.zeros.append(len(bit) - int(bit.sum()))

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word, inside = at >> 6, (at & 63).astype(np.uint64)
        return self.before[level][word] + np.bitwise_count(self.bits[level][word] & ((np.uint64(1) << inside) - np.uint64(1)))

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs before each position of ``at``."""
        low, at = np.zeros(1, dtype=np.int64), np.asarray(at, dtype=np.int64)
        for level in range(self.levels):
            if symbol >> (self.levels - 1 - level) & 1:
                low, at = (self.zeros[level] + self._ones(level, x) for x in (low, at))
            else:
                low, at = (x - self._ones(level, x) for x in (low, at))
        return at - low

    def count(self, symbols: tuple[int, ...], at: np.ndarray) -> np.ndarray:
        """Ranks of several symbols together; of many, by the ranks of the others."""
        if 2 * len(symbols) > 1 << self.levels:
            return at - self.count(tuple(s for s in range(1 << self.levels) if s not in symbols), at)
        return sum((self.rank(s, at) for s in symbols), np.zeros(len(at), dtype=np.int64))

    def select(self, symbols: tuple[int, ...], nth: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Position of the ``nth`` (1-based, over all positions) of some symbols, known to be within [low, high)."""
        low, high = low.copy(), high.copy()
        while (open_ := np.flatnonzero(low < high - 1)).size:
            middle = (low[open_] + high[open_]) // 2
            left = self.count(symbols, middle) >= nth[open_]
            high[open_[left]], low[open_[~left]] = middle[left], middle[~left]
        return low


def _cuts(matrix: WaveletMatrix, unit: str, first: np.ndarray, last: np.ndarray, draws: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """(units, byte of the lower cut, byte of the upper cut) of texts that span [first, last)."""
    starts = unit in STARTS
    symbols = (STARTS if starts else ENDS)[unit]
    ahead = matrix.count(symbols, first)
    units = matrix.count(symbols, last) - ahead
    if unit == "word":
        units = np.maximum(units, (last > first).astype(np.int64))  # a text without words is one unit
    elif not starts:
        units = units + ((last > first) & (matrix.count(symbols, np.maximum(last - 1, first)) == matrix.count(symbols, last)))
    chosen = [(d % (units + 1).astype(np.uint64)).astype(np.int64) for d in draws]
    out = []
    for k in (np.minimum(*chosen), np.maximum(*chosen)):
        at = np.where(k >= units, last, first)
        inner = np.flatnonzero((k > 0) & (k < units))
        found = matrix.select(symbols, ahead[inner] + k[inner] + starts, first[inner], last[inner])
        at[inner] = found if starts else found + 1
        out.append(at)
    return units, *out


def _moved(unit: str, share: int, spm: int, sentinels: tuple[str, str, str]):
    p, s, m = (x.encode() for x in sentinels)

    def rows(piece: Piece, h: list[np.ndarray]) -> dict[str, pa.Array]:
        first, last = piece.bounds[:-1], piece.bounds[1:]
        matrix = WaveletMatrix(classes(piece.data, piece.bounds))
        units, low, high = _cuts(matrix, unit, first, last, h[:2])
        at = [matrix.count(STARTS["char"], x) for x in (first, low, high)]
        data, moved, backwards = piece.data.tobytes(), h[2] % np.uint64(100) < share, h[3] % np.uint64(100) < spm
        forms, outputs = [], []
        for a, b, c, d, move, back in zip(first.tolist(), low.tolist(), high.tolist(), last.tolist(), moved.tolist(), backwards.tolist()):
            text = data[a:d]
            if not move or not text or p in text or s in text or m in text:
                forms.append("plain")
                outputs.append(text)
            elif back:
                forms.append("spm")
                outputs.append(b"".join((s, data[c:d], p, data[a:b], m, data[b:c])))
            else:
                forms.append("psm")
                outputs.append(b"".join((p, data[a:b], s, data[c:d], m, data[b:c])))
        plain = np.array([f == "plain" for f in forms], dtype=bool)
        return {"n": pa.array(units, pa.int64()), "form": pa.array(forms, pa.string()), "prefix_chars": pa.array(at[1] - at[0], pa.int64(), mask=plain),
                "middle_chars": pa.array(at[2] - at[1], pa.int64(), mask=plain), "output": pa.array(outputs, pa.binary()).cast(pa.string())}

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_iter:
            draws = [batch.column(i).to_numpy().astype(np.uint64) for i in range(1, 5)]
            for piece in pieces(batch.column(0)):
                own = batch.slice(piece.first, piece.last - piece.first)
                found = rows(piece, [h[piece.first : piece.last] for h in draws])
                yield pa.RecordBatch.from_pydict(found | dict(zip(own.schema.names[5:], own.columns[5:])))

    return run


def transform(
    docs: DataFrame, unit: str = "char", share: int = 90, spm: int = 20, seed: str = "1",
    sentinels: tuple[str, str, str] = SENTINELS, keep: list[str] | None = None,
) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of every document.

    ``n`` counts the units (``char``: code points, ``word``, ``line``, ``sentence``); a text is cut before
    one of them or at its end, twice, by numbers drawn from ``seed`` and doc_id. Of 100 texts ``share`` are
    moved, of 100 moved ones ``spm`` have their suffix first. NULL and empty texts and texts that hold a
    sentinel stay ``plain`` with NULL lengths; a NULL doc_id draws like an empty one, equal ids draw alike.
    Whatever stands before the first word belongs to it. ``keep`` names columns to carry along.
    """
    mark = {x[:1] for x in sentinels}
    if len(mark) != 1 or len(set(sentinels)) != 3 or any(x.count(x[:1]) != 1 or len(x) < 2 for x in sentinels) or any(
            a != b and a.startswith(b) for a in sentinels for b in sentinels):
        raise ValueError("sentinels begin with one common character that they hold once, and none begins another")
    if unit not in STARTS and unit not in ENDS:
        raise ValueError(f"unknown unit {unit!r}")
    plain, names = carried(docs, keep)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint").alias(f"h{i}") for i in range(4)]
    rows = plain.select("text", *draws, F.col("doc_id").cast("bigint").alias("doc_id"), *names)
    kinds = "".join(f", {f.name} {f.dataType.simpleString()}" for f in rows.schema[5:])
    found = rows.mapInArrow(_moved(unit, share, spm, sentinels), f"n bigint, form string, prefix_chars bigint, middle_chars bigint, output string{kinds}")
    return uncarried(found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", *names), names)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that ``transform`` made ``output`` of."""
    p, s, m = sentinels
    behind = lambda mark, text: F.instr(text, mark) + len(mark)
    between = lambda a, b: F.substr(output, behind(a, output), F.instr(output, b) - behind(a, output))
    middle = F.substr(output, behind(m, output))
    return F.when(form == "psm", F.concat(between(p, s), middle, between(s, m))).when(
        form == "spm", F.concat(between(p, m), middle, between(s, p))).otherwise(output)
