"""Packing of documents into windows of tokens by non-negative least squares.

Every document is encoded once.  Its whole windows are sequences of their own; what is left of
it, shorter than a window, is one of ``window - 1`` lengths.  The histogram of these lengths, a
bounded table, goes to the driver: all combinations of two or three lengths that fill a window
are enumerated, and their repeat counts solved against the histogram by non-negative least
squares and rounded down.  The lengths that remain are packed greedily, longest first, one after the other,
each cut where a window is full; the last window is cut into powers of two, which need no padding.

A remainder is known by its length and its ordinal among those of that length.  The plan
says for ranges of ordinals of each length where they go, so it is bounded too, and
each document finds its place by itself: no task sees all documents of a length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _words as W
from ._scratch import Scratch
from .token_output import encoder

WINDOW = 1024
#: Steps of the solver at most; what it leaves is packed greedily.
STEPS = 6000
#: Bits of an ordinal beside its length in one key.
ORDINAL_BITS = 44


def combinations(window: int) -> np.ndarray:
    """All (a, b, c) with a <= b <= c and sum ``window``; a is 0 for two lengths."""
    found = []
    for a in range(window // 3 + 1):
        b = np.arange(max(a, 1), (window - a) // 2 + 1)
        found.append(np.stack([np.full(len(b), a), b, window - a - b], 1))
    return np.concatenate(found)


def least_squares(combos: np.ndarray, histogram: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Non-negative counts of the combinations whose lengths come nearest to the histogram, by coordinate descent.

    Each step moves the combination that lowers the sum of squares most to its best count, so few
    are used.  ``histogram[0]`` belongs to the absent third length.  It ends when no step would move half a document.
    """
    counts, rest = np.zeros(len(combos)), histogram.astype(np.float64)
    rest[0] = 0.0
    a, b, c = combos.T
    third = (a > 0).astype(np.float64)
    norm = _squares(combos)
    for _ in range(steps):
        step = np.maximum((rest[a] * third + rest[b] + rest[c]) / norm, -counts)
        gain = np.abs(step) * np.sqrt(norm)
        k = int(gain.argmax())
        if abs(step[k]) < 0.5:
            break
        counts[k] += step[k]
        for length in combos[k].tolist():
            rest[length] -= step[k]
        rest[0] = 0.0
    return counts


def _squares(combos: np.ndarray) -> np.ndarray:
    """The squared length of each combination's column: the sum of squares of how often it has each length."""
    a, b, c = combos.T
    one, two, three = a == b, b == c, (a == b) & (b == c)
    whole = np.where(a > 0, 3.0, 2.0)
    return np.where(three, 9.0, np.where(one & (a > 0) | two, whole + 2, whole))


@dataclass
class Plan:
    """Where remainders go, by key ``length << ORDINAL_BITS | first ordinal`` of ranges.

    A range's remainders go to sequences from ``sequence`` on at ``offset``; one of offset -1 is
    the rest of its length, whose tokens lie from ``sequence`` on in the line of all rests.
    """

    window: int
    keys: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    line: int  # tokens in the line of rests
    first: int  # sequence in which the line begins

    @property
    def last(self) -> int:
        """The first number that no sequence of the plan has."""
        return self.first + self.line // self.window + (self.line % self.window).bit_count()

    def cut(self, at: int, size: int) -> Iterator[tuple[int, int, int, int]]:
        """Pieces (start, length, sequence, offset) of ``size`` tokens from place ``at`` of the line of rests."""
        start = 0
        while start < size:
            p = at + start
            number, offset = divmod(p, self.window)
            room = self.window - offset
            if number == self.line // self.window:  # the last window: powers of two, the largest first
                begin, left = 0, self.line % self.window
                while True:
                    power = 1 << left.bit_length() - 1
                    if offset < begin + power:
                        break
                    begin, left, number = begin + power, left - power, number + 1
                offset, room = offset - begin, begin + power - offset
            length = min(room, size - start)
            yield start, length, self.first + number, offset
            start += length


def plan_of(histogram: np.ndarray, window: int = WINDOW) -> Plan:
    """The plan for ``histogram[length]`` remainders of each length below ``window``."""
    combos = combinations(window)
    solved = np.floor(least_squares(combos, histogram) + 1e-9).astype(np.int64)
    left, used = histogram.astype(np.int64).tolist(), [0] * window
    ranges: list[tuple[int, int, int, int]] = []
    number = 0
    for k in sorted(np.flatnonzero(solved).tolist(), key=lambda k: (-solved[k], k)):
        lengths = [x for x in combos[k].tolist() if x]
        times = min(int(solved[k]), *(left[x] // lengths.count(x) for x in lengths))
        if times < 1:
            continue
        offset = 0
        for x in lengths:
            ranges.append((x, used[x], number, offset))
            used[x] += times
            left[x] -= times
            offset += x
        number += times
    line = 0
    for x in range(window - 1, 0, -1):
        ranges.append((x, used[x], line, -1))
        line += left[x] * x
    ranges.sort()
    keys = np.array([x << ORDINAL_BITS | first for x, first, _, _ in ranges], np.int64)
    return Plan(window, keys, np.array([r[2] for r in ranges], np.int64), np.array([r[3] for r in ranges], np.int64), line, number)


def encoded(docs: DataFrame, *, tokenizer_path: str, end_id: int | None, window: int, id_col: str, text_col: str) -> DataFrame:
    """A row per document: its number of tokens, checksums of its whole windows, the ids left and their place in the task.

    ``nth`` counts the remainders of equal length in the task, ``windows`` the whole windows before.
    """
    slim = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seen, windows = encoder(tokenizer_path, end_id), TaskContext.get().partitionId(), [0] * window, 0
        kind = f"<u{enc.width}"
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                rows = []
                few = batch.slice(i, 256)
                for ids in enc.encode([t or "" for t in few.column(1).to_pylist()]):
                    n = len(ids) // enc.width
                    whole, rest = divmod(n, window)
                    raw = memoryview(np.frombuffer(ids, kind, whole * window).astype("<u4").tobytes())
                    crcs = np.array([zlib.crc32(raw[4 * window * k : 4 * window * (k + 1)]) for k in range(whole)], "<u4").tobytes()
                    rows.append((n, rest, seen[rest], windows, crcs, ids[whole * window * enc.width :]))
                    seen[rest] += 1
                    windows += whole
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
                cols = [few.column(0), pa.array([part] * len(rows), pa.int64()), *[pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]]
                yield pa.RecordBatch.from_arrays(cols, ["doc", "part", "n", "rest", "nth", "windows", "crcs", "ids"])
        enc.forget()
        W.tidy()

    return slim.mapInArrow(run, f"doc {slim.schema['doc'].dataType.simpleString()}, part long, n long, rest int, nth long, windows long, crcs binary, ids binary")


def placed(rows: DataFrame, plan: Plan, width: int) -> DataFrame:
    """The pieces of each document; ``base`` is the number of remainders of its length in earlier tasks."""
    window = plan.window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        for batch in batches:
            n, part, rest, nth, windows, base = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("n", "part", "rest", "nth", "windows", "base"))
            whole = n // window
            row = np.repeat(np.arange(len(n)), whole)
            inner = np.arange(len(row)) - np.repeat(np.cumsum(whole) - whole, whole)
            crcs = np.frombuffer(b"".join(batch.column("crcs").to_pylist()), "<u4").astype(np.int64)
            numbers = plan.last + (part << 32) + windows
            full = [row, inner * window, np.full(len(row), window), crcs, numbers[row] + inner, np.zeros(len(row), np.int64)]
            ordinal = base + nth
            entry = np.searchsorted(plan.keys, rest << ORDINAL_BITS | ordinal, "right") - 1
            beyond = ordinal - (plan.keys[entry] & ((1 << ORDINAL_BITS) - 1))
            sequence, offset = plan.sequence[entry], plan.offset[entry]
            pieces = []
            for i, ids in enumerate(batch.column("ids").to_pylist()):
                if not ids:
                    continue
                raw = np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes()
                if offset[i] >= 0:
                    own = [(0, int(rest[i]), int(sequence[i] + beyond[i]), int(offset[i]))]
                else:
                    own = plan.cut(int(sequence[i] + beyond[i] * rest[i]), int(rest[i]))
                for start, length, number, at in own:
                    pieces.append((i, int(whole[i]) * window + start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), number, at))
            both = [np.concatenate([x, y]).astype(np.int64) for x, y in zip(full, np.array(pieces, np.int64).reshape(-1, 6).T, strict=True)]
            doc = batch.column("doc").take(pa.array(both[0]))
            for k in range(0, len(doc), 10_000):
                values = [doc, *both[1:4], n[both[0]], *both[4:]]
                yield pa.RecordBatch.from_arrays([x[k : k + 10_000] if isinstance(x, pa.Array) else pa.array(x[k : k + 10_000]) for x in values], names)

    kind = rows.schema["doc"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack(
    spark: SparkSession,
    docs: DataFrame,
    *,
    tokenizer_path: str,
    end_id: int | None = 0,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of all documents in sequences of at most ``window`` tokens, a power of two.

    Each piece has the document's id, ``start`` (ids of the document before it), ``length``, ``ids_crc32`` (of the ids
    as little-endian 32-bit integers), ``doc_tokens``, ``sequence_id`` and ``offset`` in it.  Every sequence is full or has
    a power of two of tokens, so none is padded.  Ids of sequences are unique, not gapless.

    Null texts are empty and hold only the end id; without an end id an empty text has no piece.  Texts of any
    length are encoded whole.  Each row is a document of its own, also where ids are null or equal.  Other
    columns are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(spark, "packing")
    rows = scratch.write(encoded(docs, tokenizer_path=tokenizer_path, end_id=end_id, window=window, id_col=id_col, text_col=text_col), "encoded")
    counts = scratch.write(rows.where("rest > 0").groupBy("part", "rest").agg(F.count("*").alias("n")), "counts")
    histogram = np.zeros(window, np.int64)
    for r in counts.groupBy("rest").agg(F.sum("n").alias("n")).collect():  # a row per length
        histogram[r["rest"]] = r["n"]
    before = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "rest", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    plan, width = plan_of(histogram, window), encoder(tokenizer_path, end_id).width
    found = placed(rows.join(bases, ["part", "rest"], "left").withColumn("base", F.coalesce("base", F.lit(0))), plan, width)
    return found.withColumnRenamed("doc", id_col)
