"""Benchmark decontamination by the q-gram lemma.

A passage of m characters that occurs in a text with at most k edits shares at
least m + 1 - q (k + 1) q-grams with it, all of them on k + 1 neighbouring
diagonals.  Texts are scanned once for q-grams of the benchmark; hits are counted
per passage and band of diagonals, bands overlapping so that any k + 1 diagonals
lie in one; a band that reaches the bound is verified by banded alignment.  The same
holds for every stretch of 80 bytes (some 13 words) of a passage, at any place in it,
so a text that quotes a part of an item is found too.

Texts and passages are compared in lower case, with each run of ASCII white space
as one space; places are bytes of that form.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _words as W
from ._scratch import Scratch

Q = 12
EDIT_SHARE = 0.06
PASSAGE, STRIDE = 160, 80
#: Bytes of an item that count by themselves; each such stretch lies in one passage, as passages overlap by as many.
EXCERPT = 80
EXCERPT_EDITS = min(int(EXCERPT * EDIT_SHARE), EXCERPT // Q - 1)
EXCERPT_LEAST = EXCERPT + 1 - Q * (EXCERPT_EDITS + 1)
BLOCK_CHARS = 4 << 20
BITS = 22
#: Hits of q-grams that are held at once; a part of the texts that has more is cut, down to pieces of one text.
MAX_HITS = 1 << 20
#: Bytes of a piece, and by how many neighbours overlap: more than any passage with its edits.
PIECE, OVERLAP = 2048, 512


def normal(text: bytes) -> bytes:
    text = text if text.isascii() else text.decode("utf-8", "replace").lower().encode()
    return b" ".join(text.lower().split())


def codes(data: np.ndarray) -> np.ndarray:
    """A 64-bit code of each q-gram of a byte string."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    first = np.ndarray((n,), "<u8", padded, strides=(1,))
    rest = np.ndarray((n,), "<u4", padded, offset=8, strides=(1,))
    return (first * np.uint64(0x9E3779B97F4A7C15)) ^ (rest.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Passages:
    """Windows of the benchmark items, and an index of the items' q-grams.

    The index has a code and a place for each byte of the items, 12 bytes in all; equal
    items are held once.
    """

    def __init__(self, items: list[tuple[int, bytes]]):
        keys: dict[bytes, list] = {}
        for key, text in items:
            text = normal(text)
            if text:
                keys.setdefault(text, []).append(key)
        self.short = {x: own for x, own in keys.items() if len(x) < Q}
        texts = [x for x in keys if len(x) >= Q]
        self.keys = [keys[x] for x in texts]
        self.joined = b"\n".join(texts)
        ends = np.cumsum([len(x) + 1 for x in texts]).astype(np.int64) - 1
        cuts = [(item, a, b) for item, x in enumerate(texts) for a, b in windows(len(x))]
        self.item, start, end = (np.array(x, np.int64) for x in zip(*cuts, strict=True)) if cuts else (np.zeros(0, np.int64),) * 3
        base = np.concatenate([[0], ends + 1])[:-1].astype(np.int64)
        self.start, self.end = start + base[self.item], end + base[self.item]
        self.size = self.end - self.start
        self.k = np.minimum((self.size * EDIT_SHARE).astype(np.int64), np.maximum(self.size // Q - 1, 0))
        self.least = np.maximum(1, self.size + 1 - Q * (self.k + 1))
        code = codes(np.frombuffer(self.joined, np.uint8))
        pos = np.arange(len(code))
        if len(pos):  # within one item
            of = np.searchsorted(ends, pos, "right")
            pos = pos[(pos >= base[of]) & (pos + Q <= ends[of])]
        order = np.argsort(code[pos], kind="stable")
        self.pos = pos[order].astype(np.int32 if len(code) < 1 << 31 else np.int64)
        self.code = code[pos][order]
        self.bloom = np.zeros(1 << BITS, bool)
        self.bloom[self._slot(self.code)] = True

    @staticmethod
    def _slot(code: np.ndarray) -> np.ndarray:
        return ((code * np.uint64(0xA0761D6478BD642F)) >> np.uint64(64 - BITS)).astype(np.int64)

    def text(self, p: int) -> bytes:
        return self.joined[self.start[p] : self.end[p]]

    def lookup(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in a byte string of q-grams of the items, each with its range of the index."""
        c = codes(data)
        at = np.flatnonzero(self.bloom[self._slot(c)]) if len(self.code) else np.zeros(0, np.int64)
        c = c[at]
        lo, hi = np.searchsorted(self.code, c, "left"), np.searchsorted(self.code, c, "right")
        hit = hi > lo
        return at[hit], lo[hit], hi[hit]

    def spread(self, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, low: int = 0, high: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hits of :meth:`lookup` as (place in the text, passage, place in it), for passages ``low`` to ``high``."""
        n = hi - lo
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        pos, at = self.pos[np.repeat(lo, n) + nth].astype(np.int64), np.repeat(at, n)
        high = len(self.start) if high is None else high
        first = np.maximum(np.searchsorted(self.end, pos + Q, "left"), low)
        n = np.maximum(np.minimum(np.searchsorted(self.start, pos, "right"), high) - first, 0)
        p = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(at, n), p, np.repeat(pos, n) - self.start[p]


def windows(size: int) -> list[tuple[int, int]]:
    """The passages of an item of ``size`` bytes."""
    if size <= PASSAGE + STRIDE:
        return [(0, size)]
    return [(a, a + PASSAGE) for a in range(0, size - PASSAGE, STRIDE)] + [(size - PASSAGE, size)]


def align(passage: bytes, text: bytes, k: int) -> tuple[int, int, int] | None:
    """The best occurrence of ``passage`` in ``text``: (edits, start, end), or None beyond ``k``.

    Edit distance with free ends in the text.  ``text`` is a band of diagonals, so
    a row spans its width; the cell left of another is folded in by a running
    minimum.  Among equals the first end wins, with the latest start for it.
    """
    at = text.find(passage)
    if at >= 0:
        return 0, at, at + len(passage)
    b = np.frombuffer(text, np.uint8)
    n = len(b)
    step = np.arange(n + 1)
    big = n + len(passage) + 2
    row = np.zeros(n + 1, np.int64) * big + (n - step)  # edits and start in one number: edits * big + (n - start)
    for c in passage:
        new = np.empty(n + 1, np.int64)
        new[0] = row[0] + big
        new[1:] = np.minimum(row[:-1] + big * (b != c), row[1:] + big)
        row = np.minimum.accumulate(new - big * step) + big * step
    edits = row // big
    best = int(edits.min())
    if best > k:
        return None
    end = int(edits.argmin())
    return best, n - int(row[end] % big), end


def scan(passages: Passages, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(text, item, start, end, edits) of each passage found, places in normalised bytes.

    Of overlapping places of one passage those with fewer edits, then the first, are given.
    """
    texts = [normal(data[a:b].tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    out = [(d, key, 0, len(x), 0) for d, x in enumerate(texts) for key in passages.short.get(x, ())]
    found, parts = search(passages, texts)
    found = apart(found)
    places: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for d, p, start, end, _ in found:
        places.setdefault((d, int(passages.item[p])), []).append((start, end))
    for d, p, start, end, edits in found:
        out += [(d, key, start, end, edits) for key in passages.keys[passages.item[p]]]
    slack = EXCERPT_EDITS
    for d, item, start, end, edits in merged(parts):
        if not any(a - slack <= start and end <= b + slack for a, b in places.get((d, item), ())):
            out += [(d, key, start, end, edits) for key in passages.keys[item]]
    return sorted(set(out), key=lambda x: (x[0], x[1] is None, x[1] or 0, x[2:]))


def apart(found: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Places of each (text, passage) that do not overlap: least edits first, then the first."""
    groups: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for d, p, start, end, edits in set(found):
        groups.setdefault((d, p), []).append((edits, start, end))
    out = []
    for (d, p), own in groups.items():
        kept: list[tuple[int, int, int]] = []
        for edits, start, end in sorted(own):
            n = bisect_left(kept, (start, end, edits))
            if (n == 0 or kept[n - 1][1] <= start) and (n == len(kept) or end <= kept[n][0]):
                kept.insert(n, (start, end, edits))
        out += [(d, p, *x) for x in kept]
    return out


def merged(parts: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(text, item, start, end, edits) with overlapping places of an item as one, of the most edits."""
    out: list[tuple[int, int, int, int, int]] = []
    for d, item, start, end, edits in sorted(set(parts)):
        if out and out[-1][:2] == (d, item) and start <= out[-1][3]:
            out[-1] = (*out[-1][:3], max(out[-1][3], end), max(out[-1][4], edits))
        else:
            out.append((d, item, start, end, edits))
    return out


def search(passages: Passages, texts: list[bytes]) -> tuple[list, list]:
    """Places of passages, as (text, passage, start, end, edits), and of excerpts, as (text, item, ...).

    All hits count, but no more than about ``MAX_HITS`` are held at once: texts are halved
    until theirs are few, then a text is cut into overlapping pieces, each different one
    searched once, then the passages of a piece are taken range by range.
    """
    at, lo, hi = passages.lookup(np.frombuffer(b"\n".join(texts), np.uint8))
    if not len(at):
        return [], []
    if 2 * int((hi - lo).sum()) <= MAX_HITS:
        return matches(passages, texts, *passages.spread(at, lo, hi))
    found, parts = [], []
    if len(texts) > 1:
        half = len(texts) // 2
        for first, own in ((0, texts[:half]), (half, texts[half:])):
            for kept, new in zip((found, parts), search(passages, own), strict=True):
                kept += [(first + x[0], *x[1:]) for x in new]
        return found, parts
    text = texts[0]
    if len(text) > PIECE + OVERLAP:
        pieces: dict[bytes, list[int]] = {}
        for a in range(0, len(text) - OVERLAP, PIECE):
            pieces.setdefault(text[a : a + PIECE + OVERLAP], []).append(a)
        for piece, starts in pieces.items():
            for kept, new in zip((found, parts), search(passages, [piece]), strict=True):
                kept += [(0, x[1], a + x[2], a + x[3], x[4]) for a in starts for x in new]
        return apart(found), merged(parts)
    for low, high in ranges(passages, at, lo, hi):
        hits = [passages.spread(*x, low, high) for x in slices(at, lo, hi)]
        for kept, new in zip((found, parts), matches(passages, texts, *(np.concatenate(x) for x in zip(*hits, strict=True))), strict=True):
            kept += new
    return found, parts


def slices(at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The ranges of a lookup in parts of at most ``MAX_HITS / 2`` places."""
    step = MAX_HITS // 4
    n = -(-(hi - lo) // step)
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    low = np.repeat(lo, n) + nth * step
    at, high = np.repeat(at, n), np.minimum(low + step, np.repeat(hi, n))
    cuts = np.flatnonzero(np.diff(np.cumsum(high - low) // step)) + 1
    for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)], strict=True):
        yield at[x:y], low[x:y], high[x:y]


def ranges(passages: Passages, at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of passages of at most ``MAX_HITS`` hits each, or one passage; those of too few hits to be found are between them."""
    total = np.zeros(len(passages.start), np.int64)
    for x in slices(at, lo, hi):
        total += np.bincount(passages.spread(*x)[1], minlength=len(total))
    upto = np.concatenate([[0], np.cumsum(total)])
    chosen = np.flatnonzero(total >= np.minimum(passages.least, EXCERPT_LEAST)).tolist()
    while chosen:
        n = 1
        while n < len(chosen) and upto[chosen[n] + 1] - upto[chosen[0]] <= MAX_HITS:
            n += 1
        yield chosen[0], chosen[n - 1] + 1
        chosen = chosen[n:]


def matches(passages: Passages, texts: list[bytes], at: np.ndarray, p: np.ndarray, j: np.ndarray) -> tuple[list, list]:
    """Of hits at places ``at`` of the joined texts: the passages found, and excerpts outside of them."""
    off = np.concatenate([[0], np.cumsum([len(x) + 1 for x in texts])]).astype(np.int64)
    doc = np.searchsorted(off, at, "right") - 1
    shift = at - off[doc] - j
    width = passages.k[p] + 1
    diagonal = shift + passages.size[p]
    found: list[tuple[int, int, int, int, int]] = []
    seen: dict[tuple[int, bytes], tuple[int, int, int] | None] = {}
    for lag in (0, 1):  # bands of 2 (k + 1) diagonals, every k + 1
        band = (diagonal // width + lag) // 2
        # one count for each place of the passage in the band
        key = np.stack([doc, p, band, j], 1)
        key = key[np.lexsort(key.T[::-1])]
        key = key[np.concatenate([[True], (key[1:] != key[:-1]).any(1)])]
        first = np.concatenate([[True], (key[1:, :3] != key[:-1, :3]).any(1)])
        group = np.flatnonzero(first)
        n = np.diff(np.concatenate([group, [len(key)]]))
        for g in group[n >= passages.least[key[group, 1]]]:
            d, q, v = (int(x) for x in key[g, :3])
            k, m = int(passages.k[q]), int(passages.size[q])
            lo = max(0, (2 * v - lag) * (k + 1) - m - k)
            hi = (2 * v - lag + 2) * (k + 1) - 1 + k
            part = texts[d][lo : max(lo, hi + 1)]
            if (q, part) not in seen:
                seen[q, part] = align(passages.text(q), part, k)
            hit = seen[q, part]
            if hit:
                found.append((d, q, lo + hit[1], lo + hit[2], hit[0]))
    found = apart(found)
    return found, excerpts(passages, texts, doc, p, j, shift, found)


def least_edits(stretches: np.ndarray, bands: np.ndarray) -> np.ndarray:
    """For each row the least edits with which its stretch occurs in its band of text."""
    step = np.arange(bands.shape[1] + 1)
    row = np.zeros((len(bands), len(step)), np.int64)
    for c in stretches.T:
        new = row + 1
        new[:, 1:] = np.minimum(row[:, :-1] + (bands != c[:, None]), new[:, 1:])
        row = np.minimum.accumulate(new - step, 1) + step
    return row.min(1)


def excerpts(passages: Passages, texts: list[bytes], doc: np.ndarray, p: np.ndarray, j: np.ndarray, shift: np.ndarray, found: list) -> list[tuple[int, int, int, int, int]]:
    """(text, item, start, end, edits) of stretches of EXCERPT bytes of passages, outside the places found.

    Hits are given by text, passage, place in it and diagonal.  Neighbouring stretches of a
    passage are one excerpt, with the most edits of the first and the last.
    """
    w, k, least = EXCERPT, EXCERPT_EDITS, EXCERPT_LEAST
    places: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for d, q, start, end, _ in found:
        places.setdefault((d, int(passages.item[q])), []).append((start, end))
    out: list[tuple[int, int, int, int, int]] = []
    seen: dict[tuple, list[tuple[int, int, int]]] = {}
    long = passages.size[p] > w
    doc, p, j, shift = doc[long], p[long], j[long], shift[long]
    for lag in (0, 1):  # bands as in scan
        key = np.stack([doc, p, (shift // (k + 1) + lag) // 2, j], 1)
        key = key[np.lexsort(key.T[::-1])]
        if len(key) < least:
            continue
        key = key[np.concatenate([[True], (key[1:] != key[:-1]).any(1)])]
        ahead = key[least - 1 :]
        head = key[: len(ahead)]
        ok = (head[:, :3] == ahead[:, :3]).all(1) & (ahead[:, 3] - head[:, 3] <= w - Q)
        head, ahead = head[ok], ahead[ok]
        cuts = np.flatnonzero((head[1:, :3] != head[:-1, :3]).any(1)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(head)], strict=True):
            if a == b:
                continue
            d, q, band = (int(x) for x in head[a, :3])
            passage, text, item = passages.text(q), texts[d], int(passages.item[q])
            # all starts of stretches that may hold enough q-grams
            room = np.zeros(len(passage) - w + 2, np.int64)
            np.add.at(room, np.clip(ahead[a:b, 3] + Q - w, 0, len(passage) - w + 1), 1)
            np.add.at(room, np.clip(head[a:b, 3] + 1, 0, len(passage) - w + 1), -1)
            starts = np.flatnonzero(np.cumsum(room)[:-1] > 0)
            low = (2 * band - lag) * (k + 1)
            for start, end in places.get((d, item), ()):
                middle = starts + low + k + w // 2
                starts = starts[(middle < start) | (middle >= end)]
            if not len(starts):
                continue
            # places are counted from the band's lowest diagonal, so what was aligned once serves wherever the same bytes come again
            begin, width = int(starts[0]) + low - k, w + 2 * (k + 1) - 1 + 2 * k
            part = (q, starts.tobytes(), min(begin, 0), text[max(0, begin) : int(starts[-1]) + low - k + width])
            if part not in seen:
                seen[part] = _stretches(passage, text, starts, low, k, width)
            out += [(d, item, low + start, low + end, edits) for start, end, edits in seen[part]]
    return out


def _stretches(passage: bytes, text: bytes, starts: np.ndarray, low: int, k: int, width: int) -> list[tuple[int, int, int]]:
    """(start, end, edits) of runs of the stretches at ``starts`` that the text holds, less ``low``."""
    where = (starts + low - k)[:, None] + np.arange(width)
    inside = (where >= 0) & (where < len(text))
    band_text = np.where(inside, np.frombuffer(text, np.uint8)[np.clip(where, 0, len(text) - 1)], 256).astype(np.int64)
    stretch = np.frombuffer(passage, np.uint8)[starts[:, None] + np.arange(EXCERPT)].astype(np.int64)
    good = starts[least_edits(stretch, band_text) <= k]
    out = []
    for part in np.split(good, np.flatnonzero(np.diff(good) > EXCERPT) + 1) if len(good) else ():
        ends = []
        for x in sorted({int(part[0]), int(part[-1])}):
            at = max(0, x + low - k)
            edits, start, end = align(passage[x : x + EXCERPT], text[at : x + low - k + width], k)
            ends.append((at + start - low, at + end - low, edits))
        out.append((ends[0][0], max(x[1] for x in ends), max(x[2] for x in ends)))
    return out


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, limit: int = BLOCK_CHARS) -> Iterator[list[tuple[int, bytes]]]:
    """The benchmark in blocks of bounded size, each held by the driver one at a time."""
    held, size = [], 0
    for r in benchmark.select(F.col(item_col).cast("long"), F.col(text_col)).toLocalIterator():
        text = (r[1] or "").encode()
        if held and size + len(text) > limit:
            yield held
            held, size = [], 0
        held.append((r[0], text))
        size += len(text)
    if held:
        yield held


def contaminated(
    spark: SparkSession,
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_col: str = "item_id",
    benchmark_text: str = "text",
    block_chars: int | None = None,
) -> DataFrame:
    """All columns of ``docs``, with ``leaks``: what each whole text holds of the benchmark.

    ``leaks`` is an array of (item_id, start, end, edits), sorted, empty for clean
    texts; places are in the normalised text.  An item of up to 240 bytes is one
    passage, a longer one is cut into overlapping passages of 160, each of which
    counts; a passage may have edits of 6% of its length.  Of overlapping places of one
    passage the best is given.  Where no passage is found, any 80 bytes of an item count,
    with up to 4 edits.  Items shorter than a q-gram must equal the whole text.  Null and
    empty texts and items hold nothing; equal items are each reported; equal rows get
    equal leaks; a text of any length, and one that repeats itself, is searched whole in
    bounded memory.  A column of ``docs`` named ``leaks`` is replaced.  An empty table of
    either kind gives no leaks.

    The benchmark is searched for in blocks of at most ``block_chars`` bytes of text, about
    30 bytes of memory each in the driver and in a worker.  One block is one pass over the
    documents; of more, each is a pass of its own whose finds are written before the next
    is built, by the MD5 of the text, and joined to the documents at the end.
    """
    own = [f for f in docs.schema.fields if f.name != "leaks"]
    plain = docs.select(*[F.col(f"`{f.name}`") for f in own])
    blocks = item_blocks(benchmark, item_col, benchmark_text, block_chars or BLOCK_CHARS)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        at = [f.name for f in own].index(text_col)
        schema = T.StructType([*own, T.StructField("leaks", T._parse_datatype_string(LEAKS))])
        return plain.mapInArrow(_scanner(spark.sparkContext.broadcast(Passages(first)), at), schema)
    scratch = Scratch(spark, "leaks")
    texts = plain.select(F.md5(F.col(f"`{text_col}`").cast("binary")).alias("key"), F.col(f"`{text_col}`").alias("text")).where("text is not null")
    found = None
    for n, block in enumerate(chain([first, second], blocks)):
        sent = spark.sparkContext.broadcast(Passages(block))
        held = texts.mapInArrow(_scanner(sent, 1, 1), f"key string, leaks {LEAKS}").where(F.size("leaks") > 0)
        part = scratch.write(held.groupBy("key").agg(F.first("leaks").alias("leaks")), f"block-{n}")
        sent.destroy()
        found = part if found is None else found.unionByName(part)
    order = F.transform(F.flatten(F.collect_list("leaks")), lambda x: F.struct(x["item_id"].isNull().alias("nul"), x.alias("leak")))
    found = found.groupBy("key").agg(F.transform(F.sort_array(order), lambda x: x["leak"]).alias("_leaks"))
    inner = [f"_{i}_" for i in range(len(own))]
    keyed = plain.toDF(*inner).withColumn("_key", F.md5(F.col(inner[[f.name for f in own].index(text_col)]).cast("binary")))
    out = keyed.join(found.hint("merge"), F.col("_key") == F.col("key"), "left")
    return out.select(*[F.col(c).alias(f.name) for c, f in zip(inner, own, strict=True)], F.coalesce("_leaks", F.array().cast(LEAKS)).alias("leaks"))


LEAKS = "array<struct<item_id:long,start:long,end:long,edits:long>>"


def _scanner(sent, at: int, keep: int | None = None):
    """The first ``keep`` columns, or all, and the leaks of the text in column ``at``."""
    names = ("item_id", "start", "end", "edits")
    struct = pa.struct([(n, pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = W.utf8(batch.column(at))
            leaks: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for i, j in W.blocks(offsets, 1 << 20):
                for d, *rest in scan(sent.value, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]):
                    leaks[i + d].append(dict(zip(names, rest, strict=True)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:keep], pa.array(leaks, pa.list_(struct))], [*batch.schema.names[:keep], "leaks"])
        W.tidy()

    return run
