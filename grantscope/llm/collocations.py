"""Collocations of words, mined from position bitmaps per word.

Texts are cut into pieces at punctuation and line ends, and their words put on a line of places,
with an empty place between pieces.  A shard is a stretch of that line; for each word it
has a bitmap of the places where the word stands, stored as 16-bit places or, for a frequent
word, as packed bits.  A phrase's bitmap marks the places where it ends: shifted by one place
and ANDed with a word's bitmap, it gives the longer phrase's; an empty place ends every phrase.

Supports are popcounts summed over all shards, length by
length: the bitmap of all phrases of k words whose first and last k - 1 words are frequent is the shift-and-AND
of that of k - 1, and popcounts are summed by a 64-bit hash of the phrase.  The sums that reach the
support are kept, and their hashes go into a bit filter of bounded size.  Of each frequent phrase one part of the
shards that holds it is kept too, its home.  A last pass
searches each shard depth first, within these bitmaps, for the words of the phrases that are at home there,
so a frequent phrase is told once, in however many tasks it stands.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _words as W
from ._scratch import Scratch

BREAKS = b".,;:!?\n\x0b\x0c\r"
IS_BREAK = np.zeros(256, bool)
IS_BREAK[list(BREAKS)] = True
IS_WORD = ~IS_BREAK
IS_WORD[list(b" \t")] = False
#: Places of a shard, so that one is a 16-bit number.
PLACES = 1 << 16
#: Entries from which packed bits take less than places.
DENSE = PLACES // 16
#: Phrases whose sums a task holds before it hands them on.
HELD = 3 << 18
#: Bits of a filter: 16 for each phrase, at most 2^28 (32 MB). Beyond some 30 million frequent phrases it prunes less and the results stay the same.
MIN_BITS, MAX_BITS, BITS_EACH = 16, 28, 16
STORED = ["lang", "part", "words", "counts", "sparse", "dense"]
SHARD = "lang string, part int, n_words long, words binary, counts binary, sparse binary, dense binary"
#: Parts of a language that are ranked by themselves before the best of all parts are.
RANK_PARTS = 256
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shards_of(data: np.ndarray, offsets: np.ndarray, context: int) -> Iterator[tuple]:
    """The shards of a block of lower-case texts: (own words, words, counts, sparse, dense).

    Each shard begins with the last ``context`` places of the one before, so that phrases across the
    cut are found; phrases count where they end, at places from ``context`` on.
    """
    starts, ends, _ = W.spans(data, offsets, IS_WORD)
    if not len(starts):
        return
    breaks, text = np.cumsum(IS_BREAK[data])[starts], np.searchsorted(offsets, starts, "right")
    new = np.ones(len(starts), bool)
    new[1:] = (breaks[1:] != breaks[:-1]) | (text[1:] != text[:-1])
    place = np.arange(len(starts)) + np.cumsum(new)
    hashes, own = W.hashes(data, starts, ends), PLACES - context
    for low in range(0, int(place[-1]) + 1, own):
        a, b = np.searchsorted(place, [low - context, low + own])
        if a == b:
            continue
        at = place[a:b] - (low - context)
        _, first, number, counts = np.unique(hashes[a:b], return_index=True, return_inverse=True, return_counts=True)
        order = np.argsort(number, kind="stable")
        at, few = at[order].astype("<u2"), counts <= DENSE
        dense = []
        for k in np.flatnonzero(~few).tolist():
            bits = np.zeros(PLACES, np.uint8)
            upto = int(counts[: k + 1].sum())
            bits[at[upto - counts[k] : upto]] = 1
            dense.append(np.packbits(bits, bitorder="little").tobytes())
        s, size = starts[a:b][first], (ends - starts)[a:b][first] + 1
        upto = np.cumsum(size)
        words = data[np.minimum(np.arange(upto[-1]) + np.repeat(s - upto + size, size), len(data) - 1)]
        words[upto - 1] = 32
        yield int((place[a:b] >= low).sum()), words.tobytes(), counts.astype("<u4").tobytes(), at[np.repeat(few, counts)].tobytes(), b"".join(dense)


class Shard:
    """Word numbers by place, and the words with their hashes."""

    def __init__(self, words: bytes, counts: bytes, sparse: bytes, dense: bytes):
        data = np.frombuffer(words, np.uint8)
        starts, ends, _ = W.spans(data, np.array([0, len(data)]), IS_WORD)
        self.words, self.hashes = words.split(b" ")[:-1], W.hashes(data, starts, ends)
        n = np.frombuffer(counts, "<u4").astype(np.int64)
        few = n <= DENSE
        self.code = np.zeros(PLACES, np.int64)  # 0: no word, else the word's number and 1
        self.code[np.frombuffer(sparse, "<u2")] = np.repeat(np.flatnonzero(few), n[few]) + 1
        for k, i in enumerate(np.flatnonzero(~few).tolist()):
            self.code[np.unpackbits(np.frombuffer(dense, np.uint8, PLACES // 8, k * PLACES // 8), bitorder="little") == 1] = i + 1

    def levels(self, seed: int, passes: list[Callable[[np.ndarray], np.ndarray]], depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For 1 to ``depth`` words: where phrases end whose parts all passed, and their hashes."""
        word = np.concatenate([[np.uint64(0)], W.mix(self.hashes ^ np.uint64(seed))])[self.code]
        live, h = self.code > 0, word
        for k in range(depth):
            if k:
                live = live & np.concatenate([[False], live[:-1]])  # shift and AND
                h = W.mix((np.concatenate([[np.uint64(0)], h[:-1]]) * _MIX) ^ word)
            if k < len(passes):
                at = np.flatnonzero(live)
                live = np.zeros(PLACES, bool)
                live[at[passes[k](h[at])]] = True
            yield live, h


def seed_of(lang: str) -> int:
    """A number of the language, mixed so that a word named like one language does not meet the word of another's name there."""
    data = np.frombuffer(lang.encode() or b" ", np.uint8)
    return int(W.mix(W.mix(W.hashes(data, np.array([0]), np.array([len(data)])) * _MIX) + _MIX)[0])


def index(docs: DataFrame, *, lang_col: str, text_col: str, context: int) -> DataFrame:
    """A row per shard of documents of one language, with the words' bitmaps; a null language is ``und``, a null text empty.

    ``part`` is the number of the task that made it.
    """
    slim = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part_of = TaskContext.get().partitionId()
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            code = langs.indices.to_numpy(zero_copy_only=False)
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                data, offsets = W.utf8(batch.column(1).take(pa.array(np.flatnonzero(code == k))))
                for i, j in W.blocks(offsets):
                    part = W.LOWER[data[offsets[i] : offsets[j]]]
                    rows = list(shards_of(part, offsets[i : j + 1] - offsets[i], context))
                    if rows:
                        cols = [pa.array([lang] * len(rows)), pa.array([part_of] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int64()), *[pa.array([r[n] for r in rows], pa.binary()) for n in range(1, 5)]]
                        yield pa.RecordBatch.from_arrays(cols, ["lang", "part", "n_words", "words", "counts", "sparse", "dense"])
        W.tidy()

    return slim.mapInArrow(run, SHARD)


class Filter:
    """A set of hashes as bits, two of each: all that were put in pass, and some others."""

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.mask = words, np.uint64((1 << bits) - 1)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        return self._has(h & self.mask) & self._has((h >> np.uint64(32)) & self.mask)

    def _has(self, bit: np.ndarray) -> np.ndarray:
        return (self.words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)

    @classmethod
    def of(cls, hashes: DataFrame) -> Filter:
        """The filter of a column ``h``: its words are ORed where the hashes are, and come to the driver as at most 2^28 bits."""
        bits = min(MAX_BITS, max(MIN_BITS, int(hashes.count() * BITS_EACH).bit_length()))
        mask = F.lit((1 << bits) - 1).cast("long")
        places = F.explode(F.array(F.col("h").bitwiseAND(mask), F.shiftrightunsigned("h", 32).bitwiseAND(mask))).alias("bit")
        rows = hashes.select(places).groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(F.lit(63).cast("long")).cast("int"))).alias("word"))
        found = rows.toArrow()
        words = np.zeros(max(1, 1 << (bits - 6)), np.uint64)
        words[found["at"].to_numpy()] = found["word"].to_numpy().view(np.uint64)
        return cls(words, bits)


def turns(h: np.ndarray, part: np.ndarray, parts: int) -> np.ndarray:
    """How many parts after the one that its hash names a phrase's part comes: the least of several is its home, and homes are spread."""
    return (part - _named(h, parts)) % parts


def _named(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(33)) * np.uint64(parts) >> np.uint64(31)).astype(np.int64)


def home_keys(h: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of a phrase at a part."""
    one = W.mix(h ^ W.mix(part.astype(np.uint64) * _MIX))
    return one, W.mix(one * _MIX)


def supports(shards: DataFrame, passes: list, depth: int, context: int, parts: int) -> DataFrame:
    """``h``, ``n`` and ``turn``: popcounts of the phrases of ``depth`` words whose parts all passed, summed by hash, and the least of :func:`turns`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        tests = [p.value for p in passes]

        def summed() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            h, n, part = (np.concatenate([x[i] for x in held]) for i in range(3))
            held.clear()
            order = np.argsort(h, kind="stable")
            h = h[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])[: len(h)])
            return h[first], np.add.reduceat(n[order], first) if len(first) else n, part[order[first]]

        def out(h: np.ndarray, n: np.ndarray, part: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(h), PLACES):
                j = slice(i, i + PLACES)
                yield pa.RecordBatch.from_arrays([pa.array(h[j].view(np.int64)), pa.array(n[j]), pa.array(turns(h[j], part[j], parts))], ["h", "n", "turn"])

        for batch in batches:
            for lang, part, *bits in zip(*(batch.column(n).to_pylist() for n in STORED), strict=True):
                for live, h in Shard(*bits).levels(seed_of(lang), tests, depth):
                    pass
                live[:context] = False
                found, n = np.unique(h[live], return_counts=True)
                held.append((found, n, np.full(len(found), part, np.int32)))
                if sum(len(x[0]) for x in held[1:]) > HELD:
                    held = [summed()]
                    if len(held[0][0]) > HELD:
                        yield from out(*held.pop())
        if held:
            yield from out(*summed())
        W.tidy()

    sums = shards.select(*STORED).mapInArrow(run, "h long, n long, turn long")
    return sums.groupBy("h").agg(F.sum("n").alias("n"), F.min("turn").alias("turn"))


def homes(frequent: DataFrame, parts: int) -> DataFrame:
    """A column ``h`` of both :func:`home_keys` of each phrase at its home."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy().view(np.uint64)
            keys = home_keys(h, (batch.column(1).to_numpy() + _named(h, parts)) % parts)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64))], ["h"])

    return frequent.select("h", "turn").mapInArrow(run, "h long")


def search(shard: Shard, depths: np.ndarray, own: np.ndarray, longest: int) -> Iterator[tuple[bytes, int, int]]:
    """Depth first, the phrases asked for: (phrase, its words, a place where it ends).

    ``own`` has bit k - 1 where a phrase of k words ends that is asked for, ``depths`` how many words of such phrases end at a place.
    """
    code, depth, asked, words = shard.code.tolist(), depths.tobytes() + b"\0", own.tobytes(), shard.words
    for p in np.flatnonzero(own & 1).tolist():
        yield words[code[p] - 1], 1, p
    # bitmaps of words, of those places only after which a pair goes on
    at = np.flatnonzero((depths[:-1] > 0) & (depths[1:] > 1))
    at = at[np.argsort(shard.code[at], kind="stable")]
    cuts = np.flatnonzero(np.diff(shard.code[at])) + 1

    def grow(phrase: bytes, ends: list[int], size: int) -> Iterator[tuple[bytes, int, int]]:
        after = defaultdict(list)
        for p in ends:  # shifted by one, ANDed with the bitmap of each word that stands there
            if depth[p + 1] >= size:
                after[code[p + 1]].append(p + 1)
        for k, places in after.items():
            longer = phrase + b" " + words[k - 1]
            p = next((p for p in places if asked[p] >> (size - 1) & 1), None)
            if p is not None:
                yield longer, size, p
            if size < longest:
                yield from grow(longer, places, size + 1)

    for ends in np.split(at, cuts):
        if len(ends):
            yield from grow(words[code[ends[0]] - 1], ends.tolist(), 2)


def named(shards: DataFrame, passes: list, home, longest: int, context: int) -> DataFrame:
    """``h``, ``lang``, ``phrase`` and ``k`` (its words) of the frequent phrases, each from its home.

    The filter of homes takes some phrases from other parts too, so rows can be repeated.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests, at_home, told, rows = [p.value for p in passes], home.value, set(), []

        def out() -> pa.RecordBatch:
            h, lang, phrase, k = zip(*rows, strict=True)
            cols = [pa.array(np.array(h, np.uint64).view(np.int64)), pa.array(lang), pa.array(phrase, pa.binary()).cast(pa.string()), pa.array(k, pa.int32())]
            return pa.RecordBatch.from_arrays(cols, ["h", "lang", "phrase", "k"])

        for batch in batches:
            for lang, part, *bits in zip(*(batch.column(n).to_pylist() for n in STORED), strict=True):
                shard, depths, own, hashes = Shard(*bits), np.zeros(PLACES, np.uint8), np.zeros(PLACES, np.uint8), []
                for k, (live, h) in enumerate(shard.levels(seed_of(lang), tests, longest)):
                    hashes.append(h)
                    at = np.flatnonzero(live[context:]) + context
                    found, first = np.unique(h[at], return_index=True)
                    one, two = home_keys(found, np.array([part]))
                    at = at[first[at_home(one) & at_home(two)]]
                    own[at] |= 1 << k
                    for j in range(k + 1):
                        depths[at - j] = np.maximum(depths[at - j], k + 1 - j)
                for phrase, k, p in search(shard, depths, own, longest):
                    h = int(hashes[k - 1][p])
                    if (h, k) not in told:
                        told.add((h, k))
                        rows.append((h, lang, phrase, k))
                if len(rows) > HELD // 4:
                    yield out()
                    rows.clear()
                    told.clear()
        if rows:
            yield out()
        W.tidy()

    return shards.select(*STORED).mapInArrow(run, "h long, lang string, phrase string, k int")


def mined(scratch: Scratch, shards: DataFrame, *, support: int, longest: int, context: int) -> tuple[DataFrame, DataFrame]:
    """The frequent phrases of 1 to ``longest`` words: ``h``, ``k`` and ``f``, and their words as :func:`named` gives them."""
    sc, parts = scratch.spark.sparkContext, (shards.agg(F.max("part")).first()[0] or 0) + 1
    passes, frequent = [], []
    for k in range(1, longest + 1):
        sums = scratch.write(supports(shards, passes, k, context, parts).where(F.col("n") >= support), f"frequent-{k}")
        frequent.append(sums.withColumn("k", F.lit(k)))
        if k < longest:
            passes.append(sc.broadcast(Filter.of(sums.select("h"))))
    every = reduce(DataFrame.unionByName, frequent)
    home = sc.broadcast(Filter.of(homes(every, parts)))
    return every.select("h", "k", F.col("n").alias("f")), named(shards, passes, home, longest, context)


def scored(counted: DataFrame, totals: DataFrame, *, support: int, covered: int) -> DataFrame:
    """Candidates with the score of their weakest cut, less those that a longer candidate covers.

    ``counted`` has lang, phrase, k and f of phrases of one word and more, ``totals`` lang and n.  Products are
    decimals of 38 digits.
    """
    known = counted.where(F.col("f") >= support)
    words = F.split("phrase", " ")
    many = known.where("k > 1").withColumn("words", words)
    part = lambda a, n: F.array_join(F.slice("words", a, n), " ")
    cuts = many.select("lang", "phrase", "words", "k", "f", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", F.col("f").alias("a"), "cut", part(F.lit(1), F.col("cut")).alias("head"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("tail"))
    side = lambda name, f: known.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    both = cuts.join(side("head", "l"), ["lang", "head"]).join(side("tail", "r"), ["lang", "tail"]).join(totals, "lang")
    wide = lambda c, digits: F.col(c).cast(f"decimal({digits},0)")
    top = (wide("a", 16) * F.lit(1000).cast("decimal(4,0)")).cast("decimal(20,0)") * wide("n", 18)
    score = F.call_function("div", top, wide("l", 19) * wide("r", 19))
    best = both.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "cut", "a", "l", "r", "n")).alias("x")).select("lang", "phrase", "x.score", "x.a", "x.l", "x.r", "x.n")
    lengths = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("k") - n + 1), lambda a: F.array_join(F.slice("words", a, n), " "))))
    inside = many.where("k > 2").select("lang", F.explode(lengths).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    left = best.join(inside, ["lang", "phrase"], "left")
    return left.where(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a"))).drop("longer")


def ranked(rows: DataFrame, order: list[Column], key: str, most: int) -> DataFrame:
    """The first rows of each key with their ``rank``; a key's rows are ranked in parts first, so that none meets all of them."""
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    first = F.row_number().over(Window.partitionBy(key, "_part").orderBy(*order))
    some = rows.withColumn("_part", part).withColumn("_n", first).where(F.col("_n") <= most).drop("_part", "_n")
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return some.withColumn("rank", rank.cast("long")).where(F.col("rank") <= most)


def collocations(
    spark: SparkSession,
    docs: DataFrame,
    *,
    lang_col: str = "lang",
    text_col: str = "text",
    support: int = 100,
    longest: int = 5,
    covered: int = 100,
    most: int = 2000,
) -> DataFrame:
    """Each language's strongest phrases of 2 to ``longest`` words: lang, rank, phrase, a, l, r, n and score.

    A phrase of at least ``support`` occurrences is cut after each of its words; with the counts l and r of
    both parts, a of the phrase and n of all words, its score is the least floor(1000 * a * n / (l * r)), of equal ones that of
    the earliest cut.  Phrases inside a longer one with ``covered`` percent of their count are left out.  The first
    ``most`` by score, count and phrase (in byte order) are returned.

    Letters A to Z count as small; overlapping occurrences count.  Null texts are empty, a null language is
    ``und``; texts of any length are read whole, a shard at a time; repeated rows count each; other columns are ignored; an
    empty table gives an empty result.  Words of a shard are told apart by 64-bit hashes, phrases that are counted too.
    """
    scratch, context = Scratch(spark, "collocations"), longest - 1
    shards = scratch.write(index(docs, lang_col=lang_col, text_col=text_col, context=context), "shards")
    frequent, texts = mined(scratch, shards, support=support, longest=longest, context=context)
    counted = scratch.write(texts.dropDuplicates().join(frequent.hint("merge"), ["h", "k"]).drop("h"), "phrases")
    totals = scratch.write(shards.groupBy("lang").agg(F.sum("n_words").alias("n")), "totals")
    out = scored(counted, totals, support=support, covered=covered)
    best = ranked(out, [F.desc("score"), F.desc("a"), F.col("phrase")], "lang", most)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
