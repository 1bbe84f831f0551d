"""Language identification by cross-parsing entropy.

For every language a suffix automaton of a bounded sample of labelled text
accepts all substrings of that sample.  A text is parsed greedily into longest
matches against each automaton; the number of phrases times log2 of the sample's
length, over the text's length, estimates the cross entropy in bits per
character.  The language with the least wins.

Texts are parsed in segments of a fixed length, each beginning a phrase, so that
one table lookup advances all segments of a block, in all languages, by a
character.  All letters are folded to lower case; runs of other characters count
as one space.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _words as W

SEGMENT = 256
PAD, GAP, UNKNOWN = 0, 1, 2
#: Above the state, a table entry holds how many phrases the step ends.
COUNT = 29
UND = "und"


@dataclass
class Model:
    """Languages in order, symbol of each code point, and the joint transition table.

    Symbols from ``width`` on are no columns of the table; ``rare`` holds their
    transitions as sorted keys, state times ``symbols`` plus symbol, and ``rare_to``
    the states.
    """

    langs: list[str]
    symbol: np.ndarray
    table: np.ndarray
    roots: np.ndarray
    bits: np.ndarray
    width: int
    symbols: int
    rare: np.ndarray
    rare_to: np.ndarray


def automaton(text: list[int]) -> tuple[list[dict[int, int]], int]:
    """Transitions of the suffix automaton of a symbol string; state 0 is the root."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt, len(nxt)


def _fold() -> np.ndarray:
    """For each code point the code point of its lower-case letter, or 0 if it is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def fit(samples: dict[str, str], max_letters: int = 120) -> Model:
    """The model of one bounded sample of text per language.

    Every letter of a sample has a symbol of its own; UNKNOWN are those that no sample
    holds.  The ``max_letters`` most frequent ones are columns of the table, all
    others have sparse transitions.
    """
    fold = _fold()
    langs = sorted(samples)
    folded = {k: fold[np.frombuffer(samples[k].encode("utf-32-le", "replace"), "<u4")] for k in langs}
    seen: Counter = Counter()
    for x in folded.values():
        values, counts = np.unique(x[x > 0], return_counts=True)
        for c, n in zip(values.tolist(), counts.tolist(), strict=True):
            seen[c] += n
    letters = sorted(sorted(seen), key=lambda c: -seen[c])
    symbols = 3 + len(letters)
    kind = np.min_scalar_type(symbols)
    of = np.full(0x110000, UNKNOWN, kind)
    for k, c in enumerate(letters):
        of[c] = 3 + k
    symbol = np.where(fold > 0, of[fold], GAP).astype(kind)
    width = 3 + min(len(letters), max_letters)
    tables, roots, bits, base = [], [], [], 0
    rare: dict[int, int] = {}
    for k in langs:
        text = squeeze(of[folded[k]] * (folded[k] > 0) + GAP * (folded[k] == 0), np.array([0, len(folded[k])]))[0]
        nxt, n = automaton(text.tolist())
        # a step without a match ends the phrase and begins one; a symbol not in the sample is a phrase of its own
        t = np.full((n, width), base + (2 << COUNT), np.int32)
        t[0] = base + (1 << COUNT)
        for c, s in nxt[0].items():
            if c < width:
                t[:, c] = base + s + (1 << COUNT)
        t[:, PAD] = base + np.arange(n)
        for s, row in enumerate(nxt):
            for c, to in row.items():
                if c < width:
                    t[s, c] = base + to
                else:
                    rare[(base + s) * symbols + c] = base + to
        tables.append(t)
        roots.append(base)
        bits.append(math.log2(max(2, len(text))))
        base += n
    table = np.concatenate(tables) if tables else np.zeros((0, width), np.int32)
    keys = np.array(sorted(rare), np.int64)
    return Model(langs, symbol, table, np.array(roots, np.int32), np.array(bits), width, symbols, keys, np.array([rare[x] for x in keys.tolist()], np.int32))


def squeeze(symbols: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keeps one GAP of each run within a text."""
    gap = symbols == GAP
    keep = np.ones(len(symbols), bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    keep[offsets[offsets < len(symbols)]] = True
    return symbols[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


def phrases(model: Model, symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Phrases of each text in each language, as an array (texts, languages)."""
    n, k = len(offsets) - 1, len(model.langs)
    size = np.diff(offsets)
    parts = -(-size // SEGMENT)
    doc = np.repeat(np.arange(n), parts)
    if not len(doc) or not k:
        return np.zeros((n, k), np.int64)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
    at = offsets[doc] + nth * SEGMENT
    left = np.minimum(offsets[doc + 1] - at, SEGMENT)
    padded = np.concatenate([symbols, np.zeros(SEGMENT, np.uint8)])
    roots = np.repeat(model.roots, len(doc))
    state = roots
    count = np.zeros(k * len(doc), np.int32)
    flat, width = model.table.ravel(), model.width
    for step in range(int(left.max())):
        sym = np.where(step < left, padded[at + step], PAD)
        every = np.tile(sym, k)
        if len(model.rare):
            v = flat[state * np.int64(width) + np.where(every < width, every, UNKNOWN)]
            at_rare = np.flatnonzero(every >= width)
            # from the state, else from the root as a new phrase, else as a letter that is not in the sample
            for start, more in ((roots, 1 << COUNT), (state, 0)):
                key = start[at_rare] * np.int64(model.symbols) + every[at_rare]
                place = np.minimum(np.searchsorted(model.rare, key), len(model.rare) - 1)
                hit = model.rare[place] == key
                v[at_rare[hit]] = model.rare_to[place[hit]] + more
        else:
            v = flat[state * np.int64(width) + every]
        count += v >> COUNT
        state = v & ((1 << COUNT) - 1)
    open_ = state != roots
    ended = (count + open_).reshape(k, -1)
    return np.stack([np.bincount(doc, e, minlength=n) for e in ended], 1).astype(np.int64)


def predict(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and score of each text of an Arrow array."""
    data, offsets = W.utf8(texts)
    langs: list[str] = []
    scores: list[np.ndarray] = []
    for i, j in W.blocks(offsets, 1 << 20):
        strs = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[i:j].tolist(), offsets[i + 1 : j + 1].tolist(), strict=True)]
        off = np.concatenate([[0], np.cumsum([len(x) for x in strs])]).astype(np.int64)
        sym = model.symbol[np.frombuffer("".join(strs).encode("utf-32-le", "replace"), "<u4")]
        letters = np.concatenate([[0], np.cumsum(sym > GAP)])[off]
        known = np.diff(letters) > 0
        sym, off = squeeze(sym, off)
        if not model.langs:
            langs += [UND] * (j - i)
            scores.append(np.zeros(j - i))
            continue
        cost = phrases(model, sym, off) * model.bits
        best = cost.argmin(1)
        ranked = np.sort(cost, 1)
        second = ranked[:, 1] if cost.shape[1] > 1 else np.maximum(ranked[:, 0], np.diff(off) * model.bits[0])
        score = np.where(known, 1 - ranked[:, 0] / np.maximum(second, 1e-9), 0.0)
        langs += [model.langs[b] if ok else UND for b, ok in zip(best.tolist(), known.tolist(), strict=True)]
        scores.append(np.clip(score, 0, 1))
    return langs, np.concatenate(scores) if scores else np.zeros(0)


def held_out(key: Column) -> Column:
    """Documents never learned from: CRC-32 of the key as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    max_docs: int = 64,
    doc_chars: int = 1_000,
    max_chars: int = 24_000,
    total_chars: int = 400_000,
) -> Model:
    """Learns from a bounded sample of the documents that are not held out.

    Per language: the first ``doc_chars`` characters of the ``max_docs`` documents
    whose ids have the least hash, ``max_chars`` in all; over all languages at
    most ``total_chars``, so from 17 languages on each has less than ``max_chars``, and 1,000 at least.  Documents with a null id,
    language or text are skipped.
    """
    key = F.col(id_col)
    known = docs.where(key.isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(key))
    known = known.select(F.col(lang_col).alias("lang"), F.xxhash64(key).alias("h"), F.substring(text_col, 1, doc_chars).alias("text")).where(F.length(F.trim("text")) > 0)
    order = Window.partitionBy("lang").orderBy("h", "text")
    rows = known.withColumn("n", F.row_number().over(order)).where(F.col("n") <= max_docs).collect()
    texts: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["n"])):
        texts.setdefault(r["lang"], []).append(r["text"])
    share = max(1_000, min(max_chars, total_chars // max(1, len(texts))))
    return fit({k: " ".join(v)[:share] for k, v in texts.items()})


def identify(spark: SparkSession, docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, with ``lang_pred`` and ``score`` (0 to 1) of each whole text.

    Texts of any length are parsed whole.  A null text, and one without a letter, gets ``und`` and score 0; so does every
    text if nothing was learned.  The score is 1 - least / second least cost; at
    equal cost the first language in order wins.  Columns of ``docs`` that are named
    like a result column are replaced.  An empty table gives an empty result.
    """
    sent = spark.sparkContext.broadcast(model)
    own = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score")]
    at = [f.name for f in own].index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = predict(sent.value, batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "lang_pred", "score"])
        W.tidy()

    schema = T.StructType([*own, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select(*[F.col(f"`{f.name}`") for f in own]).mapInArrow(run, schema)
