"""Token ids as binary shards with Elias-Fano document boundaries.

A shard holds consecutive documents in ascending order of id.  Its file is

    header   11 little-endian int64: magic, version, bytes per id, documents, ids,
             documents with a null id (they come first), the least id; then low bits
             per entry and bytes of `high` of the ids, and of the boundaries
    keys     the other documents' ids, less the least one, as a sequence
    ends     the end offset of each document, as a sequence
    ids      all token ids, uint16 if the vocabulary allows it, else uint32

and a sequence is

    low      the low bits of each entry, packed
    high     the high parts in unary: bit (high part + i) is set for entry i
    hint     position of every 256th set bit of `high`, int64

An Elias-Fano sequence of n offsets up to u takes about n * (2 + log2(u / n))
bits, against 64 n for a table; select(i) finds the i-th set bit from the hint.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _words as W
from ._scratch import Scratch

MAGIC, VERSION, HINT = 0x45464944, 2, 256
#: A shard holds at most so many bytes of ids, or one document, and so many documents.
SHARD_BYTES, SHARD_DOCS = 32 << 20, 1 << 17
#: Units that each cache of an encoder keeps, and characters of a unit that it keeps: some 30 MB of words, 130 MB of the longest units.
CACHE_UNITS, CACHED_CHARS = 200_000, 64
#: Cuts found by quantiles of the ids, and parts of equal width into which each is dealt if more are needed.
MAX_CUTS, MAX_PARTS = 1 << 13, 16
MARKS = ".,;:!?"


class EliasFano:
    """A non-decreasing sequence of integers with select in near-constant time."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, hint: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.hint = n, low_bits, low, high, hint

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values).astype(np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        low = np.packbits(np.concatenate([cls._bits(values[i : i + 65_536], low_bits) for i in range(0, n, 65_536)] or [np.zeros(0, np.uint8)]), bitorder="little")
        at = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        flags[at] = 1
        return cls(n, low_bits, low, np.packbits(flags, bitorder="little"), at[::HINT].astype(np.int64))

    @staticmethod
    def _bits(values: np.ndarray, n: int) -> np.ndarray:
        return ((values[:, None] >> np.arange(n, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()

    def parts(self) -> list[bytes]:
        return [self.low.tobytes(), self.high.tobytes(), self.hint.astype("<i8").tobytes()]

    @classmethod
    def read(cls, raw: bytes | memoryview, at: int, n: int, low_bits: int, n_high: int) -> tuple[EliasFano, int]:
        """The sequence whose parts lie from ``at``, and where they end."""
        cuts = np.cumsum([at, (n * low_bits + 7) // 8, n_high, 8 * -(-n // HINT)]).tolist()
        low, high = (np.frombuffer(raw[a:b], np.uint8) for a, b in zip(cuts[:2], cuts[1:3], strict=True))
        return cls(n, low_bits, low, high, np.frombuffer(raw[cuts[2] : cuts[3]], "<i8")), cuts[3]

    def select(self, i: int) -> int:
        """The i-th value, from the hint before it and the words after that."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.hint[i // HINT]), i % HINT
        byte = at >> 3
        word = np.unpackbits(self.high[byte : byte + 64], bitorder="little")
        word[: at & 7] = 0
        while True:
            ones = np.flatnonzero(word)
            if left < len(ones):
                break
            left -= len(ones)
            byte += 64
            word = np.unpackbits(self.high[byte : byte + 64], bitorder="little")
        high = byte * 8 + int(ones[left]) - i
        return (high << self.low_bits) | int(self._low(np.array([i]))[0])

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        bit = i[:, None].astype(np.int64) * self.low_bits + np.arange(self.low_bits)
        return (((self.low[bit >> 3] >> (bit & 7)) & 1).astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(1, dtype=np.uint64)

    def all(self) -> np.ndarray:
        """Every value, by one pass over the set bits."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        i = np.arange(self.n)
        low = np.concatenate([self._low(i[k : k + 65_536]) for k in range(0, self.n, 65_536)] or [np.zeros(0, np.uint64)])
        return ((ones - i).astype(np.uint64) << np.uint64(self.low_bits)) | low


def pack(keys: list[int | None], ids: list[bytes], width: int) -> bytes:
    """The bytes of one shard: keys in ascending order, nulls first; ``ids`` holds each document's ids, ``width`` bytes each."""
    ends = np.cumsum([len(x) // width for x in ids], dtype=np.int64) if ids else np.zeros(0, np.int64)
    nulls = sum(k is None for k in keys)
    base = keys[nulls] if nulls < len(keys) else 0
    own, ef = EliasFano.of(np.array([k - base for k in keys[nulls:]], np.uint64)), EliasFano.of(ends)
    head = np.array([MAGIC, VERSION, width, len(keys), ends[-1] if len(ends) else 0, nulls, base, own.low_bits, len(own.high), ef.low_bits, len(ef.high)], "<i8")
    return b"".join([head.tobytes(), *own.parts(), *ef.parts(), *ids])


class Shard:
    """Random access to the documents of a packed shard."""

    def __init__(self, raw: bytes | memoryview):
        head = np.frombuffer(raw, "<i8", 11)
        if head[0] != MAGIC or head[1] != VERSION:
            raise ValueError("not a shard of this format")
        self.width, self.n, self.n_ids, self.nulls, self.base, *sizes = (int(x) for x in head[2:])
        self.own, at = EliasFano.read(raw, head.nbytes, self.n - self.nulls, *sizes[:2])
        self.ends, at = EliasFano.read(raw, at, self.n, *sizes[2:])
        self.ids = np.frombuffer(raw[at : at + self.n_ids * self.width], f"<u{self.width}")

    @property
    def keys(self) -> np.ndarray:
        """Document ids; 0 where null."""
        found = self.own.all() + np.array(self.base).astype(np.int64).view(np.uint64)
        return np.concatenate([np.zeros(self.nulls, np.int64), found.view(np.int64)])

    def bounds(self, i: int) -> tuple[int, int]:
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def document(self, i: int) -> np.ndarray:
        start, end = self.bounds(i)
        return self.ids[start:end]


class Encoder:
    """Ids of whole texts, equal to the tokenizer's, with a bounded cache of units.

    A byte-level BPE tokenizer cuts texts into pieces before it merges, and a
    piece never crosses a single space between two characters that are not white
    space, nor one or two line feeds before such a character.  A text is therefore cut there into units, a unit not seen yet into
    pieces, and the library's model merges each piece not seen yet.  Texts that
    hold an added token's string, and texts for tokenizers of any other kind, go
    through the library whole.
    """

    def __init__(self, path: str, end_id: int | None):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok = Tokenizer.from_file(path)
        self.width = 2 if self.tok.get_vocab_size() <= 1 << 16 else 4
        self.end = np.array([] if end_id is None else [end_id], f"<u{self.width}").tobytes()
        kind = json.loads(self.tok.to_str())
        pre = kind.get("pre_tokenizer") or {}
        added = [t["content"] for t in kind.get("added_tokens", [])]
        self.cuts = (
            kind.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space", True)
            and pre.get("use_regex", True) and not any(" " in t for t in added)
            and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in kind.get("added_tokens", []))
        )
        self.added = set(added)
        hidden = [b for b in range(256) if b not in set(SHOWN)]
        self.visible = {b: 256 + k for k, b in enumerate(hidden)}
        self.space = chr(self.visible[32])
        self.model = self.tok.model
        self.coded = [i.to_bytes(self.width, "little") for i in range(self.tok.get_vocab_size())]
        self.pieces = Cache(lambda _, piece: self._piece(piece))
        self.marks = {x: self._piece(x) for x in MARKS} if self.cuts else {}
        self.feed = self._piece("\n") if self.cuts else b""
        self.whole, self.spaced = Cache(self._unit("")), Cache(self._unit(" "))

    def _unit(self, before: str) -> Callable[[Cache, str], bytes]:
        """How to find the ids of a unit with ``before`` in front; letters, and letters before one mark, need no search for pieces."""
        marks, letters, pieces = self.marks, self._letters, self.pieces

        def found(own: Cache, unit: str) -> bytes:
            if unit.isalpha():
                return letters(unit, before)
            if unit[-1] in marks and unit[:-1].isalpha():
                return own[unit[:-1]] + marks[unit[-1]]
            return b"".join(map(pieces.__getitem__, PIECES.findall(before + unit)))

        return found

    def _raw(self, texts: list[str]) -> list[bytes]:
        kind = f"<u{self.width}"
        return [np.array(e.ids, kind).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def units(text: str) -> list[str]:
        """Consecutive parts of the text, cut before single inner spaces."""
        found: list[str] = []
        solid = False
        for k, part in enumerate(text.split(" ")):
            piece = " " + part if k else part
            if found and not (solid and part and not part[0].isspace()):
                found[-1] += piece
            elif piece:
                found.append(piece)
            solid = bool(part) and not part[-1].isspace()
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text, with the end id."""
        if not self.cuts:
            return [x + self.end for x in self._raw(texts)]
        return [self._encode(t) + self.end for t in texts]

    def _encode(self, text: str) -> bytes:
        if not text:
            return b""
        if any(t in text for t in self.added):
            return self._raw([text])[0]
        if not plain(text):
            return b"".join(map(self.whole.__getitem__, self.units(text)))
        return self.feed.join(map(self._line, text.split("\n")))

    def _line(self, line: str) -> bytes:
        if not line:
            return b""
        head, _, rest = line.partition(" ")
        return self.whole[head] + b"".join(map(self.spaced.__getitem__, rest.split(" "))) if rest else self.whole[head]

    def _letters(self, unit: str, before: str) -> bytes:
        if unit.isascii():
            seen = self.space + unit if before else unit
        else:
            seen = (before + unit).encode().decode("latin-1").translate(self.visible)
        return b"".join([self.coded[t.id] for t in self.model.tokenize(seen)])

    def _piece(self, piece: str) -> bytes:
        return b"".join([self.coded[t.id] for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.visible))])

    def forget(self) -> None:
        """Empties the caches but that of what follows a space."""
        self.whole.clear()
        self.pieces.clear()


class Cache(dict):
    """Ids by unit, found when a unit is first asked for; short units are kept, the newer half goes when there are too many."""

    def __init__(self, found: Callable[[Cache, str], bytes]):
        self.found = found

    def __missing__(self, unit: str) -> bytes:
        ids = self.found(self, unit)
        if len(unit) <= CACHED_CHARS:
            if len(self) >= CACHE_UNITS:  # what is frequent came early
                kept = list(islice(self.items(), CACHE_UNITS // 2))
                self.clear()
                self.update(kept)
            self[unit] = ids
        return ids


#: Fixed values of byte-level BPE: how it cuts texts, and the characters that stand for its bytes.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]


def plain(text: str) -> bool:
    """Every space stands alone between two characters that are not white space, and line feeds are pieces of their own."""
    return not ("\n\n\n" in text or text.endswith("\n\n") or "  " in text or " \n" in text or "\n " in text or text[0] == " " or text[-1] == " " or any(c in text for c in ODD))


#: White space other than a space and a line feed.
ODD = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, end_id: int | None) -> Encoder:
    """One encoder per Python worker, so that tasks share its cache."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]


def _encode(path: str, end_id: int | None, bounds: np.ndarray, chunk: int = 256):
    """Ids of each text, and the number of the cut that its key falls into (a null key: the first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, end_id)
        for batch in batches:
            for i in range(0, batch.num_rows, chunk):
                part = batch.slice(i, chunk)
                ids = enc.encode([t or "" for t in part.column(1).to_pylist()])
                keys = part.column(0).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
                cut = pa.array(np.searchsorted(bounds, keys, "left").astype(np.int64))
                yield pa.RecordBatch.from_arrays([cut, part.column(0), pa.array(ids, pa.binary())], ["cut", "key", "ids"])
        enc.forget()
        W.tidy()

    return run


def finer(bounds: list[int], parts: int) -> list[int]:
    """The bounds with each range between two of them cut into ``parts`` of equal width."""
    inner = (a + (b - a) * i // parts for a, b in zip(bounds, bounds[1:], strict=False) for i in range(1, parts))
    return sorted({*bounds, *inner})


def _put(uri: str, raw: list[bytes]) -> None:
    """Writes a file whole or not at all: a retry or a rival attempt replaces it by the same bytes."""
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    temp = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(temp) as out:
        for x in raw:
            out.write(x)
    fs.move(temp, path)


def _write(root: str, width: int, limit: int, most: int):
    """Writes runs of rows sorted by (cut, key) as shards of at most ``limit`` bytes of ids, or one document, and ``most`` documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list = []
        ids: list[bytes] = []
        cut, part, held = None, 0, 0

        def flush():
            name = f"{root}/cut-{cut:08d}-{part:05d}.bin"
            _put(name, [pack(keys, ids, width)])
            row = [[cut], [part], [name], [len(keys)], [sum(len(x) for x in ids) // width]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()], strict=True)], ["cut", "part", "file", "n_docs", "n_ids"])

        for batch in batches:
            for c, k, x in zip(*(batch.column(n).to_pylist() for n in ("cut", "key", "ids")), strict=True):
                if keys and (c != cut or held + len(x) > limit or len(keys) >= most):
                    yield flush()
                    part = part + 1 if c == cut else 0
                    keys, ids, held = [], [], 0
                cut = c
                keys.append(k)
                ids.append(x)
                held += len(x)
        if keys:
            yield flush()

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each shard file, decoded from the file alone."""
    for batch in batches:
        for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            fs, path = pafs.FileSystem.from_uri(uri)
            with fs.open_input_stream(path) as f:
                shard = Shard(f.read())
            ends = shard.ends.all().astype(np.int64)
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if shard.n else ends
            crc = [zlib.crc32(shard.ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            keys = pa.array(shard.keys, pa.int64(), mask=np.arange(shard.n) < shard.nulls)
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(starts + base), pa.array(ends - starts), pa.array(crc, pa.int64())], ["key", "start", "n_tokens", "ids_crc32"]
            )


def write_tokens(
    spark: SparkSession,
    docs: DataFrame,
    root: str,
    *,
    tokenizer_path: str,
    end_id: int | None = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Encodes ``docs`` into shard files below ``root``, a folder all executors share.

    Documents are in ascending order of the integer id over all shards, null ids
    first, rows of equal id by their ids' bytes.  Null texts are empty and hold
    only the end id.  An empty table writes no shard.  Other columns are ignored.

    Returns a row per shard: ``file``, ``n_docs``, ``n_ids`` and ``base``, the
    number of ids in earlier shards.  Cuts between shards come from quantiles of
    the ids (at most ``MAX_CUTS``, each in up to ``MAX_PARTS`` parts); a task writes its cut
    as shards of at most ``shard_bytes``, or one document, and ``SHARD_DOCS`` documents,
    one shard at a time.  A text of any length is one document, encoded whole; columns of
    other names, also those used here, do no harm.
    """
    scratch = Scratch(spark, "tokens")
    enc = Encoder(tokenizer_path, end_id)
    slim = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text"))
    stats = docs.select(F.col(id_col).cast("long").alias("key"), F.octet_length(text_col).alias("n"))
    n_bytes = stats.agg(F.sum("n")).first()[0] or 0
    wanted = max(1, int(n_bytes * 0.6) // shard_bytes + 1)
    cuts = min(MAX_CUTS, wanted)
    bounds: list[int] = []
    if cuts > 1:
        found = stats.agg(F.percentile_approx("key", [i / cuts for i in range(1, cuts)], min(20 * cuts, 100_000))).first()[0]
        bounds = finer(sorted(set(found or [])), min(MAX_PARTS, -(-wanted // cuts)))
    ids = slim.mapInArrow(_encode(tokenizer_path, end_id, np.array(bounds, np.int64)), "cut long, key long, ids binary")
    dealt = ids.repartitionById(len(bounds) + 1, F.col("cut").cast("int")).sortWithinPartitions("cut", "key", "ids")
    shards = dealt.select("cut", "key", "ids").mapInArrow(_write(root, enc.width, shard_bytes, SHARD_DOCS), "cut long, part long, file string, n_docs long, n_ids long")
    shards = scratch.write(shards, "shards")
    before = Window.orderBy("cut", "part").rowsBetween(Window.unboundedPreceding, -1)
    return shards.select("file", "n_docs", "n_ids", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))


def read_tokens(spark: SparkSession, shards: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document of the shard files: id, ``start``, ``n_tokens`` and ``ids_crc32``.

    ``ids_crc32`` is the CRC-32 of the ids as little-endian 32-bit integers.
    Every file is read by one task; each task reads one file at a time.
    """
    n = spark.sparkContext.defaultParallelism * 4
    out = shards.select("file", "base").repartition(n, "file").mapInArrow(_read, "key long, start long, n_tokens long, ids_crc32 long")
    return out.withColumnRenamed("key", id_col)
