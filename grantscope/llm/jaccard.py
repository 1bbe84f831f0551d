"""Exact Jaccard self-join on word shingles with a token-group matrix.

Documents of equal shingle sets are one class.  Classes that share a min-hash are
put into a family, and families are cut into groups of bounded size, so similar
classes share a group.  A token's row of the matrix lists the groups that hold it.
Two sets of Jaccard similarity t or more share SHARED tokens (or all the t n they
must share, if fewer) among the first n - ceil(t n) + SHARED of each, in any fixed
order of tokens; with frequent tokens last, few groups qualify.  A query class is
sent to each group whose row shares so many such tokens with it, its overlap with
the group's whole token union is counted there, and only if that reaches t n the
group is opened and its members are compared.

Within a group all members are compared by block products of its incidence matrix,
and only a spanning set of links is emitted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _words as W
from ._scratch import Scratch
from .components import components

HASHES = 4
HEAVY = 1 << 16
SHARED = 8
GROUP_MEMBERS, GROUP_TOKENS = 1024, 1 << 19
#: Queries of a group that one task opens, with a copy of its members; parts into which the rows of a frequent token are dealt.
GROUP_QUERIES, SALTS = 4096, 16
#: Prefix tokens are counted in 2 ** LOAD_BITS buckets; those of a bucket with over SALT_ROWS rows, and over four times the mean, are dealt out too.
LOAD_BITS, SALT_ROWS = 18, 4096
#: A token of more groups than this is asked about only by classes whose other tokens cannot do without it.
WIDE = 512
#: Bits of the filter of wanted sets, as a power of two: BLOOM_ROOM bits for each set, within these bounds.
BLOOM_BITS, BLOOM_ROOM = (24, 28), 16
_TOP = np.uint64(1 << 63)
ROW = ["token", "c8", "g", "n"]
_SEEDS = W.mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The sorted set of 64-bit shingle hashes of each text; A-Z count as lower case."""
    low = W.LOWER[data]
    starts, ends, first = W.spans(low, offsets)
    h = W.hashes(low, starts, ends)
    grams = W.ngrams(h, width)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        n = b - a
        if n >= width:
            x = np.sort(grams[a : b - width + 1])
            yield x[np.concatenate([[True], x[1:] != x[:-1]])]
        elif n:
            whole = np.full(1, W._K1)
            for v in h[a:b]:  # fewer than ``width`` words: one hash of the sequence
                whole = W.mix((whole ^ v) * W._K2 + np.uint64(n))
            yield whole
        else:
            yield np.zeros(0, np.uint64)


def _sets(batch: pa.RecordBatch, width: int):
    data, offsets = W.utf8(batch.column(1))
    for i, j in W.blocks(offsets):
        yield i, j, list(shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width))
    W.tidy()


def _frequent(width: int):
    """Tokens that several texts of a block share, with their number there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, sets in _sets(batch, width):
                token, n = np.unique(np.concatenate(sets), return_counts=True)
                many = n >= max(4, (j - i) // 500)
                yield pa.RecordBatch.from_arrays([pa.array(token[many].view(np.int64)), pa.array(n[many])], ["token", "n"])

    return run


class Order:
    """Tokens renamed to their place in the order: frequent ones last, by number."""

    def __init__(self, heavy: np.ndarray):
        self.by_hash = np.sort(heavy)
        self.place = np.argsort(heavy)

    def __call__(self, tokens: np.ndarray) -> np.ndarray:
        out = tokens & ~_TOP
        if len(self.by_hash):
            at = np.minimum(np.searchsorted(self.by_hash, tokens), len(self.by_hash) - 1)
            hit = self.by_hash[at] == tokens
            out[hit] = _TOP | self.place[at[hit]].astype(np.uint64)
        return np.sort(out)


def needed(n: int, num: int, den: int) -> int:
    """The least overlap that a set of ``n`` tokens has with a similar one: ceil(t n)."""
    return -(-n * num // den)


def cid_of(tokens: np.ndarray) -> bytes:
    return hashlib.md5(tokens.tobytes()).digest()


def _signed(order, width: int, num: int, den: int):
    """Class, size, min-hashes and prefix of each text; columns after the text are handed on."""
    names = ["id", "cid", "n", "mins", "prefix"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = order.value
        for batch in batches:
            for i, j, sets in _sets(batch, width):
                cid, mins, prefix = [], [], []
                for s in sets:
                    n = len(s)
                    if not n:
                        cid.append(None)
                        mins.append(None)
                        prefix.append(None)
                        continue
                    s = rank(s)
                    cid.append(cid_of(s))
                    prefix.append(s[: n - needed(n, num, den) + SHARED].tobytes())
                    light = int(np.searchsorted(s, _TOP))
                    part = s[:light] if 2 * light >= n else s
                    mins.append(np.array([W.mix(part ^ seed).min() for seed in _SEEDS]).view(np.int64).tolist())
                sizes = pa.array([len(s) for s in sets], pa.int64())
                own = [batch.column(0).slice(i, j - i), pa.array(cid, pa.binary()), sizes, pa.array(mins, pa.list_(pa.int64())), pa.array(prefix, pa.binary())]
                more = [batch.column(k).slice(i, j - i) for k in range(2, batch.num_columns)]
                yield pa.RecordBatch.from_arrays(own + more, names + batch.schema.names[2:])

    return run


def _bucket(token: np.ndarray) -> np.ndarray:
    return (W.mix(token.view(np.uint64)) >> np.uint64(64 - LOAD_BITS)).astype(np.int64)


def _loads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of prefix tokens in each bucket."""
    load = np.zeros(1 << LOAD_BITS, np.int64)
    for batch in batches:
        data, _ = W.utf8(batch.column(0))
        load += np.bincount(_bucket(np.frombuffer(data.tobytes(), np.int64)), minlength=len(load))
    at = np.flatnonzero(load)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(load[at])], ["bucket", "n"])


def _full(scratch: Scratch, classes: DataFrame) -> np.ndarray:
    """The buckets whose tokens are dealt out by a salt: any token of more rows than the limit is in one.

    Fewer than a quarter of the buckets are above four times the mean, so what comes to the driver is bounded.
    """
    loads = scratch.write(classes.select("prefix").mapInArrow(_loads, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")), "loads")
    limit = F.greatest(F.lit(SALT_ROWS).cast("double"), 4 * F.col("total") / (1 << LOAD_BITS))
    total = loads.agg(F.sum("n").alias("total")).first()[0] or 0
    full = np.zeros(1 << LOAD_BITS, bool)
    full[[r[0] for r in loads.withColumn("total", F.lit(total)).where(F.col("n") > limit).select("bucket").collect()]] = True
    return full


def _exploded(full):
    """A row per prefix token: token, short class id, group, set size, and a salt from 1 on for tokens of many rows, else 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealt = full.value
        for batch in batches:
            data, offsets = W.utf8(batch.column("prefix"))
            count = np.diff(offsets) // 8
            token = np.frombuffer(data.tobytes(), np.int64)
            cols = [pa.array(np.repeat(batch.column(k).to_numpy(), count)) for k in ("c8", "g", "n")]
            salt = np.where((token < 0) | dealt[_bucket(token)], 1 + (cols[0].to_numpy() & (SALTS - 1)), 0)
            yield pa.RecordBatch.from_arrays([pa.array(token), *cols, pa.array(salt)], [*ROW, "salt"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (token, salt, g), those whose token may be in several groups.

    Tokens whose rows are dealt out by their salt all pass.  A run of equal
    tokens that goes on in the next batch is held only while all its rows are of one
    group, whose size is bounded.
    """
    names = [*ROW, "salt"]
    held, mixed = None, None  # rows of a run not decided; the token of a run known to be mixed
    for batch in batches:
        rows = np.stack([batch.column(k).to_numpy() for k in names], 1) if batch.num_rows else np.zeros((0, len(names)), np.int64)
        if held is not None:
            rows = np.concatenate([held, rows])
        if not len(rows):
            continue
        token, g, salt = rows[:, 0], rows[:, 2], rows[:, 4]
        start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        end = np.concatenate([start[1:], [len(rows)]])
        many = (g[start] != g[end - 1]) | (salt[start] > 0)
        if mixed is not None:
            many |= token[start] == mixed
        last = len(start) - 1
        mixed = token[start[last]] if many[last] else None
        held = None if many[last] else rows[start[last] :]
        keep = np.repeat(many, end - start)
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[keep, k])) for k in range(len(names))], names)


def _salts() -> Column:
    """The salts under which a token's rows are dealt out."""
    return F.when(F.col("hot"), F.sequence(F.lit(1).cast("long"), F.lit(SALTS).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))


def _dealt(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Rows with the facts of their key; a key's rows are dealt out by salt, as one family may hold most of them."""
    salt = F.pmod(F.xxhash64("cid"), F.lit(SALTS))
    dealt = facts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return rows.withColumn("salt", salt.cast("long")).join(dealt.hint("merge"), [key, "salt"])


def _bloom(cids: list[bytes], ids: list[int | None], bits: int) -> np.ndarray:
    """Slots of (class, document) pairs in a filter of 2 ** ``bits`` bits."""
    short = np.array([int.from_bytes(x[:8], "little") for x in cids], np.uint64)
    key = np.array([0 if k is None else k for k in ids], np.int64).view(np.uint64)
    h = W.mix(short ^ W.mix(key * np.uint64(0xA0761D6478BD642F) + np.uint64(1)))
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _slots(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = _bloom(batch.column("cid").to_pylist(), batch.column("rep").to_pylist(), bits) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(slot >> 6), pa.array((np.uint64(1) << (slot & 63).astype(np.uint64)).view(np.int64))], ["word", "bits"])

    return run


def _wanted(order, bloom, size: int, width: int):
    """Whole token sets of the documents that the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, bits = order.value, bloom.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, _, sets in _sets(batch, width):
                at = [k for k, s in enumerate(sets) if len(s)]
                ranked = [rank(sets[k]) for k in at]
                cids = [cid_of(s) for s in ranked]
                own = [ids[i + k] for k in at]
                slot = _bloom(cids, own, size) if at else np.zeros(0, np.int64)
                hit = np.flatnonzero((bits[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1)).tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([own[k] for k in hit], pa.int64()), pa.array([cids[k] for k in hit], pa.binary()), pa.array([ranked[k].tobytes() for k in hit], pa.binary())],
                    ["id", "cid", "tokens"],
                )

    return run


def _product(left: list[np.ndarray], right: list[np.ndarray], n_cols: int, step: int = 4096) -> np.ndarray:
    """Sizes of all intersections of two lists of column sets, by blocks of columns."""
    out = np.zeros((len(left), len(right)), np.float32)
    same = left is right
    for a in range(0, n_cols, step):
        b = _block(right, a, step)
        out += (b if same else _block(left, a, step)) @ b.T
    return np.rint(out).astype(np.int64)


def _block(sets: list[np.ndarray], a: int, step: int) -> np.ndarray:
    m = np.zeros((len(sets), step), np.float32)
    for r, s in enumerate(sets):
        i, j = np.searchsorted(s, (a, a + step))
        m[r, s[i:j] - a] = 1
    return m


class Group:
    """The members of a group, its token union, and their links."""

    def __init__(self, cids: list[bytes], sets: list[np.ndarray], num: int, den: int):
        self.cids, self.num, self.den = cids, num, den
        self.size = np.array([len(s) for s in sets])
        self.union, inverse = np.unique(np.concatenate(sets), return_inverse=True)
        cut = np.cumsum(self.size)[:-1]
        self.cols = np.split(inverse.ravel(), cut)
        self.part = np.arange(len(sets))

    def similar(self, inter: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """inter / union >= num / den, in whole numbers."""
        return inter * (self.num + self.den) >= self.num * (sizes[:, None] + self.size[None, :])

    def own_links(self) -> list[tuple[bytes, bytes]]:
        """A spanning set of the links between members."""
        n = len(self.cids)
        if n < 2:
            return []
        times = np.bincount(np.concatenate(self.cols), minlength=len(self.union))
        new = np.cumsum(times > 1) - 1
        cols = [new[c[times[c] > 1]] for c in self.cols]
        linked = self.similar(_product(cols, cols, int((times > 1).sum())), self.size)
        out, seen = [], np.zeros(n, bool)
        for i in range(n):
            if seen[i]:
                continue
            front, seen[i] = [i], True
            while front:
                k = front.pop()
                for j in np.flatnonzero(linked[k] & ~seen).tolist():
                    seen[j] = True
                    self.part[j] = i
                    out.append((self.cids[i], self.cids[j]))
                    front.append(j)
        return out

    def query(self, cids: list[bytes], sets: list[np.ndarray]) -> list[tuple[bytes, bytes]]:
        """Opens the group for the queries whose overlap with its union is large enough."""
        chosen, cols = [], []
        for k, s in enumerate(sets):
            at = np.minimum(np.searchsorted(self.union, s), len(self.union) - 1)
            hit = at[self.union[at] == s]
            if len(hit) >= needed(len(s), self.num, self.den):
                chosen.append(k)
                cols.append(hit)
        if not chosen:
            return []
        used = np.unique(np.concatenate(cols))
        new = np.full(len(self.union), -1)
        new[used] = np.arange(len(used))
        mine = [x[x >= 0] for x in (new[c] for c in self.cols)]
        inter = _product([new[c] for c in cols], mine, len(used))
        linked = self.similar(inter, np.array([len(sets[k]) for k in chosen]))
        out = []
        for r, k in enumerate(chosen):
            at = np.flatnonzero(linked[r])
            for first in np.unique(self.part[at], return_index=True)[1]:  # one link to each part of the group
                out.append((cids[k], self.cids[at[first]]))
        return out


def _opened(num: int, den: int):
    """Links found in rows (g, part, role, cid, tokens) sorted by (g, part, role): members first, then queries.

    Each part of a group's queries comes with all its members; links among these are
    emitted by part 0 alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group, cids, sets, size = None, None, [], [], 0

        def flush() -> list[tuple[bytes, bytes]]:
            nonlocal group, cids, sets, size
            out = []
            if at[2] == 0:
                group = Group(cids, sets, num, den)
                own = group.own_links()
                out = own if at[1] == 0 else []
            elif group is not None:
                out = group.query(cids, sets)
            cids, sets, size = [], [], 0
            return out

        for batch in batches:
            links = []
            for g, part, r, c, t in zip(*(batch.column(k).to_pylist() for k in ("g", "part", "role", "cid", "tokens")), strict=True):
                if (g, part, r) != at:
                    if cids:
                        links += flush()
                    if at is None or (g, part) != at[:2]:
                        group = None
                    at = (g, part, r)
                elif r and (size > GROUP_TOKENS // 2 or len(cids) >= GROUP_MEMBERS):
                    links += flush()
                cids.append(c)
                sets.append(np.frombuffer(t, np.uint64))
                size += len(sets[-1])
            yield _edges(links)
        if cids:
            yield _edges(flush())
        group = None
        W.tidy()

    return run


def _edges(links: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.binary()) for k in (0, 1)], ["a", "b"])


def join_classes(
    spark: SparkSession,
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    similarity: tuple[int, int] = (80, 100),
    carry: Sequence[str] = (),
    label_col: str | None = None,
) -> DataFrame:
    """Size of each document's shingle set, and the least id that its links reach.

    Words are runs of characters other than ASCII white space, A-Z in lower case.
    The set holds the distinct windows of ``width`` words; a text of fewer words has
    one shingle, the whole sequence.  Documents link if intersection over union is
    at least ``similarity`` (a fraction in whole numbers).  Returns the id,
    ``n_shingles`` and ``component_id``; also the columns named by ``carry``, and under
    ``label_col``, if it is given, a binary label of the component that does not
    depend on ids (null where there is no shingle).

    A text of any length is read whole, and its set is held by one worker at a time.
    Null texts and texts without a word have no shingle, no link, and their own id.
    Ids are whole numbers; a null id is ignored as the least of its component unless
    all are null.  Equal rows are kept and are one class.  A similarity of exactly the
    fraction is a link.  Columns of other names, also those used here, are
    ignored; an empty table gives an empty result.  Shingles are compared by 63-bit
    hash, classes by MD5 of their hashes.
    """
    num, den = similarity
    scratch = Scratch(spark, "jaccard")
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *[F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(carry)])
    kinds = "".join(f", {f.name} {f.dataType.simpleString()}" for f in slim.schema[2:])
    often = slim.select("id", "text").mapInArrow(_frequent(width), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where("n >= 64")
    heavy = sorted((r[1], r[0]) for r in often.orderBy(F.desc("n"), "token").limit(HEAVY).collect())
    order = spark.sparkContext.broadcast(Order(np.array([t for _, t in heavy], np.int64).view(np.uint64)))

    signed = scratch.write(slim.mapInArrow(_signed(order, width, num, den), "id long, cid binary, n long, mins array<long>, prefix binary" + kinds), "signed")
    grouped = signed.where("cid is not null").groupBy("cid").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("mins").alias("mins"), F.first("prefix").alias("prefix"))
    classes = scratch.write(grouped, "classes")
    thin = scratch.write(signed.drop("mins", "prefix"), "thin")
    scratch.drop("signed")

    # families and their groups
    mins = classes.select("cid", F.posexplode("mins").alias("k", "m"))
    leaders = mins.groupBy("k", "m").agg(F.min("cid").alias("a"), F.count("*").alias("n")).where("n > 1")
    weak = mins.join(leaders.hint("merge"), ["k", "m"]).where(F.col("cid") != F.col("a")).select("a", F.col("cid").alias("b"))
    family = components(scratch, weak, "family", rounds=6)  # any partition gives the same links
    member = classes.select("cid", "rep", "n").join(family.hint("merge"), F.col("cid") == F.col("node"), "left").select("cid", "rep", "n", "label")
    bulk = member.where("label is not null").groupBy("label").agg(F.count("*").alias("members"), F.sum("n").alias("tokens"))
    parts = F.ceil(F.greatest(F.col("members") / GROUP_MEMBERS, F.col("tokens") / GROUP_TOKENS))
    grouped = _dealt(member.where("label is not null"), bulk.select("label", parts.alias("parts")), "label").select("cid", "rep", "n", F.xxhash64("label", F.pmod(F.xxhash64("cid"), F.col("parts"))).alias("g"))
    member = scratch.write(grouped.unionByName(member.where("label is null").select("cid", "rep", "n", F.xxhash64("cid").alias("g"))), "member")

    # the matrix: groups that share a prefix token, and who has to ask which group
    member = member.withColumn("c8", F.xxhash64("cid"))
    prefixes = classes.select("cid", "prefix").join(member.select("cid", "c8", "g", "n").hint("merge"), "cid").select("c8", "g", "n", "prefix")
    full = spark.sparkContext.broadcast(_full(scratch, classes))
    prefixes = scratch.write(prefixes, "prefixes")
    scratch.drop("classes")
    row = ", ".join(f"{c} long" for c in [*ROW, "salt"])
    tokens = prefixes.mapInArrow(_exploded(full), row)
    shared = tokens.repartition("token", "salt").sortWithinPartitions("token", "salt", "g").mapInArrow(_shared, row)
    shared = scratch.write(shared, "shared")
    scratch.drop("prefixes")
    # a class with fewer shared tokens in all than it must share with one group asks none
    enough = F.least(F.lit(SHARED), F.ceil(F.col("n") * num / den))
    asks = shared.groupBy("c8").agg(F.count("*").alias("tokens"), F.first("n").alias("n")).where(F.col("tokens") >= enough)
    shared = shared.join(asks.select("c8").hint("merge"), "c8", "left_semi")
    matrix = scratch.write(shared.groupBy("token", "g").agg(F.min("n").alias("least"), F.max("n").alias("most"), (F.max("salt") > 0).alias("hot")), "matrix")
    live = matrix.groupBy("token").agg(F.count("*").alias("groups"), F.bool_or("hot").alias("hot")).where("groups > 1").select("token", (F.col("groups") > WIDE).alias("wide"), F.explode(_salts()).alias("salt"))
    shared = scratch.write(shared.join(live.hint("merge"), ["token", "salt"]), "asking")
    # whoever shares ``enough`` tokens with a group shares all but its wide ones of them among the others
    wide = shared.groupBy("c8").agg(F.count_if("wide").alias("wides"))
    shared = shared.join(wide.hint("merge"), "c8").where(~F.col("wide") | (F.col("wides") >= enough)).withColumn("least_hits", F.when(F.col("wides") >= enough, enough).otherwise(enough - F.col("wides")))
    to = matrix.withColumnRenamed("g", "to").withColumn("salt", F.explode(_salts())).drop("hot")
    fits = (F.col("most") * den >= F.col("n") * num) & (F.col("least") * num <= F.col("n") * den)
    asked = shared.join(to.hint("merge"), ["token", "salt"]).where((F.col("g") < F.col("to")) & fits).groupBy("c8", "to").agg(F.count("*").alias("hits"), F.first("least_hits").alias("least_hits"))
    asked = scratch.write(asked.where(F.col("hits") >= F.col("least_hits")).select("c8", "to"), "asked")

    # whole sets of the classes concerned; a group with many queries is opened in several parts
    queries = asked.groupBy(F.col("to").alias("g")).agg(F.ceil(F.count("*") / GROUP_QUERIES).cast("int").alias("parts"))
    asking = _dealt(asked.join(member.select("c8", "cid", "rep").hint("merge"), "c8").withColumnRenamed("to", "g"), queries, "g")
    asking = asking.select("g", F.pmod(F.xxhash64("c8", F.lit(1)), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("role"), "cid", "rep")
    own = member.groupBy("g").agg(F.count("*").alias("n")).join(queries.hint("merge"), "g", "left").where("n > 1 or parts is not null")
    own = own.select("g", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    roles = scratch.write(member.join(own.hint("merge"), "g").select("g", "part", F.lit(0).alias("role"), "cid", "rep").union(asking), "roles")
    wanted = scratch.write(roles.select("cid", "rep").distinct(), "wanted")
    size = min(max((wanted.count() * BLOOM_ROOM).bit_length(), BLOOM_BITS[0]), BLOOM_BITS[1])
    words = wanted.mapInArrow(_slots(size), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # a row per word of a filter of bounded size
    bloom = np.zeros(1 << (size - 6), np.uint64)
    bloom[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    sets = slim.select("id", "text").mapInArrow(_wanted(order, spark.sparkContext.broadcast(bloom), size, width), "id long, cid binary, tokens binary")
    # the keys are the same columns for the grouping and the join, so whole sets are dealt out once
    key = lambda c: [F.coalesce(c, F.lit(0).cast("long")).alias("k"), F.isnull(c).alias("nul"), "cid"]
    sets = sets.select(*key("id"), "tokens").groupBy("k", "nul", "cid").agg(F.first("tokens").alias("tokens"))
    rows = roles.select("g", "part", "role", *key("rep")).join(sets.hint("merge"), ["k", "nul", "cid"])
    links = rows.repartition("g", "part").sortWithinPartitions("g", "part", "role").select("g", "part", "role", "cid", "tokens").mapInArrow(_opened(num, den), "a binary, b binary")
    links = scratch.write(links, "links")
    scratch.drop("shared", "matrix", "asking", "asked", "roles")

    joined = components(scratch, links, "join")
    reps = scratch.write(member.select("cid", "rep").join(joined.hint("merge"), F.col("cid") == F.col("node"), "left").select("cid", "rep", "label"), "reps")
    linked = reps.where("label is not null")
    found = _dealt(linked, linked.groupBy("label").agg(F.min("rep").alias("component_id")), "label").select("cid", "component_id", "label")
    found = found.unionByName(reps.where("label is null").select("cid", F.col("rep").alias("component_id"), F.col("cid").alias("label")))
    out = thin.join(found.hint("merge"), "cid", "left")
    component = F.when(F.col("cid").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id")
    more = [F.col(f"_{k}").alias(c) for k, c in enumerate(carry)] + ([F.col("label").alias(label_col)] if label_col else [])
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component, *more)
