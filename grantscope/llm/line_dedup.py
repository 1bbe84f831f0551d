"""Removal of repeated multi-line chunks with content-defined boundaries.

Each text is split into lines.  A rolling hash over the hashes of a few
consecutive lines cuts the text after a line where the hash meets a mask, so an
insertion moves boundaries only near itself and a shared passage is cut alike in
every text.  Chunks of two lines or more that are equal, byte by byte, to a chunk
that occurs earlier in the corpus are removed.  All of it is DataFrame functions.

Chunks alone (:func:`dedup_lines`) miss the lines of a repeated passage that fall outside a
common chunk; :func:`dedup_chunks` takes them as seeds and extends them by equal neighbouring lines.  :func:`dedup_passages` has no boundaries: it compares every two neighbouring lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._scratch import Scratch

WINDOW, MASK = 2, 1
MIN_LINES = 2
#: A pair of lines with more copies than this is compared in so many parts.
HOT, SALTS = 1000, 16
#: So many lines on either side of a repeated chunk are compared at most.
REACH = 8
#: A line of its own between two chunks; lines that begin with its character get another one in front.
NUL = "\x00"


def _marked(text: Column, window: int, mask: int) -> Column:
    """The escaped text with a line of its own, NUL, between two chunks."""
    escaped = F.when(F.contains(text, F.lit(NUL)), F.regexp_replace(text, "(?m)^\\x00", "\x00\x00")).otherwise(text)
    lines = F.split(escaped, "\n")
    rolled = hashed = F.transform(lines, lambda x: F.xxhash64(x))
    for k in range(1, window):
        rolled = F.zip_with(rolled, F.slice(hashed, k + 1, F.size(hashed)), lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b)))
    # the hash of the window that ends at a line; none at the last line, which ends the text
    upto = F.concat(F.array_repeat(F.lit(None).cast("long"), window - 1), F.slice(rolled, 1, F.greatest(F.size(rolled) - window, F.lit(0))))
    marked = F.zip_with(lines, upto, lambda x, h: F.when(h.bitwiseAND(F.lit(mask)) == 0, F.concat(x, F.lit("\n" + NUL))).otherwise(x))
    return F.array_join(marked, "\n")


def chunks(text: Column, window: int = WINDOW, mask: int = MASK) -> Column:
    """Consecutive chunks of a text, as an array of strings that join by ``\n`` to it.

    A boundary follows line i where the hash of lines i - window + 1 .. i is 0 in
    the bits of ``mask``; the first window - 1 lines of a text end no chunk.  Chunks
    are in escaped form (see :func:`plain`).  Every step is linear in the text.
    """
    return F.split(_marked(text, window, mask), "\n\x00\n")


def starts(text: Column, window: int = WINDOW, mask: int = MASK) -> Column:
    """The number of the first line of each of the :func:`chunks`, from 0."""
    marks = F.transform(F.split(_marked(text, window, mask), "\n"), lambda x, i: F.when(x == NUL, i))
    return F.concat(F.array(F.lit(0)), F.transform(F.filter(marks, lambda i: i.isNotNull()), lambda i, k: i - k))


def plain(text: Column) -> Column:
    """Undoes the escape of lines that begin with NUL."""
    return F.when(F.contains(text, F.lit(NUL)), F.regexp_replace(text, "(?m)^\\x00", "")).otherwise(text)


def lines_in(chunk: Column) -> Column:
    return F.length(chunk) - F.length(F.replace(chunk, F.lit("\n"), F.lit(""))) + 1


def dedup_lines(
    spark: SparkSession,
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    mask: int = MASK,
    min_lines: int = MIN_LINES,
) -> DataFrame:
    """Texts without the multi-line chunks that occur earlier in the corpus.

    The earlier of two equal chunks is the one in the row of lesser id (null last),
    then of lesser text hash, then nearer the start.  A chunk counts if it has
    ``min_lines`` lines, one of them with more than white space.  Chunks are found by
    hash and length, and removed only if equal byte by byte to the one that stays.

    Returns the id, ``text`` (remaining chunks joined by ``\\n``) and ``n_removed``,
    the number of chunks removed.  Null and empty texts stay as they are.  Of fully equal rows each keeps what the
    first keeps, as they are one occurrence; other columns are ignored; an empty table
    gives an empty result.
    """
    # joins are sort-merge joins at every size: the plan, and what it moves, then grow alike
    scratch = Scratch(spark, "lines")
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("th"))
    cut = slim.withColumn("chunks", chunks(F.col("text"), window, mask))
    counted = lambda c: (lines_in(c) >= min_lines) & F.rlike(c, F.lit(r"\S"))
    keys = F.transform(F.col("chunks"), lambda c, i: F.struct(F.when(counted(c), F.xxhash64(c)).alias("h"), F.length(c).alias("n"), i.alias("pos")))
    key = ["h", "n"]
    every = cut.select("id", "th", F.explode(F.filter(keys, lambda k: k["h"].isNotNull())).alias("k")).select("id", "th", "k.*")
    first = F.min(F.struct(F.col("id").isNull().alias("nul"), "id", "th", "pos")).alias("first")
    repeated = scratch.write(every.groupBy(*key).agg(F.count("*").alias("times"), first).where("times > 1"), "repeated")
    # texts of the chunks that stay, and of their later copies; both sides only of repeated chunks
    where = F.filter(F.transform(F.col("chunks"), lambda c, i: F.struct(F.when(counted(c), F.xxhash64(c)).alias("h"), F.length(c).alias("n"), i.alias("pos"), c.alias("chunk"))), lambda k: k["h"].isNotNull())
    copies = cut.select("id", "th", F.explode(where).alias("k")).select("id", "th", "k.*").join(repeated.hint("merge"), key)
    stays = (F.col("id").eqNullSafe(F.col("first.id"))) & (F.col("th") == F.col("first.th")) & (F.col("pos") == F.col("first.pos"))
    copies = scratch.write(copies.select("id", "th", *key, "pos", "chunk", stays.alias("stays")), "copies")
    kept = copies.where("stays").groupBy(*key).agg(F.min("chunk").alias("kept"))
    gone = copies.where(~F.col("stays")).join(kept.hint("merge"), key).where(F.col("chunk") == F.col("kept"))
    gone = gone.groupBy("id", "th").agg(F.collect_set("pos").alias("gone"))
    gone = scratch.write(gone, "gone")
    gone = gone.select(F.col("id").alias("gid"), F.col("th").alias("gth"), "gone")
    left = slim.join(gone.hint("merge"), F.col("id").eqNullSafe(F.col("gid")) & F.col("th").eqNullSafe(F.col("gth")), "left")
    drop = F.coalesce("gone", F.array().cast("array<int>"))
    rest = F.filter(chunks(F.col("text"), window, mask), lambda c, i: ~F.array_contains(drop, i))
    return left.select(
        F.col("id").alias(id_col),
        F.when(F.size(drop) == 0, F.col("text")).otherwise(plain(F.array_join(rest, "\n"))).alias("text"),
        F.size(drop).cast("long").alias("n_removed"),
    )


def aligned(at: Column, values: Column, kind: str) -> Column:
    """An array with ``values`` at the ascending places ``at``, from 0, and null between them."""
    gaps = F.zip_with(at, F.concat(F.array(F.lit(-1)), F.slice(at, 1, F.size(at) - 1)), lambda a, b: a - b - 1)
    return F.flatten(F.zip_with(gaps, values, lambda g, v: F.concat(F.array_repeat(F.lit(None).cast(kind), g), F.array(v))))


def dedup_passages(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts without the passages of two lines or more that occur earlier in the corpus.

    A passage is repeated where each two neighbouring lines of it are, so every pair of
    neighbours is looked up; a pair counts if one of its lines has more than white
    space.  The earlier of two equal pairs is the one in the row of lesser id (null
    last), then of lesser text hash, then nearer the start.  The lines of all later
    ones are removed, but for one that overlaps the first itself.  The first occurrence
    of a line always stays.  Pairs are found by hash and size, and removed only if equal
    byte by byte to the one that stays.

    Returns the id, ``text`` (remaining lines joined by ``\n``) and ``n_removed``, the
    number of runs of removed lines.  Null and one-line texts stay as they are; texts of any
    length are compared whole, their lines being rows.  Of fully
    equal rows each keeps what the first keeps, as they are one occurrence; other
    columns are ignored; an empty table gives an empty result.
    """
    # joins are sort-merge joins at every size: the plan, and what it moves, then grow alike
    scratch = Scratch(spark, "passages")
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("th"))
    lines, key = F.split("text", "\n"), ["h", "n"]
    each = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), F.octet_length(x).alias("n"), F.rlike(x, F.lit(r"\S")).alias("full")))
    cut = slim.where(F.contains("text", F.lit("\n"))).select("id", "th", each.alias("each"))
    pairs = F.zip_with("each", F.slice("each", 2, F.size("each")), lambda a, b: F.when(a["full"] | b["full"], F.struct(F.xxhash64(a["h"], b["h"]).alias("h"), (a["n"] + b["n"]).alias("n"))))
    every = cut.select("id", "th", F.posexplode(pairs).alias("pos", "k")).where("k is not null").select("id", "th", "pos", "k.*")
    every = scratch.write(every, "pairs")
    first = F.min(F.struct(F.col("id").isNull().alias("nul"), "id", "th", "pos")).alias("first")
    repeated = every.groupBy(*key).agg(F.count("*").alias("times"), first).where("times > 1")
    found = every.join(repeated.select(*key, "first", (F.col("times") > HOT).alias("hot")).hint("merge"), key)
    same = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("th") == F.col("first.th"))
    found = found.where(~(same & (F.col("pos") == F.col("first.pos") + 1))).select("id", "th", "pos", *key, "hot", (same & (F.col("pos") == F.col("first.pos"))).alias("stays"))
    found = found.groupBy(F.col("id").alias("gid"), F.col("th").alias("gth")).agg(F.sort_array(F.collect_set(F.struct("pos", *key, "hot", "stays"))).alias("found"))
    # texts of the pairs that stay, and of their later copies
    on = F.col("id").eqNullSafe(F.col("gid")) & (F.col("th") == F.col("gth"))
    kind = "struct<pos:int,h:bigint,n:int,hot:boolean,stays:boolean>"
    held = slim.join(found.hint("merge"), on).select("id", "th", lines.alias("lines"), aligned(F.col("found.pos"), F.col("found"), kind).alias("found"))
    both = F.zip_with("lines", F.slice("lines", 2, F.size("lines")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    both = F.filter(F.zip_with(both, "found", lambda x, k: F.when(k.isNotNull(), F.struct(k.alias("k"), F.concat(x["a"], F.lit("\n"), x["b"]).alias("pair")))), lambda x: x.isNotNull())
    copies = scratch.write(held.select("id", "th", F.explode(both).alias("x")).select("id", "th", "x.k.*", "x.pair"), "copies")
    # copies of a pair that very many texts hold are dealt out, each part with the pair that stays
    salts = F.when(F.col("hot"), F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    kept = copies.where("stays").groupBy(*key).agg(F.min("pair").alias("kept"), F.first("hot").alias("hot")).select(*key, "kept", F.explode(salts).alias("salt"))
    own = F.when(F.col("hot"), F.pmod(F.xxhash64("id", "th", "pos"), F.lit(SALTS))).otherwise(0).cast("long")
    gone = copies.where("not stays").withColumn("salt", own).join(kept.hint("merge"), [*key, "salt"]).where(F.col("pair") == F.col("kept"))
    gone = gone.groupBy(F.col("id").alias("gid"), F.col("th").alias("gth")).agg(F.collect_set("pos").alias("at"))
    gone = scratch.write(gone.select("gid", "gth", F.sort_array(F.array_union("at", F.transform("at", lambda p: p + 1))).alias("gone")), "gone")
    left = slim.join(gone.hint("merge"), on, "left")
    flags = aligned(F.col("gone"), F.transform("gone", lambda p: F.lit(True)), "boolean")
    rest = F.array_join(F.zip_with(lines, flags, lambda x, f: F.when(f.isNull(), x)), "\n")
    before = F.concat(F.array(F.lit(-2)), F.slice("gone", 1, F.size("gone") - 1))
    runs = F.size(F.filter(F.zip_with("gone", before, lambda a, b: a - b > 1), lambda x: x))
    return left.select(
        F.col("id").alias(id_col),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(rest).alias("text"),
        F.when(F.col("gone").isNull(), 0).otherwise(runs).cast("long").alias("n_removed"),
    )



def dedup_chunks(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, mask: int = MASK, reach: int = REACH) -> DataFrame:
    """Texts without the multi-line :func:`chunks` that occur earlier in the corpus, and the equal lines around them.

    A chunk of two lines or more, one of them with more than white space, that is equal
    byte by byte to one earlier is removed; so are up to ``reach`` lines on either side
    of a row of such chunks, as far as they equal the lines in the same place beside the earlier
    ones.  Each line that goes has an equal one earlier, so a line's first occurrence always
    stays.  The earlier of two equal chunks is as in :func:`dedup_lines`.

    Returns the id, ``text`` (remaining lines joined by ``\n``) and ``n_removed``, the
    number of runs of removed lines.  Null, empty and one-line texts stay as they are; texts
    of any length are read whole.  Of fully equal rows each keeps what the first keeps,
    as they are one occurrence; other columns are ignored; an empty table gives an empty result.
    """
    # joins are sort-merge joins at every size: the plan, and what it moves, then grow alike
    scratch = Scratch(spark, "chunks")
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("th"))
    key, doc, lines = ["h", "n"], ["id", "th"], F.split("text", "\n")
    each = F.zip_with(chunks(F.col("text"), window, mask), starts(F.col("text"), window, mask), lambda c, a: F.struct(c.alias("chunk"), a.alias("at")))
    cut = slim.where(F.contains("text", F.lit("\n"))).select(*doc, F.explode(each).alias("x")).select(*doc, "x.*").withColumn("size", lines_in(F.col("chunk")))
    cut = cut.where((F.col("size") >= MIN_LINES) & F.rlike("chunk", F.lit(r"\S"))).select(*doc, "at", "size", F.xxhash64("chunk").alias("h"), F.length("chunk").alias("n"), "chunk")
    first = F.min(F.struct(F.col("id").isNull().alias("nul"), "id", "th", "at")).alias("first")
    repeated = cut.groupBy(*key).agg(F.count("*").alias("times"), first).where("times > 1")
    repeated = scratch.write(repeated.select(*key, (F.col("times") > HOT).alias("hot"), F.col("first.id").alias("fid"), F.col("first.th").alias("fth"), F.col("first.at").alias("fat")), "repeated")
    stays = F.col("id").eqNullSafe(F.col("fid")) & (F.col("th") == F.col("fth")) & (F.col("at") == F.col("fat"))
    copies = scratch.write(cut.join(repeated.hint("merge"), key).withColumn("stays", stays), "copies")

    # copies of what very many texts hold are dealt out, each part with the one that stays
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    own = F.when(F.col("hot"), F.pmod(F.xxhash64(*doc, "at"), F.lit(SALTS))).otherwise(0).cast("int")
    kept = copies.where("stays").groupBy(*key).agg(F.min("chunk").alias("kept"), F.first("hot").alias("hot")).select(*key, "kept", F.explode(salts).alias("salt"))
    gone = copies.where("not stays").withColumn("salt", own).join(kept.hint("merge"), [*key, "salt"]).where(F.col("chunk") == F.col("kept"))
    gone = scratch.write(gone.select(*doc, "at", "size", "fid", "fth", "fat", "hot").distinct(), "seeds")

    # ends of rows of chunks whose earlier ones are a row too; step k of an end compares the k-th lines beyond it
    order = Window.partitionBy(*doc).orderBy("at")
    shape = F.struct("fid", "fth", (F.col("at") - F.col("fat")).alias("shift"), "at", (F.col("at") + F.col("size")).alias("end"))
    rows = gone.withColumn("before", F.lag(shape).over(order)).withColumn("after", F.lead(shape).over(order))
    joins = lambda other, here, there: F.coalesce(F.col(f"{other}.fid").eqNullSafe(F.col("fid")) & (F.col(f"{other}.fth") == F.col("fth")) & (F.col(f"{other}.shift") == F.col("at") - F.col("fat")) & (here == there), F.lit(False))
    end = F.col("at") + F.col("size")
    to = lambda line, way: F.struct(line.alias("line"), F.lit(way).alias("way"))
    ends = F.array(F.when(~joins("before", F.col("before.end"), F.col("at")), to(F.col("at"), -1)), F.when(~joins("after", F.col("after.at"), end), to(end - 1, 1)))
    rows = rows.select(*doc, "fid", "fth", (F.col("at") - F.col("fat")).alias("shift"), "hot", F.explode(F.filter(ends, lambda x: x.isNotNull())).alias("x"))
    steps = rows.select(*doc, "fid", "fth", "shift", "hot", F.col("x.line").alias("edge"), F.col("x.way").alias("way"), F.explode(F.sequence(F.lit(1), F.lit(reach))).alias("k"))
    steps = steps.withColumn("line", F.col("edge") + F.col("way") * F.col("k")).withColumn("fline", F.col("line") - F.col("shift")).where("line >= 0 and fline >= 0")
    steps = scratch.write(steps, "steps")

    # the texts of all these lines, once each
    there = steps.select(F.col("fid").alias("id"), F.col("fth").alias("th"), F.col("fline").alias("line"))
    asked = steps.select(*doc, "line").unionByName(there).groupBy(F.col("id").alias("gid"), F.col("th").alias("gth")).agg(F.sort_array(F.collect_set("line")).alias("asked"))
    on = F.col("id").eqNullSafe(F.col("gid")) & (F.col("th") == F.col("gth"))
    flags = aligned(F.col("asked"), F.transform("asked", lambda p: F.lit(True)), "boolean")
    shown = F.zip_with(lines, F.slice(flags, 1, F.size(lines)), lambda x, f: F.when(f, x))
    held = slim.join(asked.hint("merge"), on).select("gid", "gth", F.posexplode(shown).alias("gline", "text")).where("text is not null").dropDuplicates(["gid", "gth", "gline"])
    held = scratch.write(held, "lines")
    mine = steps.join(held.withColumnRenamed("text", "mine").hint("merge"), on & (F.col("line") == F.col("gline"))).drop("gid", "gth", "gline")
    firsts = steps.groupBy("fid", "fth", "fline").agg(F.bool_or("hot").alias("hot"))
    theirs = firsts.join(held.hint("merge"), F.col("fid").eqNullSafe(F.col("gid")) & (F.col("fth") == F.col("gth")) & (F.col("fline") == F.col("gline")))
    every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    theirs = theirs.where("hot").select("gid", "gth", "gline", "text", every.alias("salt")).unionByName(theirs.select("gid", "gth", "gline", "text", F.lit(-1).alias("salt")))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64(*doc, "line"), F.lit(SALTS))).otherwise(-1).cast("int")
    met = F.col("fid").eqNullSafe(F.col("gid")) & (F.col("fth") == F.col("gth")) & (F.col("fline") == F.col("gline")) & (F.col("own") == F.col("salt"))
    equal = mine.withColumn("own", salt).join(theirs.hint("merge"), met).withColumn("equal", F.col("mine") == F.col("text"))
    grown = equal.groupBy(*doc, "edge", "way").agg(F.coalesce(F.min(F.when(~F.col("equal"), F.col("k"))) - 1, F.max("k")).alias("far")).where("far > 0")
    grown = grown.select(*doc, F.explode(F.sequence(F.lit(1), F.col("far"))).alias("k"), "edge", "way").select(*doc, (F.col("edge") + F.col("way") * F.col("k")).alias("line"))

    out = gone.select(*doc, F.explode(F.sequence(F.col("at"), end - 1)).alias("line")).unionByName(grown)
    out = out.groupBy(F.col("id").alias("gid"), F.col("th").alias("gth")).agg(F.sort_array(F.collect_set("line")).alias("gone"))
    left = slim.join(scratch.write(out, "gone").hint("merge"), on, "left")
    flags = aligned(F.col("gone"), F.transform("gone", lambda p: F.lit(True)), "boolean")
    rest = F.array_join(F.zip_with(lines, flags, lambda x, f: F.when(f.isNull(), x)), "\n")
    before = F.concat(F.array(F.lit(-2)), F.slice("gone", 1, F.size("gone") - 1))
    runs = F.size(F.filter(F.zip_with("gone", before, lambda a, b: a - b > 1), lambda x: x))
    return left.select(
        F.col("id").alias(id_col),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(rest).alias("text"),
        F.when(F.col("gone").isNull(), 0).otherwise(runs).cast("long").alias("n_removed"),
    )
