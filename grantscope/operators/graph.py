"""Call graph: edges by name, entry points, and bounded breadth-first paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import catalog
from ..functions.shared import checkpointed
from ..sources.project import keys_of
from .declarations import FUNCTION_KINDS

MAX_CANDIDATES, MAX_PATHS, MAX_DEPTH, MAX_USAGES, MAX_REPORTED = 6, 5, 8, 20, 12


def guarded_edges(calls: DataFrame, callees: DataFrame, *, name: str = "name", limit: int = MAX_CANDIDATES) -> DataFrame:
    """(callee_id, caller_id, caller_ord) by equal name, for names of at most ``limit`` callees.

    ``calls`` has caller_id, caller_ord and the name; ``callees`` has id and the name.
    Names of many callees are dropped before the join, so a common name never makes
    all its pairs.  Of each name one callee more than the limit is kept at most, and that before
    rows of a name meet.  A function that calls itself has no edge; repeated calls have one.
    """
    nth = F.row_number().over(Window.partitionBy(name).orderBy("id"))
    some = callees.withColumn("_nth", nth).where(F.col("_nth") <= limit + 1)
    few = some.groupBy(name).agg(F.collect_set("id").alias("ids"), F.count("*").alias("n")).where(F.col("n") <= limit)
    pairs = calls.join(few.hint("merge"), name).select(F.explode("ids").alias("callee_id"), "caller_id", "caller_ord")
    return pairs.where(F.col("callee_id") != F.col("caller_id")).distinct()


def call_edges(decls: DataFrame) -> DataFrame:
    """Edges by name, within each ``project`` where there are several."""
    keys = keys_of(decls)
    # callers and callees: read twice, made once
    functions = checkpointed(decls.where(F.col("kind").isin(*FUNCTION_KINDS)).select(*keys, "id", "simple_name", "calls", "relative_path", "ord"))
    within = lambda name: F.struct(*keys, F.col(name)) if keys else F.col(name)
    calls = functions.select("*", F.explode("calls").alias("_called"))
    calls = calls.select(F.col("id").alias("caller_id"), F.struct("relative_path", "ord").alias("caller_ord"), within("_called").alias("name"))
    return guarded_edges(calls, functions.select("id", within("simple_name").alias("name")))


def all_supertypes(decls: DataFrame) -> DataFrame:
    """The super types of each type, its own and those of types of these names: simple_name, super and ``level`` (1: its own).

    Names are simple ones, within each ``project`` where there are several; types of one name count as one, and none is
    its own super type.  A semi-naive closure: each level joins only the pairs that the one before has found, and pairs
    found before are not followed again, so a cycle ends.  Of several ways to a super type the shortest counts.
    """
    keys = keys_of(decls)
    types = decls.where(~F.col("kind").isin(*FUNCTION_KINDS))
    edges = checkpointed(types.select(*keys, "simple_name", F.explode("super_types").alias("super")).where("simple_name <> super").distinct())
    step = edges.select(*keys, F.col("super").alias("above"), F.col("simple_name").alias("super"))
    found = front = edges.withColumn("level", F.lit(1))
    level = 1
    while True:
        level += 1
        grown = front.drop("level").join(step, [*keys, "super"]).select(*keys, "simple_name", F.col("above").alias("super")).where("simple_name <> super").distinct()
        front = checkpointed(grown.join(found, [*keys, "simple_name", "super"], "left_anti").withColumn("level", F.lit(level)))
        if front.isEmpty():
            return found
        found = found.unionByName(front)


def entry_kinds(decls: DataFrame, transitive: bool = False) -> DataFrame:
    """Adds ``entry_kind`` to declarations, null for those that are no entry point.

    A function is one by the super types that its type's header names.  With ``transitive`` those of its super
    types count too, the nearest first, then by name.
    """
    keys, is_type = keys_of(decls), ~F.col("kind").isin(*FUNCTION_KINDS)
    # one pass over the declarations: a type meets its functions by its name, and what belongs to no type stands alone
    owner = F.when(is_type, F.col("qualified_name")).otherwise(F.coalesce("container", "id"))
    last = F.max_by(F.when(is_type, F.col("super_types")), F.when(is_type, F.struct("relative_path", "ord")))
    supers = F.when(F.col("container").isNotNull(), last.over(Window.partitionBy(*keys, "_owner")))
    marked = decls.withColumn("_owner", owner).withColumn("_supers", supers)
    if transitive:
        types = decls.where(is_type).select(*keys, F.col("qualified_name").alias("container"), "simple_name").distinct()
        above = all_supertypes(decls).where(F.col("super").isin(*catalog.ENTRY_SUPERTYPES) & (F.col("level") > 1))
        more = types.join(above, [*keys, "simple_name"]).groupBy(*keys, "container").agg(F.transform(F.sort_array(F.collect_set(F.struct("level", "super"))), lambda x: x["super"]).alias("_above"))
        marked = marked.join(more, [*keys, "container"], "left").withColumn("_supers", F.concat("_supers", F.coalesce("_above", F.array().cast("array<string>"))))
    known = F.array(*[F.lit(x) for x in catalog.ENTRY_SUPERTYPES])
    hit = F.try_element_at(F.filter(F.col("_supers"), lambda s: F.array_contains(known, s)), F.lit(1))
    kind = F.when(F.col("kind") == "COMPOSABLE", "COMPOSABLE").when(hit.isNotNull(), hit).when(F.col("simple_name").isin(*catalog.ENTRY_FUNCTIONS), "LIFECYCLE")
    return marked.withColumn("entry_kind", kind).select(*decls.columns, "entry_kind")


def entry_functions(decls: DataFrame) -> DataFrame:
    """The declarations of :func:`entry_kinds` that are entry points."""
    return decls.where(F.col("entry_kind").isNotNull())


def callers_paths(targets: DataFrame, edges: DataFrame, kinds: DataFrame, *, max_paths: int = MAX_PATHS, max_depth: int = MAX_DEPTH) -> tuple[DataFrame, DataFrame]:
    """Breadth-first search from each target to its callers.

    ``targets`` has ``id``; ``edges`` callee_id, caller_id, caller_ord; ``kinds`` id and
    entry_kind.  A node is visited once per target, in the order of a queue.  A path
    is reported where its head is an entry point (and goes no further) or has no
    caller; at most ``max_paths`` per target, of at most ``max_depth`` nodes.

    Returns (target, entry_kind, nodes, level, pos) and all visited (target, node,
    level).  One join per level, written once; a target that has its paths is not
    followed further.
    """
    # the place in the queue: at each step the caller's order, then its id; arrays compare as a queue would deal them out
    turn = f"array<struct<ord:{edges.schema['caller_ord'].dataType.simpleString()},node:{edges.schema['caller_id'].dataType.simpleString()}>>"
    edges = checkpointed(edges)  # each level reads them again
    has = checkpointed(edges.select(F.col("callee_id").alias("node")).distinct()).withColumn("called", F.lit(True))
    kind = kinds.select(F.col("id").alias("node"), "entry_kind").dropDuplicates(["node"])
    front = targets.select(F.col("id").alias("target")).distinct().select("target", F.col("target").alias("node"), F.array().cast(turn).alias("pos"), F.array("target").alias("nodes"))
    is_end = F.col("entry_kind").isNotNull() | F.col("called").isNull()
    rank = F.row_number().over(Window.partitionBy("target").orderBy("level", "pos"))
    found = visited = None
    for level in range(1, max_depth + 1):
        own = checkpointed(front.join(kind, "node", "left").join(has, "node", "left").withColumn("level", F.lit(level)))
        if level > 1 and own.isEmpty():
            break
        ends = own.where(is_end).select("target", F.coalesce("entry_kind", F.lit("UNKNOWN")).alias("entry_kind"), "nodes", "level", "pos")
        found = ends if found is None else found.unionByName(ends)
        seen = own.select("target", "node", "level")
        visited = seen if visited is None else visited.unionByName(seen)
        if level == max_depth:
            break
        done = found.groupBy("target").agg(F.count("*").alias("n")).where(F.col("n") >= max_paths)
        open_ = own.where("entry_kind is null and called").join(done.select("target"), "target", "left_anti")
        grown = open_.join(edges, F.col("node") == F.col("callee_id"))
        step = F.concat("pos", F.array(F.struct(F.col("caller_ord").alias("ord"), F.col("caller_id").alias("node"))))
        grown = grown.select("target", F.col("caller_id").alias("node"), step.alias("pos"), F.array_prepend(F.col("nodes"), F.col("caller_id")).alias("nodes"))
        grown = grown.join(visited.select("target", "node"), ["target", "node"], "left_anti")
        # of several ways to a node the first in the queue; an aggregate, so a node of many callers is summed up before the shuffle
        front = grown.groupBy("target", "node").agg(F.min(F.struct("pos", "nodes")).alias("first")).select("target", "node", "first.pos", "first.nodes")
    return found.withColumn("n", rank).where(F.col("n") <= max_paths).drop("n"), visited


def usage_paths(decls: DataFrame, paths: DataFrame, chosen: DataFrame) -> DataFrame:
    """Call paths per permission, as sorted arrays of at most twelve.

    ``chosen`` has permission, nth (of the usage) and target, and ``project`` where there are several; equal
    paths, by symbol and line of their nodes, are reported once, where they come first.
    """
    own = [*keys_of(chosen), "permission"]
    rows = chosen.join(paths, "target").select(*own, "nth", "level", "pos", "entry_kind", "nodes")
    nodes = rows.select("*", F.posexplode("nodes").alias("at", "id")).join(decls.select("id", "qualified_name", "relative_path", "start_line"), "id")
    node = F.struct(F.col("qualified_name").alias("symbol"), F.col("relative_path").alias("file"), F.col("start_line").alias("line"))
    built = nodes.groupBy(*own, "nth", "level", "pos", "entry_kind").agg(F.sort_array(F.collect_list(F.struct("at", node.alias("node")))).alias("x"))
    built = built.withColumn("nodes", F.transform("x", lambda v: v["node"]))
    name = F.array_join(F.transform("nodes", lambda v: F.concat_ws(":", v["symbol"], v["line"].cast("string"))), ", ")
    built = built.withColumn("name", name)
    first = F.row_number().over(Window.partitionBy(*own, "name").orderBy("nth", "level", "pos"))
    built = built.withColumn("n", first).where("n = 1")
    head = F.col("nodes")[0]
    path = F.struct(head["symbol"].alias("entryPoint"), F.col("entry_kind").alias("entryKind"), F.size("nodes").alias("depth"), "nodes")
    ordered = F.sort_array(F.collect_list(F.struct("nth", "level", "pos", path.alias("path"))))
    return built.groupBy(*own).agg(F.slice(F.transform(ordered, lambda v: v["path"]), 1, MAX_REPORTED).alias("callPaths"))


def inverted(rows: DataFrame, *, key: str | list[str], value: str, order: list[str], carry: list[str], place: str | None = None) -> DataFrame:
    """Per key, of one column or several, the sorted set of values, and of ``carry`` what the last row has; most values first, then by
    the least ``order``, which ``place`` names as a column if it is wanted."""
    last = F.max_by(F.struct(*carry), F.struct(*order))
    key = [key] if isinstance(key, str) else key
    out = rows.groupBy(*key).agg(F.sort_array(F.collect_set(value)).alias("reached"), last.alias("_last"), F.min(F.struct(*order)).alias("_first"))
    return out.select(*key, *[F.col(f"_last.{c}").alias(c) for c in carry], "reached", "_first").orderBy(*key[:-1], F.desc(F.size("reached")), "_first").withColumnRenamed("_first", place or "_first").drop("_first")


def module_of_file(file: Column) -> Column:
    return F.substring_index(file, "/src/", 1)
