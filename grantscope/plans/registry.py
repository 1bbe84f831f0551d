"""Registered queries: each operator on the driver's tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import catalog, markup, text
from ..functions.catalog import Signal
from ..functions.shared import shared_folder
from ..operators import classify, declarations, graph, rules, signals, textindex
from . import analyze, generated, samples

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return declared_vs_used(spark, sf_dir)


LINES_SQL = """parts AS (SELECT doc_id, source, regexp_split_to_array(text, '\\r\\n|\\n|\\r') AS p FROM documents),
whole AS (SELECT doc_id, source, CASE WHEN p[len(p)] = '' THEN p[:len(p) - 1] ELSE p END AS q FROM parts),
lines AS (SELECT doc_id, source, unnest(q) AS line, generate_subscripts(q, 1) AS line_no FROM whole)"""


def doc_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as source files: their lines as they are, their source as the only import."""
    lines = text.lines_of(F.col("text"))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("relative_path"), F.lit("").alias("module"), F.lit("").alias("language"), F.lit("").alias("package"), F.array("source").alias("imports"), lines.alias("raw"), lines.alias("code"))


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.code_lines(doc_sources(spark, sf_dir)).withColumn("doc_id", F.col("file").cast("long"))


@query(f"""WITH {LINES_SQL}
SELECT doc_id, max(line_no)::INTEGER AS last_line, count(*)::BIGINT AS n_nonblank, sum(length(line))::BIGINT AS n_chars
FROM lines WHERE regexp_matches(line, '[^ \\t\\x0B\\f\\r]') GROUP BY doc_id""")
def scan_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every text, numbered, blank ones left out: counts per document."""
    return doc_lines(spark, sf_dir).groupBy("doc_id").agg(F.max("line").alias("last_line"), F.count("*").alias("n_nonblank"), F.sum(F.length("raw")).alias("n_chars"))


@query(f"""WITH {LINES_SQL} SELECT doc_id, line_no::INTEGER AS line, left(trim(line), 220) AS snippet FROM lines WHERE length(line) > 300""")
def snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long lines, trimmed and cut to 220 characters."""
    return doc_lines(spark, sf_dir).where(F.length("raw") > 300).select("doc_id", "line", text.snippet(F.col("raw")).alias("snippet"))


DOC_SIGNALS = [
    Signal("LICENSE", "license line", r"[Ll]icensed? under", "HIGH"),
    Signal("RIGHTS", "rights line", r"[Rr]ights reserved", "HIGH"),
    Signal("MAIL", "mail address", r"[a-z0-9.]+@[a-z0-9.]+", "HIGH"),
    Signal("SECRET", "assigned secret", r"(token|secret|key) = ", "MEDIUM"),
    Signal("CAPS", "shouted word", r"[A-Z]{8}", "LOW"),
    Signal("DIGITS", "long number", r"[0-9]{12}", "MEDIUM", ("src0", "src1")),
]
SIGNAL_VALUES = ", ".join(f"('{s.permission}', '{s.label}', '{s.pattern}', '{s.confidence}', {1 if s.import_needles else 0})" for s in DOC_SIGNALS)


@query(f"""WITH {LINES_SQL}, sig(name, label, pattern, confidence, guarded) AS (VALUES {SIGNAL_VALUES})
SELECT name, confidence, count(*)::BIGINT AS hits, count(DISTINCT doc_id)::BIGINT AS docs
FROM lines JOIN sig ON regexp_matches(line, pattern) WHERE guarded = 0 OR contains(source, 'src0') OR contains(source, 'src1') GROUP BY ALL""")
def signal_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines against a catalog of patterns, one of them guarded."""
    lines = signals.candidate_lines(doc_sources(spark, sf_dir), DOC_SIGNALS).withColumn("doc_id", F.col("file").cast("long"))
    df = lines.select("doc_id", F.explode(signals.matches(F.col("code"), DOC_SIGNALS, F.col("imports"), F.col("hits"))).alias("s"))
    return df.groupBy(F.col("s.permission").alias("name"), F.col("s.confidence").alias("confidence")).agg(F.count("*").alias("hits"), F.countDistinct("doc_id").alias("docs"))


@query("""WITH w AS (SELECT conv_id, turn, text, string_agg(text, ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS win FROM conversations)
SELECT conv_id, turn, length(win)::INTEGER AS win_chars,
  coalesce(CASE WHEN contains(lower(text), 'tion') THEN 'REQUEST' WHEN contains(lower(text), 'able') THEN 'CHECK' END,
           CASE WHEN contains(lower(win), 'tion') THEN 'REQUEST' WHEN contains(lower(win), 'able') THEN 'CHECK' END, 'NONE') AS kind FROM w""")
def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hints in a turn, else in the four turns around it."""
    df = text.around(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text", 4, "win")
    kind = lambda c: F.when(text.holds_any(c, ["TION"]), "REQUEST").when(text.holds_any(c, ["Able"]), "CHECK")
    return df.select("conv_id", "turn", F.length("win").alias("win_chars"), F.coalesce(kind(F.col("text")), kind(F.col("win")), F.lit("NONE")).alias("kind"))


@query("""WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<a\\s[^>]*>')) AS tag FROM pages)
SELECT page_id, regexp_extract(tag, 'href="([^"]*)"', 1) AS href, count(*)::BIGINT AS n FROM t GROUP BY ALL""")
def tag_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages with their target."""
    df = table(spark, sf_dir, "pages").select("page_id", F.explode(markup.tags(F.col("html"), r"<a\s[^>]*>")).alias("t"))
    return df.groupBy("page_id", F.coalesce(markup.attribute(F.col("t.tag"), "href"), F.lit("")).alias("href")).agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT page_id, string_split(html, '<p>') AS parts FROM pages),
t AS (SELECT page_id, unnest(generate_series(1, len(parts) - 1)) AS k, parts FROM p WHERE len(parts) > 1)
SELECT page_id, k::BIGINT AS nth, (length(array_to_string(parts[1:k], '')) - length(replace(array_to_string(parts[1:k], ''), chr(10), '')) + 1)::INTEGER AS line FROM t""")
def tag_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line number of every paragraph tag."""
    df = table(spark, sf_dir, "pages").select("page_id", F.posexplode(markup.tags(F.col("html"), "<p>")).alias("k", "t"))
    return df.select("page_id", (F.col("k") + 1).cast("long").alias("nth"), F.col("t.line").alias("line"))


@query(r"""WITH t AS (SELECT page_id, html, regexp_extract_all(html, '"(?:[^"\\\n]|\\.)*\\?"?|''(?:[^''\\\n]|\\.)*\\?''?|//[^\n]*|/\*[\s\S]*?(?:\*/|\z)|[^"''/]+|/') AS tokens FROM pages),
c AS (SELECT page_id, html, array_to_string(list_transform(tokens, lambda x: CASE WHEN starts_with(x, '//') THEN '' WHEN starts_with(x, '/*') THEN regexp_replace(x, '[^\n]', '', 'g') ELSE x END), '') AS code FROM t)
SELECT page_id, code, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, length(html) - length(replace(html, chr(10), '')) = length(code) - length(replace(code, chr(10), '')) AS same_lines FROM c""")
def strip_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages read as source text, without its comments and with all its lines."""
    code, breaks = text.strip_comments(F.col("html")), lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    return table(spark, sf_dir, "pages").withColumn("code", code).select("page_id", "code", F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"), (breaks(F.col("html")) == breaks(F.col("code"))).alias("same_lines"))


@query("""WITH p AS (SELECT page_id, regexp_replace(replace(regexp_replace(url, '^https?:', ''), '\\', '/'), '^/+', '') AS path FROM pages),
m AS (SELECT page_id, path, replace(path, '/en/', '/src/') AS source FROM p)
SELECT page_id, path, CASE WHEN instr(source, '/src/') > 1 THEN split_part(source, '/src/', 1) WHEN split_part(source, '/', 1) = '' THEN 'root' ELSE split_part(source, '/', 1) END AS module,
CASE WHEN split_part(source, '/src/', 1) <> source THEN split_part(source, '/src/', 1) ELSE split_part(source, '/', 1) END AS manifest_module, string_split(path, '.')[-1] AS short_name FROM m""")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative path, modules and last segment of a path."""
    path = text.relative_path(F.col("url"), F.regexp_extract("url", "^https?:", 0))
    df = table(spark, sf_dir, "pages").select("page_id", path.alias("path")).withColumn("source", F.replace(F.col("path"), F.lit("/en/"), F.lit("/src/")))
    return df.select("page_id", "path", text.module_of(F.col("source")).alias("module"), text.manifest_module(F.col("source")).alias("manifest_module"), text.short_name(F.col("path")).alias("short_name"))


@query("""WITH v AS (SELECT event_id, json_extract_string(props, '$.k') AS k, CASE WHEN value > 50 THEN 'true' WHEN value > 25 THEN 'TRUE' ELSE 'false' END AS b FROM events)
SELECT event_id, CASE WHEN regexp_full_match(k, '[+-]?[0-9]+') THEN k::INTEGER END AS k, CASE WHEN regexp_full_match(' ' || k, '[+-]?[0-9]+') THEN 1 END AS padded,
CASE b WHEN 'true' THEN true WHEN 'false' THEN false END AS flag FROM v""")
def strict_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole numbers and booleans, exact or null."""
    df = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.when(F.col("value") > 50, "true").when(F.col("value") > 25, "TRUE").otherwise("false").alias("b"))
    return df.select("event_id", text.strict_int(F.col("k")).alias("k"), text.strict_int(F.concat(F.lit(" "), F.col("k"))).alias("padded"), text.strict_bool(F.col("b")).alias("flag"))


@query("""SELECT event_id, CASE WHEN event_id % 6 < 3 THEN event_type ELSE '' END AS path, event_id % 6 = 1 AS include_tests,
CASE event_id % 6 WHEN 3 THEN 'The body is not JSON' WHEN 4 THEN 'The body is not a JSON object' WHEN 5 THEN 'No project path was given' END AS error FROM events""")
def json_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of requests, whole and broken, as the service reads them."""
    kinds = ['{"path": "<type>", "other": <k>}', '{"path": "<type>", "includeTests": true}', '{"path": "<type>", "includeTests": "true"}', '{"path": "<type>"', '["<type>"]', '{"path": "  "}']
    body = generated.nth(kinds, F.col("event_id"))
    df = table(spark, sf_dir, "events").select("event_id", F.replace(F.replace(body, F.lit("<type>"), F.col("event_type")), F.lit("<k>"), F.col("event_id").cast("string")).alias("body"))

    path, tests, error = text.request_fields(F.col("body"))
    return df.select("event_id", path.alias("path"), tests.alias("include_tests"), error.alias("error"))


@query("""WITH u AS (SELECT doc_id, count(*) FILTER (WHERE n_chars > 0) AS n, max(n_chars) AS chars FROM documents GROUP BY doc_id),
j AS (SELECT coalesce(u.doc_id, l.doc_id) AS doc_id, l.doc_id IS NOT NULL AS declared, coalesce(chars, 0) > 1000 AS api, coalesce(chars, 0) > 4000 AS strong,
  coalesce(chars, 0) % 7 = 0 AND chars IS NOT NULL AS req, coalesce(chars, 0) % 5 = 0 AND chars IS NOT NULL AS chk, chars IS NOT NULL AS const, coalesce(toxic, 0) = 1 AS alt, quality
  FROM u FULL OUTER JOIN labels l ON u.doc_id = l.doc_id),
s AS (SELECT *, CASE WHEN NOT declared AND NOT strong AND NOT req AND api THEN 'WEAK_SIGNAL' WHEN NOT declared AND alt AND NOT req THEN 'ALTERNATIVE_COVERED'
  WHEN api AND NOT declared THEN 'UNDECLARED_USAGE' WHEN api THEN 'USED' WHEN declared AND (req OR chk OR const) THEN 'REQUESTED_ONLY'
  WHEN NOT declared AND (req OR chk) THEN 'UNDECLARED_USAGE' ELSE 'DECLARED_UNUSED' END AS status,
  CASE WHEN quality = 1 THEN 'DANGEROUS' WHEN quality = 0 THEN 'SPECIAL' ELSE 'NORMAL' END AS protection FROM j)
SELECT doc_id, status, CASE WHEN status IN ('WEAK_SIGNAL', 'ALTERNATIVE_COVERED') THEN 'LOW' WHEN status = 'UNDECLARED_USAGE' THEN 'HIGH'
  WHEN status = 'DECLARED_UNUSED' AND protection <> 'NORMAL' THEN 'HIGH' WHEN status = 'DECLARED_UNUSED' THEN 'MEDIUM' WHEN protection = 'DANGEROUS' AND NOT req THEN 'HIGH'
  WHEN alt THEN 'MEDIUM' WHEN status = 'REQUESTED_ONLY' THEN 'MEDIUM' ELSE 'LOW' END AS risk,
  CASE WHEN strong OR req THEN 'HIGH' WHEN api THEN 'MEDIUM' WHEN NOT const THEN 'HIGH' ELSE 'LOW' END AS confidence FROM s""")
def declared_vs_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (used) and labels (declared) matched by id, classified by the decision tables (J5, 2.7)."""
    used = table(spark, sf_dir, "documents").groupBy("doc_id").agg(F.max("n_chars").alias("chars"))
    both = signals.full_match(used, table(spark, sf_dir, "labels"), "doc_id")
    chars, there = F.coalesce("chars", F.lit(0)), F.col("chars").isNotNull()
    both = both.withColumn("api", chars > 1000).withColumn("strong", chars > 4000).withColumn("req", (chars % 7 == 0) & there).withColumn("chk", (chars % 5 == 0) & there)
    alt = F.coalesce("toxic", F.lit(0)) == 1
    both = both.withColumn("status", classify.status(F.col("in_right"), F.col("api"), F.col("strong"), F.col("req"), F.col("chk"), there, alt))
    protection = F.when(F.col("quality") == 1, "DANGEROUS").when(F.col("quality") == 0, "SPECIAL").otherwise("NORMAL")
    note = F.when(alt, F.lit("note"))
    return both.select("doc_id", "status", classify.risk(F.col("status"), protection, F.col("req"), note).alias("risk"), classify.confidence(F.col("strong"), F.col("api"), F.col("req"), there).alias("confidence"))


SPEC_VALUES = ", ".join("('{}', '{}', '{}', {})".format(s[0], s[1], s[2], "NULL" if s[4] is None else "'" + s[4].replace("'", "''") + "'") for s in catalog.SPECS)
PERMISSION_SQL = "CASE p_size % 4 WHEN 0 THEN 'android.permission.CAMERA' WHEN 1 THEN 'com.android.vending.BILLING' WHEN 2 THEN 'android.permission.' || p_type ELSE p_brand END"


@query(f"""WITH spec(name, protection, grp, note) AS (VALUES {SPEC_VALUES}), p AS (SELECT p_partkey, {PERMISSION_SQL} AS permission FROM part)
SELECT p_partkey, permission, coalesce(protection, CASE WHEN starts_with(permission, 'android.permission.') THEN 'NORMAL' ELSE 'SIGNATURE' END) AS protection, coalesce(grp, 'Other') AS "group", note AS policy_note
FROM p LEFT JOIN spec ON name = permission""")
def default_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookup in the catalog, with a default row."""
    df = table(spark, sf_dir, "part").select("p_partkey", F.expr(PERMISSION_SQL).alias("permission"))
    return catalog.described(df, "permission", catalog.specs(spark)).select("p_partkey", "permission", "protection", "group", "policy_note")


def whole_seconds(ts: Column) -> Column:
    """The nearest whole second, halves to the even one, as a cast to whole numbers rounds in SQL."""
    return F.rint(F.unix_micros(ts.cast("timestamp")) / 1e6).cast("long")


SPANS = "spans AS (SELECT user_id, event_id AS span_id, epoch(ts)::BIGINT AS s, epoch(ts)::BIGINT + 3 * 86400 AS e, event_type = 'purchase' AS strong FROM events WHERE event_type IN ('signup', 'purchase'))"


@query(f"""WITH {SPANS}, p AS (SELECT user_id, event_id, epoch(ts)::BIGINT AS t FROM events WHERE event_type = 'click')
SELECT p.user_id, p.event_id, (SELECT span_id FROM spans x WHERE x.user_id = p.user_id AND p.t BETWEEN x.s AND x.e ORDER BY x.strong DESC, x.s DESC, x.span_id LIMIT 1) AS span_id FROM p""")
def innermost_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks and the innermost span of the same user around them, strong spans first."""
    events = table(spark, sf_dir, "events").withColumn("t", whole_seconds(F.col("ts")))
    spans = events.where(F.col("event_type").isin("signup", "purchase")).select(
        "user_id", F.col("event_id").alias("ord"), F.col("t").alias("start_line"), (F.col("t") + 3 * 86400).alias("end_line"), (F.col("event_type") == "purchase").alias("strong"))
    points = events.where("event_type = 'click'").select("user_id", "event_id", "t")
    out = declarations.innermost(points, spans, point_keys=["user_id"], point="t", first="strong")
    return out.select("user_id", "event_id", F.col("in_ord").alias("span_id"))


@query("""WITH few AS (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) <= 6)
SELECT DISTINCT l_orderkey || '-' || l_linenumber AS callee_id, o_custkey::VARCHAR AS caller_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey
WHERE l_orderkey IN (SELECT l_orderkey FROM few) AND l_orderkey || '-' || l_linenumber <> o_custkey::VARCHAR""")
def guarded_edges_by_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges by an equal order key, whose candidates do not grow with the table, for keys of at most six."""
    callees = table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.col("l_orderkey").alias("name"))
    calls = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("caller_id"), F.lit(0).alias("caller_ord"), F.col("o_orderkey").alias("name"))
    return graph.guarded_edges(calls, callees).select("callee_id", "caller_id")


SUPPLY_EDGES = """edges AS (SELECT DISTINCT 's' || l_suppkey AS callee, 'p' || l_partkey AS caller FROM lineitem WHERE l_suppkey IS NOT NULL AND l_partkey IS NOT NULL
UNION ALL SELECT DISTINCT 'p' || l_partkey, 's' || l_suppkey FROM lineitem WHERE l_suppkey IS NOT NULL AND l_partkey IS NOT NULL)"""


@query(f"""WITH RECURSIVE {SUPPLY_EDGES}, walk(target, node, level) AS (SELECT t, t, 1 FROM (VALUES ('s1'), ('s5'), ('s9')) v(t)
UNION SELECT target, caller, level + 1 FROM walk JOIN edges ON node = callee WHERE level < 4)
SELECT target, node, min(level)::INTEGER AS level FROM walk GROUP BY ALL""")
def bounded_bfs_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and suppliers that reach three suppliers within four levels, over every row and key of lineitem."""
    items = table(spark, sf_dir, "lineitem").where("l_suppkey is not null and l_partkey is not null")
    supplier, part = F.concat(F.lit("s"), F.col("l_suppkey")), F.concat(F.lit("p"), F.col("l_partkey"))
    pairs = items.select("l_suppkey", "l_partkey").distinct().select(supplier.alias("s"), part.alias("p"))  # keys are shuffled, not their texts
    edges = pairs.select(F.col("s").alias("callee_id"), F.col("p").alias("caller_id")).unionByName(pairs.select(F.col("p").alias("callee_id"), F.col("s").alias("caller_id")))
    edges = edges.withColumn("caller_ord", F.col("caller_id"))
    targets = spark.createDataFrame([("s1",), ("s5",), ("s9",)], "id string")
    kinds = spark.createDataFrame([], "id string, entry_kind string")
    _, visited = graph.callers_paths(targets, edges, kinds, max_depth=4)
    return visited.groupBy("target", "node").agg(F.min("level").alias("level"))


@query("""SELECT o_orderpriority AS priority, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS reached, count(DISTINCT c_mktsegment)::INTEGER AS n,
arg_max(o_orderstatus, o_orderkey) AS last_status FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 200000 GROUP BY 1""")
def inverted_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per key the sorted set of values and what the last row carries."""
    orders = table(spark, sf_dir, "orders").where("o_totalprice > 200000")
    rows = orders.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    out = graph.inverted(rows, key="o_orderpriority", value="c_mktsegment", order=["o_orderkey"], carry=["o_orderstatus"])
    return out.select(F.col("o_orderpriority").alias("priority"), F.array_join("reached", ",").alias("reached"), F.size("reached").alias("n"), F.col("o_orderstatus").alias("last_status"))


SEVERITY_SQL = "CASE WHEN l_discount > 0.09 THEN 'CRITICAL' WHEN l_discount > 0.07 THEN 'HIGH' WHEN l_discount > 0.04 THEN 'MEDIUM' WHEN l_discount > 0.02 THEN 'LOW' ELSE 'INFO' END"


def severity_of(discount: Column) -> Column:
    return F.when(discount > 0.09, "CRITICAL").when(discount > 0.07, "HIGH").when(discount > 0.04, "MEDIUM").when(discount > 0.02, "LOW").otherwise("INFO")


@query(f"""WITH f AS (SELECT l_orderkey, {SEVERITY_SQL} AS sev FROM lineitem),
s AS (SELECT l_orderkey, least(100, sum(CASE sev WHEN 'CRITICAL' THEN 40 WHEN 'HIGH' THEN 20 WHEN 'MEDIUM' THEN 8 WHEN 'LOW' THEN 3 ELSE 0 END))::INTEGER AS score FROM f GROUP BY 1)
SELECT l_orderkey, score, CASE WHEN score < 10 THEN 'A' WHEN score < 25 THEN 'B' WHEN score < 45 THEN 'C' WHEN score < 70 THEN 'D' ELSE 'F' END AS grade FROM s""")
def scored_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capped sums of severity weights and their grades."""
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", severity_of(F.col("l_discount")).alias("sev"))
    df = df.groupBy("l_orderkey").agg(classify.capped_score(F.col("sev")).alias("score"))
    return df.withColumn("grade", classify.grade(F.col("score")))


@query("""WITH f AS (
  SELECT 0 AS block, doc_id, 0 AS nth, 'UNUSED_PERMISSION' AS rule, CASE WHEN quality = 1 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM labels WHERE toxic = 1
  UNION ALL SELECT 0, doc_id, 1, 'UNDECLARED_PERMISSION', 'CRITICAL' FROM labels WHERE quality = 0
  UNION ALL SELECT 9, NULL, 13, 'NO_MANIFEST', 'HIGH' FROM (SELECT count(*) AS n FROM labels WHERE quality > 5) WHERE n = 0)
SELECT printf('F-%03d', row_number() OVER (ORDER BY block, coalesce(printf('%012d', doc_id), ''), nth)) AS id, rule, severity FROM f""")
def numbered_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules in one pass, a rule on empty input, ids in order of emission."""
    labels = table(spark, sf_dir, "labels")
    name, order = F.col("doc_id").cast("string"), F.format_string("%012d", "doc_id")
    own = rules.any_of(labels, [
        (F.col("toxic") == 1, rules.finding("UNUSED_PERMISSION", F.when(F.col("quality") == 1, "HIGH").otherwise("MEDIUM"), subject=name, other=name, block=0, order=order)),
        (F.col("quality") == 0, rules.finding("UNDECLARED_PERMISSION", "CRITICAL", subject=name, block=0, order=order)),
    ])
    none = rules.any_of(labels.where("quality > 5").agg(F.count("*").alias("n")), [(F.col("n") == 0, rules.finding("NO_MANIFEST", "HIGH", block=9, order=F.lit("")))])
    return rules.numbered(own.unionByName(none)).select("id", "rule", "severity")


@query("""SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n <= 8""")
def top_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight rows per key in a stable order (L1, O1, O2)."""
    order = [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")]
    first = analyze.first_places(table(spark, sf_dir, "lineitem"), ["l_suppkey"], order, ["l_orderkey", "l_linenumber"], "places")
    return first.select("l_suppkey", F.explode("places").alias("p")).select("l_suppkey", "p.*")


@query("""SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1""")
def first_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicates by a composite key, the first kept."""
    return signals.first_of(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("""WITH a AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 5000), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 300000)
SELECT coalesce(a.k, b.k) AS k, a.k IS NOT NULL AS in_left, b.k IS NOT NULL AS in_right FROM a FULL JOIN b ON a.k = b.k""")
def key_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of two key sets, with the sides that have each (J5, SO1)."""
    a = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("k"))
    return signals.full_match(a, table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("k")).distinct(), "k")


@query("""SELECT p_partkey, p_name FROM part WHERE p_size > 25 AND p_brand = 'Brand#11' AND contains(lower(concat_ws(' ', p_name, p_type, p_brand)), 'brand#1')""")
def report_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equality and any-case substring over several columns (K8)."""
    df = table(spark, sf_dir, "part").select(
        F.col("p_partkey"), F.col("p_name").alias("permission"), F.col("p_type").alias("description"), F.col("p_brand").alias("group"), F.col("p_brand").alias("status"),
        F.when(F.col("p_size") > 25, "HIGH").otherwise("LOW").alias("riskLevel"), F.array().cast("array<string>").alias("touchedFiles"), F.array().cast(rules.NONE).alias("usages"))
    return analyze.report_filter(df, status="Brand#11", risk="HIGH", query="BRAND#1").select("p_partkey", F.col("permission").alias("p_name"))


@query(f"""WITH spec(name, protection, grp, note) AS (VALUES {SPEC_VALUES}), p AS (SELECT {PERMISSION_SQL} AS permission FROM part)
SELECT name, protection, (SELECT count(*) FROM p WHERE permission = name)::BIGINT AS parts FROM spec""")
def catalog_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The static catalog as a table, with the parts that name each permission."""
    named = table(spark, sf_dir, "part").groupBy(F.expr(PERMISSION_SQL).alias("name")).agg(F.count("*").alias("parts"))
    return catalog.specs(spark).join(named, "name", "left").select("name", "protection", F.coalesce("parts", F.lit(0)).alias("parts"))


SOUGHT = ["brand#1", "steel", "Brand#11", "ed b", "r", "", "no such part", "12"]


@query("WITH q(query) AS (VALUES " + ", ".join(f"('{x}')" for x in SOUGHT) + """) SELECT query, p_partkey FROM part JOIN q ON contains(lower(concat_ws(' ', p_name, p_type, p_brand)), lower(query))""")
def indexed_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any-case substrings by stored posting lists of trigrams, verified (K8 by an index)."""
    part, said = table(spark, sf_dir, "part"), F.concat_ws(" ", "p_name", "p_type", "p_brand")
    path = shared_folder(spark, "index")
    textindex.write_index(part, path, key="p_partkey", text=said)
    out = None
    for x in SOUGHT:
        found = textindex.search(spark, part, path, x, key="p_partkey", text=said).select(F.lit(x).alias("query"), "p_partkey")
        out = found if out is None else out.unionByName(found)
    return out


for module in (generated, samples):
    QUERIES |= module.QUERIES
    ORACLE_SQL |= module.ORACLE_SQL
