"""The queries of this subpackage, and the SQL of those that SQL can express.

Each query reads its whole table, applies one operator with production
parameters and returns the columns that its contract names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    out = mix(spark, table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
}

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op1_mixing"] = r"""
WITH thin AS (
  SELECT doc_id, coalesce(source, '') AS s, source IS NULL AS sn,
         coalesce(len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS h
  FROM documents),
totals AS (SELECT s, sn, sum(size)::BIGINT AS total FROM thin GROUP BY s, sn),
ranked AS (
  SELECT *, CASE (row_number() OVER (ORDER BY sn, encode(s)) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
         3.0::DOUBLE * total AS cap FROM totals),
levels AS (
  SELECT *, (sum(total) OVER () - coalesce(sum(cap) OVER before, 0.0::DOUBLE))
            / (sum(w) OVER () - coalesce(sum(w) OVER before, 0.0::DOUBLE)) AS level
  FROM ranked
  WINDOW before AS (ORDER BY cap / w, sn, encode(s) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals AS (
  SELECT s, sn, total, CASE WHEN level * w >= cap THEN cap
    ELSE (SELECT arg_min(level, cap / w) FROM levels WHERE level * w < cap) * w END AS target FROM levels),
parts AS (
  SELECT *, CASE WHEN total > 0 THEN least(floor(target / total), 3)::BIGINT ELSE 0 END AS repeats FROM goals),
runs AS (
  SELECT s, sn, h, sum(size) AS n FROM thin WHERE size > 0 GROUP BY s, sn, h),
upto AS (
  SELECT *, sum(n) OVER (PARTITION BY s, sn ORDER BY h) AS upto FROM runs),
edges AS (
  SELECT p.s, p.sn, arg_min(u.h, u.h) AS edge, arg_min(2 * (p.target - p.repeats * p.total - u.upto + u.n) >= u.n, u.h) AS take_edge
  FROM parts p JOIN upto u ON p.s = u.s AND p.sn = u.sn WHERE u.upto > p.target - p.repeats * p.total GROUP BY p.s, p.sn)
SELECT t.doc_id, t.size, p.total AS source_size, p.target,
       (t.size * (p.repeats + CASE WHEN e.edge IS NULL OR t.h < e.edge OR (t.h = e.edge AND e.take_edge) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM thin t JOIN parts p ON t.s = p.s AND t.sn = p.sn LEFT JOIN edges e ON t.s = e.s AND t.sn = e.sn
"""


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from ._scratch import Scratch
    from .token_output import read_tokens, write_tokens

    root = Scratch(spark, "token-files").root
    shards = write_tokens(spark, table(spark, sf_dir, "documents"), root, tokenizer_path=public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, shards)


QUERIES["op4_token_output"] = op4_token_output


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    out = judge(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op10_quality that SQL can express."""
    return op10_quality(spark, sf_dir).drop("kept")


QUERIES["op10_quality"] = op10_quality
QUERIES["quality_counts"] = quality_counts
ORACLE_SQL["quality_counts"] = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
grams AS (
  SELECT r, unnest(generate_series(1, len(ws) - 2)) AS i, unnest(list_transform(generate_series(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 2], ' '))) AS g FROM w WHERE len(ws) > 2),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM grams) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + d) AS n FROM again, (VALUES (0), (1), (2)) v(d) GROUP BY r),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM w),
dups AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
       (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(dups.n, 0)::BIGINT AS n_dup_lines,
       coalesce(covered.n, 0)::BIGINT AS n_repeat_words, len(ws) < 50 OR 100 * coalesce(covered.n, 0) > 50 * len(ws) AS base_failed
FROM w LEFT JOIN covered USING (r) LEFT JOIN dups USING (r)
"""


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .language import held_out, identify, train

    docs = table(spark, sf_dir, "documents")
    out = identify(spark, docs.select("doc_id", "text"), train(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES["op7_language"] = op7_language


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document that holds a benchmark passage: its items and their places."""
    from pyspark.sql import functions as F

    from .decontaminate import contaminated

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = contaminated(spark, docs, table(spark, sf_dir, "benchmark"))
    items = F.array_distinct(F.transform("leaks", lambda x: x["item_id"]))
    return out.where(F.size("leaks") > 0).select("doc_id", items.alias("item_ids"), "leaks")


QUERIES["op9_decontaminate"] = op9_decontaminate


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import Rule, by_host_words, judge_urls

    rules = [Rule.of("com/en/", False), Rule.of("example.com/en/7", True), Rule.of("net/de/", True), Rule.of("example.net/de/8", False), Rule.of("org/es/", False)]
    pages = table(spark, sf_dir, "pages")
    return judge_urls(spark, pages, rules, labelled=by_host_words(pages)).select("page_id", "host", "path", "rule", "verdict")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op2_url_filter that SQL can express."""
    return op2_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule")


QUERIES["op2_url_filter"] = op2_url_filter
QUERIES["url_rules"] = url_rules
ORACLE_SQL["url_rules"] = r"""
WITH rest AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
cut AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM rest),
parts AS (
  SELECT r, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM cut),
rules(host, path) AS (VALUES ('com', '/en/'), ('example.com', '/en/7'), ('net', '/de/'), ('example.net', '/de/8'), ('org', '/es/')),
hits AS (
  SELECT r, arg_max(x.host || x.path, length(x.host || x.path)) AS rule
  FROM parts p JOIN rules x ON (p.host = x.host OR ends_with(p.host, '.' || x.host)) AND starts_with(p.path, x.path) GROUP BY r)
SELECT page_id, host, path, rule FROM parts LEFT JOIN hits USING (r)
"""


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract

    return extract(spark, table(spark, sf_dir, "pages"))


QUERIES["op6_html_text"] = op6_html_text


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import join_classes

    return join_classes(spark, table(spark, sf_dir, "documents"))


QUERIES["op5_ngram_jaccard"] = op5_ngram_jaccard
ORACLE_SQL["op5_ngram_jaccard"] = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
sets AS (
  SELECT r, doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(generate_series(1, len(ws) - 4), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS s FROM w),
tokens AS (SELECT r, len(s) AS n, unnest(s) AS t FROM sets),
pairs AS (SELECT a.r AS a, b.r AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS n FROM tokens a JOIN tokens b ON a.t = b.t AND a.r < b.r GROUP BY a.r, b.r),
links AS (SELECT a, b FROM pairs WHERE 100 * n >= 80 * (na + nb - n)),
both_ AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM both_ UNION SELECT reach.a, both_.b FROM reach JOIN both_ ON reach.b = both_.a),
least AS (SELECT reach.a AS r, min(sets.doc_id) AS m FROM reach JOIN sets ON sets.r = reach.b GROUP BY reach.a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, coalesce(least(doc_id, m), doc_id) AS component_id FROM sets LEFT JOIN least USING (r)
"""


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_passages

    return dedup_passages(spark, table(spark, sf_dir, "documents"))


def line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of all documents without repeated content-defined chunks and the equal lines around them."""
    from .line_dedup import dedup_chunks

    return dedup_chunks(spark, table(spark, sf_dir, "documents"))


def op8_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four batches and a compaction: all documents in, one batch sent twice, toxic ones out, counts revised.

    Words of a text are its tokens under ``words-1``; ``words-2`` counts line ends too.  Batch 2 deletes documents that labels call toxic, batch 3 revises the
    counts of all others that have several lines, batch 4 counts every document under ``words-2``.
    """
    from pyspark.sql import functions as F

    from ._scratch import Scratch
    from .mixing import n_words
    from .rollup import Rollup

    scratch = Scratch(spark, "rollup")
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    text = F.coalesce(F.col("text"), F.lit(""))
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    counted = scratch.write(docs.select("doc_id", "source", "lang", n_words(F.col("text")).alias("words"), breaks.cast("long").alias("breaks")), "counts")
    toxic = labels.where("toxic = 1").select("doc_id").distinct()
    change = lambda df, op, tokenizer, tokens, old=None: df.select(F.lit(op).alias("op"), "source", "lang", F.lit(tokenizer).alias("tokenizer"), tokens.alias("tokens"), (F.lit(None).cast("long") if old is None else old).alias("old_tokens"))
    words, both = F.col("words"), F.col("words") + F.col("breaks")
    store = Rollup(spark, scratch.path("store"))
    first = change(counted, "insert", "words-1", words)
    store.commit("0001", first)
    store.commit("0001", first)  # sent again: no effect
    store.commit("0002", change(counted.join(toxic, "doc_id", "left_semi"), "delete", "words-1", words))
    store.compact()
    store.commit("0002", first)  # sent again after it went into the base: no effect
    store.commit("0003", change(counted.join(toxic, "doc_id", "left_anti").where("breaks > 0"), "revise", "words-1", both, words))
    store.commit("0004", change(counted, "insert", "words-2", both))
    return store.totals()


def token_rollup_by_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of all documents by source, language and tokenizer, for two tokenizers; the second batch revises the first."""
    import public_tokenizers
    from pyspark.sql import functions as F

    from ._scratch import Scratch
    from .rollup import Rollup, count_tokens

    scratch, docs = Scratch(spark, "rollup"), table(spark, sf_dir, "documents").select("source", "lang", "text")
    # a job for each tokenizer, so that no worker holds the units of two
    docs = scratch.write(count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), name="byte_bpe_50k"), "texts")
    docs = count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), name="word_bpe_49k")
    counted = scratch.write(docs.select("source", "lang", "byte_bpe_50k", "word_bpe_49k"), "counts")
    scratch.drop("texts")
    row = lambda op, name, tokens, old: counted.select(F.lit(op).alias("op"), "source", "lang", F.lit(name).alias("tokenizer"), tokens.alias("tokens"), old.alias("old_tokens"))
    none, first, second = F.lit(None).cast("long"), F.col("byte_bpe_50k"), F.col("word_bpe_49k")
    store = Rollup(spark, scratch.path("store"))
    store.commit("1", row("insert", "byte_bpe_50k", first, none).unionByName(row("insert", "word_bpe_49k", first, none)))
    store.commit("2", row("revise", "word_bpe_49k", second, first))
    return store.totals()


QUERIES["op3_line_dedup"] = op3_line_dedup
ORACLE_SQL["op3_line_dedup"] = r"""
WITH whole AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line FROM whole WHERE len(ls) > 1),
pairs AS (SELECT doc_id, pos, line AS a, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM l),
full_ AS (SELECT * FROM pairs WHERE b IS NOT NULL AND (regexp_matches(a, '[^ \t\n\x0B\f\r]') OR regexp_matches(b, '[^ \t\n\x0B\f\r]'))),
ranked AS (SELECT *, first_value(doc_id) OVER earliest AS first_doc, first_value(pos) OVER earliest AS first_pos FROM full_ WINDOW earliest AS (PARTITION BY a, b ORDER BY doc_id, pos)),
later AS (SELECT doc_id, pos FROM ranked WHERE doc_id <> first_doc OR pos > first_pos + 1),
gone AS (SELECT DISTINCT doc_id, pos + d AS pos FROM later, (VALUES (0), (1)) v(d)),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM l WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = l.doc_id AND gone.pos = l.pos) GROUP BY doc_id),
runs AS (SELECT doc_id, count(*) AS n FROM gone WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = gone.doc_id AND g.pos = gone.pos - 1) GROUP BY doc_id)
SELECT w.doc_id, CASE WHEN runs.n IS NULL THEN w.text ELSE coalesce(kept.text, '') END AS text, coalesce(runs.n, 0)::BIGINT AS n_removed
FROM whole w LEFT JOIN kept USING (doc_id) LEFT JOIN runs USING (doc_id)
"""
QUERIES["line_chunks"] = line_chunks
QUERIES["op8_token_rollup"] = op8_token_rollup
QUERIES["token_rollup_by_tokenizer"] = token_rollup_by_tokenizer
ORACLE_SQL["op8_token_rollup"] = r"""
WITH counted AS (
  SELECT doc_id, source, lang,
         coalesce(len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')), 0)::BIGINT AS words,
         (length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')))::BIGINT AS breaks
  FROM documents),
changes AS (
  SELECT source, lang, 'words-1' AS tokenizer, 1 AS docs, words AS tokens FROM counted
  UNION ALL
  SELECT source, lang, 'words-1', -1, -words FROM counted WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)
  UNION ALL
  SELECT source, lang, 'words-1', 0, breaks FROM counted
  WHERE breaks > 0 AND NOT EXISTS (SELECT 1 FROM labels WHERE toxic = 1 AND labels.doc_id = counted.doc_id)
  UNION ALL
  SELECT source, lang, 'words-2', 1, words + breaks FROM counted)
SELECT source, lang, tokenizer, sum(docs)::BIGINT AS docs, sum(tokens)::BIGINT AS tokens
FROM changes GROUP BY ALL HAVING sum(docs) <> 0 OR sum(tokens) <> 0
"""


def op11_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per final file: clicks in files of a day, lot and piece, small ones merged."""
    from pyspark.sql import functions as F

    from ._scratch import Scratch
    from .compaction import by_lots, compact, digests, write_files

    clicks = table(spark, sf_dir, "clicks")
    rows = clicks.count()
    share = lambda x: 1 + rows // x
    keys, root = ["day", "lot", "piece"], Scratch(spark, "clicks", keep=True).root
    keyed = by_lots(spark, clicks, time_col="arrived_at", id_col="click_id", per_lot=share(150))
    files = write_files(keyed, root, keys, ["arrived_at", "click_id"])
    final = compact(spark, root, files, keys, small=share(600), limit=share(500))
    held = digests(final, id_col="click_id", value_col="value").withColumnsRenamed({"min_id": "min_click_id", "max_id": "max_click_id"})
    return final.drop("n_rows").join(held, "path").select(*keys, "n_rows", "min_click_id", "max_click_id", "cents", "sources", "ids_sha256", "columns", F.col("path"), "rewritten")


QUERIES["op11_compaction"] = op11_compaction


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations

    return collocations(spark, table(spark, sf_dir, "documents"))


QUERIES["op12_collocations"] = op12_collocations
ORACLE_SQL["op12_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces),
sizes(k) AS (VALUES (1), (2), (3), (4), (5)),
grams AS (SELECT lang, k, unnest(list_transform(generate_series(1, len(ws) - k + 1), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM w JOIN sizes ON len(ws) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= 100),
cuts AS (SELECT lang, phrase, a, cut, array_to_string(ws[1:cut], ' ') AS head, array_to_string(ws[cut + 1:], ' ') AS tail FROM (SELECT *, unnest(generate_series(1, k - 1)) AS cut FROM cand)),
best AS (
  SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, n, ((1000::HUGEINT * c.a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score, cut
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.head JOIN f y ON y.lang = c.lang AND y.phrase = c.tail JOIN totals t ON t.lang = c.lang
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, cut) = 1),
inside AS (
  SELECT DISTINCT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, a AS longer
  FROM (SELECT *, unnest(generate_series(1, k - m + 1)) AS i FROM (SELECT *, unnest(generate_series(2, k - 1)) AS m FROM cand WHERE k > 2))),
kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = b.lang AND i.phrase = b.phrase AND i.longer >= b.a)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score FROM numbered WHERE rank <= 2000
"""


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(spark, table(spark, sf_dir, "documents"), tokenizer_path=public_tokenizers.path("byte_bpe_50k.json"))


QUERIES["op13_packing"] = op13_packing
