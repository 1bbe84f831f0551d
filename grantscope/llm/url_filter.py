"""URL verdicts: explicit rules first, then gradient-boosted trees.

A rule is a host suffix and a path prefix; the longest rule that fits decides.
All other URLs are judged by boosted regression trees on lexical features: length,
depth, digit ratio, entropy, parameter counts and statistics of the host's suffix.
The trees learn from labelled URLs: a table of them, or those that a rule decides.  A
URL's suffix statistics never count the URL itself: they leave out its fold.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_LABELLED = 20_000
SUFFIXES, FOLDS = 1 << 16, 4


#: Host name parts of sites that no corpus wants, used to label URLs.
UNWANTED = (
    "adult", "ads", "advert", "bet", "bets", "betting", "casino", "escort", "gambling", "hentai", "lottery", "malware", "nude",
    "payday", "phishing", "pills", "poker", "porn", "sex", "slots", "spam", "torrent", "tracker", "viagra", "warez", "xxx",
)


@dataclass(frozen=True)
class Rule:
    """``host`` with all its subdomains, and paths that start with ``path``."""

    host: str
    path: str
    allow: bool

    @classmethod
    def of(cls, text: str, allow: bool) -> Rule:
        host, slash, path = text.partition("/")
        return cls(host, slash + path, allow)

    @property
    def text(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def matched(rules: Sequence[Rule], host: Column, path: Column) -> Column:
    """The longest rule that fits, as struct(rule, allow), else null; at equal length a block wins."""
    best = F.lit(None).cast("struct<rule:string,allow:boolean>")
    for r in sorted(rules, key=lambda r: (len(r.text), not r.allow, r.text)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        best = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.allow).alias("allow"))).otherwise(best)
    return best


def with_rules(urls: DataFrame, rules: Sequence[Rule] | DataFrame) -> DataFrame:
    """Adds ``m``, the rule of :func:`matched`, to rows with ``host`` and ``path``.

    A table of rules (host, path, allow) of any length is joined on the suffixes of the
    hosts, each different host and path once; rules of a host are tried one by one and
    only those that fit go on.
    """
    if not isinstance(rules, DataFrame):
        return urls.withColumn("m", matched(rules, F.col("host"), F.col("path")))
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    each = urls.select("host", "path").distinct().select("host", "path", F.explode(suffixes).alias("_suffix"))
    own = rules.select(F.col("host").alias("_host"), F.col("path").alias("_path"), "allow").where("_host is not null and _path is not null and allow is not null")
    hits = each.join(own, (F.col("_suffix") == F.col("_host")) & F.startswith(F.col("path"), F.col("_path")))
    text = F.concat("_host", "_path")
    best = hits.groupBy("host", "path").agg(F.max(F.struct(F.length(text).alias("n"), (~F.col("allow")).alias("block"), text.alias("rule"))).alias("best"))
    best = best.select("host", "path", F.struct(F.col("best.rule").alias("rule"), (~F.col("best.block")).alias("allow")).alias("m"))
    return urls.join(best, ["host", "path"], "left")


def suffix_slot(host: Column) -> Column:
    """A slot of a fixed number for the host's last three labels."""
    return F.pmod(F.xxhash64(F.substring_index(host, ".", -3)), F.lit(SUFFIXES)).cast("int")


def by_host_words(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Labelled URLs: ``blocked`` if a part of the host name is an unwanted word."""
    host, _ = host_and_path(F.col(url_col))
    parts = F.split(host, r"[^a-z]+")
    return pages.select(F.col(url_col).alias("url"), F.arrays_overlap(parts, F.array(*[F.lit(w) for w in UNWANTED])).alias("blocked"))


def fold_of(url: Column) -> Column:
    return F.pmod(F.xxhash64(url, F.lit(1)), F.lit(FOLDS)).cast("int")


def suffix_stats(known: DataFrame) -> np.ndarray:
    """(blocked share, log count) by fold and suffix slot, over the labelled URLs of all other folds."""
    blocked = F.col("blocked").cast("long")
    sums = [x for f in range(FOLDS) for x in (F.count_if(F.col("fold") == f), F.coalesce(F.sum(F.when(F.col("fold") == f, blocked)), F.lit(0)))]
    held = np.zeros((2 * FOLDS, SUFFIXES))
    for slot, *own in known.groupBy("slot").agg(*[x.alias(f"s{k}") for k, x in enumerate(sums)]).toLocalIterator():  # a row per slot at most
        held[:, slot] = own
    n, bad = held[::2], held[1::2]
    n, bad = n.sum(0) - n, bad.sum(0) - bad
    prior = bad.sum(1, keepdims=True) / np.maximum(1, n.sum(1, keepdims=True))
    return np.stack([(bad + 20 * prior) / (n + 20), np.log1p(n)], 2).astype(np.float32)


def features(urls: list[str | None], hosts: list[str], paths: list[str], folds: np.ndarray, slots: np.ndarray, stats: np.ndarray) -> np.ndarray:
    """One row of lexical features per URL; ``stats`` holds (blocked share, log count) by fold and suffix slot."""
    rows = []
    for url, host, path in zip(urls, hosts, paths, strict=True):
        url = url or ""
        n = len(url)
        counts = np.bincount(np.frombuffer(url.encode("utf-8", "replace"), np.uint8), minlength=1) if n else np.zeros(1)
        p = counts[counts > 0] / max(1, counts.sum())
        query = url.partition("#")[0].partition("?")[2]
        digits = sum(c.isdigit() for c in url)
        rows.append((
            n, len(host), len(path), path.count("/"), digits / max(1, n), sum(c.isdigit() for c in host),
            float(-(p * np.log2(p)).sum()), len([x for x in query.split("&") if x]), len(query), "#" in url,
            host.count("."), host.count("-"), path.count("-") + path.count("_"), path.endswith("/"), "." in path.rpartition("/")[2], url.startswith("https"),
        ))
    lexical = np.array(rows, np.float32).reshape(len(urls), 16)
    return np.concatenate([lexical, stats[folds, slots]], 1)


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    """Where bins of a feature begin: at each value if they are few, else at quantiles of the rows and of the values, so that rare ones have bins too."""
    values = np.unique(x)
    if len(values) <= bins:
        return values[1:]
    return np.unique(np.concatenate([np.quantile(x, np.linspace(0, 1, bins // 2 + 1)[1:-1]), np.quantile(values, np.linspace(0, 1, bins // 2 + 1)[1:-1])]))


class Trees:
    """Boosted regression trees for log loss, on features cut into bins."""

    def __init__(self, cuts: list[np.ndarray], base: float, trees: list[tuple]):
        self.cuts, self.base, self.trees = cuts, base, trees

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 1.0) -> Trees:
        share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
        base = float(np.log(share / (1 - share)))
        cuts = [_cuts(x[:, f], bins) for f in range(x.shape[1])]
        model = cls(cuts, base, [])
        if not len(y) or y.min() == y.max():
            return model
        binned = model._bin(x)
        margin = np.full(len(y), base)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = y - p, p * (1 - p)
            tree = model._grow(binned, grad, hess, depth, bins, ridge, rate)
            model.trees.append(tree)
            margin += model._leaf(tree, binned)
        return model

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, f], "right") for f, c in enumerate(self.cuts)], 1)

    def _grow(self, b, grad, hess, depth, bins, ridge, rate):
        """A full tree in heap order: feature and cut of inner nodes (-1: all go left), value of leaves."""
        n_inner = (1 << depth) - 1
        feature, cut = np.full(n_inner, -1), np.zeros(n_inner, np.int64)
        node = np.zeros(len(b), np.int64)
        for level in range(depth):
            width, base = 1 << level, (1 << level) - 1
            gain = np.full((width, b.shape[1], bins), -np.inf)
            for f in range(b.shape[1]):
                key = (node - base) * bins + b[:, f]
                g = np.bincount(key, grad, width * bins).reshape(width, bins)
                h = np.bincount(key, hess, width * bins).reshape(width, bins)
                gl, hl = g.cumsum(1), h.cumsum(1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain[:, f] = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            flat = gain.reshape(width, -1)
            best = flat.argmax(1)
            use = flat[np.arange(width), best] > 1e-6
            feature[base : base + width] = np.where(use, best // bins, -1)
            cut[base : base + width] = best % bins
            node = 2 * node + 1 + self._right(feature, cut, node, b)
        leaf = node - n_inner
        size = 1 << depth
        value = np.bincount(leaf, grad, size) / (np.bincount(leaf, hess, size) + ridge) * rate
        return feature, cut, value

    @staticmethod
    def _right(feature, cut, node, b):
        f = feature[node]
        return np.where(f >= 0, b[np.arange(len(b)), np.maximum(f, 0)] > cut[node], False).astype(np.int64)

    def _leaf(self, tree, b) -> np.ndarray:
        feature, cut, value = tree
        node = np.zeros(len(b), np.int64)
        while len(node) and node[0] < len(feature):
            node = 2 * node + 1 + self._right(feature, cut, node, b)
        return value[node - len(feature)] if len(node) else np.zeros(0)

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self._bin(x)
        return self.base + sum((self._leaf(t, b) for t in self.trees), np.zeros(len(x)))


def judge_urls(
    spark: SparkSession,
    pages: DataFrame,
    rules: Sequence[Rule] | DataFrame,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    labelled: DataFrame | None = None,
    max_labelled: int = MAX_LABELLED,
    threshold: float = 0.5,
) -> DataFrame:
    """Host, path, rule and verdict of every URL.

    ``rules`` is a short list, or a table (host, path, allow) of any length.  ``labelled``
    has ``url`` and ``blocked`` (boolean); without it the URLs that a rule decides are the
    labelled ones.  Suffix statistics count all of them but for the fold of the URL judged;
    the trees learn from at most ``max_labelled`` different URLs (those of least hash), of
    a URL with several labels from their mean.

    Returns the id, ``host``, ``path``, ``rule`` (null if none fits), ``verdict``
    (``allow`` or ``block``) and ``blocked_score`` (the trees' probability).  A null
    URL, and one without ``://``, has empty host and path and is judged by the trees; a URL
    of any length is judged whole.  Repeated rows get equal verdicts; of rules of equal
    length a block wins; a score equal to ``threshold`` blocks.  Without labels the trees
    allow.  Other columns are ignored; an empty table gives an empty result.
    """
    host, path = host_and_path(F.col("url"))
    parts = lambda df: df.withColumn("host", host).withColumn("path", path).withColumn("slot", suffix_slot(F.col("host"))).withColumn("fold", fold_of(F.col("url")))
    slim = with_rules(parts(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))), rules)
    if labelled is None:
        known = slim.where("m is not null").withColumn("blocked", ~F.col("m.allow"))
    else:
        known = parts(labelled.select("url", "blocked").where("blocked is not null"))
    stats = suffix_stats(known)
    # only about twice as many different URLs as are wanted reach the sort, however large the table and however often one is repeated
    place = F.pmod(F.xxhash64("url"), F.lit(1 << 32))
    share = min(1.0, 2.0 * max_labelled / max(1, known.agg(F.approx_count_distinct("url")).first()[0]))
    near = known.where(place < int(share * (1 << 32))).groupBy("url", "host", "path", "slot", "fold").agg(F.avg(F.col("blocked").cast("double")).alias("blocked"))
    rows = near.orderBy(place, "url").limit(max_labelled).collect()
    column = lambda name: np.array([r[name] for r in rows], np.int64)
    x = features([r["url"] for r in rows], [r["host"] for r in rows], [r["path"] for r in rows], column("fold"), column("slot"), stats)
    # one fold is learned as if nothing were known of its suffixes, so that the trees know what to make of new hosts
    strange = column("fold") == 0
    x[strange, -2], x[strange, -1] = stats[0, :, 0][stats[0, :, 1] == 0].mean() if (stats[0, :, 1] == 0).any() else 0.5, 0
    sent = spark.sparkContext.broadcast((Trees.fit(x, np.array([r["blocked"] for r in rows], float)) if rows else None, stats))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, st = sent.value
        for batch in batches:
            url, h, p = (batch.column(n).to_pylist() for n in ("url", "host", "path"))
            score = np.zeros(batch.num_rows)
            if trees is not None and batch.num_rows:
                score = 1 / (1 + np.exp(-trees.margin(features(url, h, p, batch.column("fold").to_numpy(), batch.column("slot").to_numpy(), st))))
            keep = [batch.column(n) for n in ("id", "host", "path", "rule", "allow")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(score)], ["id", "host", "path", "rule", "allow", "blocked_score"])

    kind = slim.schema["id"].dataType.simpleString()
    out = slim.select("id", "url", "host", "path", "fold", "slot", F.col("m.rule").alias("rule"), F.col("m.allow").alias("allow"))
    out = out.mapInArrow(run, f"id {kind}, host string, path string, rule string, allow boolean, blocked_score double")
    block = F.coalesce(~F.col("allow"), F.col("blocked_score") >= threshold)
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.when(block, "block").otherwise("allow").alias("verdict"), "blocked_score")
