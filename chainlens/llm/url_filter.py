"""URL filter: rules first, gradient-boosted trees on lexical features for the rest (DataFrame functions only).

A rule is (action, host, path): it fits its host and all subdomains when the url's path starts with
its path; of several the longest rule wins, of equally long ones the later in the list.  URLs that no rule decides are judged by a boosted
ensemble trained from labelled URLs (by default those the rules decide).  Features are binned at
fixed thresholds, so training works on counts of distinct bin vectors; every tree level is one
aggregate to a histogram of (node, feature, bin), at most ``2**depth * features * bins`` rows, from
which the splits are chosen.  All gradient sums are integers (billionths), so reruns agree.

Trees are ordinary column expressions: judging a table is a projection without a shuffle, but for
the suffix statistics (one aggregate of a row per top-level name, joined back).

Defined results: a NULL url or one without ``://`` has empty host and path and fits no rule; its
features are those of the empty string; ids may be NULL or repeated; without labelled rows of both
actions the method allows everything (or blocks, where only blocked rows exist); other columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainlens.llm.common import written

ALLOW, BLOCK = "allow", "block"

# Upper thresholds of the bins of every feature.
BINS = {
    "url_length": (20, 25, 30, 35, 40, 45, 50, 55, 60, 70, 80, 100, 150),
    "host_length": (10, 13, 16, 19, 22, 25, 28, 32, 40, 60),
    "depth": (0, 1, 2, 3, 4, 5, 6, 8),
    "labels": (1, 2, 3, 4, 5),
    "hyphens": (0, 1, 2, 3, 5),
    "digit_ratio": (0.0, 0.02, 0.04, 0.06, 0.08, 0.10, 0.13, 0.17, 0.22, 0.30),
    "entropy": (2.0, 2.6, 3.0, 3.2, 3.4, 3.6, 3.7, 3.8, 3.9, 4.0, 4.1, 4.2, 4.4, 4.7),
    "parameters": (0, 1, 2, 3, 5, 8),
    "suffix_block_rate": (0.05, 0.15, 0.25, 0.35, 0.45, 0.55, 0.65, 0.75, 0.85, 0.95),
    "suffix_share": (0.001, 0.01, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5),
}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_UNIT = 1_000_000_000
#: folds of the labelled hosts for the suffix rates, and the name of all of them together
FOLDS, WHOLE = 5, -1


def url_parts(url: Column) -> tuple[Column, Column]:
    """``(host, path)``: host after the first ``://``, A-Z lower-cased; path up to ``?`` or ``#``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, pattern, 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """``(rule text, action)`` of the longest rule that fits, else NULL."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, action = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(act)).otherwise(action)
    return name, action


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def lexical_features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Features of a URL alone (the suffix statistics come from a table)."""
    text = F.coalesce(url, F.lit(""))
    size = F.greatest(F.length(text), F.lit(1))
    digits = F.length(text) - F.length(F.regexp_replace(text, "[0-9]", ""))
    query = F.regexp_extract(text, r"(?s)\?([^#]*)", 1)
    chars = F.array_distinct(F.split(text, ""))

    def part(total, c):
        p = (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / size
        return total + F.when((F.length(c) > 0) & (p > 0), -p * F.log2(p)).otherwise(F.lit(0.0))

    return {
        "url_length": F.length(text), "host_length": F.length(host), "depth": _count(path, "/"),
        "labels": F.when(host == "", 0).otherwise(_count(host, ".") + 1), "hyphens": _count(host, "-"),
        "digit_ratio": digits / size, "entropy": F.aggregate(chars, F.lit(0.0), part),
        "parameters": F.when(query == "", 0).otherwise(_count(query, "&") + 1),
    }


def _binned(value: Column, name: str) -> Column:
    return reduce(lambda rest, kt: F.when(value <= kt[1], F.lit(kt[0])).otherwise(rest),
                  reversed(list(enumerate(BINS[name]))), F.lit(len(BINS[name]))).cast("int")


def suffix_statistics(labelled: DataFrame, smooth: float = 20.0) -> DataFrame:
    """``suffix`` (last label of the host), its smoothed block rate and its share of the labelled rows, for
    each ``fold`` of the hosts without that fold's labels, and with all of them as fold ``WHOLE``.

    A training row gets the rate of the other folds, so neither its own label nor another one of its host is among its
    features.
    """
    per = labelled.groupBy("suffix", "fold").agg(F.sum(F.col("blocked").cast("long")).alias("b"),
                                                 F.count(F.lit(1)).alias("n"))
    whole = per.groupBy("suffix").agg(F.sum("b").alias("wb"), F.sum("n").alias("wn"))
    total = whole.agg(F.sum("wb").alias("tb"), F.sum("wn").alias("tn"))
    left = per.join(whole, "suffix").select("suffix", "fold", (F.col("wb") - F.col("b")).alias("b"),
                                            (F.col("wn") - F.col("n")).alias("n"), "wn")
    rows = left.union(whole.select("suffix", F.lit(WHOLE), "wb", "wn", "wn"))
    return rows.crossJoin(F.broadcast(total)).select(  # total is one row
        "suffix", "fold", ((F.col("b") + smooth * F.col("tb") / F.col("tn")) / (F.col("n") + smooth)).alias("rate"),
        (F.col("wn") / F.col("tn")).alias("share"))


def train_trees(binned: DataFrame, trees: int = 12, depth: int = 3, rate: float = 0.3, ridge: float = 1.0,
                min_rows: int = 5) -> tuple[float, list]:
    """``(prior margin, trees)`` from ``blocked``, ``n`` and one bin column per feature.

    A tree is ``{node: (feature, bin) or leaf value}``; node k has children 2k and 2k + 1, rows whose
    bin is at most the split's go to 2k.
    """
    names = list(BINS)
    total = binned.agg(F.sum(F.when(F.col("blocked"), F.col("n"))).alias("b"), F.sum("n").alias("n")).first()
    b, n = int(total["b"] or 0), int(total["n"] or 0)
    if b in (0, n):
        return (math.inf if n and b == n else -math.inf), []
    prior, grown = math.log(b / (n - b)), []
    for _ in range(trees):
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-margin(prior, grown)))
        rows = binned.withColumn("g", F.round((p - F.col("blocked").cast("double")) * _UNIT).cast("long")).withColumn(
            "h", F.round(p * (1 - p) * _UNIT).cast("long"))
        tree: dict = {}
        for level in range(depth):
            pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(c).alias("bin"))
                                        for i, c in enumerate(names)])).alias("x")
            hist = (rows.withColumn("node", _node(tree, level)).where("node is not null")
                    .select("node", "g", "h", "n", pairs).groupBy("node", "x.f", "x.bin")
                    .agg(F.sum(F.col("g") * F.col("n")).alias("g"), F.sum(F.col("h") * F.col("n")).alias("h"),
                         F.sum("n").alias("n")).collect())
            by_node: dict = {}
            for r in hist:
                by_node.setdefault(r["node"], {}).setdefault(r["f"], []).append((r["bin"], r["g"], r["h"], r["n"]))
            for node, features in by_node.items():
                g, h = (sum(x[k] for x in features[0]) / _UNIT for k in (1, 2))
                tree[node], left = _split(features, names, ridge, min_rows)
                if tree[node] is None:
                    tree[node] = _leaf(g, h, rate, ridge)
                else:  # leaves, unless the next level splits them
                    tree[2 * node] = _leaf(*left, rate, ridge)
                    tree[2 * node + 1] = _leaf(g - left[0], h - left[1], rate, ridge)
            if not any(isinstance(tree[k], tuple) for k in by_node):
                break
        grown.append(tree)
    return prior, grown


def _leaf(g: float, h: float, rate: float, ridge: float) -> float:
    return -rate * g / (h + ridge)


def _split(features: dict, names: list, ridge: float, min_rows: int):
    """The best ``(feature, bin)`` of a node and its left part's sums; ``(None, None)`` where no split gains."""
    best = (1e-6, None, None)
    for f in sorted(features):
        bins = sorted(features[f])
        g, h, n = (sum(x[k] for x in bins) for k in (1, 2, 3))
        lg = lh = ln = 0
        for b, xg, xh, xn in bins[:-1]:
            lg, lh, ln = lg + xg, lh + xh, ln + xn
            if min(ln, n - ln) < min_rows:
                continue
            score = [(u / _UNIT) ** 2 / (v / _UNIT + ridge) for u, v in ((lg, lh), (g - lg, h - lh), (g, h))]
            gain = score[0] + score[1] - score[2]
            if gain > best[0] + 1e-12:
                best = (gain, (names[f], b), (lg / _UNIT, lh / _UNIT))
    return best[1:]


def _node(tree: dict, level: int) -> Column:
    """The node of ``level`` a row is in, NULL where its branch has ended."""
    def walk(k, left):
        if not left:
            return F.lit(k)
        if not isinstance(tree.get(k), tuple):
            return F.lit(None).cast("int")
        f, b = tree[k]
        return F.when(F.col(f) <= b, walk(2 * k, left - 1)).otherwise(walk(2 * k + 1, left - 1))

    return walk(1, level)


def margin(prior: float, trees: list) -> Column:
    """Log-odds of block as a column expression over the bin columns."""
    def value(tree, k):
        if not isinstance(tree[k], tuple):
            return F.lit(float(tree[k]))
        f, b = tree[k]
        return F.when(F.col(f) <= b, value(tree, 2 * k)).otherwise(value(tree, 2 * k + 1))

    return reduce(lambda a, t: a + value(t, 1), trees, F.lit(float(prior)))


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], labelled: DataFrame | None = None,
                id_col: str = "page_id", url_col: str = "url", train_rows: int = 50_000, suffixes: bool = True, **training) -> DataFrame:
    """One row per input row: ``id_col``, ``host``, ``path``, ``rule``, ``verdict``, ``block_odds``.

    ``labelled`` has ``url`` and ``blocked`` (boolean); without it the rows that a rule decides are the
    labels.  About ``train_rows`` of them, chosen by the hash of the url, train the trees; the suffix
    statistics are of all.  With ``suffixes=False`` the trees see no suffix statistics.
    """
    def described(df, url):
        df = df.withColumn("_u", url)
        host, path = url_parts(F.col("_u"))
        return df.withColumn("host", host).withColumn("path", path).withColumn(
            "suffix", F.regexp_extract("host", r"([^.]*)$", 1))

    rows = described(pages.select(F.col(id_col), F.col(url_col).cast("string").alias("_u")), F.col("_u"))
    rule, action = matching_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("action", action)
    if labelled is None:
        known = rows.where("action is not null").select("_u", "host", "path", "suffix",
                                                        (F.col("action") == BLOCK).alias("blocked"))
    else:
        known = described(labelled.where("blocked is not null").select("blocked", F.col("url").alias("_u")),
                          F.col("_u"))
    known = known.withColumn("fold", F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int"))
    statistics = written(suffix_statistics(known).where(F.lit(suffixes)), "suffixes")

    def binned(df):
        df = df.join(statistics, ["suffix", "fold"], "left")
        features = lexical_features(F.col("_u"), F.col("host"), F.col("path"))
        features["suffix_block_rate"] = F.coalesce("rate", F.lit(0.5))
        features["suffix_share"] = F.coalesce("share", F.lit(0.0))
        # in a step of its own, so that a feature is computed once a row and not at each threshold
        return df.withColumns(features).withColumns({c: _binned(F.col(c), c) for c in features})

    n = known.count()
    if n > train_rows:
        known = known.where(F.pmod(F.xxhash64("_u"), F.lit(2**31 - 1)) < int(train_rows / n * (2**31 - 1)))
    counts = written(binned(known).groupBy("blocked", *BINS).agg(F.count(F.lit(1)).alias("n")), "url-train")
    prior, trees = train_trees(counts, **training)
    judged = binned(rows.withColumn("fold", F.lit(WHOLE))).withColumn("block_odds", margin(prior, trees))
    verdict = F.coalesce("action", F.when(F.col("block_odds") > 0, BLOCK).otherwise(ALLOW))
    return judged.select(id_col, "host", "path", "rule", verdict.alias("verdict"), "block_odds")
