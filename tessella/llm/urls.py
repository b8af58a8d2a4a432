"""URL filters: allow and block rules, and gradient-boosted trees for the urls that no rule names.
DataFrame functions only.

Labelled urls are those that a rule decides. Trees are trained on lexical features of these: length,
depth, digit ratio, entropy, parameter counts, and statistics of the suffix (last host label), of the
registered domain (last two), of the first host label, of the first path segment and of the suffix with
that segment: the share of blocked urls among the labelled ones that have the same, and how many
those are. A labelled url's statistics leave out its own fold (a tenth of the urls, by hash), so the
trees learn from shares as new urls will have them.

The statistics are aggregates over all labelled urls and go back to the pages by joins, for the kinds
that the trees use. The trees are fitted on the driver from a bounded sample: the ``train_rows`` labelled urls that come first in the
order of a hash, cut into bins at quantiles and counted by distinct bins. The model is a CASE expression,
so scoring is a narrow projection.

Cases: null urls and urls without ``://`` have empty host and path, match no rule and are judged by
the trees like any other; without labelled urls everything that no rule names is allowed; repeated
rows and very long urls are judged one by one; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import first_by_hash, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host and path prefix)
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
LEXICAL = ("url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "mark_ratio", "entropy", "parameters")
#: What statistics are kept of.
KINDS = ("suffix", "domain", "first", "segment", "suffix_segment")
PARENT = {"domain": "suffix", "suffix_segment": "segment"}
FEATURES = (*LEXICAL, *(f"{k}_share" for k in KINDS), *(f"{k}_known" for k in KINDS))
FOLDS = 10


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path), both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.substr(url, F.instr(url, "://") + 3), "#", 1))
    rest = F.coalesce(F.substring_index(rest, "?", 1), F.lit(""))
    slash = F.instr(rest, "/")
    host = F.when(slash > 0, F.substr(rest, F.lit(1), slash - 1)).otherwise(rest)
    return F.translate(host, UPPER, LOWER), F.when(slash > 0, F.substr(rest, slash)).otherwise("")


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits host and path, or null: its host is that of the url or a parent
    domain, and the url's path starts with its path. For some hundreds of rules at most."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        domain, _, prefix = rule.partition("/")
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit("/" + prefix))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def entropy(text: Column) -> Column:
    """Bits a character, of the text's own characters."""
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    share = lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n
    return F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda s, c: s + F.when(F.length(c) > 0, -share(c) * F.log2(F.greatest(share(c), F.lit(1e-12)))).otherwise(0.0))


def lexical(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, the features that need no statistics, and what statistics are kept of."""
    url = F.coalesce("url", F.lit(""))
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", url.alias("url"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("rule", matching_rule(F.col("host"), F.col("path")))
    n, url = F.greatest(F.length("url"), F.lit(1)), F.col("url")
    query = F.substring_index(F.when(F.instr(url, "?") > 0, F.substr(url, F.instr(url, "?"))).otherwise(""), "#", 1)
    return rows.withColumns({
        "url_length": F.length("url").cast("double"), "host_length": F.length("host").cast("double"), "path_length": F.length("path").cast("double"),
        "depth": _count(F.col("path"), "/").cast("double"), "labels": _count(F.col("host"), ".").cast("double"),
        "digit_ratio": _count(url, "0123456789") / n, "mark_ratio": _count(url, "-_%~=&") / n, "entropy": entropy(F.col("host")),
        "parameters": F.when(F.length(query) > 0, _count(query, "&") + 1.0).otherwise(0.0),
        **_kinds(F.col("host"), F.col("path")),
    })


def _kinds(host: Column, path: Column) -> dict[str, Column]:
    suffix, domain, segment = F.substring_index(host, ".", -1), F.substring_index(host, ".", -2), F.substring_index(F.substr(path, F.lit(2)), "/", 1)
    found = {"suffix": suffix, "domain": domain, "first": F.substring_index(host, ".", 1), "segment": segment, "suffix_segment": F.concat(suffix, F.lit("/"), segment)}
    # 64-bit numbers: long hosts and paths do not travel with the statistics.
    return {k: F.xxhash64(F.lit(k), c) for k, c in found.items()}


@dataclass
class Trees:
    edges: dict[str, list[float]]
    start: float
    trees: list[list[tuple[tuple, float]]]

    def bins(self, feature: str) -> Column:
        return sum((F.when(F.col(feature) > e, 1).otherwise(0) for e in self.edges[feature]), F.lit(0))

    def used(self) -> list[str]:
        return sorted({f for tree in self.trees for conditions, _ in tree for f, _, _ in conditions})

    def margin(self) -> Column:
        """Over columns named like the features that hold bins."""
        out = F.lit(self.start)
        for tree in self.trees:
            value = F.lit(0.0)
            for conditions, leaf in tree:
                value = F.when(_holds(conditions), F.lit(leaf)).otherwise(value)
            out = out + value
        return out


def _holds(conditions: tuple) -> Column:
    """conditions: (feature, bin, above)"""
    out = F.lit(True)
    for feature, edge, above in conditions:
        out = out & ((F.col(feature) > edge) if above else (F.col(feature) <= edge))
    return out


class Growth:
    """The sample while trees grow: distinct rows of bins (one column for each feature), how many urls have
    them, how many of those are blocked, and the margins so far."""

    def __init__(self, bins: np.ndarray, n: np.ndarray, ones: np.ndarray, start: float, depth: int, rate: float, ridge: float) -> None:
        self.bins, self.n, self.ones, self.margin = bins, n, ones, np.full(len(n), start)
        self.depth, self.rate, self.ridge = depth, rate, ridge

    def tree(self) -> list[tuple[tuple, float]]:
        guess = 1 / (1 + np.exp(-self.margin))
        self.g, self.h = self.ones - self.n * guess, self.n * guess * (1 - guess)
        return self._grow(np.arange(len(self.n)), self.depth, ())

    def _split(self, rows: np.ndarray) -> tuple[int, int] | None:
        """The feature and bin with the largest gain; the first of equal ones."""
        g, h = self.g[rows].sum(), self.h[rows].sum()
        best, found = 1e-6, None
        for feature in range(self.bins.shape[1]):
            own = self.bins[rows, feature]
            left_g, left_h = (np.cumsum(np.bincount(own, x[rows]))[:-1] for x in (self.g, self.h))
            gain = left_g**2 / (left_h + self.ridge) + (g - left_g) ** 2 / (h - left_h + self.ridge) - g**2 / (h + self.ridge)
            gain[np.minimum(left_h, h - left_h) <= 1e-3] = 0
            if len(gain) and gain.max() > best:
                best, found = gain.max(), (feature, int(gain.argmax()))
        return found

    def _grow(self, rows: np.ndarray, depth: int, conditions: tuple) -> list[tuple[tuple, float]]:
        """Leaves as (conditions, value)."""
        found = self._split(rows) if depth and len(rows) else None
        if not found:
            value = float(self.rate * self.g[rows].sum() / (self.h[rows].sum() + self.ridge))
            self.margin[rows] += value
            return [(conditions, value)]
        feature, edge = found
        above = self.bins[rows, feature] > edge
        return [leaf for side in (False, True) for leaf in self._grow(rows[above == side], depth - 1, (*conditions, (FEATURES[feature], edge, side)))]


def train(labelled: DataFrame, *, rounds: int = 24, depth: int = 3, bins: int = 16, rate: float = 0.3, ridge: float = 1.0) -> Trees:
    """Boosted trees for ``blocked`` (0 or 1) over FEATURES. ``labelled`` is a bounded sample; what comes to
    the driver is one small row for each of its distinct rows of bins, at most."""
    cuts = [i / bins for i in range(1, bins)]
    row = labelled.agg(F.count("*").alias("n"), F.avg("blocked").alias("p"), *[F.percentile_approx(f, cuts, 1000).alias(f) for f in FEATURES]).first()
    if not row["n"]:
        return Trees({f: [] for f in FEATURES}, -2.0, [])
    p = min(max(row["p"], 1e-3), 1 - 1e-3)
    model = Trees({f: sorted(set(row[f])) for f in FEATURES}, log(p / (1 - p)), [])
    binned = labelled.select("blocked", *[model.bins(f).alias(f) for f in FEATURES])
    counted = binned.groupBy(*FEATURES).agg(F.count("*").alias("n"), F.sum("blocked").alias("ones")).orderBy(*FEATURES).collect()
    sample = np.array(counted, np.int64).reshape(len(counted), -1)
    growth = Growth(sample[:, :-2], sample[:, -2], sample[:, -1], model.start, depth, rate, ridge)
    model.trees = [growth.tree() for _ in range(rounds)]
    return model


def statistics(known: DataFrame) -> DataFrame:
    """(of, fold, share, known) from labelled urls with ``blocked``: for each value of each kind, of the urls
    outside each fold that has it, and (fold FOLDS) of all."""
    rows = known.select("blocked", "fold", F.explode(F.array(*KINDS)).alias("of"))
    counts = rows.groupBy("of", "fold").agg(F.count("*").alias("n"), F.sum("blocked").alias("ones"))
    nothing = F.struct(F.lit(FOLDS).alias("fold"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("ones"))
    folds = counts.groupBy("of").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones"), F.collect_list(F.struct("fold", "n", "ones")).alias("folds"))
    each = folds.select("of", "n", "ones", F.explode(F.array_append("folds", nothing)).alias("p"))
    n, ones = F.col("n") - F.col("p.n"), F.col("ones") - F.col("p.ones")
    return each.select("of", F.col("p.fold").alias("in_fold"), ((ones + 1) / (n + 2)).alias("share"), F.log1p(n.cast("double")).alias("known"))


def with_statistics(rows: DataFrame, stats: DataFrame, kinds: list[str]) -> DataFrame:
    """``rows`` with the shares and counts of the kinds. What no labelled url has is known 0 times and has
    the share of its parent (PARENT), or 0.5.

    Small statistics are broadcast by their measured size; else the pages are shuffled by the kind, and
    Spark splits the partition of a frequent suffix, as the statistics are a written table."""
    for kind in kinds:
        own = stats.select(F.col("of").alias("_of"), F.col("in_fold").alias("_fold"), F.col("share").alias(f"{kind}_share"), F.col("known").alias(f"{kind}_known"))
        rows = rows.join(own, (F.col(kind) == F.col("_of")) & (F.col("fold") == F.col("_fold")), "left").drop("_of", "_fold")
    shares = {f"{k}_share": F.coalesce(*(f"{x}_share" for x in (k, PARENT.get(k)) if x in kinds), F.lit(0.5)) for k in kinds}
    return rows.withColumns(shares | {f"{k}_known": F.coalesce(f"{k}_known", F.lit(0.0)) for k in kinds})


def judge(pages: DataFrame, *, train_rows: int = 20_000, threshold: float = 0.5, learn: Column | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every page; score: the trees' probability
    that the url is one to block. ``learn``: which of the labelled urls are learned (all)."""
    verdicts = {rule: verdict for verdict, rule in RULES}
    blocked = F.col("rule").isin([rule for verdict, rule in RULES if verdict == "block"]).cast("int")
    taught = F.col("rule").isNotNull() & (F.lit(True) if learn is None else learn)
    fold = F.when(taught, F.pmod(F.xxhash64("url"), F.lit(FOLDS))).otherwise(FOLDS).cast("int")
    rows = materialize(lexical(pages).withColumns({"blocked": blocked, "fold": fold}), "lexical")
    known = rows.where(F.col("fold") < FOLDS)
    stats = materialize(statistics(known), "statistics")
    sample = first_by_hash(known, known.count(), train_rows, "url", "page_id")
    model = train(materialize(with_statistics(sample, stats, list(KINDS)), "labelled"))
    used = model.used()
    kinds = {k for k in KINDS if {f"{k}_share", f"{k}_known"} & set(used)}
    rows = with_statistics(rows, stats, [k for k in KINDS if k in kinds or k in {PARENT.get(x) for x in kinds}])
    binned = rows.select("page_id", "host", "path", "rule", *[model.bins(f).alias(f) for f in used])
    score = 1 / (1 + F.exp(-model.margin()))
    verdict = F.when(score >= threshold, F.lit("block")).otherwise("allow")
    for rule, v in verdicts.items():
        verdict = F.when(F.col("rule") == rule, F.lit(v)).otherwise(verdict)
    return binned.select("page_id", "host", "path", "rule", verdict.alias("verdict"), score.alias("score"))
