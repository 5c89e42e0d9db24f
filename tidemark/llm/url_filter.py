"""URL filters: explicit host and path rules, and gradient-boosted trees on lexical features for all other URLs.

Only DataFrame functions and the trees of the engine's own library run; no Python reaches the executors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, written

#: Verdict and rule (host, then path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Bound of the labelled sample that the trees are fitted on: first by a hash of the URL.
SAMPLE_URLS = 4000
#: A URL that no rule lists counts as allowed at this weight: leaving it out is a weak label too, and without it
#: a suffix that only block rules name would be blocked as a whole.
UNLISTED_WEIGHT = 0.25
TREES = 10
DEPTH = 3
SEED = 7
#: Characters whose shares make up a URL's entropy; any other counts together as one.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789-._/:?&=%#"
#: Weight of the overall block rate in the rate of a suffix or first path segment.
SMOOTHING = 10.0
#: Hosts fall into so many folds: a training row's rates are those of the other folds' hosts.
FOLDS = 5
LEAST_LEAF = 40

KEYS = ("tld", "suffix", "segment")
FEATURES = (
    "length", "host_length", "depth", "labels", "digit_ratio", "hyphens", "entropy", "parameters", "fragment", "extension", "secure",
        *(f"{k}_rate" for k in KEYS)
)


def url_parts(url: Column) -> tuple[Column, Column]:
    """``(host, path)``: host after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path then
    up to ``?``, ``#`` or the end. Both empty without ``://``, or for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """``(rule, verdict)`` of the longest rule that fits, else nulls: host equal or a subdomain, path by its start."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        r_host, _, r_path = text.partition("/")
        fits = ((host == r_host) | host.endswith("." + r_host)) & path.startswith("/" + r_path)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def lexical_features(pages: DataFrame) -> DataFrame:
    """``pages`` (columns ``url, host, path``) with lexical columns, none of them null."""
    url = F.lower(F.coalesce("url", F.lit("")))
    n = F.greatest(F.length(url), F.lit(1))
    lacking = lambda chars: F.length(F.translate(url, chars, ""))
    counts = [F.length(url) - lacking(c) for c in ALPHABET] + [lacking(ALPHABET)]
    share = lambda c: F.when(c > 0, -(c / n) * F.log2(c / n)).otherwise(F.lit(0.0))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return pages.withColumns(
        {
            "length": F.length(url).cast("double"),
            "host_length": F.length("host").cast("double"),
            "depth": F.size(F.filter(F.split("path", "/"), lambda x: x != "")).cast("double"),
            "labels": F.size(F.split("host", r"\.")).cast("double"),
            "digit_ratio": ((F.length(url) - lacking("0123456789")) / n).cast("double"),
            "hyphens": (F.length("host") - F.length(F.translate("host", "-", ""))).cast("double"),
            "entropy": reduce(lambda a, b: a + b, map(share, counts)),
            "parameters": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))).cast("double"),
            "fragment": F.contains(url, F.lit("#")).cast("double"),
            "extension": F.col("path").rlike(r"\.[A-Za-z0-9]{1,5}$").cast("double"),
            "secure": url.startswith("https:").cast("double"),
            "tld": F.substring_index("host", ".", -1),
            "suffix": F.substring_index("host", ".", -2),
            "segment": F.regexp_extract("path", "^/([^/]*)", 1),
            "fold": F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int"),
        }
    )


def labelled_rows(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """All rows with lexical columns, ``rule``, ``ruled`` (the rule's verdict) and, where there is a host, ``label``
    and ``weight``: a rule's verdict counts whole, a URL that no rule lists as weakly allowed."""
    parts = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    host, path = url_parts(F.col("url"))
    parts = parts.withColumns({"host": host, "path": path})
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    rows = lexical_features(parts.withColumns({"rule": rule, "ruled": verdict}))
    there = F.col("ruled").isNotNull() | (F.col("host") != "")
    label = F.coalesce((F.col("ruled") == "block").cast("double"), F.lit(0.0))
    weight = F.when(F.col("ruled").isNotNull(), 1.0).otherwise(UNLISTED_WEIGHT)
    return rows.withColumns({"label": F.when(there, label), "weight": F.when(there, weight)})


class UrlTrees:
    """Boosted trees on lexical features. Rates of suffixes and first path segments are counted over all rows and
    joined without a broadcast; the trees are fitted on a bounded sample, weighted up to the rows it stands for."""

    def __init__(self, rows: DataFrame, sample: int = SAMPLE_URLS, without_fold: int | None = None):
        known = rows.where("label is not null")
        known = known if without_fold is None else known.where(F.col("fold") != without_fold)
        listed = F.col("ruled").isNotNull()
        sizes = {r.listed: (r.n, r.blocked) for r in known.groupBy(listed.alias("listed")).agg(F.count(F.lit(1)).alias("n"),
            F.sum("label").alias("blocked")).collect()}
        n, blocked = sizes.get(True, (0, 0.0))
        free = sizes.get(False, (0, 0.0))[0]
        self.model, self.only = None, "block" if n and blocked else "allow"
        if not n or blocked in (0.0, float(n)):
            return
        self.prior = blocked / (n + UNLISTED_WEIGHT * free)
        sums = [F.sum(F.col("label") * F.col("weight")).alias("hits"), F.sum("weight").alias("mass")]
        self.counts = {k: written(known.groupBy(F.col(k), F.col("fold").alias("of_fold")).agg(*sums), f"url-{k}") for k in KEYS}
        first = [F.xxhash64("url"), F.col("page_id")]
        parts = [known.where(which).orderBy(*first).limit(sample).withColumn("weight", F.col("weight") * max(1.0,
            total / sample)) for which, total in ((listed, n), (~listed, free))]
        chosen = written(parts[0].unionByName(parts[1]), "url-sample")
        for k, counts in self.counts.items():
            keys = F.broadcast(chosen.select(k, "fold").distinct())  # as many rows as the sample at most
            rates = counts.join(keys, k).where("fold <> of_fold").groupBy(k, "fold").agg(self._rate(k))
            chosen = chosen.join(F.broadcast(rates), [k, "fold"], "left").fillna(self.prior, f"{k}_rate")
        trees = GBTClassifier(labelCol="label", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, minInstancesPerNode=LEAST_LEAF,
            seed=SEED, stepSize=0.3)
        self.assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
        self.model = trees.fit(self.assembler.transform(chosen).select("features", "label", "weight"))

    def _rate(self, key: str) -> Column:
        return ((F.sum("hits") + SMOOTHING * self.prior) / (F.sum("mass") + SMOOTHING)).alias(f"{key}_rate")

    def verdicts(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``found``: block or allow."""
        if self.model is None:
            return rows.withColumn("found", F.lit(self.only))
        for k, counts in self.counts.items():
            rates = written(counts.groupBy(k).agg(self._rate(k)), f"url-{k}-rates")
            rows = rows.join(rates.hint("merge"), k, "left").fillna(self.prior, f"{k}_rate")
        judged = self.model.transform(self.assembler.transform(rows))
        return judged.withColumn("found", F.when(F.col("prediction") > 0.5, F.lit("block")).otherwise(F.lit("allow")))


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, sample: int = SAMPLE_URLS) -> DataFrame:
    """One row per input row: ``page_id, host, path, rule, verdict``.

    A rule's verdict stands. URLs that a rule judges are also the labelled ones: trees fitted on a sample of them, of
    bounded size, with unlisted URLs as weakly allowed, judge all others, null and malformed ones included. With
    labels of one kind only that verdict is given, with none ``allow``. Of fitting rules of equal length the one given
    last holds. Repeated rows are rows of their own; an empty
    table gives no rows; other columns are not read.
    """
    rows = labelled_rows(pages, id_col, url_col, rules)
    keep = [F.col(c) for c in ("page_id", "host", "path", "rule")]
    trees = UrlTrees(rows, sample)
    listed = rows.where("ruled is not null").select(*keep, F.col("ruled").alias("verdict"))
    return listed.unionByName(trees.verdicts(rows.where("ruled is null")).select(*keep, F.col("found").alias("verdict")))
