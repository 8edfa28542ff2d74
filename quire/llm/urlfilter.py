"""URL filters: host and path rules, and gradient-boosted trees on lexical features for what no rule decides."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import keep

#: (host and path, verdict)
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: URLs decided by rules that the trees are fitted to, about, and as many of the others.
TRAIN_ROWS = 20_000
#: Weight of an undecided URL as a presumed allow, against 1 of a decided one.
PRESUMED = 0.25
#: Hosts are dealt to so many folds; what a page's suffix is like is learned from the other folds' hosts.
FOLDS = 5
FEATURES = ["length", "host_length", "path_length", "labels", "depth", "digits", "hyphens", "entropy", "parameters", "fragment", "suffix_share", "suffix_blocked"]
TREES, DEPTH, SEED = 12, 4, 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, with A-Z lowered; empty for null or without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From behind the host up to ?, # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """struct(rule, verdict) of the longest rule that fits the host, or a domain above it, and starts the path; else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        domain, slash, start = rule.partition("/")
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit(slash + start))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _share(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)) / F.greatest(F.length(text), F.lit(1))


def entropy(text: Column) -> Column:
    """Bits per character of an ASCII text, from the counts of its distinct characters."""
    size = F.greatest(F.length(text), F.lit(1)).cast("double")
    chars = F.array_distinct(F.split(text, ""))
    counts = F.transform(chars, lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / size)
    return F.aggregate(counts, F.lit(0.0), lambda total, p: total - F.when(p > 0, p * F.log2(p)).otherwise(0.0))


def lexical_features(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict (of the rule) and features but for the suffix's."""
    url = F.coalesce(F.col("url"), F.lit(""))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    decided = pages.select("page_id", url.alias("_url"), host.alias("host"), path.alias("path"), query.alias("_query"))
    decided = decided.withColumn("_rule", rule_for(F.col("host"), F.col("path"), RULES))
    return decided.select(
        "page_id", "host", "path", "_rule.rule", "_rule.verdict",
        F.element_at(F.split("host", r"\."), -1).alias("suffix"),
        F.xxhash64("_url").alias("_h"),
        F.length("_url").cast("double").alias("length"),
        F.length("host").cast("double").alias("host_length"),
        F.length("path").cast("double").alias("path_length"),
        F.regexp_count("host", F.lit(r"\.")).cast("double").alias("labels"),
        F.regexp_count("path", F.lit("/[^/]")).cast("double").alias("depth"),
        _share(F.col("_url"), "[0-9]").alias("digits"),
        F.regexp_count("host", F.lit("-")).cast("double").alias("hyphens"),
        entropy(F.col("_url")).alias("entropy"),
        F.when(F.col("_query") == "", 0.0).otherwise(F.regexp_count("_query", F.lit("&")) + 1.0).alias("parameters"),
        F.contains("_url", F.lit("#")).cast("double").alias("fragment"),
    )


def fold_of(host: Column) -> Column:
    return F.pmod(F.xxhash64(host), F.lit(FOLDS)).cast("int")


def with_suffix_statistics(decided: DataFrame) -> DataFrame:
    """decided with, for the last label of each host, its share of all pages, and the share that rules block among its pages of other folds of hosts.

    All pages of a host have the same two, whatever rules say of them, and no page of the host counts in the second: so the trees can't read a label
    off a feature, and what they find holds for hosts that they have not seen.
    """
    by_fold = decided.groupBy("suffix", fold_of(F.col("host")).alias("fold")).agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "block").alias("blocked"))
    by_fold = keep(by_fold, "suffixes")
    total = by_fold.agg(F.sum("n")).first()[0] or 1
    whole = by_fold.groupBy(F.col("suffix").alias("_whole")).agg(F.sum("n").alias("_all"), F.sum("blocked").alias("_all_blocked"))
    counts = by_fold.join(whole, F.col("suffix") == F.col("_whole")).select(
        F.col("suffix").alias("_suffix"), F.col("fold").alias("_fold"), (F.col("_all") / total).alias("suffix_share"),
        ((F.col("_all_blocked") - F.col("blocked") + 1) / (F.col("_all") - F.col("n") + 10)).alias("suffix_blocked"),
    )
    mine = (F.col("suffix") == F.col("_suffix")) & (fold_of(F.col("host")) == F.col("_fold"))
    return decided.join(counts, mine, "left").drop("_suffix", "_fold")


def bounded_sample(rows: DataFrame, n: int, most: int) -> DataFrame:
    """All rows, or about most of them by hash of the URL."""
    return rows if n <= most else rows.where(F.pmod("_h", F.lit(1 << 30)) < int((1 << 30) * most / n))


def featured(pages: DataFrame) -> DataFrame:
    """All pages with their rules' verdicts and all features."""
    return with_suffix_statistics(keep(lexical_features(pages), "urls"))


def fit_trees(full: DataFrame, rows: int = TRAIN_ROWS) -> GBTClassificationModel | None:
    """Trees fitted to URLs that rules decide, and to undecided ones as presumed allows of less weight; None without both verdicts among rules' own."""
    known = full.groupBy("verdict").agg(F.count("*").alias("n")).collect()  # three rows at most
    n = {r["verdict"]: r["n"] for r in known}
    if not n.get("block") or not n.get("allow"):
        return None
    ruled = bounded_sample(full.where("verdict is not null"), n["block"] + n["allow"], rows).withColumn("weight", F.lit(1.0))
    other = bounded_sample(full.where("verdict is null"), n.get(None, 0), rows).withColumn("weight", F.lit(PRESUMED))
    train = keep(ruled.unionByName(other).select(*FEATURES, "weight", (F.coalesce("verdict", F.lit("allow")) == "block").cast("double").alias("label")).coalesce(4), "train")
    trees = GBTClassifier(featuresCol="_features", labelCol="label", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, maxBins=32, seed=SEED)
    return trees.fit(assembled(train).coalesce(4))


def assembled(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="_features", handleInvalid="keep").transform(rows)


def judged(full: DataFrame, model: GBTClassificationModel | None, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict and score; the trees' verdict where there is no rule's."""
    columns = ["page_id", "host", "path", "rule"]
    if model is None:
        return full.select(*columns, F.coalesce("verdict", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("score"))
    scored = model.transform(assembled(full)).withColumn("score", F.get(vector_to_array("probability"), F.lit(1)))
    verdict = F.coalesce("verdict", F.when(F.col("score") > threshold, "block").otherwise("allow"))
    return scored.select(*columns, verdict.alias("verdict"), "score")


def filter_urls(pages: DataFrame, threshold: float = 0.5, rows: int = TRAIN_ROWS) -> DataFrame:
    """page_id, host, path, rule, verdict and score of each page.

    The trees learn from URLs that rules decide, and from undecided ones as presumed allows of less weight, since rules that block say little of the
    rest; an undecided URL is blocked at a score over threshold. Without both verdicts among rules' all undecided ones are allowed. Null URLs, and such
    without ://, have empty host and path and are judged alike; repeated rows are judged each; a score equal to threshold allows; the html is not read.
    """
    full = featured(pages)
    return judged(full, fit_trees(full, rows), threshold)
