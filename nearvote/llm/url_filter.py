"""URL filter: rules decide by host and path; other URLs are judged by gradient-boosted trees on lexical
features (length, depth, digit ratio, entropy, parameter counts, suffix statistics). DataFrame functions only.

The trees learn from URLs that a rule decides, a bounded sample of them (SAMPLE_URLS distinct URLs, by hash).
Suffix statistics of a URL are the number and the block share of the sampled domains (a host's last two labels)
under its host's last label, without its own domain, both in training and in judging; so a URL's own label, or a
rule about its domain, is not handed to the trees. Their tables have at most as many rows as the sample and are
broadcast.

Null URLs, and those without `://`, have an empty host and path, fit no rule and are judged like others.
Without labelled URLs of both kinds the verdict is that of the only kind, or allow. Rows repeat as in the
input; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values: (host and path prefix, verdict).
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
SAMPLE_URLS = 20_000
TREES = 12
DEPTH = 4
SEED = 7
#: Domains of the common block share that the share of a suffix is mixed with.
PRIOR = 10
FEATURES = ["url_length", "host_length", "path_length", "depth", "host_depth", "digit_ratio", "letter_ratio", "entropy", "parameters", "parameter_length", "hyphens", "has_fragment", "suffix_domains", "suffix_block"]
#: Characters whose shares make the entropy; all others count as one more.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789./-_?=&%:#"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The part from the first :// to / ? # or the end, with A-Z in lower case; from there to ? # or the end."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, else null."""
    fits = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        of, _, prefix = rule.partition("/")
        own = (host == of) | host.endswith("." + of)
        fits = F.when(own & path.startswith("/" + prefix), F.lit(rule)).otherwise(fits)
    return fits


def lexical(df: DataFrame) -> DataFrame:
    """df with the features of its columns url (not null), host and path, and `suffix` and `domain`, the host's last label and last two."""
    url, n = F.col("url"), F.greatest(F.length("url"), F.lit(1)).cast("double")
    lower, count = F.lower(url), lambda c, x: (F.length(c) - F.length(F.replace(c, F.lit(x)))).cast("double")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    known = F.length(F.regexp_replace(lower, r"[^a-z0-9./\-_?=&%:#]", ""))
    shares = F.array(*(count(lower, x) / n for x in ALPHABET), (F.length(lower) - known) / n)
    entropy = F.aggregate(shares, F.lit(0.0), lambda total, p: total - F.when(p > 0, p * F.log2(F.greatest(p, F.lit(1e-9)))).otherwise(0.0))
    return df.select(
        "*",
        F.substring_index("host", ".", -1).alias("suffix"), F.substring_index("host", ".", -2).alias("domain"),
        F.length("url").cast("double").alias("url_length"), F.length("host").cast("double").alias("host_length"), F.length("path").cast("double").alias("path_length"),
        count(F.col("path"), "/").alias("depth"), count(F.col("host"), ".").alias("host_depth"),
        (F.length(F.regexp_replace(url, "[^0-9]", "")) / n).alias("digit_ratio"), (F.length(F.regexp_replace(lower, "[^a-z]", "")) / n).alias("letter_ratio"),
        entropy.alias("entropy"),
        F.when(query != "", count(query, "&") + 1).otherwise(0.0).alias("parameters"), F.length(query).cast("double").alias("parameter_length"),
        count(url, "-").alias("hyphens"), F.contains(url, F.lit("#")).cast("double").alias("has_fragment"),
    )


def ruled_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, url, host, path, rule): a row for each row of pages."""
    host, path = host_and_path(F.col("url"))
    parts = pages.select("page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url")).select("page_id", "url", host.alias("host"), path.alias("path"))
    return parts.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))


def labelled_urls(ruled: DataFrame, rules=RULES) -> DataFrame:
    """(url, host, path, label): the sample, with label 1.0 for block."""
    blocks = [r for r, verdict in rules if verdict == "block"]
    return ruled.where("rule is not null").select("url", "host", "path", F.col("rule").isin(blocks).cast("double").alias("label")).distinct().orderBy(F.xxhash64("url"), "url").limit(SAMPLE_URLS)


def with_suffix(df: DataFrame, domains: DataFrame, share: float) -> DataFrame:
    """df with the suffix statistics of the sampled `domains` (suffix, domain, block), without the own domain."""
    total = domains.groupBy("suffix").agg(F.count("*").alias("_n"), F.sum("block").alias("_k"))
    own = domains.select("suffix", "domain", F.col("block").alias("_own"))
    df = df.join(F.broadcast(total), "suffix", "left").join(F.broadcast(own), ["suffix", "domain"], "left")
    n = F.coalesce(F.col("_n"), F.lit(0)) - F.col("_own").isNotNull().cast("int")
    k = F.coalesce(F.col("_k"), F.lit(0.0)) - F.coalesce(F.col("_own"), F.lit(0.0))
    return df.withColumns({"suffix_domains": F.log1p(n.cast("double")), "suffix_block": (k + PRIOR * share) / (n + PRIOR)}).drop("_n", "_k", "_own")


def fit(sample: DataFrame):
    """A function from (url, host, path) rows to these rows with `block_score`; or, without labels of both kinds,
    the only kind's score (0.0 without any)."""
    sample = lexical(sample).coalesce(1).cache()
    prior = sample.agg(F.count("*").alias("n"), F.sum("label").alias("k")).first()
    if not prior.n or prior.k in (0, prior.n):
        sample.unpersist()
        only = float(bool(prior.n and prior.k))
        return lambda df: df.withColumn("block_score", F.lit(only))
    share = prior.k / prior.n
    # Rows of the model's own, so that what is broadcast does not depend on the sample any more.
    known = sample.groupBy("suffix", "domain").agg(F.avg("label").alias("block")).toArrow()
    domains = sample.sparkSession.createDataFrame(known)
    vector = VectorAssembler(inputCols=FEATURES, outputCol="features")
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED, labelCol="label", maxBins=32).fit(vector.transform(with_suffix(sample, domains, share)))
    sample.unpersist()

    def score(df: DataFrame) -> DataFrame:
        scored = model.transform(vector.transform(with_suffix(lexical(df), domains, share)))
        return scored.select(*df.columns, vector_to_array("probability")[1].alias("block_score"))

    return score


def judge_pages(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, block_score): a row for each row of pages (page_id, url).
    block_score is the trees' probability of block, null where a rule decides."""
    ruled = ruled_urls(pages, rules)
    scored = fit(labelled_urls(ruled, rules))(ruled)
    own = F.when(F.col("block_score") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    told = F.create_map(*(F.lit(x) for rule in rules for x in rule))
    return scored.select("page_id", "host", "path", "rule", F.coalesce(told[F.col("rule")], own).alias("verdict"), F.when(F.col("rule").isNull(), F.col("block_score")).alias("block_score"))
