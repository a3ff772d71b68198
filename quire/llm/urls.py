"""URL filtering by rules and gradient-boosted trees on lexical features.

Urls that a rule fits are the labelled ones; trees trained on them judge the others.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.runtime import broadcast_if_small, materialize

#: (host, path prefix, verdict) of the rules in use.
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]
#: Labelled urls of each verdict that the trees are fitted on, about; a verdict with fewer gives all.
SAMPLE = 5_000
TREES, DEPTH, SEED = 20, 3, 7
#: Labelled urls that a suffix is credited with at even odds, so that rare suffixes stay near them.
PRIOR = 20.0
FEATURES = ["url_length", "host_length", "path_length", "depth", "labels", "params", "query_length", "digit_ratio", "host_digits", "hyphens", "host_entropy", "path_entropy", "suffix_odds"]


def parts(url: Column) -> tuple[Column, Column, Column]:
    """Host (A-Z lower-cased), path and the rest of a url; empty where it is null or has no "://"."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    after = F.substr(rest, F.char_length(host) + 1)
    path = F.regexp_extract(after, r"^[^?#]*", 0)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path, F.substr(after, F.char_length(path) + 1)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule (rule, verdict) that fits, null if none does.

    The rules are a parameter and part of the plan, longest first, so that the first that
    fits decides.
    """
    chosen = F.lit(None)
    for name, prefix, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        chosen = F.when(fits, F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def entropy(text: Column) -> Column:
    """Bits per character of a short text's characters; 0 for the empty text."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars)
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    bits = F.transform(F.array_distinct(chars), lambda c: -share(c) * F.log2(share(c)))
    return F.when(n > 0, F.aggregate(bits, F.lit(0.0), lambda a, b: a + b)).otherwise(0.0)


def _count(text: Column, character: str) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit(character), F.lit("")))


def lexical(urls: DataFrame, id_col: str = "page_id", url: str = "url") -> DataFrame:
    """Id, host, path, rule, label (of the rule), suffix and the lexical features of each url."""
    host, path, rest = parts(F.col(url).cast("string"))
    text = F.coalesce(F.col(url).cast("string"), F.lit(""))
    split = urls.select(F.col(id_col), text.alias("url"), host.alias("host"), path.alias("path"), rest.alias("rest"))
    split = split.withColumn("chosen", rule_for(F.col("host"), F.col("path")))
    digits = lambda c: F.char_length(F.regexp_replace(c, "[^0-9]+", ""))
    query = F.regexp_extract("rest", r"^\?([^#]*)", 1)
    short = lambda c: F.col(c)
    features = {
        "url_length": F.char_length("url"),
        "host_length": F.char_length("host"),
        "path_length": F.char_length("path"),
        "depth": _count(F.col("path"), "/"),
        "labels": _count(F.col("host"), "."),
        "params": F.when(query == "", 0).otherwise(_count(query, "&") + 1),
        "query_length": F.char_length(query),
        "digit_ratio": digits(F.col("url")) / F.greatest(F.char_length("url"), F.lit(1)),
        "host_digits": digits(F.col("host")),
        "hyphens": _count(F.col("host"), "-"),
        "host_entropy": entropy(short("host")),
        "path_entropy": entropy(short("path")),
    }
    suffix = F.substring_index("host", ".", -1)
    return split.select(id_col, "host", "path", F.col("chosen.rule").alias("rule"), F.col("chosen.verdict").alias("label"), suffix.alias("suffix"), *(c.cast("double").alias(n) for n, c in features.items()))


def suffix_odds(labelled: DataFrame) -> DataFrame:
    """(suffix, suffix_odds): share of blocked urls among a suffix's labelled urls, smoothed."""
    blocked = F.sum((F.col("label") == "block").cast("double"))
    return labelled.groupBy("suffix").agg(((blocked + PRIOR / 2) / (F.count("*") + PRIOR)).alias("suffix_odds"))


def fit(labelled: DataFrame, sample: int = SAMPLE) -> GBTClassificationModel | None:
    """Trees fitted on a bounded sample of labelled urls, chosen by a hash of host and path.

    Rows weigh so that both verdicts count alike. With a single verdict there is no model.
    """
    counts = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    if len(counts) < 2:
        return None
    place = F.pmod(F.xxhash64(F.lit(SEED), "host", "path"), F.lit(1_000_000)) / 1_000_000
    share = F.when(F.col("label") == "block", min(1.0, sample / counts["block"])).otherwise(min(1.0, sample / counts["allow"]))
    weight = F.when(F.col("label") == "block", 1.0 / min(sample, counts["block"])).otherwise(1.0 / min(sample, counts["allow"]))
    rows = labelled.where(place < share).select(*FEATURES, (F.col("label") == "block").cast("double").alias("y"), (weight * sample).alias("w"))
    rows = materialize(rows)
    if rows.select("y").distinct().count() < 2:
        return None
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(rows)
    return GBTClassifier(featuresCol="x", labelCol="y", weightCol="w", maxIter=TREES, maxDepth=DEPTH, seed=SEED).fit(vectors)


def judge(urls: DataFrame, id_col: str = "page_id", url: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) of each url: the longest fitting rule's verdict, else the trees'.

    A url that is null or lacks "://" has an empty host and path and gets the trees' verdict.
    Where the labelled urls have a single verdict it is given to all, and "allow" where there
    are none. Repeated rows stay; an empty table gives an empty result; columns other than
    the id and the url are not read.
    """
    known = lexical(urls, id_col, url)
    labelled = known.where("label IS NOT NULL")
    odds = materialize(suffix_odds(labelled))
    odds = broadcast_if_small(odds)
    known = known.join(odds, "suffix", "left").fillna({"suffix_odds": 0.5})
    model = fit(known.where("label IS NOT NULL"))
    if model is None:
        only = [r["label"] for r in labelled.select("label").distinct().collect()]
        judged = known.withColumn("prediction", F.lit(1.0 if only == ["block"] else 0.0))
    else:
        judged = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="x").transform(known))
    verdict = F.coalesce("label", F.when(F.col("prediction") == 1.0, "block").otherwise("allow"))
    return judged.select(id_col, "host", "path", "rule", verdict.alias("verdict"))
