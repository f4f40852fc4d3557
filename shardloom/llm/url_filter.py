"""URL verdicts: rules first, gradient-boosted trees on lexical features for all other URLs.

Rules name a host (with its subdomains) and the start of a path. URLs that a rule decides are the labelled
ones; the trees learn from them what blocked URLs look like: lengths, depth, digit ratio, entropy, parameters,
hyphens, and how often the host's suffix is blocked. All of it is DataFrame functions and Spark's own trees.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.llm.tables import load, stored

#: Host, path, verdict.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
#: The trees are fitted on about this many distinct labelled URLs at most, chosen by hash.
TRAINING_ROWS = 20_000
TREES, DEPTH = 12, 3
FEATURES = ["length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "parameters", "hyphens", "secure", "suffix_rate"]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (between ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased) and path (up to ``?`` or ``#``); empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"(?s)^([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """``struct<rule, verdict>`` of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for name, start, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r[0], r[1])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def entropy(text: Column) -> Column:
    """Bits a character, from how often each occurs."""
    n = F.length(text).cast("double")
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    each = F.transform(F.array_distinct(F.split(text, "")), lambda c: F.when(c == "", F.lit(0.0)).otherwise(-share(c) * F.log2(share(c))))
    return F.when(n > 0, F.aggregate(each, F.lit(0.0), lambda a, b: a + b)).otherwise(0.0)


def lexical_features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    n = F.length(url).cast("double")
    return {
        "length": n, "host_length": F.length(host).cast("double"), "path_length": F.length(path).cast("double"),
        "depth": count(path, "/"), "labels": count(host, r"\."), "digit_ratio": F.when(n > 0, count(url, "[0-9]") / n).otherwise(0.0),
        "entropy": entropy(url), "parameters": count(url, "[?&][^=&#]*="), "hyphens": count(host, "-"), "secure": F.lower(url).startswith("https").cast("double"),
    }


def judge_urls(pages: DataFrame, key: str = "page_id", url: str = "url", rules: list[tuple[str, str, str]] = RULES, training_rows: int = TRAINING_ROWS) -> DataFrame:
    """Per row: ``key``, ``host``, ``path``, ``rule`` (of the longest rule that fits, else null), ``verdict`` and ``block_score``.

    URLs without a rule get the verdict of the trees. If the rules decide URLs of one verdict only, that one holds for
    all; if they decide none, all others are allowed. Null URLs and URLs without ``://`` have empty parts. Equal URLs get equal
    verdicts; other columns are not read.
    """
    text = F.coalesce(F.col(url), F.lit(""))
    host, path = url_parts(text)
    parsed = pages.select(F.col(key).alias("_key"), text.alias("_url"), host.alias("host"), path.alias("path"))
    parsed = parsed.withColumn("_rule", matched_rule(F.col("host"), F.col("path"), rules))
    parsed = parsed.withColumn("_suffix", F.element_at(F.split("host", r"\."), -1))
    blocked = (F.col("_rule.verdict") == "block").cast("double")

    # Suffix statistics over all labelled URLs: smoothed share of blocked ones, as a narrow table.
    labelled = parsed.where("_rule IS NOT NULL")
    rates = stored(labelled.groupBy("_suffix").agg(F.sum(blocked).alias("_blocked"), F.count("*").alias("_all")), "suffixes")
    total = rates.agg(F.sum("_blocked").alias("blocked"), F.sum("_all").alias("rows")).first()
    rows, hits = total.rows or 0, total.blocked or 0.0
    base = (hits + 1) / (rows + 2)

    def features(of: DataFrame, own_rows: Column | int = 0, own_blocked: Column | int = 0) -> DataFrame:
        """Features of URLs; what a URL's own rows say of its suffix is left out where they are given."""
        wide = of.withColumns(lexical_features(F.col("_url"), F.col("host"), F.col("path"))).join(rates, "_suffix", "left")
        others, bad = (F.coalesce(F.col(c), F.lit(0)) - own for c, own in (("_all", own_rows), ("_blocked", own_blocked)))
        wide = wide.withColumn("suffix_rate", (bad + 10 * base) / (others + 10))
        return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(wide)

    if hits == 0 or hits == rows:
        found = parsed.withColumn("block_score", F.lit(1.0 if rows and hits else 0.0))
    else:
        # The sample is one of different URLs, so they are what is counted: copies of a few must not thin it out.
        different = labelled.agg(F.count_distinct(F.xxhash64("_url"))).first()[0]
        one_in = max(1, math.ceil(different / training_rows))
        chosen = labelled.where(F.pmod(F.xxhash64("_url"), F.lit(one_in)) == 0).groupBy("_url", "host", "path", "_suffix")
        chosen = chosen.agg(F.first(blocked).alias("label"), F.count("*").alias("_own"))
        fit = stored(features(chosen, F.col("_own"), F.col("_own") * F.col("label")).select("label", "features").repartition(4), "training")
        model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7, cacheNodeIds=False).fit(fit)
        scored = model.transform(features(parsed))
        found = scored.withColumn("block_score", F.round(vector_to_array("probability")[1], 9))
    guess = F.when(F.col("block_score") > 0.5, "block").otherwise("allow")
    return found.select(
        F.col("_key").alias(key), "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", guess).alias("verdict"), "block_score",
    )


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(load(spark, sf_dir, "pages", "page_id", "url"))
