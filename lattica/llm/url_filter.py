"""URL filtering by association rules.

A short list of host rules with paths judges what it fits; the longest wins. The method judges the rest: Spark's FP-growth mines
token combinations of labelled URLs together with their label, rules whose consequent is a label are pruned by confidence and
support, and an inverted index from token to rule matches them: a rule fires where all its tokens are found.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import cut, unused

#: Host rules (fixed by the query's contract): (rule as host and path, verdict).
HOST_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
PARTS = r"(?s)^(.*?)://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Lower-cased host and path of a URL; both empty for null and without ``://``."""
    part = lambda k: F.coalesce(F.regexp_extract(url, PARTS, k), F.lit(""))
    return F.translate(part(2), UPPER, LOWER), part(3)


def host_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = HOST_RULES) -> Column:
    """The longest rule that fits host (or a parent of it) and path, else null. One expression for a short, fixed list."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        own, _, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL: scheme, labels of the host by kind, parts of the path, keys of the query, fragment."""
    scheme = F.array(F.concat(F.lit("scheme="), F.coalesce(F.regexp_extract(url, r"(?s)^(.*?)://", 1), F.lit(""))))
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("host="), x))
    words = F.transform(F.split(F.regexp_replace(host, r"[-.]", " "), " "), lambda x: F.concat(F.lit("word="), x))
    parts = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("path="), F.regexp_replace(x, r"^[0-9]+", "0")))
    keys = F.transform(F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#]+)"), F.lit(1)), lambda x: F.concat(F.lit("key="), x))
    end = F.array(F.concat(F.lit("fragment="), F.regexp_extract(F.coalesce(url, F.lit("")), r"#(.*)$", 1)))
    return F.array_distinct(F.concat(scheme, labels, words, parts, keys, end))


def mine(labelled: DataFrame, support: float = 0.02, confidence: float = 0.8, most_tokens: int = 3) -> DataFrame:
    """(rule_id, tokens, verdict, confidence, support) mined from labelled(tokens, label).

    At least ``support`` of the labelled rows hold a rule's tokens and label, so that the number of frequent
    tokens is bounded by a URL's tokens over ``support``. A rule stays only if no rule with fewer tokens among its own
    and the same verdict is as confident. No labelled rows: no rules.

    Tokens that all labelled rows hold would double the itemsets each, for rules that are all pruned: with one, a rule is as
    confident as without it. So they are not mined; each is a rule of its own if a label's share is confident enough.
    """
    labelled = cut(labelled.select("tokens", "label"))
    n = labelled.count()
    always = [r[0] for r in labelled.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("n")).where(F.col("n") == n).select("t").collect()]  # of one URL at most
    shares = labelled.groupBy("label").agg((F.count("*") / n).alias("share")).where(F.col("share") >= max(support, confidence)).collect()  # one per label
    alone = labelled.sparkSession.createDataFrame([([t], r["label"], r["share"], r["share"]) for t in sorted(always) for r in shares], "tokens array<string>, verdict string, confidence double, support double")
    mined = F.array_except("tokens", F.array(*[F.lit(t) for t in always]).cast("array<string>"))
    baskets = labelled.select(F.array_union(mined, F.array(F.concat(F.lit("label="), "label"))).alias("items"))
    rules = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets).associationRules
    target = F.element_at("consequent", 1)
    rules = rules.where(target.startswith("label=")).where(~F.exists("antecedent", lambda x: x.startswith("label="))).where(F.size("antecedent") <= most_tokens)
    rules = rules.select(F.array_sort("antecedent").alias("tokens"), F.substring(target, 7, 1000).alias("verdict"), "confidence", "support").union(alone)
    rules = cut(rules.withColumn("rule_id", F.concat_ws("\x1f", F.concat_ws("\x1e", "tokens"), "verdict")))
    # supersets meet their subsets through the inverted index of the rules themselves
    small = rules.select(F.col("rule_id").alias("s_id"), F.col("verdict"), F.col("confidence").alias("s_conf"), F.size("tokens").alias("s_n"), F.explode("tokens").alias("token"))
    big = rules.select("rule_id", "verdict", "confidence", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    inside = big.join(small, ["token", "verdict"]).where("s_n < n and s_conf >= confidence").groupBy("rule_id", "s_id", "s_n").agg(F.count("*").alias("hits")).where("hits = s_n")
    return rules.join(inside.select("rule_id").distinct(), "rule_id", "left_anti")


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(key, verdict) for each of urls(key, tokens) that a mined rule fits: of the most confident, best supported one.

    The index holds one posting per token of a rule; rules are bounded by the support (see ``mine``).
    """
    index = rules.select("rule_id", "verdict", "confidence", "support", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    hits = urls.select("key", F.explode("tokens").alias("token")).join(index, "token")
    fired = hits.groupBy("key", "rule_id", "verdict", "confidence", "support", "n").agg(F.count("*").alias("found")).where("found = n")
    best = F.max(F.struct("confidence", "support", (F.col("verdict") == "block").alias("b"), "rule_id", "verdict"))
    return fired.groupBy("key").agg(best["verdict"].alias("verdict"))


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = HOST_RULES, labels: DataFrame | None = None, support: float = 0.02, confidence: float = 0.8) -> DataFrame:
    """pages plus host, path, rule, verdict and how it was reached (``by``: rule, mined or default).

    ``labels(url, label)`` are the labelled URLs to mine; without them, the verdicts of the host rules label the URLs
    they fit. URLs that neither judges are allowed, as are null URLs and those without ``://``. Tokens are
    matched once per distinct URL. Columns of those five names in ``pages`` are replaced.
    """
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "by")]
    (mined_,) = unused(pages.columns, "_mined")
    host, path = host_and_path(F.col("url"))
    verdict_of = F.create_map(*[F.lit(x) for r, v in rules for x in (r, v)])
    based = pages.select(*kept, host.alias("host"), path.alias("path")).withColumn("rule", host_rule(F.col("host"), F.col("path"), rules))
    distinct = cut(based.where("url is not null").groupBy("url", "host", "path", "rule").agg(F.count("*").alias("times")).withColumn("tokens", url_tokens(F.col("url"), F.col("host"), F.col("path"))))
    if labels is None:
        labelled = distinct.where("rule is not null").select("tokens", F.element_at(verdict_of, F.col("rule")).alias("label"))
    else:
        labelled = labels.select("url", "label").join(distinct.select("url", "tokens"), "url")
    mined = mine(labelled, support, confidence) if labelled.limit(1).count() else None
    if mined is None:
        decided = distinct.select("url", F.lit(None).cast("string").alias(mined_)).limit(0)
    else:
        open_ = distinct.where(F.col("rule").isNull() & (F.col("host") != "")).select(F.col("url").alias("key"), "tokens")
        decided = match(open_, mined).select(F.col("key").alias("url"), F.col("verdict").alias(mined_))
    whole = based.join(decided, "url", "left")
    by = F.when(F.col("rule").isNotNull(), "rule").when(F.col(mined_).isNotNull(), "mined").otherwise("default")
    verdict = F.coalesce(F.element_at(verdict_of, F.col("rule")), F.col(mined_), F.lit("allow"))
    return whole.select(*kept, "host", "path", "rule", verdict.alias("verdict"), by.alias("by"))
