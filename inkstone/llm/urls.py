"""URL filtering by association rules over URL tokens, next to a list of host and path rules. DataFrame operations only.

A listed rule names a host and a path prefix; it fits that host and all its subdomains where the URL's path starts with the
rule's path, and the longest fitting rule decides. FP-growth mines combinations of URL tokens (host labels with their level,
path segments without digits, query keys, scheme) that come with the verdict of labelled URLs; combinations of enough support
and confidence, not implied by a shorter one of no less confidence, are the mined rules. They match by an inverted index: a
URL's tokens are joined to the rules' tokens and a rule fires where all its tokens are met. The most confident firing rule
decides for a URL that no listed rule fits (then the larger, then block before allow); where none fires it is allowed.

Mining is bounded without loss. Tokens below the support can be in no rule and are dropped; of tokens that the very same URLs have
one stands for all, as a combination of two of them is implied by each. FP-growth makes every frequent combination, 2^n of n
tokens, so it gets baskets of at most PLAIN_BASKET tokens; where one is longer, the same conditional bases are grown level by level
to MOST_TOKENS tokens only (grow), which counts the same combinations.

The listed rules and the mined rules are bounded (mined ones by minimum support: at most one pattern in 1 / support of the
labelled URLs for each itemset) and are checked before a broadcast; larger lists are joined by shuffle.

Defined cases: a null URL, or one without ://, has empty host and path, no listed rule and is judged by mined rules of no
tokens, that is allowed; repeated rows repeat their verdict, also without distinct page_id; a null page_id is kept; without
labelled URLs nothing is mined; a URL of any length is judged by all its tokens; rules tied in all of the above have one verdict, so
either may decide; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkstone.llm.common import cut as keep

#: Listed rules of the supplied tables: verdict, host, path.
LISTED = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Of mined rules: least share of the URLs with all tokens and the verdict, least confidence, most tokens.
SUPPORT, CONFIDENCE, MOST_TOKENS = 0.01, 0.6, 3
#: Most tokens in a basket of FP-growth: 2^12 combinations.
PLAIN_BASKET = 12
#: Rules up to this number are broadcast.
BROADCAST_RULES = 20_000


def parts(url: Column) -> tuple[Column, Column]:
    """Host (lower-cased A-Z) and path, both empty for null or where :// is missing."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, upper, lower), F.lit("")), F.coalesce(path, F.lit(""))


def tokens(url: Column, host: Column, path: Column) -> Column:
    labels = F.reverse(F.split(host, r"\."))
    hosts = F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(labels, lambda x, i: F.concat(F.lit("h"), i.cast("string"), F.lit(":"), x)))
    segments = F.transform(F.filter(F.split(path, "/"), lambda x: (x != "") & ~x.rlike("[0-9]")), lambda x: F.concat(F.lit("p:"), x))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    keys = F.when(query == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(query, "&"), lambda x: F.concat(F.lit("q:"), F.regexp_extract(x, "^([^=]*)", 1))))
    scheme = F.when(F.instr(url, "://") > 0, F.array(F.concat(F.lit("s:"), F.lower(F.regexp_extract(url, "^(.*?)://", 1))))).otherwise(F.array().cast("array<string>"))
    return F.coalesce(F.array_distinct(F.concat(hosts, segments, keys, scheme)), F.array().cast("array<string>"))


def sized(rules: DataFrame, n: int) -> DataFrame:
    """The rules, broadcast only up to the proven size."""
    return F.broadcast(rules) if n <= BROADCAST_RULES else rules


def listed_verdicts(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """key, rule, listed: the longest fitting rule of each page (key, host, path). rules: verdict, host, path.

    Only as many trailing host labels are looked up as the rules have at most, so a long host costs no more than a short one."""
    row = rules.agg(F.count("*").alias("n"), F.max(F.size(F.split("host", r"\."))).alias("deep")).first()
    if not row.n:
        return pages.select("key", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("listed")).limit(0)
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(row.deep))), lambda k: F.concat_ws(".", F.slice(labels, -k, k)))
    asked = pages.select("key", "path", F.explode(suffixes).alias("rule_host"))
    rules = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("listed"))
    fits = asked.join(sized(rules, row.n), "rule_host").where(F.expr("startswith(path, rule_path)"))
    best = F.max(F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host"), F.concat("rule_host", "rule_path").alias("rule"), "listed"))
    return fits.groupBy("key").agg(best.alias("x")).select("key", "x.rule", "x.listed")


def frequent_baskets(urls: DataFrame, least: int) -> DataFrame:
    """tokens, verdict of each URL (key, tokens, verdict): only tokens of at least that many URLs, one of each set of tokens that the same URLs have."""
    met = urls.select("key", "verdict", F.explode(F.array_distinct("tokens")).alias("token"))
    where = [F.bit_xor(F.xxhash64("key", F.lit(k))).alias(f"where{k}") for k in (1, 2)]
    common = met.groupBy("token").agg(F.count("*").alias("n"), *where).where(F.col("n") >= least)
    stands = common.groupBy("n", "where1", "where2").agg(F.min("token").alias("token")).select("token")
    return met.join(stands, "token").groupBy("key", "verdict").agg(F.sort_array(F.collect_list("token")).alias("tokens")).select("tokens", "verdict")


def plain_sets(baskets: DataFrame, least: int) -> DataFrame:
    """tokens, verdict (null: any), freq of the combinations in at least that many baskets, by FP-growth; a verdict is one more item."""
    verdict = F.when(F.col("verdict").isNull(), F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("v:"), "verdict")))
    items = baskets.select(F.concat("tokens", verdict).alias("items"))
    n = items.count()
    sets = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / max(n, 1)).fit(items).freqItemsets
    is_verdict = lambda x: x.startswith("v:")
    split = sets.select(F.array_sort(F.filter("items", lambda x: ~is_verdict(x))).alias("tokens"), F.substring(F.get(F.filter("items", is_verdict), F.lit(0)), 3, 1 << 20).alias("verdict"), "freq")
    return split.where((F.size("tokens") > 0) & (F.size("tokens") <= MOST_TOKENS))


def grow(baskets: DataFrame, least: int) -> DataFrame:
    """The same as plain_sets, by pattern growth that stops at MOST_TOKENS tokens: a frequent combination keeps its conditional base, the tokens
    that follow it in each basket, equal ones counted together, and grows by each of these."""
    base = baskets.groupBy(F.array().cast("array<string>").alias("tokens"), F.col("tokens").alias("rest"), "verdict").agg(F.count("*").alias("w"))
    found = None
    for _ in range(MOST_TOKENS):
        grown = base.select("tokens", "rest", "verdict", "w", F.posexplode("rest").alias("at", "token"))
        grown = grown.select(F.concat("tokens", F.array("token")).alias("tokens"), F.expr("slice(rest, at + 2, size(rest))").alias("rest"), "verdict", "w")
        grown = keep(grown.groupBy("tokens", "rest", "verdict").agg(F.sum("w").alias("w")))
        bodies = grown.groupBy("tokens").agg(F.sum("w").alias("freq")).where(F.col("freq") >= least)
        heads = grown.where("verdict is not null").groupBy("tokens", "verdict").agg(F.sum("w").alias("freq")).where(F.col("freq") >= least)
        level = bodies.select("tokens", F.lit(None).cast("string").alias("verdict"), "freq").unionByName(heads)
        found = level if found is None else found.unionByName(level)
        base = grown.join(bodies.select("tokens"), "tokens", "left_semi")
    return found


def mine(urls: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """rule_id, tokens, verdict, confidence, support. urls: key, tokens array, verdict (null where unlabelled).

    All URLs are counted, a label's verdict as one more item; only itemsets with a verdict make rules. URLs without a label
    count against a rule's confidence, so that what only few labels tell of isn't taken for certain."""
    n = urls.count()
    least = max(1, math.ceil(n * support - 1e-9))
    baskets = keep(frequent_baskets(urls, least))
    longest = baskets.agg(F.max(F.size("tokens"))).first()[0]
    if not longest:
        return urls.sparkSession.createDataFrame([], "rule_id long, tokens array<string>, verdict string, confidence double, support double")
    sets = plain_sets(baskets, least) if longest <= PLAIN_BASKET else grow(baskets, least)
    bodies = sets.where("verdict is null").select("tokens", F.col("freq").alias("body"))
    rules = sets.where("verdict is not null").join(bodies, "tokens").select("tokens", "verdict", (F.col("freq") / F.col("body")).alias("confidence"), (F.col("freq") / n).alias("support"))
    rules = rules.where(F.col("confidence") >= confidence)
    # A rule that a part of its tokens implies with no less confidence says nothing more.
    parts_of = rules.select(F.col("tokens").alias("whole"), "verdict", F.col("confidence").alias("c"), F.explode("tokens").alias("left_out")).select("whole", "verdict", "c", F.array_except("whole", F.array("left_out")).alias("part"))
    implied = parts_of.join(rules.select(F.col("tokens").alias("part"), "verdict", "confidence"), ["part", "verdict"]).where("confidence >= c").select(F.col("whole").alias("tokens"), "verdict").distinct()
    kept = rules.join(implied, ["tokens", "verdict"], "left_anti")
    return kept.select(F.xxhash64("tokens", "verdict").alias("rule_id"), "tokens", "verdict", "confidence", "support")


def mined_verdicts(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """key, mined: the verdict of the most confident rule whose tokens a page (key, tokens) all has. The index holds each rule once a token."""
    postings = rules.select("rule_id", "verdict", "confidence", F.size("tokens").alias("size"), F.explode("tokens").alias("token"))
    n = postings.count()
    met = pages.select("key", F.explode("tokens").alias("token")).join(sized(postings, n), "token")
    fired = met.groupBy("key", "rule_id", "size", "verdict", "confidence").agg(F.count("*").alias("n")).where("n = size")
    return fired.groupBy("key").agg(F.max(F.struct("confidence", "size", (F.col("verdict") == "block").alias("first"), "verdict")).alias("x")).select("key", F.col("x.verdict").alias("mined"))


def judge(pages: DataFrame, listed: list[tuple[str, str, str]] = LISTED) -> DataFrame:
    """page_id, host, path, rule, verdict. Labels for mining are the verdicts of the listed rules.

    Verdicts depend on the URL alone, so distinct URLs are judged once and joined back by their hash and themselves."""
    spark = pages.sparkSession
    rules = spark.createDataFrame(listed, T.StructType([T.StructField(c, T.StringType()) for c in ("verdict", "host", "path")]))
    every = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    urls = every.where("url is not null").select("url").distinct()
    host, path = parts(F.col("url"))
    cut = urls.select(F.col("url").alias("key"), "url", host.alias("host"), path.alias("path"))
    cut = cut.select("key", "host", "path", tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"))
    by_list = listed_verdicts(cut, rules)
    known = keep(cut.join(by_list, "key", "left"))
    mined = keep(mine(known.select("key", "tokens", F.col("listed").alias("verdict"))))
    by_rule = mined_verdicts(known.where("rule is null").select("key", "tokens"), mined)
    verdicts = known.join(by_rule, "key", "left").select("key", "rule", F.coalesce("listed", "mined").alias("verdict"))
    found = every.where("url is not null").join(verdicts.withColumnRenamed("key", "url"), "url", "left")
    # Null URLs would all meet in one task of the join.
    none = every.where("url is null").select("url", "page_id", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    return found.unionByName(none).select("page_id", host.alias("host"), path.alias("path"), "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))
