"""URL filtering: a list of host rules first, then association rules mined from labelled URLs.

A URL becomes a basket of tokens (host labels and suffixes, path words, query keys, fragment). FP-growth
mines the baskets of labelled URLs, each with its label as one more token. A rule from tokens to the
label ``block`` survives with enough support, a confidence above the share of all labelled URLs that
are blocked by the factor ``MIN_LIFT``, and a lower bound of its confidence (Wilson, ``DEVIATIONS``)
above that share; and it has to reach that confidence over the labelled URLs that no more confident
rule decides, too.
With ``false_rate`` the rules are those that stand when all candidates are tested at once (Benjamini
and Hochberg), and with ``held_out`` they are mined on two thirds of the labelled URLs and have to
reach the confidence on the third part, too. A rule is filed under its rarest token; a URL looks its tokens up and is blocked if
it holds all tokens of a rule found.

Defined results: a null URL, or one without ``://``, has an empty host and path, no tokens, and is
allowed; digits in path words read as ``#``; of several labels for one row ``block`` counts;
without labelled URLs no rule is mined. Other columns are carried along; columns named like a
result are replaced.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

MIN_SUPPORT = 0.002
#: Fewer blocked URLs than this never make a rule, however small the sample.
MIN_URLS = 4
MIN_LIFT = 1.5
#: Standard deviations between a rule's confidence and its lower bound.
DEVIATIONS = 1.28
BROADCAST_RULES = 100_000
_PARTS = r"://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#([\s\S]*))?"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def tokens(url: Column) -> Column:
    """Distinct tokens of a URL, typed by where they stand."""
    labels = F.split(host(url), r"\.")
    words = F.filter(F.split(F.regexp_replace(F.lower(path(url)), r"[0-9]+", "#"), r"[/._-]+"), lambda w: w != "")
    query = F.filter(F.split(F.coalesce(F.regexp_extract(url, _PARTS, 3), F.lit("")), "[&;]"), lambda w: w != "")
    fragment = F.coalesce(F.regexp_extract(url, _PARTS, 4), F.lit(""))
    found = F.concat(
        F.transform(F.filter(labels, lambda w: w != ""), lambda w: F.concat(F.lit("host:"), w)),
        F.array(F.concat(F.lit("site:"), F.substring_index(host(url), ".", -2))),
        F.transform(words, lambda w: F.concat(F.lit("path:"), w)),
        F.transform(query, lambda w: F.concat(F.lit("query:"), F.substring_index(w, "=", 1))),
        F.when(fragment != "", F.array(F.concat(F.lit("fragment:"), fragment))).otherwise(F.array().cast("array<string>")),
    )
    return F.when(F.coalesce(F.contains(url, F.lit("://")), F.lit(False)), F.array_distinct(found)).otherwise(F.array().cast("array<string>"))


def listed_rule(host_col: Column, path_col: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule of (host, path, verdict), as written, and its verdict; null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host_col == h) | host_col.endswith(f".{h}")) & path_col.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def lower_bound(share: Column, n: Column, deviations: float = DEVIATIONS) -> Column:
    """Wilson's lower bound of a share seen in ``n`` cases."""
    z2 = deviations**2
    return (share + z2 / (2 * n) - deviations * F.sqrt(share * (1 - share) / n + z2 / (4 * n * n))) / (1 + z2 / n)


def log_chance(share: Column, n: Column, base: float) -> Column:
    """Logarithm of a bound (Chernoff) of the chance to see ``share`` or more in ``n`` cases that are blocked with chance ``base``."""
    part = lambda x, y: F.when(x > 0, x * F.ln(x / F.lit(y))).otherwise(0.0)
    return F.when(share > base, -n * (part(share, base) + part(1 - share, 1 - base))).otherwise(0.0)


def _threshold(told: DataFrame, tested: int, rate: float) -> float:
    """The greatest log chance at which no more than ``rate`` of the rules below it are expected to be false, of ``tested`` ones.

    Rules are counted by hundredths of the logarithm, upwards, so that the driver gets a bounded number of rows.
    """
    steps = told.groupBy(F.ceil(F.greatest(F.col("chance"), F.lit(-1200.0)) * 100).alias("step")).agg(F.count("*").alias("n")).orderBy("step").collect()
    found, best = 0, float("-inf")
    for r in steps:
        found += r["n"]
        if math.exp(r["step"] / 100) * tested <= rate * found:
            best = r["step"] / 100
    return best


def mine_rules(labelled: DataFrame, url_col: str = "url", block_col: str = "block", min_support: float = MIN_SUPPORT, min_lift: float = MIN_LIFT, false_rate: float | None = None, held_out: bool = False) -> DataFrame:
    """(antecedent, confidence, support, lookup) of the rules that lead to a block, with no superfluous tokens.

    ``support`` is the share of labelled URLs that hold the tokens and are blocked, ``lookup`` the
    antecedent's rarest token. A rule is dropped if a rule of one token less has no less confidence.
    """
    scratch = Scratch(labelled.sparkSession, "rules")
    if held_out:
        third = F.pmod(F.xxhash64(url_col), F.lit(3)) == 0  # rows of one URL stay together
        rules = mine_rules(labelled.where(~third), url_col, block_col, min_support, min_lift, false_rate)
        rest = scratch.keep(labelled.where(third).select(tokens(F.col(url_col)).alias("items"), F.coalesce(block_col, F.lit(False)).alias("block")), "held-out")
        n, blocked = rest.agg(F.count("*"), F.count_if("block")).first()
        base = blocked / max(1, n)
        seen = _matches(rest, rules, "items").groupBy("antecedent").agg(F.count("*").alias("n"), F.count_if("block").alias("blocked"))
        holds = seen.where((F.col("blocked") >= min_lift * base * F.col("n")) & (F.col("blocked") > 0)).select("antecedent")
        return scratch.keep(rules.join(holds, "antecedent", "left_semi"), "rules-held-out")
    baskets = labelled.select(F.array_append(tokens(F.col(url_col)), F.when(F.col(block_col), "label:block").otherwise("label:allow")).alias("items"))
    baskets = scratch.keep(baskets, "baskets")
    n, blocked = baskets.agg(F.count("*"), F.count_if(F.array_contains("items", "label:block"))).first()
    base = blocked / max(1, n)
    support = min(1.0, max(min_support, MIN_URLS / max(1, n)))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min(1.0, min_lift * base)).fit(baskets)
    rules = model.associationRules.where(F.array_contains("consequent", "label:block") & (F.col("support") * n >= MIN_URLS - 0.5))
    rules = rules.where((F.col("confidence") >= min_lift * base) & (lower_bound(F.col("confidence"), F.col("support") * n / F.col("confidence")) > base))
    if false_rate is not None and 0 < base < 1:
        tested = model.freqItemsets.where(F.array_contains("items", "label:block") & (F.size("items") > 1)).count()
        told = rules.withColumn("chance", log_chance(F.col("confidence"), F.col("support") * n / F.col("confidence"), base))
        rules = told.where(F.col("chance") <= _threshold(told, tested, false_rate))
    rules = scratch.keep(rules.select(F.array_sort("antecedent").alias("antecedent"), "confidence", "support"), "mined")
    inner = rules.select(F.posexplode("antecedent"), "antecedent", F.col("confidence").alias("c")).select("antecedent", "c", F.array_remove(F.col("antecedent"), F.col("col")).alias("shorter"))
    better = inner.join(rules.select(F.col("antecedent").alias("shorter"), "confidence"), "shorter").where("confidence >= c").select("antecedent").distinct()
    rules = rules.join(better, "antecedent", "left_anti")
    single = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    rarest = rules.select("antecedent", "confidence", "support", F.explode("antecedent").alias("token")).join(single, "token")
    rarest = rarest.groupBy("antecedent").agg(F.max("confidence").alias("confidence"), F.max("support").alias("support"), F.min_by("token", F.struct("freq", "token")).alias("lookup"))
    rarest = scratch.keep(rarest, "filed")
    # each labelled URL goes to the most confident rule that it holds
    held = _matches(baskets.withColumn("row", F.monotonically_increasing_id()), rarest, "items")
    best = F.max_by("antecedent", F.struct("confidence", "support", "antecedent")).alias("antecedent")
    own = held.groupBy("row").agg(best, F.bool_or(F.array_contains("items", "label:block")).alias("block")).groupBy("antecedent").agg(F.count("*").alias("n"), F.count_if("block").alias("blocked"))
    strong = own.where(F.col("blocked") >= min_lift * base * F.col("n")).select("antecedent")
    return scratch.keep(rarest.join(strong, "antecedent", "left_semi"), "rules")


def _matches(baskets: DataFrame, rules: DataFrame, col: str) -> DataFrame:
    """``baskets`` joined with the rules whose tokens they all hold, by way of each rule's rarest token."""
    small = rules.count() <= BROADCAST_RULES
    index = rules.withColumnRenamed("lookup", "__token")
    found = baskets.withColumn("__token", F.explode(col)).join(F.broadcast(index) if small else index, "__token")
    return found.where(F.size(F.array_except("antecedent", col)) == 0).drop("__token")


def filter_urls(pages: DataFrame, rules: DataFrame, listed: list[tuple[str, str, str]], url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict."""
    pages = pages.drop("host", "path", "rule", "verdict")
    url = F.col(url_col)
    rule, verdict = listed_rule(F.col("host"), F.col("path"), listed)
    out = pages.withColumns({"host": host(url), "path": path(url)}).withColumns({"rule": rule, "verdict": verdict})
    # every distinct URL that no listed rule decides is looked up once
    open_urls = out.where("verdict is null").select(url.alias("__url")).where("__url is not null").distinct().withColumn("tokens", tokens(F.col("__url")))
    found = _matches(open_urls, rules.select("antecedent", "lookup"), "tokens").select("__url").distinct()
    found = Scratch(pages.sparkSession, "blocked").keep(found.withColumn("__hit", F.lit(True)), "urls")
    joined = out.join(found, out[url_col] == found["__url"], "left")
    return joined.select(*pages.columns, "host", "path", "rule", F.coalesce("verdict", F.when(F.col("__hit"), "block").otherwise("allow")).alias("verdict"))
