"""URL filters: host and path rules, and a ratio of two character language models for the rest.

URLs that a rule allows or blocks train the two models.  Each mixes orders 0 to 2: the share of a
character after two others leans on its share after one, and that on its plain share, the more the
rarer the context is.  The difference of the mean log-likelihoods is held against a threshold that
separates the ruled URLs best.  All of it is DataFrame operations.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.frames import pick, stage

#: fixed values: the contract's rules
RULES = (
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
    ("allow", "com/fr/"), ("block", "com/de/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OTHER_SIGNS = "[^a-z0/.:?=&#_%-]"
#: letters, one sign for digits, ten signs, one for all others, begin and end
ALPHABET = 26 + 1 + 10 + 1 + 2
ORDER = 2  # so the model has at most ALPHABET ** 3 = 64,000 rows
LEAN = 5.0  # weight of the shorter context, in counts
BINS_A_NAT, BIN_RANGE = 50, 500  # scores are counted in bins of 1/50 from -10 to 10 to find the threshold


@dataclass(frozen=True)
class UrlModel:
    ratios: DataFrame  # gram, ratio
    threshold: float


def _lowered(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def address(url: Column) -> tuple[Column, Column]:
    """Host and path as the contract has them; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return _lowered(F.regexp_extract(rest, "^([^/?#]*)", 1)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and what it says; null where none does.  Rules are a short list."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):
        site, slash, start = text.partition("/")
        fits = ((host == site) | host.endswith("." + site)) & path.startswith(slash + start)
        rule, action = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(action)
    return rule, action


def _grams(url: Column) -> Column:
    """All runs of three signs of a URL, begin and end signs added."""
    signs = F.regexp_replace(F.translate(_lowered(F.coalesce(url, F.lit(""))), "123456789", "000000000"), OTHER_SIGNS, "~")
    signs = F.concat(F.lit("^^"), signs, F.lit("$"))
    return F.transform(F.sequence(F.lit(1), F.length(signs) - ORDER), lambda i: F.substr(signs, i, F.lit(ORDER + 1)))


def with_rules(pages: DataFrame, page_id: str, url: str, rules=RULES) -> DataFrame:
    named = pick(pages, page_id=page_id, url=url)
    host, path = address(F.col("url"))
    named = named.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, action = longest_rule(F.col("host"), F.col("path"), rules)
    return named.select("*", rule.alias("rule"), action.alias("action"))


def gram_ratios(ruled: DataFrame) -> DataFrame:
    """gram and log-likelihood ratio, allowed over blocked, of every gram of all URLs."""
    grams = ruled.select("action", F.explode(_grams(F.col("url"))).alias("gram"))
    counts = stage(grams.groupBy("gram").agg(
        F.count_if(F.col("action") == "allow").alias("allow"), F.count_if(F.col("action") == "block").alias("block"),
    ))
    totals = counts.agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")).first()

    def over(kind: str, first: int, size: int) -> Column:
        return F.sum(kind).over(Window.partitionBy(F.substring("gram", first, size)))

    logs = {}
    for kind in ("allow", "block"):
        p0 = (over(kind, 3, 1) + 1) / F.lit(float((totals[kind] or 0) + ALPHABET))
        p1 = (over(kind, 2, 2) + LEAN * p0) / (over(kind, 2, 1) + LEAN)
        logs[kind] = F.log((F.col(kind) + LEAN * p1) / (over(kind, 1, 2) + LEAN))
    return counts.select("gram", (logs["allow"] - logs["block"]).alias("ratio"))


def _scored(ruled: DataFrame, ratios: DataFrame) -> DataFrame:
    """Rows with the mean ratio of their grams; the model is broadcast, being at most 64,000 rows."""
    keys = ["row", *[c for c in ruled.columns if c != "url"]]
    rows = ruled.withColumn("row", F.monotonically_increasing_id())
    rows = rows.select(*keys, F.explode(_grams(F.col("url"))).alias("gram"))
    return rows.join(F.broadcast(ratios), "gram").groupBy(*keys).agg(F.avg("ratio").alias("score")).drop("row")


def _threshold(scored: DataFrame) -> float:
    """The score from which URLs pass: the cut with the fewest errors, a class weighing as much as the other."""
    place = F.floor(F.col("score") * BINS_A_NAT)
    bins = scored.where("action is not null").groupBy(
        F.least(F.greatest(place, F.lit(-BIN_RANGE)), F.lit(BIN_RANGE)).alias("bin"),
    ).agg(F.count_if(F.col("action") == "allow").alias("allow"), F.count_if(F.col("action") == "block").alias("block"))
    # a window over all bins: there are at most 1,001
    below, everywhere = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()

    def share(kind: str, part) -> Column:
        return F.coalesce(F.sum(kind).over(part) / F.greatest(F.sum(kind).over(everywhere), F.lit(1)), F.lit(0.0))

    errors = bins.select("bin", (share("allow", below) - share("block", below)).alias("error"))
    best = errors.orderBy(F.round("error", 9), "bin").first()
    return best["bin"] / BINS_A_NAT if best else 0.0


def judge(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every page.

    A null URL, or one without ``://``, has an empty host and path, so no rule; the models judge its
    signs.  Without ruled URLs all scores are 0 and pass.  Repeated rows give repeated rows; other
    columns are not read.
    """
    ruled = with_rules(pages, page_id, url, rules)
    scored = stage(_scored(ruled, gram_ratios(ruled)))
    passes = F.when(F.col("score") >= _threshold(scored), "allow").otherwise("block")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("action", passes).alias("verdict"), "score")
