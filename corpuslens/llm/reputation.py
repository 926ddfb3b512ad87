"""URL filtering by rules and by empirical-Bayes reputation of hosts."""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.staging import stage

# Public suffixes of two labels that are told apart from domains.
TWO_LABEL_SUFFIXES = [
    "ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "co.nz", "org.nz", "co.jp", "ne.jp", "or.jp",
    "co.kr", "co.in", "co.za", "com.br", "com.mx", "com.ar", "com.cn", "com.tw", "com.tr", "com.sg", "com.hk",
]
_SUFFIX = "(?:" + "|".join(s.replace(".", r"\.") for s in TWO_LABEL_SUFFIXES) + r"|[^.]+)"
SUFFIX_PATTERN = rf"(?:^|\.)({_SUFFIX})$"
DOMAIN_PATTERN = rf"(?:^|\.)([^.]+\.{_SUFFIX})$"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to a slash, question mark, number sign or the end, A-Z lowered."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host up to a question mark, number sign or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


@dataclass(frozen=True)
class Rule:
    """Like ``net/`` or ``example.org/en/1``: a host with its subdomains and the beginning of a path."""

    text: str
    allow: bool

    def fits(self, host: Column, path: Column) -> Column:
        name, slash, rest = self.text.partition("/")
        return ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))


def longest_rule(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """Text of the longest rule that fits and its verdict; null where none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = rule.fits(host, path)
        text = F.when(fits, rule.text).otherwise(text)
        verdict = F.when(fits, "allow" if rule.allow else "block").otherwise(verdict)
    return text, verdict


def _spread(children: DataFrame, prior: str) -> float:
    """Strength of the beta prior that explains how much the children's rates differ.

    By moments: a beta-binomial count has the variance n m (1 - m) (1 + (n - 1) r) with
    r = 1 / (strength + 1). One group or none gives the strongest prior allowed.
    """
    m = F.col(prior)
    noise = m * (1 - m) * F.col("n")
    got = children.where("n > 0").agg(
        F.sum((F.col("bad") - F.col("n") * m) ** 2 - noise).alias("extra"), F.sum(noise * (F.col("n") - 1)).alias("room")
    ).first()
    r = (got["extra"] or 0.0) / got["room"] if got["room"] else 0.0
    return 1 / min(max(r, 1e-3), 0.9) - 1


def _posterior(rows: DataFrame, prior: str, strength: float, name: str) -> DataFrame:
    rate = (F.col(prior) * strength + F.col("bad")) / (F.lit(strength) + F.col("n"))
    return rows.withColumn(name, rate)


def host_reputations(outcomes: DataFrame, z: float = 1.645) -> DataFrame:
    """Posterior of the bad share of each host: host, n, bad, rate, low, high.

    ``outcomes`` has host and bad (0, 1 or null for a page without label). The mean over
    all shrinks each suffix, the suffix its registered domains, the domain its hosts,
    each by a beta prior whose strength is fitted on that level. ``low`` and ``high`` are
    the mean less and plus z standard deviations of the host's beta posterior. Counts
    are summed before they are moved, so a host of any size is one row per task; hosts
    without labels get their domain's mean.
    """
    counted = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    suffix, domain = (F.regexp_extract("host", p, 1) for p in (SUFFIX_PATTERN, DOMAIN_PATTERN))
    hosts = stage(
        counted.withColumn("suffix", suffix).withColumn("domain", F.when(domain == "", F.col("host")).otherwise(domain)), "hosts"
    )
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    root = ((total["bad"] or 0) + 1) / ((total["n"] or 0) + 2)
    suffixes = suffixes.withColumn("prior", F.lit(root))
    suffixes = _posterior(suffixes, "prior", _spread(suffixes, "prior"), "suffix_rate")
    domains = stage(domains.join(suffixes.select("suffix", "suffix_rate"), "suffix"), "domains")
    domains = _posterior(domains, "suffix_rate", _spread(domains, "suffix_rate"), "domain_rate")
    hosts = stage(hosts.join(domains.select("suffix", "domain", "domain_rate"), ["suffix", "domain"]), "hosts")
    strength = _spread(hosts, "domain_rate")
    hosts = _posterior(hosts, "domain_rate", strength, "rate")
    error = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + strength + 1))
    return hosts.select("host", "n", "bad", "rate", (F.col("rate") - z * error).alias("low"), (F.col("rate") + z * error).alias("high"))


def judge_urls(
    pages: DataFrame, labels: DataFrame, rules: list[Rule], most_bad: float = 0.2, z: float = 1.645,
    key: str = "page_id", url: str = "url", label_key: str = "doc_id", good: str = "quality",
) -> DataFrame:
    """Every page row with host, path, the rule that decides (or null) and the verdict.

    Without a rule a page is blocked if even the lower bound of its host's posterior bad
    share is above ``most_bad``. A page's outcome is bad when the label of its key has
    ``good`` = 0. Null urls and urls without ``://`` have an empty host and path and share
    one reputation; null keys have no label; a key with several labels counts each;
    repeated pages stay; empty tables give no rows; other columns are not read.
    """
    place = pages.select(F.col(key).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    outcome = labels.select(F.col(label_key).alias("page_id"), (1 - F.col(good).cast("int")).alias("bad"))
    judged = place.select("page_id", "host").join(outcome, "page_id", "left")
    reputation = host_reputations(judged, z).select("host", (F.col("low") > most_bad).alias("_block"))
    text, verdict = longest_rule(rules, F.col("host"), F.col("path"))
    own = F.when(F.col("_block"), "block").otherwise("allow")
    return place.join(reputation, "host").select(
        F.col("page_id").alias(key), "host", "path", text.alias("rule"), F.coalesce(verdict, own).alias("verdict")
    )
