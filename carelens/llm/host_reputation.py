"""URL filtering by fixed host rules and empirical-Bayes host reputation.

Labelled page outcomes (bad or not) give a count of bad pages for every host. Small hosts are
shrunk: the overall rate is the prior mean of a suffix, the suffix's posterior mean that of its
registered domains, the domain's that of its hosts; each level's prior strength is the
beta-binomial one that fits the spread of the rates at that level (method of moments). Every host
of the pages has a posterior: one without outcomes (n = k = 0) has its domain's mean, a domain
without any its suffix's. A host is blocked when a lower bound of its posterior bad rate lies
above ``max_bad``. Rules go before the reputation.

The suffix is the last label of a host, or the last two where SECOND_LEVEL lists them; the
registered domain has one label more. A port is left out, an IP address is its own domain and suffix.

Only built-in functions are used. Outcomes are counted by host map-side, and pages meet their
host's posterior in a join on the host that adaptive execution can split.

Defined cases: a NULL url or one without ``://`` has an empty host and path, matches no rule and
is judged by the empty host's posterior; outcomes of a page are its worst label; NULL outcomes
and outcomes of unknown pages count for nothing; without any outcome all is allowed but what a
rule blocks; repeated pages are judged each; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelens.llm.common import LOWER, UPPER, saved

#: Fixed values: (verdict, host, path prefix).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: Suffixes of two labels under which domains are registered.
SECOND_LEVEL = ("ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "co.nz", "co.za", "co.in", "co.jp", "co.kr", "com.br",
                "com.cn", "com.mx", "com.tr")
MAX_BAD = 0.5
Z = 1.645
STRENGTH = (1.0, 10_000.0)


def split_url(url: str) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url column; both empty without ``://``."""
    u = F.coalesce(F.col(url), F.lit(""))
    host = F.translate(F.regexp_extract(u, r"://([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(u, r"://[^/?#]*([^?#]*)", 1)


def rule_of(host: str, path: str, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else NULLs."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col(host) == h) | F.col(host).endswith("." + h)) & F.col(path).startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def levels_of(host: str) -> tuple[str, str]:
    """SQL (registered domain, suffix) of a host column."""
    name = f"regexp_replace({host}, ':[0-9]*$', '')"
    listed = ", ".join(f"'{s}'" for s in SECOND_LEVEL)

    def level(short: int) -> str:
        return (f"CASE WHEN {name} RLIKE '^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$' THEN {name} "
                f"WHEN substring_index({name}, '.', -2) IN ({listed}) THEN substring_index({name}, '.', {short - 1}) "
                f"ELSE substring_index({name}, '.', {short}) END")

    return level(-2), level(-1)


def _strength(groups: DataFrame, mean: str) -> DataFrame:
    """One row: the pseudo-count m of a beta prior with the given means that fits groups (n, k).

    Var(k) = n mu (1 - mu) (1 + (n - 1) rho) with rho = 1 / (m + 1), summed over the groups.
    """
    rho = F.try_divide(
        F.sum((F.col("k") - F.col("n") * F.col(mean)) ** 2 - F.col("n") * F.col(mean) * (1 - F.col(mean))),
        F.sum(F.col("n") * (F.col("n") - 1) * F.col(mean) * (1 - F.col(mean))))
    low, high = STRENGTH
    return groups.agg(rho.alias("rho")).select(
        F.expr(f"CASE WHEN rho IS NULL OR isnan(rho) OR rho <= 0 THEN {high} "
               f"ELSE least({high}, greatest({low}, 1 / rho - 1)) END").alias("m"))


def _level(groups: DataFrame, parents: DataFrame, key: str, out: str) -> DataFrame:
    """Posterior means of ``groups`` under the posterior mean of their parent (joined on ``key``)."""
    g = groups.join(parents, key)
    return g.withColumn("m", _strength(g, "prior").scalar()).withColumn(out, F.expr("(k + m * prior) / (n + m)"))


def host_posteriors(pages: DataFrame, max_bad: float = MAX_BAD, z: float = Z) -> DataFrame:
    """host, bad_host for every host of ``pages`` (host, bad 0/1 or NULL); bad_host is NULL without any outcome.

    The counts by host are written to the shared folder first: all levels read that small table.
    """
    hosts = pages.groupBy("host").agg(F.count("bad").cast("double").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("k"))
    domain, suffix = levels_of("host")
    hosts = saved(pages.sparkSession, hosts, "host_counts").withColumn("suffix", F.expr(suffix)).withColumn("domain", F.expr(domain))
    total = F.sum("n").alias("n"), F.sum("k").alias("k")
    domains = hosts.groupBy("suffix", "domain").agg(*total)
    suffixes = domains.groupBy("suffix").agg(*total)
    base = suffixes.agg(F.expr("try_divide(sum(k), sum(n))")).scalar()
    by_suffix = _level(suffixes, suffixes.select("suffix", base.alias("prior")), "suffix", "post")
    by_domain = _level(domains, by_suffix.select("suffix", F.col("post").alias("prior")), "suffix", "post")
    by_host = _level(hosts, by_domain.select("domain", F.col("post").alias("prior")), "domain", "mean")
    bound = F.expr(f"mean - {z} * sqrt(mean * (1 - mean) / (n + m + 1))")
    return by_host.select("host", (bound > max_bad).alias("bad_host"))


def judged_pages(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]] = RULES,
                 max_bad: float = MAX_BAD, z: float = Z) -> DataFrame:
    """page_id, host, path, rule, verdict of ``pages`` (page_id, url); ``outcomes``: (page_id, bad 0/1)."""
    host, path = split_url("url")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    worst = outcomes.filter("bad IS NOT NULL").groupBy(F.col("page_id").cast("long").alias("page_id")).agg(F.max("bad").alias("bad"))
    posteriors = host_posteriors(p.join(worst, "page_id", "left").select("host", "bad"), max_bad, z)
    rule, said = rule_of("host", "path", rules)
    return p.join(posteriors, "host", "left").select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(said, F.when(F.col("bad_host"), "block").otherwise("allow")).alias("verdict"))
