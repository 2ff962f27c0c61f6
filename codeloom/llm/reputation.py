"""Empirical-Bayes host reputation, with allow and block rules before it.

Labelled page outcomes (bad or not) are counted per host. Counts roll up from host to registered domain to public
suffix to all; each level's rate is shrunk towards its parent's mean by a beta prior whose strength is the
moment estimate of the overdispersion among that level's groups (beta-binomial):

    E[n (p - m)^2] = m (1 - m) (1 + (n - 1) rho),   strength = 1 / rho - 1

A host is blocked when the lower posterior bound of its bad rate, mean - z * sd, passes ``threshold``; a host
without labels has its domain's prior. Pages are counted by id and host before they meet outcomes, so a repeated or missing id is
no hot key, and meet their host's score under salts, so a host with a third of the pages is no task's. The outcome of a page
counts for its own host too.

Defined results: a null url or one without ``://`` has empty host and path and is judged like any host; a label
whose quality and toxic are both null is no outcome; several labels of a page each count; without any labels
the prior is 1/2 with no evidence, which blocks nothing; a very long url is read whole; an empty table gives an empty
result; other columns are ignored.

Suffixes of more than one label are the parameter ``multi``; its default is short, and a deployment passes the public suffix
list of its day. Host counts are stored once, and all levels read them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import ascii_lower, materialise, salted_join

#: (verdict, rule); a rule is host/path and fits the host and its subdomains where the path starts with its path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
THRESHOLD, Z = 0.4, 1.645
RHO_MIN, RHO_MAX = 1e-3, 0.5
#: Hosts (100 bytes each) whose scores are broadcast; more are joined under salts.
SMALL_HOSTS = 200_000
#: Suffixes of more than one label; a parameter, as lists of public suffixes change.
MULTI_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_columns(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits (ties: the smaller text) and its verdict, both null without one."""
    rule = verdict = F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def domain_columns(host: Column, multi: Sequence[str] = MULTI_SUFFIXES) -> tuple[Column, Column]:
    """Registered domain and suffix; a port or user part is no name. Single-label hosts are their own domain."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":\d*$", "")
    width = F.lit(1)
    for s in multi:
        width = F.when((bare == s) | bare.endswith(f".{s}"), s.count(".") + 1).otherwise(width)
    suffix = F.when(width == 1, F.substring_index(bare, ".", -1)).otherwise(F.substring_index(bare, ".", -2))
    domain = F.when(width == 1, F.substring_index(bare, ".", -2)).otherwise(F.substring_index(bare, ".", -3))
    return domain, suffix


def _strength(groups: DataFrame) -> DataFrame:
    """One row: the prior strength of a level whose rows have bad, n and the parent's mean m."""
    spread = F.col("m") * (1 - F.col("m"))
    seen = groups.where("n > 0").agg(
        F.sum((F.col("bad") - F.col("n") * F.col("m")) * (F.col("bad") / F.col("n") - F.col("m"))).alias("s"), F.sum(spread).alias("a"), F.sum(spread * (F.col("n") - 1)).alias("b")
    )
    rho = F.when(F.col("b") > 0, F.least(F.lit(RHO_MAX), F.greatest(F.lit(RHO_MIN), (F.col("s") - F.col("a")) / F.col("b")))).otherwise(RHO_MAX)
    return seen.select((1 / rho - 1).alias("k"))


def _shrunk(groups: DataFrame) -> DataFrame:
    """Posterior mean per group, from the rates and the level's own prior strength."""
    return groups.crossJoin(F.broadcast(_strength(groups))).withColumn("mean", (F.col("bad") + F.col("k") * F.col("m")) / (F.col("n") + F.col("k")))


def host_scores(hosts: DataFrame, z: float = Z) -> DataFrame:
    """hosts: host, domain, suffix, bad, n. Adds the posterior mean and its lower bound. The four levels hold one
    row per host, domain, suffix and in all; the single rows are aggregates, so broadcasting them is bounded."""
    total = hosts.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("m"))
    suffixes = _shrunk(hosts.groupBy("suffix").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")).crossJoin(F.broadcast(total)))
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    domains = _shrunk(domains.join(suffixes.select("suffix", F.col("mean").alias("m")), "suffix"))
    leaves = _shrunk(hosts.join(domains.select("domain", F.col("mean").alias("m")), "domain"))
    size = F.col("n") + F.col("k")
    sd = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (size + 1))
    return leaves.select("host", F.col("mean").alias("bad_rate"), (F.col("mean") - z * sd).alias("bad_bound"))


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]] = RULES, threshold: float = THRESHOLD, z: float = Z, multi: Sequence[str] = MULTI_SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_bound per page."""
    host, path = split_url(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    known = labels.where("doc_id is not null and (quality is not null or toxic is not null)")
    bad = (F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).cast("long")
    outcomes = known.groupBy(F.col("doc_id").alias("page_id")).agg(F.sum(bad).alias("bad"), F.count("*").alias("n"))
    pairs = urls.groupBy("page_id", "host").agg(F.count("*").alias("times")).join(outcomes, "page_id", "left")
    counts = pairs.groupBy("host").agg(*[F.coalesce(F.sum(F.col(c) * F.col("times")), F.lit(0)).alias(c) for c in ("bad", "n")])
    domain, suffix = domain_columns(F.col("host"), multi)
    hosts = materialise(pages.sparkSession, counts.select("host", domain.alias("domain"), suffix.alias("suffix"), "bad", "n"), "reputation-hosts")
    scores = materialise(pages.sparkSession, host_scores(hosts, z), "reputation-scores")
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bad_bound") > threshold, "block").otherwise("allow")
    met = salted_join(pages.sparkSession, urls, scores, "host", F.xxhash64("page_id", "path"), SMALL_HOSTS, how="left")
    return met.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "bad_bound")
