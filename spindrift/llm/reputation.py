"""URL filters by empirical-Bayes host reputation, in DataFrame functions only.

Labelled page outcomes (bad or good) are counted by host.  The rate of bad pages is shrunk level by level: a
suffix (`com`) towards the rate of all pages, a registered domain (`example.com`) towards its suffix, a host
towards its domain.  The strength of each prior is that of a beta-binomial fitted by moments to the level's
groups.  A host without labels gets its domain's rate, and so on up.  A page is blocked if the lower bound of
its host's posterior lies over `LIMIT`; explicit rules go before that.

Counts are combined before they are shuffled, and levels above hosts shrink at each step; the posterior of
the hosts is a written table, so that a host with a third of all pages is split by the skew join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import staged, table

# The rules of the registered query (verdict, rule).
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
# Public second-level suffixes under which domains are registered one label further down.
SUFFIXES = ("ac.uk", "co.jp", "co.kr", "co.nz", "co.uk", "com.au", "com.br", "com.cn", "com.mx", "org.au", "org.uk")
LIMIT = 0.35
BOUND = 1.645  # standard deviations under the posterior mean
LEAST, MOST = 1.0, 1000.0  # limits of a prior's strength, in pages

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def suffix_of(host: Column) -> Column:
    two = F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)
    return F.when(two.isin(*SUFFIXES), two).otherwise(F.regexp_extract(host, r"([^.]*)$", 1))


def domain_of(host: Column) -> Column:
    two = F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)
    three = F.regexp_extract(host, r"([^.]+\.[^.]+\.[^.]+)$", 1)
    found = F.when(two.isin(*SUFFIXES), three).otherwise(two)
    return F.when(found == "", host).otherwise(found)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits, else null.  A rule fits its host and all its subdomains."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        at = rule.index("/")
        fits = ((host == rule[:at]) | host.endswith("." + rule[:at])) & path.startswith(rule[at:])
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def _strength(groups: DataFrame) -> Column:
    """Beta-binomial prior strength by moments over (n, bad, prior) rows: an aggregate.

    Between-group variance v of the rates, less the binomial part, gives strength m(1 - m)/v - 1.
    """
    p = F.col("prior")
    excess = F.sum((F.col("bad") - F.col("n") * p) * (F.col("bad") - F.col("n") * p) - F.col("n") * p * (1 - p))
    scale = F.sum(F.col("n") * (F.col("n") - 1) * p * (1 - p))
    rho = excess / scale  # correlation within a group: 1 / (strength + 1)
    return F.when((scale > 0) & (rho > 0), F.least(F.lit(MOST), F.greatest(F.lit(LEAST), 1 / rho - 1))).otherwise(F.lit(MOST))


def reputations(spark: SparkSession, hosts: DataFrame) -> DataFrame:
    """Posterior of each host: (host, rate, bound) from (host, n, bad); n may be 0."""
    hosts = hosts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    top = suffixes.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 0.5) / (F.coalesce(F.sum("n"), F.lit(0)) + 1.0)).alias("prior"))

    def shrunk(groups: DataFrame) -> DataFrame:
        # One row each: the strength of a level and the rate of all pages.
        return groups.crossJoin(F.broadcast(groups.agg(_strength(groups).alias("s")))).withColumn("rate", (F.col("bad") + F.col("s") * F.col("prior")) / (F.col("n") + F.col("s")))

    suffixes = shrunk(suffixes.crossJoin(F.broadcast(top)))
    domains = shrunk(domains.join(suffixes.select("suffix", F.col("rate").alias("prior")), "suffix"))
    hosts = shrunk(hosts.drop("suffix").join(domains.select("domain", F.col("rate").alias("prior")), "domain"))
    spread = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + F.col("s") + 1))
    return hosts.select("host", "rate", (F.col("rate") - BOUND * spread).alias("bound"))


def judge(spark: SparkSession, pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]] = RULES, limit: float = LIMIT) -> DataFrame:
    """One row for each row of `pages`: (page_id, host, path, rule, verdict, bound).

    `outcomes` has (page_id, bad 0/1); null ids and outcomes are no evidence, of several for one page the
    worst counts once.  A null url, or one without `://`, has empty host and path and is judged as host ''.
    Repeated pages are judged alike, and each counts.  Other columns are ignored.
    """
    pages = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = outcomes.where("page_id is not null and bad in (0, 1)").groupBy("page_id").agg(F.max("bad").alias("bad"))
    seen = pages.select("page_id", "host").join(known, "page_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    of = staged(spark, reputations(spark, staged(spark, seen)))
    rule = rule_of(F.col("host"), F.col("path"), rules)
    verdict = F.lit(None).cast("string")
    for said, name in rules:
        verdict = F.when(F.col("rule") == name, F.lit(said)).otherwise(verdict)
    return pages.join(of.select("host", "bound"), "host", "left").withColumn("rule", rule).select("page_id", "host", "path", "rule", F.coalesce(verdict, F.when(F.col("bound") > limit, "block").otherwise("allow")).alias("verdict"), "bound")


def op7_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    return judge(spark, table(spark, sf_dir, "pages"), outcomes).drop("bound")


def _oracle() -> str:
    """The registered query in DuckDB's SQL."""
    two, three = r"regexp_extract(host, '([^.]+\.[^.]+)$', 1)", r"regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1)"
    listed = ", ".join(f"'{s}'" for s in SUFFIXES)
    rules = "".join(
        f" WHEN (host = '{r[: r.index('/')]}' OR host LIKE '%.{r[: r.index('/')]}') AND starts_with(path, '{r[r.index('/') :]}') THEN '{r}'"
        for _, r in sorted(RULES, key=lambda x: -len(x[1]))
    )
    said = "".join(f" WHEN rule = '{r}' THEN '{v}'" for v, r in RULES)

    def level(name: str, source: str) -> str:
        rho = "sum((bad - n * prior) * (bad - n * prior) - n * prior * (1 - prior)) / nullif(sum(n * (n - 1) * prior * (1 - prior)), 0)"
        strength = f"(SELECT CASE WHEN {rho} > 0 THEN least({MOST}, greatest({LEAST}, 1 / ({rho}) - 1)) ELSE {MOST} END AS s FROM {source})"
        return f"{name} AS (SELECT *, (bad + s * prior) / (n + s) AS rate FROM {source}, {strength})"

    return f"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_UPPER.lower()}') AS host,
 regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
o AS (SELECT doc_id AS page_id, max(1 - quality) AS bad FROM labels WHERE doc_id IS NOT NULL AND quality IN (0, 1) GROUP BY 1),
c AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad FROM p LEFT JOIN o USING (page_id) GROUP BY 1),
h AS (SELECT *, CASE WHEN {two} IN ({listed}) AND {three} <> '' THEN {three} WHEN {two} NOT IN ({listed}) AND {two} <> '' THEN {two} ELSE host END AS domain,
 CASE WHEN {two} IN ({listed}) THEN {two} ELSE regexp_extract(host, '([^.]*)$', 1) END AS suffix FROM c),
d0 AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY 1, 2),
s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d0 GROUP BY 1),
s1 AS (SELECT *, (SELECT (sum(bad) + 0.5) / (sum(n) + 1.0) FROM s0)::DOUBLE AS prior FROM s0), {level("s2", "s1")},
d1 AS (SELECT d0.*, s2.rate AS prior FROM d0 JOIN s2 USING (suffix)), {level("d2", "d1")},
h1 AS (SELECT h.host, h.n, h.bad, d2.rate AS prior FROM h JOIN d2 USING (domain)), {level("h2", "h1")},
j AS (SELECT p.*, h2.rate - {BOUND} * sqrt(h2.rate * (1 - h2.rate) / (h2.n + h2.s + 1)) AS bound, CASE{rules} END AS rule FROM p JOIN h2 USING (host))
SELECT page_id, host, path, rule, CASE{said} WHEN bound > {LIMIT} THEN 'block' ELSE 'allow' END AS verdict FROM j
"""


ORACLE = _oracle()
