"""URL filter by rules and by empirical-Bayes host reputation.

Labelled pages give each host a count of pages and of bad pages. Reputation is shrunk level by
level: the corpus rate is the prior mean of the suffixes, a suffix's posterior mean that of its
registered domains, and a domain's posterior mean that of its hosts. Each level's prior is a beta
distribution whose strength is estimated by the method of moments from the spread of the observed
rates between the units of that level (beta-binomial), limited to [1, 1000]. A host is blocked when
the lower posterior bound of its bad rate (mean - z * sd) exceeds ``max_bad``; hosts without labelled
pages fall back to their prior. Explicit rules come first: the longest fitting rule wins.

Plan: one aggregate by host with map-side combining (a host with a third of all pages is one row a
task), after which all tables have a row a host at most. Each level is checkpointed, as the next ones
read it several times. Reputation rows join the pages by host;
they are left to adaptive execution, which broadcasts only what it has measured as small. The page
side of a shuffled join is salted.

Defined results: a url that is null or lacks ``://`` has an empty host and path and the corpus prior.
Labels that are null in quality or toxic count as not bad for that part. Repeated pages count each
time; a page with several labels is bad if any of them is. Without labels all rates are 0 and only
rules block. Columns that the operator does not name are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ballastry.llm.common import ascii_lower, checkpointed, table

#: (verdict, host, path prefix)
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
#: Public suffixes of two labels that this filter knows; others have one label.
TWO_LABEL_SUFFIXES = ["co.uk", "org.uk", "ac.uk", "com.au", "net.au", "co.jp", "co.nz", "co.za", "com.br", "com.mx", "co.in", "com.cn"]
MAX_BAD = 0.3
Z = 1.0
SALTS = 32


def host_of(url: Column) -> Column:
    after = F.when(F.instr(url, "://") > 0, F.substring_index(_after_scheme(url), "/", 1))
    bare = F.substring_index(F.substring_index(after, "?", 1), "#", 1)
    return ascii_lower(F.coalesce(bare, F.lit("")))


def _after_scheme(url: Column) -> Column:
    return F.substring(url, F.instr(url, "://") + 3, F.length(url))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.substring_index(_after_scheme(url), "?", 1), "#", 1))
    return F.coalesce(F.when(F.instr(rest, "/") > 0, F.substring(rest, F.instr(rest, "/"), F.length(rest))), F.lit(""))


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)


def rule_of(host: Column, path: Column) -> tuple[Column, Column]:
    """The longest fitting rule (by host, then path) as text, and its verdict; null if none fits."""
    rule = verdict = None
    for what, own, prefix in sorted(RULES, key=lambda r: (len(r[1]) + len(r[2]), r), reverse=True):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(prefix)
        rule = F.when(fits, own + prefix) if rule is None else rule.when(fits, own + prefix)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    return rule, verdict


def _strength(units: DataFrame, mean: Column) -> Column:
    """An aggregate: the moment estimate of a beta prior's strength from units with n and bad.

    With S = sum n_i (p_i - m_i)^2 and V = sum m_i (1 - m_i), the within-unit part of S is V; what
    is beyond it is the spread between units, whose share of the variance gives the strength.
    """
    n, p = F.col("n"), F.try_divide("bad", "n")
    s = F.sum(n * (p - mean) * (p - mean))
    v = F.sum(mean * (1 - mean))
    w = F.sum((n - 1) * mean * (1 - mean))
    rho = F.try_divide(s - v, w)
    return F.round(F.least(F.greatest(F.coalesce(F.try_divide(1 - rho, F.when(rho > 0, rho)), F.lit(1000.0)), F.lit(1.0)), F.lit(1000.0)), 6)


def reputations(outcomes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """From (host, bad in {0, 1}) rows: posterior tables of hosts, domains and suffixes, and the corpus row."""
    hosts = (
        outcomes.groupBy("host")
        .agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("bad").cast("double").alias("bad"))
        .withColumn("domain", domain_of(F.col("host")))
        .withColumn("suffix", suffix_of(F.col("host")))
    )
    hosts = checkpointed(hosts)
    corpus = hosts.agg(F.round(F.coalesce(F.try_divide(F.sum("bad"), F.sum("n")), F.lit(0.0)), 9).alias("mean0"))

    def level(units: DataFrame, key: str, prior: str, out: str) -> DataFrame:
        fitted = units.agg(_strength(units, F.col(prior)).alias("k"))
        mean = F.round((F.col("k") * F.col(prior) + F.col("bad")) / (F.col("k") + F.col("n")), 9)
        joined = units.crossJoin(F.broadcast(fitted))  # one row
        return joined.withColumn(out, mean).withColumn(out + "_k", F.round(F.col("k") + F.col("n"), 6)).withColumn(out + "_prior_k", F.col("k")).drop("k")

    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).crossJoin(F.broadcast(corpus))
    suffixes = checkpointed(level(suffixes, "suffix", "mean0", "mean1").select("suffix", "mean1", "mean1_k"))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).join(suffixes, "suffix")
    domains = checkpointed(level(domains, "domain", "mean1", "mean2").select("domain", "mean2", "mean2_k"))
    hosts = level(hosts.join(domains, "domain"), "host", "mean2", "mean3").select("host", "n", "bad", "mean3", "mean3_k")
    return hosts, domains, suffixes, corpus


def filter_urls(pages: DataFrame, labels: DataFrame, max_bad: float = MAX_BAD, z: float = Z) -> DataFrame:
    """page_id, host, path, rule, verdict and the posterior mean and lower bound of the host's bad rate.

    ``labels`` has doc_id (the page's id), quality and toxic; a page is bad if quality is 0 or toxic is 1.
    """
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    marks = labels.groupBy(F.col("doc_id").alias("page_id")).agg(
        F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad")
    )
    hosts, domains, suffixes, corpus = reputations(urls.join(marks, "page_id").select("host", "bad"))
    known = urls.select("host").distinct().withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    known = known.join(hosts, "host", "left").join(domains, "domain", "left").join(suffixes, "suffix", "left").crossJoin(F.broadcast(corpus))
    mean = F.coalesce("mean3", "mean2", "mean1", "mean0")
    k = F.when(F.col("mean3").isNotNull(), F.col("mean3_k")).when(F.col("mean2").isNotNull(), F.col("mean2_k")).otherwise(F.coalesce("mean1_k", F.lit(1.0)))
    bound = F.greatest(mean - z * F.sqrt(mean * (1 - mean) / (k + 1)), F.lit(0.0))
    known = known.select("host", F.round(mean, 6).alias("bad_mean"), F.round(bound, 6).alias("bad_bound"))
    known = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = urls.withColumn("salt", F.pmod(F.hash("page_id", "path"), F.lit(SALTS)))
    rule, verdict = rule_of(F.col("host"), F.col("path"))
    own = F.when(F.col("bad_bound") > max_bad, "block").otherwise("allow")
    return salted.join(known, ["host", "salt"]).select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "bad_mean", "bad_bound"
    )


def op2_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, table(spark, sf_dir, "labels"))


OP2_SQL = r"""
WITH u AS (
  SELECT page_id,
         CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^?#]*') ELSE '' END AS hp
  FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(hp, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         CASE WHEN instr(hp, '/') > 0 THEN substr(hp, instr(hp, '/')) ELSE '' END AS path FROM u),
d0 AS (
  SELECT page_id, host, path, string_split(host, '.') AS a,
         array_to_string(string_split(host, '.')[-2:], '.') IN ('co.uk','org.uk','ac.uk','com.au','net.au','co.jp','co.nz','co.za','com.br','com.mx','co.in','com.cn') AS two
  FROM p),
d AS (
  SELECT page_id, host, path, array_to_string(a[(CASE WHEN two THEN -3 ELSE -2 END):], '.') AS domain,
         array_to_string(a[(CASE WHEN two THEN -2 ELSE -1 END):], '.') AS suffix FROM d0),
m AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY 1),
h AS (SELECT host, domain, suffix, count(*)::DOUBLE AS n, sum(bad)::DOUBLE AS bad FROM d JOIN m USING (page_id) GROUP BY ALL),
c AS (SELECT round(coalesce(sum(bad) / sum(n), 0), 9) AS mean0 FROM h),
s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(mean0) AS m FROM h, c GROUP BY 1),
sk AS (SELECT round(least(greatest(coalesce((1 - rho) / (CASE WHEN rho > 0 THEN rho END), 1000.0), 1.0), 1000.0), 6) AS k FROM (
  SELECT (sum(n * (bad / n - m) * (bad / n - m)) - sum(m * (1 - m))) / nullif(sum((n - 1) * m * (1 - m)), 0) AS rho FROM s0)),
s AS (SELECT suffix, round((k * m + bad) / (k + n), 9) AS mean1, round(k + n, 6) AS k1 FROM s0, sk),
e0 AS (SELECT domain, sum(n) AS n, sum(bad) AS bad, any_value(mean1) AS m FROM h JOIN s USING (suffix) GROUP BY 1),
ek AS (SELECT round(least(greatest(coalesce((1 - rho) / (CASE WHEN rho > 0 THEN rho END), 1000.0), 1.0), 1000.0), 6) AS k FROM (
  SELECT (sum(n * (bad / n - m) * (bad / n - m)) - sum(m * (1 - m))) / nullif(sum((n - 1) * m * (1 - m)), 0) AS rho FROM e0)),
e AS (SELECT domain, round((k * m + bad) / (k + n), 9) AS mean2, round(k + n, 6) AS k2 FROM e0, ek),
h0 AS (SELECT host, n, bad, mean2 AS m FROM h JOIN e USING (domain)),
hk AS (SELECT round(least(greatest(coalesce((1 - rho) / (CASE WHEN rho > 0 THEN rho END), 1000.0), 1.0), 1000.0), 6) AS k FROM (
  SELECT (sum(n * (bad / n - m) * (bad / n - m)) - sum(m * (1 - m))) / nullif(sum((n - 1) * m * (1 - m)), 0) AS rho FROM h0)),
hh AS (SELECT host, round((k * m + bad) / (k + n), 9) AS mean3, round(k + n, 6) AS k3 FROM h0, hk),
r AS (
  SELECT page_id, host, path, coalesce(mean3, mean2, mean1, mean0) AS mean,
         CASE WHEN mean3 IS NOT NULL THEN k3 WHEN mean2 IS NOT NULL THEN k2 ELSE coalesce(k1, 1) END AS k
  FROM d LEFT JOIN hh USING (host) LEFT JOIN e USING (domain) LEFT JOIN s USING (suffix), c),
b AS (SELECT *, round(greatest(mean - 1.0 * sqrt(mean * (1 - mean) / (k + 1)), 0), 6) AS bad_bound,
  CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1'
       WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/'
       WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/'
       WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/'
       WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/' END AS rule FROM r)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN bad_bound > 0.3 THEN 'block' ELSE 'allow' END AS verdict,
  round(mean, 6) AS bad_mean, bad_bound
FROM b
"""
