"""URL filter: empirical-Bayes host reputation under explicit rules, in SQL functions only.

Labelled pages give bad/good outcomes. The rate of each level is shrunk towards its parent's
by a beta-binomial prior: all pages -> suffix (last label) -> registered domain (last two
labels) -> host. The prior's strength at a level is estimated from that level's
over-dispersion by moments. A page is blocked if the lower bound of its host's posterior bad
rate is over the limit; hosts without labels use their domain's or suffix's posterior.

Defined cases: a null url or one without "://" has empty host and path and belongs to the
empty suffix; labels with null outcomes or null ids don't count; repeated label rows count
each; an empty label table gives the uniform prior; other columns of the inputs are ignored.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairline.llm.store import kept

#: (host, path, verdict); the longest fitting one wins. Fixed values.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, says in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, rule_host + rule_path).otherwise(name)
        verdict = F.when(fits, says).otherwise(verdict)
    return name, verdict


#: Rates and prior strengths by level, from {host_n}: host, domain, suffix, n labelled pages, k of them bad.
REPUTATION = """
total AS (SELECT (coalesce(sum(k), 0e0) + 1e0) / (coalesce(sum(n), 0e0) + 2e0) AS p FROM {host_n}),
suffix_n AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM {host_n} GROUP BY suffix),
suffix_m AS (
  SELECT least(1e4, greatest(1e0, 1e0 / greatest(1e-9, (sum(power(k - n * p, 2)) - sum(n * p * (1 - p))) / greatest(1e-9, sum(n * (n - 1) * p * (1 - p)))) - 1e0)) AS m
  FROM (SELECT n, k, (SELECT p FROM total) AS p FROM suffix_n)),
suffix_p AS (SELECT suffix, (k + (SELECT m FROM suffix_m) * (SELECT p FROM total)) / (n + (SELECT m FROM suffix_m)) AS p FROM suffix_n),
domain_n AS (SELECT d.domain, d.n, d.k, s.p FROM (SELECT domain, min(suffix) AS suffix, sum(n) AS n, sum(k) AS k FROM {host_n} GROUP BY domain) d JOIN suffix_p s ON d.suffix = s.suffix),
domain_m AS (SELECT least(1e4, greatest(1e0, 1e0 / greatest(1e-9, (sum(power(k - n * p, 2)) - sum(n * p * (1 - p))) / greatest(1e-9, sum(n * (n - 1) * p * (1 - p)))) - 1e0)) AS m FROM domain_n),
domain_p AS (SELECT domain, (k + (SELECT m FROM domain_m) * p) / (n + (SELECT m FROM domain_m)) AS p FROM domain_n),
host_d AS (SELECT h.host, h.n, h.k, d.p FROM {host_n} h JOIN domain_p d ON h.domain = d.domain),
host_m AS (SELECT coalesce(least(1e4, greatest(1e0, 1e0 / greatest(1e-9, (sum(power(k - n * p, 2)) - sum(n * p * (1 - p))) / greatest(1e-9, sum(n * (n - 1) * p * (1 - p)))) - 1e0)), 1e4) AS m FROM host_d)
"""
#: The posterior of a page's host and the bound; the parent's mean stands in where a level has no labels.
JUDGED = """
SELECT page_id, host, path, rule,
       coalesce(rule_verdict, CASE WHEN a / (a + b) - {z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1e0))) > {limit} THEN 'block' ELSE 'allow' END) AS verdict,
       round(a / (a + b), 6) AS bad_rate
FROM (
  SELECT p.page_id, p.host, p.path, p.rule, p.rule_verdict,
         coalesce(h.k, 0e0) + (SELECT m FROM host_m) * coalesce(d.p, s.p, (SELECT p FROM total)) AS a,
         coalesce(h.n - h.k, 0e0) + (SELECT m FROM host_m) * (1e0 - coalesce(d.p, s.p, (SELECT p FROM total))) AS b
  FROM {pages} p LEFT JOIN {host_n} h ON p.host = h.host LEFT JOIN domain_p d ON p.domain = d.domain LEFT JOIN suffix_p s ON p.suffix = s.suffix)
"""


def judged_pages(pages: DataFrame, labels: DataFrame, *, z: float = 1.645, limit: float = 0.5, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and bad_rate of every page.

    labels: page_id, bad (0 or 1). The label and page sides meet on page_id once, by a shuffle
    join; outcomes are summed per host before anything is joined by host.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    parts = parts.select(
        "page_id", "host", "path", rule.alias("rule"), verdict.alias("rule_verdict"),
        F.regexp_extract("host", r"([^.]*[.])?[^.]*$", 0).alias("domain"), F.regexp_extract("host", r"[^.]*$", 0).alias("suffix"),
    )
    host_n = (
        parts.select("page_id", "host", "domain", "suffix").join(labels.where("bad IS NOT NULL").select("page_id", "bad"), "page_id")
        .groupBy("host", "domain", "suffix").agg(F.count("*").cast("double").alias("n"), F.sum("bad").cast("double").alias("k"))
    )
    return pages.sparkSession.sql("WITH " + REPUTATION + JUDGED, host_n=kept(host_n, "host_n"), pages=parts, z=z, limit=limit)


def oracle(*, z: float = 1.645, limit: float = 0.5, rules=RULES) -> str:
    """The same in DuckDB SQL."""
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{r}'" for f, r, _ in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, _, v in fits) + " END"
    return f"""
WITH urls AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
parts AS (SELECT *, {rule} AS rule, {verdict} AS rule_verdict, regexp_extract(host, '([^.]*[.])?[^.]*$', 0) AS domain, regexp_extract(host, '[^.]*$', 0) AS suffix FROM urls),
host_n AS (
  SELECT host, domain, suffix, CAST(count(*) AS DOUBLE) AS n, CAST(sum(bad) AS DOUBLE) AS k
  FROM parts JOIN (SELECT doc_id, CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality = 1 OR toxic = 0 THEN 0 END AS bad FROM labels) ON page_id = doc_id
  WHERE bad IS NOT NULL GROUP BY ALL),
""" + (REPUTATION + JUDGED).format(host_n="host_n", pages="parts", z=z, limit=limit)
