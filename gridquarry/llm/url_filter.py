"""URL filters: stated rules first, else the empirical-Bayes reputation of the host.

Labelled pages give each host a number of outcomes and of bad ones. A suffix is shrunk towards the rate of all pages, a
registered domain towards its suffix and a host towards its domain, each through a beta-binomial prior whose strength is
fitted by moments over the units of that level. A host is blocked where the lower posterior bound of its bad rate is
above ``block_above``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridquarry.llm.common import table

#: (verdict, host, path): a rule fits its host and all subdomains where the path starts with the rule's; the longest wins.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Public suffixes of two labels; any other suffix is the last label.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.in")
Z = 1.645
BLOCK_ABOVE = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first ://, up to /, ?, # or the end, with A-Z lower-cased; empty for null or without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule as text, its verdict) of the longest rule that fits, else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name, verdict = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def _strength(units: DataFrame) -> Column:
    """Moment estimate of a level's prior strength over its units (n, bad), between 1 and 1000; 10 where it has fewer than two units."""
    p = F.sum("bad") / F.sum("n")
    spread = p * (1 - p)
    within = F.sum(F.col("bad") * F.col("bad") / F.col("n")) - F.sum("bad") * p
    free = F.count(F.lit(1)) - 1
    rho = F.try_divide(within - spread * free, spread * (F.sum("n") - F.sum(F.col("n") * F.col("n")) / F.sum("n") - free))
    fitted = F.when(rho > 0.001, F.try_divide(F.lit(1.0), rho) - 1).otherwise(1000.0)
    return F.coalesce(F.when(spread > 0, F.greatest(F.lit(1.0), F.least(F.lit(1000.0), fitted))), F.lit(10.0))


def reputation(outcomes: DataFrame, z: float = Z) -> DataFrame:
    """One row per host (host, n, mean, bound) from rows (host, bad 0/1): posterior mean of the bad rate and its lower bound."""
    parts = F.split("host", r"\.")
    two = F.array_join(F.slice(parts, -2, 2), ".")
    long = F.size(parts)
    suffix = F.when((long > 2) & two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.element_at(parts, -1))
    labels = F.when(long < 2, 1).when((long > 2) & two.isin(*TWO_LABEL_SUFFIXES), 3).otherwise(2)
    domain = F.when(long < 2, F.col("host")).otherwise(F.array_join(F.slice(parts, -labels, labels), "."))
    hosts = outcomes.groupBy("host").agg(F.count("bad").cast("double").alias("n"), F.sum(F.col("bad").cast("double")).alias("bad")).where("n > 0")
    hosts = hosts.withColumn("domain", domain).withColumn("suffix", suffix)
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    # Each of these tables is one row.
    top = suffixes.agg(((F.sum("bad") + 1) / (F.sum("n") + 2)).alias("rate"), _strength(suffixes).alias("ks"))
    kd, kh = domains.agg(_strength(domains).alias("kd")), hosts.agg(_strength(hosts).alias("kh"))
    by_suffix = suffixes.join(F.broadcast(top)).select("suffix", ((F.col("ks") * F.col("rate") + F.col("bad")) / (F.col("ks") + F.col("n"))).alias("ms"))
    by_domain = domains.join(by_suffix, "suffix").join(F.broadcast(kd)).select("domain", ((F.col("kd") * F.col("ms") + F.col("bad")) / (F.col("kd") + F.col("n"))).alias("md"))
    total = F.col("kh") + F.col("n")
    judged = hosts.join(by_domain, "domain").join(F.broadcast(kh)).withColumn("mean", (F.col("kh") * F.col("md") + F.col("bad")) / total)
    return judged.select("host", "n", "mean", (F.col("mean") - F.lit(z) * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (total + 1))).alias("bound"))


def judge(pages: DataFrame, labels: DataFrame, page_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id", rules=RULES, z: float = Z, block_above: float = BLOCK_ABOVE) -> DataFrame:
    """One row per page row (page_id, host, path, rule, verdict).

    A labelled page (``labels`` row of the same id) is bad if toxic is 1 or quality is 0; a label whose two values are
    both null says nothing. Null urls have an empty host and path and share the reputation of the empty host. Hosts
    without labels, and all hosts where there are no labels, are allowed unless a rule says otherwise. Repeated rows
    stay; each label row of a repeated page counts.
    """
    seen = pages.select(F.col(page_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    bad = F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).when(F.col("toxic").isNotNull() | F.col("quality").isNotNull(), 0)
    outcomes = seen.join(labels.select(F.col(label_id).alias("page_id"), bad.alias("bad")), "page_id").where("bad is not null")
    known = reputation(outcomes.select("host", "bad"), z).select("host", "bound")
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    learnt = F.when(F.col("bound") > block_above, F.lit("block")).otherwise(F.lit("allow"))
    return seen.join(known, "host", "left").select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, learnt).alias("verdict"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


_STRENGTH = """coalesce(case when sum(bad) / sum(n) * (1 - sum(bad) / sum(n)) > 0 then greatest(1.0, least(1000.0,
  case when {rho} > 0.001 then 1 / ({rho}) - 1 else 1000.0 end)) end, 10.0)""".format(
    rho="""(sum(bad * bad / n) - sum(bad) * (sum(bad) / sum(n)) - sum(bad) / sum(n) * (1 - sum(bad) / sum(n)) * (count(*) - 1))
    / nullif(sum(bad) / sum(n) * (1 - sum(bad) / sum(n)) * (sum(n) - sum(n * n) / sum(n) - (count(*) - 1)), 0)"""
)
_TWO = ", ".join(f"'{x}'" for x in TWO_LABEL_SUFFIXES)
OP6_SQL = f"""
WITH seen AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)\\A.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(url, '(?s)\\A.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
outcomes AS (
  SELECT host, CASE WHEN toxic = 1 OR quality = 0 THEN 1 WHEN toxic IS NOT NULL OR quality IS NOT NULL THEN 0 END AS bad
  FROM seen JOIN labels ON page_id = doc_id),
counted AS (SELECT host, count(bad)::double AS n, sum(bad)::double AS bad, string_split(host, '.') AS p FROM outcomes WHERE bad IS NOT NULL GROUP BY host),
named AS (SELECT *, array_to_string(p[-2:], '.') AS two, len(p) AS k FROM counted),
hosts AS (
  SELECT host, n, bad, CASE WHEN k > 2 AND two IN ({_TWO}) THEN two ELSE p[-1] END AS suffix,
         CASE WHEN k < 2 THEN host WHEN k > 2 AND two IN ({_TWO}) THEN array_to_string(p[-3:], '.') ELSE two END AS domain FROM named),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL),
top AS (SELECT (sum(bad) + 1) / (sum(n) + 2) AS rate, {_STRENGTH} AS ks FROM suffixes),
kd AS (SELECT {_STRENGTH} AS kd FROM domains), kh AS (SELECT {_STRENGTH} AS kh FROM hosts),
ms AS (SELECT suffix, (ks * rate + bad) / (ks + n) AS ms FROM suffixes, top),
md AS (SELECT domain, (kd * ms + bad) / (kd + n) AS md FROM domains JOIN ms USING (suffix), kd),
mh AS (SELECT host, kh + n AS total, (kh * md + bad) / (kh + n) AS mean FROM hosts JOIN md USING (domain), kh),
known AS (SELECT host, mean - {Z} * sqrt(mean * (1 - mean) / (total + 1)) AS bound FROM mh),
ruled AS (
  SELECT page_id, host, path, bound, CASE
    WHEN (host = 'www.example.com' OR suffix(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR suffix(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM seen LEFT JOIN known USING (host))
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN bound > {BLOCK_ABOVE} THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""
