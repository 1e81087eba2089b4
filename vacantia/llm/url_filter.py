"""URL filters by empirical-Bayes host reputation, with fixed rules before it.

Labelled pages give every host a number of outcomes and of bad ones. A beta-binomial prior shrinks
the bad rate of a suffix to that of all pages, of a registered domain to its suffix's, and of a host
to its domain's; the strength of each prior is the moment estimate of how far the rates of that level
spread. A host is blocked when the lower posterior bound of its bad rate is above ``LIMIT``.

Only DataFrame functions are used. The outcomes of each host are counted once, in an aggregate that
Spark combines before the shuffle, and written; all levels and strengths come from that table, and the
three strengths are the only values that reach the driver. A null url, or one with no ``://``, has
empty host and path and no reputation; hosts without labels get their domain's rate. Without labelled
pages nothing but rules decides, and an empty table gives an empty result. Other columns of pages and
outcomes, whatever their names, are passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.llm.common import materialize

#: Rule and verdict.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Suffixes of two labels.
TWO_LABELS = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "co.in", "com.br", "com.mx", "co.za", "com.cn", "com.tr")
LIMIT = 0.35
Z = 1.645
SPREAD = 1024
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABELS), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    three = F.substring_index(host, ".", -3)
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABELS), three).otherwise(two)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, else null."""
    fits = []
    for rule, _ in sorted(rules, key=lambda r: -len(r[0])):
        name, _, rest = rule.partition("/")
        fits.append(F.when(((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}"), rule))
    return F.coalesce(*fits)


def spread(level: DataFrame) -> DataFrame:
    """One row: the moment estimate of the intra-class correlation of the rates in ``level`` (n, bad)."""
    s = level.filter("n > 0").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("big_n"), F.sum("bad").alias("big_k"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("k2n"))
    p = "(big_k / big_n)"
    return s.selectExpr(f"k2n - big_n * {p} * {p} AS between", f"{p} * (1 - {p}) AS var", "big_n - n2 / big_n AS eff", "m - 1 AS df", f"{p} AS mean")


def strength(level: DataFrame) -> tuple[float, float]:
    """Mean rate and prior strength: how many outcomes the prior is worth, 1 to 999."""
    s = spread(level).first()
    if not s["mean"] or not s["var"] or s["eff"] is None or s["eff"] - s["df"] <= 0:
        return (s["mean"] or 0.0), 19.0
    rho = (s["between"] - s["var"] * s["df"]) / (s["var"] * (s["eff"] - s["df"]))
    rho = min(max(rho, 0.001), 0.5)
    return s["mean"], 1 / rho - 1


def reputation(outcomes: DataFrame) -> DataFrame:
    """``host`` and the lower posterior bound ``bad_bound`` of its bad rate; ``outcomes``: host, bad (0 or 1)."""
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = hosts.select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), "n", "bad")
    hosts = materialize(hosts, "host-outcomes")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    mean, of_suffix = strength(suffixes)
    of_domain, of_host = strength(domains)[1], strength(hosts)[1]
    suffixes = suffixes.select("suffix", ((F.col("bad") + of_suffix * mean) / (F.col("n") + of_suffix)).alias("suffix_rate"))
    domains = domains.join(suffixes, "suffix").select("domain", ((F.col("bad") + of_domain * F.col("suffix_rate")) / (F.col("n") + of_domain)).alias("domain_rate"))
    total = F.col("n") + of_host
    rate = (F.col("bad") + of_host * F.col("domain_rate")) / total
    return hosts.join(domains, "domain").select("host", (rate - Z * F.sqrt(rate * (1 - rate) / (total + 1))).alias("bad_bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES) -> DataFrame:
    """Host, path, rule and verdict of every row of ``pages`` (page_id, url); ``outcomes``: page_id, bad.

    Repeated rows and rows with a null page_id are judged like all others. Rows without a host can't be
    blocked by one; they go into the join under as many keys as there are hashes below ``SPREAD``, which
    no host has, so that they don't meet in one task.
    """
    outcomes = outcomes.select("page_id", "bad")
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labelled = parts.select("page_id", "host").join(outcomes, "page_id", "left").select("host", "bad")
    known = reputation(labelled).filter((F.col("host") != "") & (F.col("bad_bound") > LIMIT)).select(F.col("host").alias("key"), F.lit(True).alias("bad_host"))
    none = F.concat(F.lit("/"), F.pmod(F.xxhash64("page_id", "path"), F.lit(SPREAD)).cast("string"))
    keyed = parts.withColumn("key", F.when(F.col("host") == "", none).otherwise(F.col("host")))
    found = keyed.join(known, "key", "left").withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    by_rule = F.coalesce(*[F.when(F.col("rule") == r, v) for r, v in rules])
    return found.select("page_id", "host", "path", "rule", F.coalesce(by_rule, F.when(F.col("bad_host"), "block"), F.lit("allow")).alias("verdict"))


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """A page shows the document whose number is in its path; it is bad if that is toxic or of low quality."""
    number = F.regexp_extract(path_of(F.col("url")), "/([0-9]{1,18})", 1)
    shown = pages.select("page_id", F.when(number != "", number.cast("long")).alias("doc_id")).filter(F.col("doc_id").isNotNull() & F.col("page_id").isNotNull())
    marks = labels.groupBy("doc_id").agg(F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("bad"))
    return shown.join(marks, "doc_id").groupBy("page_id").agg(F.max("bad").alias("bad"))


def op2_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, page_outcomes(pages, spark.read.parquet(f"{sf_dir}/labels.parquet")))


_TWO = ", ".join(f"'{s}'" for s in TWO_LABELS)


def _spread_sql(level: str) -> str:
    return f"""(SELECT CASE WHEN mean IS NULL OR mean = 0 OR var = 0 OR eff - df <= 0 THEN 19.0
      ELSE 1 / least(greatest((between_ - var * df) / (var * (eff - df)), 0.001), 0.5) - 1 END
    FROM (SELECT k2n - big_n * mean * mean AS between_, mean * (1 - mean) AS var, big_n - n2 / big_n AS eff, m - 1 AS df, mean
      FROM (SELECT count(*) AS m, sum(n) AS big_n, sum(bad) / sum(n) AS mean, sum(n * n) AS n2, sum(bad * bad / n) AS k2n FROM {level} WHERE n > 0)))"""


ORACLE = rf"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), m AS (
  SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id
), o AS (
  SELECT p.host, m.bad FROM p LEFT JOIN m ON m.doc_id = try_cast(regexp_extract(p.path, '/([0-9]{{1,18}})', 1) AS BIGINT)
), h AS (
  SELECT host, array_to_string(string_split(host, '.')[-2:], '.') AS two, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad FROM o GROUP BY host
), hosts AS (
  SELECT host, n, bad,
         CASE WHEN two IN ({_TWO}) THEN array_to_string(string_split(host, '.')[-3:], '.') ELSE two END AS domain,
         CASE WHEN two IN ({_TWO}) THEN two ELSE string_split(host, '.')[-1] END AS suffix
  FROM h
), domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY suffix),
k AS (
  SELECT (SELECT coalesce(sum(bad) / sum(n), 0) FROM suffixes) AS mean, {_spread_sql('suffixes')} AS ss, {_spread_sql('domains')} AS sd, {_spread_sql('hosts')} AS sh
), sr AS (SELECT suffix, (bad + ss * mean) / (n + ss) AS rate FROM suffixes, k),
dr AS (SELECT domain, (d.bad + sd * sr.rate) / (d.n + sd) AS rate FROM domains d JOIN sr USING (suffix), k),
hr AS (SELECT host, h.n + sh AS total, (h.bad + sh * dr.rate) / (h.n + sh) AS rate FROM hosts h JOIN dr USING (domain), k),
rep AS (SELECT host, rate - {Z} * sqrt(rate * (1 - rate) / (total + 1)) AS bound FROM hr),
r AS (
  SELECT p.*, bound, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
  FROM p LEFT JOIN rep USING (host)
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN host <> '' AND bound > {LIMIT} THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
