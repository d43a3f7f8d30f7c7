"""URL filter by empirical-Bayes host reputation.

Labelled page outcomes (1 good, 0 bad) are counted by host, registered domain and suffix. From the
top down each level shrinks its counts to the mean of the level above through a beta-binomial prior;
the prior's strength is the moment estimate of that level (over-dispersion of the children about their
parents' means). A host is allowed if the lower bound of its posterior (mean less ``z`` standard
deviations) reaches ``threshold``; a host without labels has its domain's prior, a domain without
labels its suffix's. Explicit rules go before the method.

Counts are pre-aggregated by host, so a host with a third of all pages is one row; pages meet the
written table of hosts in a join that AQE splits where a host is hot. Only three means and strengths
reach the driver.

Cases: a null url or one without ``://`` has empty host and path and is judged as host ''; a port or user in a host is part of it, but not of its domain; without any
labelled page the prior is uniform; repeated rows are judged each by itself; an empty table gives an
empty result; other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, materialise, table

#: Rules of the contract, as (verdict, host/path).
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: Suffixes of two labels that registrars sell under; a parameter.
LONG_SUFFIXES = ("co.uk", "org.uk", "com.au", "co.jp", "com.br")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), UPPER, LOWER), F.coalesce(path, F.lit(""))


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null if none does; ties go to the first in order of the rule."""
    rule, verdict = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(""))
    for says, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        own, _, rest = text.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(f"/{rest}")
        rule, verdict = rule.when(fits, F.lit(text)), verdict.when(fits, F.lit(says))
    return rule, verdict


def domain_and_suffix(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of the name in a host, user and port left out; an address is its own domain, with the suffix ``ip``."""
    name = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    address = name.rlike(r"^[0-9]+(\.[0-9]+){3}$|^\[")
    long = F.lit(False)
    for s in LONG_SUFFIXES:
        long = long | (name == s) | name.endswith(f".{s}")
    cut = lambda n: F.when(long, F.substring_index(name, ".", -n - 1)).otherwise(F.substring_index(name, ".", -n))
    return F.when(address, name).otherwise(cut(2)), F.when(address, F.lit("ip")).otherwise(cut(1))


def _strength(children: DataFrame) -> float:
    """Moment estimate of a + b of the beta prior: children have n, k and the parent's mean m."""
    m, n, k = F.col("m"), F.col("n"), F.col("k")
    row = children.where("n > 0").agg(F.sum((k - n * m) ** 2 / (m * (1 - m))).alias("spread"), F.sum("n").alias("n"), F.sum(n * (n - 1)).alias("pairs")).first()
    if not row["pairs"]:
        return 2.0
    rho = min(0.99, max(1e-4, (row["spread"] - row["n"]) / row["pairs"]))
    return 1 / rho - 1


def reputations(pages: DataFrame, z: float = 1.645, threshold: float = 0.5) -> DataFrame:
    """Written table of host, posterior_mean, posterior_low, reputable from ``pages`` (host, outcome: 1, 0 or null)."""
    domain, suffix = domain_and_suffix(F.col("host"))
    counts = pages.groupBy("host").agg(F.count("outcome").cast("double").alias("n"), F.coalesce(F.sum("outcome"), F.lit(0)).cast("double").alias("k"))
    hosts = materialise(counts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "k"), "host-counts")
    total = hosts.agg(F.coalesce(F.sum("n"), F.lit(0.0)), F.coalesce(F.sum("k"), F.lit(0.0))).first()
    above = (total[1] + 1) / (total[0] + 2)

    def shrunk(children: DataFrame) -> DataFrame:
        s = _strength(children)
        return children.withColumn("a", s * F.col("m") + F.col("k")).withColumn("b", s * (1 - F.col("m")) + F.col("n") - F.col("k"))

    mean = F.col("a") / (F.col("a") + F.col("b"))
    add = [F.sum("n").alias("n"), F.sum("k").alias("k")]
    suffixes = materialise(shrunk(hosts.groupBy("suffix").agg(*add).withColumn("m", F.lit(above))).select("suffix", mean.alias("m")), "suffix-means")
    domains = hosts.groupBy("suffix", "domain").agg(*add).join(suffixes, "suffix")
    domains = materialise(shrunk(materialise(domains, "domain-counts")).select("domain", mean.alias("m")), "domain-means")
    hosts = shrunk(materialise(hosts.join(domains, "domain"), "host-priors"))
    sd = F.sqrt(F.col("a") * F.col("b") / (F.col("a") + F.col("b") + 1)) / (F.col("a") + F.col("b"))
    out = hosts.select("host", mean.alias("posterior_mean"), (mean - z * sd).alias("posterior_low"))
    return materialise(out.withColumn("reputable", F.col("posterior_low") >= threshold), "host-reputation")


def judged(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]] = RULES, **bounds) -> DataFrame:
    """page_id, host, path, rule, verdict, posterior_low of ``pages`` (page_id, url); ``outcomes`` has page_id, outcome."""
    host, path = host_and_path(F.col("url"))
    d = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    label = outcomes.where("outcome IS NOT NULL").groupBy("page_id").agg(F.min("outcome").alias("outcome"))
    known = reputations(d.join(label, "page_id", "left").select("host", "outcome"), **bounds)
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("reputable"), F.lit("allow")).otherwise(F.lit("block"))
    d = d.join(known, "host", "left")
    return d.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "posterior_mean", "posterior_low")


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Outcome of a page: the quality label of the document whose number its path has (``/en/825``)."""
    number = F.regexp_extract(host_and_path(F.col("url"))[1], r"^/[a-z]+/(\d{1,18})", 1)
    of = pages.select("page_id", F.when(number != "", number).cast("long").alias("doc_id"))
    own = labels.where("quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("outcome"))
    return of.where("doc_id IS NOT NULL").join(own, "doc_id").select("page_id", "outcome")


def op1(spark, sf_dir: str) -> DataFrame:
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    return judged(pages, page_outcomes(pages, labels)).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH p AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1), '') AS path FROM p),
l AS (SELECT doc_id, min(quality) AS outcome FROM labels WHERE quality IS NOT NULL GROUP BY 1),
o AS (SELECT h.*, outcome FROM h LEFT JOIN l ON try_cast(nullif(regexp_extract(path, '^/[a-z]+/(\d{1,18})', 1), '') AS BIGINT) = l.doc_id),
e AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name FROM o),
f AS (SELECT *, regexp_matches(name, '^[0-9]+([.][0-9]+){3}$|^\[') AS address,
             CASE WHEN regexp_matches(name, '(^|[.])(co[.]uk|org[.]uk|com[.]au|co[.]jp|com[.]br)$') THEN 2 ELSE 1 END AS labels FROM e),
c AS (SELECT host, CASE WHEN address THEN name ELSE array_to_string(string_split(name, '.')[-labels - 1:], '.') END AS dom,
             CASE WHEN address THEN 'ip' ELSE array_to_string(string_split(name, '.')[-labels:], '.') END AS suf,
             count(outcome)::DOUBLE AS n, coalesce(sum(outcome), 0)::DOUBLE AS k FROM f GROUP BY ALL),
g AS (SELECT (sum(k) + 1) / (sum(n) + 2) AS m0 FROM c),
s0 AS (SELECT suf, m0 AS m, sum(n) AS n, sum(k) AS k FROM c, g GROUP BY suf, m0),
s1 AS (SELECT 1 / least(0.99, greatest(1e-4, (sum(pow(k - n * m, 2) / (m * (1 - m))) - sum(n)) / sum(n * (n - 1)))) - 1 AS s FROM s0 WHERE n > 0),
sm AS (SELECT suf, (s * m + k) / (s + n) AS m FROM s0, s1),
d0 AS (SELECT dom, m, sum(n) AS n, sum(k) AS k FROM c JOIN sm USING (suf) GROUP BY dom, m),
d1 AS (SELECT 1 / least(0.99, greatest(1e-4, (sum(pow(k - n * m, 2) / (m * (1 - m))) - sum(n)) / sum(n * (n - 1)))) - 1 AS s FROM d0 WHERE n > 0),
dm AS (SELECT dom, (s * m + k) / (s + n) AS m FROM d0, d1),
h0 AS (SELECT host, m, n, k FROM c JOIN dm USING (dom)),
h1 AS (SELECT 1 / least(0.99, greatest(1e-4, (sum(pow(k - n * m, 2) / (m * (1 - m))) - sum(n)) / sum(n * (n - 1)))) - 1 AS s FROM h0 WHERE n > 0),
hm AS (SELECT host, s * m + k AS a, s * (1 - m) + n - k AS b FROM h0, h1),
v AS (SELECT host, a / (a + b) - 1.645 * sqrt(a * b / (a + b + 1)) / (a + b) >= 0.5 AS good FROM hm),
r AS (SELECT o.page_id, o.host, o.path, good,
        CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1'
             WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/'
             WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/'
             WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/'
             WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/' END AS rule
      FROM o JOIN v USING (host))
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN good THEN 'allow' ELSE 'block' END AS verdict FROM r
"""
