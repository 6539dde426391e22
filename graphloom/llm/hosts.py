"""URL filters: rules, and the reputation of hosts by empirical Bayes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import materialise, table

#: (action, host, path): a rule fits its host and all subdomains where the url's path starts with its path
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Second labels that belong to the suffix under a country's label.
SECOND = ["ac", "co", "com", "edu", "gov", "net", "org"]
#: Words of a url that tell a page of an unwanted trade.
TRADES = ["bet", "bets", "betting", "casino", "gambling", "pills", "poker", "porn", "viagra", "xxx"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host after the first '://' (A-Z folded) and the path up to '?' or '#'; both empty without '://' or url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.coalesce(F.translate(raw, _UPPER, _LOWER), F.lit("")), F.coalesce(F.regexp_extract(F.substr(rest, F.length(raw) + 1), "^[^?#]*", 0), F.lit(""))


def domain_and_suffix(host: Column) -> tuple[Column, Column]:
    """The registered domain and its suffix: the last label, or the last two of a country's second-level scheme. Without user and port; a bare or numeric host is its own."""
    bare = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    parts = F.split(bare, r"\.")
    n = F.size(parts)
    deep = (F.length(F.element_at(parts, -1)) == 2) & (n >= 2) & F.coalesce(F.get(parts, n - 2), F.lit("")).isin(SECOND)
    k = F.when(deep, 2).otherwise(1)
    own = (n <= k) | bare.rlike(r"^[0-9.]+$")
    suffix = F.when(own, bare).otherwise(F.array_join(F.slice(parts, -k, k), "."))
    return F.when(own, bare).otherwise(F.array_join(F.slice(parts, -(k + 1), k + 1), ".")), suffix


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, its action) of the longest rule that fits; null without one."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, domain, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit(start))
        name, action = F.when(fits, domain + start).otherwise(name), F.when(fits, what).otherwise(action)
    return name, action


def strength(groups: DataFrame, parents: DataFrame, key: str | None) -> float:
    """Pseudo-observations of the beta prior that groups have about their parents' shares (bad of n), by the method of moments, from 1 to 1,000.

    Groups' shares are compared with the raw share of their own parent (column key; None: one parent for all), and the
    spread that is left beyond chance, pooled over parents, says how tightly they lie. One row of sums reaches the driver."""
    up = parents.select(*([key] if key else []), F.col("n").cast("double").alias("up_n"), (F.col("bad") / F.col("n")).alias("mean")).filter("up_n > 0")
    rows = groups.filter("n > 0").join(up, key) if key else groups.filter("n > 0").crossJoin(F.broadcast(up))  # one row
    n, mean = F.col("n").cast("double"), F.col("mean")
    each = rows.groupBy(*([key] if key else []), "up_n", "mean").agg(F.count("*").alias("k"), F.sum(n * n).alias("squares"), F.sum(n * (F.col("bad") / n - mean) * (F.col("bad") / n - mean)).alias("spread"))
    noise = F.col("mean") * (1 - F.col("mean"))
    k, total, room, spread, chance = each.agg(F.sum(F.col("k") - 1), F.sum("up_n"), F.sum(F.col("up_n") - F.col("squares") / F.col("up_n")), F.sum(F.col("spread") - (F.col("k") - 1) * noise), F.sum(F.col("up_n") * noise)).first()
    if not k or not chance or not room or spread <= 0:
        return 1000.0
    return min(1000.0, max(1.0, (chance / total) / (spread / room) - 1))


def host_reputation(pages: DataFrame, outcomes: DataFrame, z: float = 1.645) -> DataFrame:
    """(host, n, bad, share, bound) of every host in pages (page_id, host): the posterior mean share of bad pages and its lower bound.

    outcomes: (page_id, bad 0/1). Each level's share is shrunk to its parent's: suffixes to the whole, domains
    to their suffix, hosts to their domain, each by a prior fitted to that level's spread within its parents. A host
    without outcomes has its domain's prior. The bound is the mean less z standard deviations of the posterior beta
    distribution, the normal approximation of its quantile. Sums by host are written once; only sums move."""
    domain, suffix = domain_and_suffix(F.col("host"))
    hosts = pages.join(outcomes, "page_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts, _ = materialise(hosts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "bad"), "hosts")
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    whole = suffixes.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    n, bad = whole.first()
    mean = float(bad) / float(n) if n else 0.0
    k_suffix, k_domain, k_host = strength(suffixes, whole, None), strength(domains, suffixes, "suffix"), strength(hosts, domains, "domain")
    suffixes = suffixes.select("suffix", ((F.col("bad") + k_suffix * mean) / (F.col("n") + k_suffix)).alias("m"))
    domains = domains.join(suffixes, "suffix").select("suffix", "domain", ((F.col("bad") + k_domain * F.col("m")) / (F.col("n") + k_domain)).alias("m"))
    a, b = F.col("bad") + k_host * F.col("m"), F.col("n") - F.col("bad") + k_host * (1 - F.col("m"))
    share, spread = a / (a + b), F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return hosts.join(domains, ["suffix", "domain"]).select("host", "n", "bad", share.alias("share"), (share - z * spread).alias("bound"))


def url_outcomes(pages: DataFrame) -> DataFrame:
    """(page_id, bad) of pages (page_id, url): bad is 1 if the url names a TRADE among its words, else 0; null urls have no outcome."""
    words = F.split(F.translate("url", _UPPER, _LOWER), "[^a-z]+")
    return pages.filter("url is not null").select("page_id", F.arrays_overlap(words, F.array(*[F.lit(w) for w in TRADES])).cast("int").alias("bad"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]] = RULES, limit: float = 0.3) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of pages (page_id, url).

    The longest fitting rule decides; without one a page is blocked if its host's posterior lower bound
    of the bad share exceeds limit. Null and odd urls share the empty host. Repeated rows are judged each; a page
    with several outcomes counts as bad if one says so; null ids and outcomes teach nothing; other columns are
    not read; no pages, no rows."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    known = outcomes.filter(F.col("page_id").isNotNull() & F.col("bad").isin(0, 1)).groupBy("page_id").agg(F.max("bad").cast("long").alias("bad"))
    bounds = host_reputation(rows.select("page_id", "host"), known).select("host", "bound")
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(action, F.when(F.col("bound") > limit, "block").otherwise("allow"))
    return rows.join(bounds, "host", "left").select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages; pages have no labels, so a page's outcome is what its url says of its trade."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, url_outcomes(pages))


ORACLE_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*', 0)) + 1), '^[^?#]*', 0) AS path
  FROM u
), o AS (
  SELECT page_id, max(CASE WHEN list_has_any(string_split_regex(translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z]+'), ['bet', 'bets', 'betting', 'casino', 'gambling', 'pills', 'poker', 'porn', 'viagra', 'xxx']) THEN 1 ELSE 0 END) AS bad
  FROM pages WHERE url IS NOT NULL AND page_id IS NOT NULL GROUP BY page_id
), hosts AS (
  SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad FROM h LEFT JOIN o ON h.page_id = o.page_id GROUP BY host
), bare AS (
  SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS b FROM hosts
), parts AS (
  SELECT *, string_split(b, '.') AS p FROM bare
), deep AS (
  SELECT *, CASE WHEN length(p[-1]) = 2 AND len(p) >= 2 AND p[-2] IN ('ac', 'co', 'com', 'edu', 'gov', 'net', 'org') THEN 2 ELSE 1 END AS k FROM parts
), named AS (
  SELECT host, n, bad,
    CASE WHEN len(p) <= k OR regexp_matches(b, '^[0-9.]+$') THEN b ELSE array_to_string(p[len(p) - k:], '.') END AS domain,
    CASE WHEN len(p) <= k OR regexp_matches(b, '^[0-9.]+$') THEN b ELSE array_to_string(p[len(p) - k + 1:], '.') END AS suffix
  FROM deep
), domains AS (
  SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM named GROUP BY ALL
), suffixes AS (
  SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL
), g AS (
  SELECT CASE WHEN sum(n) > 0 THEN CAST(sum(bad) AS DOUBLE) / sum(n) ELSE 0 END AS mu FROM suffixes
), lv AS (
  SELECT 's' AS level, '' AS up, n, bad FROM suffixes UNION ALL SELECT 'd', suffix, n, bad FROM domains UNION ALL SELECT 'h', domain, n, bad FROM named
), ups AS (
  SELECT level, up, n, bad, CAST(sum(n) OVER (PARTITION BY level, up) AS DOUBLE) AS un, sum(bad) OVER (PARTITION BY level, up) / CAST(sum(n) OVER (PARTITION BY level, up) AS DOUBLE) AS m FROM lv WHERE n > 0
), each AS (
  SELECT level, up, un, m, count(*) AS k, CAST(sum(CAST(n AS DOUBLE) * n) AS DOUBLE) AS squares, sum(n * (CAST(bad AS DOUBLE) / n - m) * (CAST(bad AS DOUBLE) / n - m)) AS spread FROM ups GROUP BY level, up, un, m
), sums AS (
  SELECT level, sum(k - 1) AS k, sum(un) AS total, sum(un - squares / un) AS room, sum(spread - (k - 1) * m * (1 - m)) AS spread, sum(un * m * (1 - m)) AS chance FROM each GROUP BY level
), kappa AS (
  SELECT level, CASE WHEN k = 0 OR chance = 0 OR room = 0 OR spread <= 0 THEN 1000.0::DOUBLE ELSE least(1000.0, greatest(1.0, (chance / total) / (spread / room) - 1))::DOUBLE END AS kappa FROM sums
), k AS (
  SELECT coalesce(max(CASE WHEN level = 's' THEN kappa END), 1000) AS ks, coalesce(max(CASE WHEN level = 'd' THEN kappa END), 1000) AS kd, coalesce(max(CASE WHEN level = 'h' THEN kappa END), 1000) AS kh FROM kappa
), ms AS (
  SELECT suffix, (bad + ks * mu) / (n + ks) AS m FROM suffixes, k, g
), md AS (
  SELECT d.suffix, d.domain, (bad + kd * m) / (n + kd) AS m FROM domains d JOIN ms ON d.suffix = ms.suffix, k
), ab AS (
  SELECT host, bad + kh * m AS a, n - bad + kh * (1 - m) AS b FROM named JOIN md ON named.suffix = md.suffix AND named.domain = md.domain, k
), bounds AS (
  SELECT host, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS bound FROM ab
), r AS (
  SELECT page_id, h.host, path, bound,
    CASE WHEN (h.host = 'example.net' OR h.host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
      WHEN (h.host = 'example.com' OR h.host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
      WHEN (h.host = 'org' OR h.host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
      WHEN (h.host = 'net' OR h.host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM h JOIN bounds ON h.host = bounds.host
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN bound > 0.3 THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
