"""URL verdicts by rules and by trust that spreads over host links, on DataFrames alone.

A rule names a host and a path; it fits urls of that host and its subdomains
whose path starts with the rule's, and the longest fitting rule decides. The
other urls are judged by their host: hosts whose pages the rules allow are
trusted seeds, hosts whose pages they block are distrusted ones, each by the
share of its pages. Trust follows links (personalised PageRank) and distrust
follows them backwards, from a bad host to those that link to it. Only the
shares of both at a host are compared, so a host that gets little of either is
judged like one that gets much: it is blocked where distrust is THRESHOLD or
more of all there is. A host that rules judge in part counts its other pages as
neutral beside both. All seeds weigh alike, whatever the number of either kind;
the rank of hosts without links goes nowhere, as giving it back to the seeds
would raise all ranks of a kind by one factor.

Links are the absolute and protocol-relative addresses in href and src
attributes, those of `base` and canonical links among them, counted once a page;
links within a host are left out. Relative addresses lead to the page's own host,
or to that of its `base`, which is counted as such.

A null url, or one without `://`, has an empty host and path, fits no rule and is
allowed, as is every host without evidence. Null html has no links. Repeated
rows are kept; other columns are ignored. One host may have a third of all
pages: what is counted by host is counted before shuffling, and what is looked
up by host goes through a join that deals out hot hosts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, lookup, written

DAMPING = 0.85
ROUNDS = 10
THRESHOLD = 0.5
LINK = r"""(?i:href|src)\s*=\s*["']?(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What lies between `://` and `/`, `?`, `#` or the end, and from there up to `?` or `#`."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def suffixes(host: Column) -> Column:
    """The host and the domains that it lies in."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def rule_table(spark, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Rules as (verdict, host, path) rows."""
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def ruled(pages: DataFrame, rules: DataFrame, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """(page_id, host, path, rule, ruling) of every page; rule and ruling are null where none fits."""
    host, path = host_and_path(F.col(url_column))
    parsed = pages.select(F.col(id_column).alias("page_id"), host.alias("host"), path.alias("path"))
    hosts = parsed.groupBy("host").agg(F.count("*").alias("n"))
    named = rules.select(F.col("host").alias("domain"), F.struct((F.length("host") + F.length("path")).alias("size"), F.concat("host", "path").alias("rule"), F.col("path").alias("prefix"), F.col("verdict").alias("ruling")).alias("r"))
    fitting = hosts.select("host", "n", F.explode(F.array_distinct(suffixes(F.col("host")))).alias("domain")).join(named, "domain")
    by_host = hosts.join(fitting.groupBy("host").agg(F.collect_list("r").alias("rules")), "host", "left")
    found = lookup(parsed, by_host, "host", "n")
    best = F.array_max(F.filter("rules", lambda r: F.startswith(F.col("path"), r["prefix"])))
    return found.withColumn("_best", best).select("page_id", "host", "path", F.col("_best.rule").alias("rule"), F.col("_best.ruling").alias("ruling"))


def edges(pages: DataFrame, url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(src, dst, n): from how many pages of a host another host is linked."""
    html = F.col(html_column)
    found = F.when(F.instr(html, "//") > 0, F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit(LINK), F.lit(1)), lambda h: F.translate(h, _UPPER, _LOWER))))
    linked = pages.select(host_and_path(F.col(url_column))[0].alias("src"), F.explode(found).alias("dst"))
    return linked.where("src != '' AND dst != src").groupBy("src", "dst").agg(F.count("*").alias("n"))


def _spread(links: DataFrame, rank: DataFrame, start: DataFrame, seed: str, rank_name: str, src: str, dst: str) -> DataFrame:
    """One round: each seed's share and what comes over the links."""
    degree = links.groupBy(src).agg(F.sum("n").alias("total"), F.count("*").alias("fan"))
    giver = degree.join(rank.withColumnRenamed("host", src), src).select(src, "total", "fan", rank_name)
    sent = lookup(links, giver, src, "fan").groupBy(F.col(dst).alias("host")).agg(F.sum(F.col(rank_name) * F.col("n") / F.col("total")).alias("got"))
    both = start.select("host", seed).join(sent, "host", "full")
    value = (1 - DAMPING) * F.coalesce(F.col(seed), F.lit(0.0)) + DAMPING * F.coalesce("got", F.lit(0.0))
    return both.select("host", value.alias(rank_name)).where(F.col(rank_name) > 0)


def host_ranks(hosts: DataFrame, links: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(host, trust, distrust) from seeds (host, trusted, blocked) over links (src, dst, n)."""
    links = written(links, "host-links")
    first = lambda seed, name: hosts.select("host", ((1 - DAMPING) * F.col(seed)).alias(name)).where(F.col(name) > 0)
    good, bad = first("trusted", "trust"), first("blocked", "distrust")
    if not links.isEmpty():
        for k in range(rounds):
            before = good, bad
            good = written(_spread(links, good, hosts, "trusted", "trust", "src", "dst"), "trust")
            bad = written(_spread(links, bad, hosts, "blocked", "distrust", "dst", "src"), "distrust")
            if k:
                discard(*before)
    joined = hosts.join(good, "host", "full").join(bad, "host", "full")
    return joined.select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def outweighed(trust: Column, distrust: Column, trusted: Column, blocked: Column) -> Column:
    """Whether distrust is THRESHOLD or more of a host's trust, distrust and neutral pages."""
    neutral = F.when(trusted + blocked > 0, (1 - DAMPING) * (1 - trusted - blocked)).otherwise(0.0)
    return (distrust > 0) & (distrust >= THRESHOLD * (trust + distrust + neutral) - 1e-12)


def verdicts(pages: DataFrame, rules: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of every page."""
    found = written(ruled(pages, rules, id_column, url_column), "ruled")
    share = lambda kind: F.count(F.when(F.col("ruling") == kind, 1)) / F.count("*")
    hosts = written(found.groupBy("host").agg(share("allow").alias("trusted"), share("block").alias("blocked"), F.count("*").alias("pages")), "hosts")
    ranks = host_ranks(hosts.select("host", "trusted", "blocked"), edges(pages, url_column, html_column))
    bad = outweighed(*(F.col(c) for c in ("trust", "distrust", "trusted", "blocked")))
    known = written(hosts.join(ranks, "host").select("host", "pages", "trust", "distrust", bad.alias("bad")), "host-ranks")
    judged = lookup(found, known, "host", "pages")
    method = F.when(F.col("bad"), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruling", method).alias("verdict"), "trust", "distrust")


def oracle(rules: Sequence[tuple[str, str, str]], rounds: int = ROUNDS) -> str:
    """DuckDB SQL for the verdicts on `pages`, with the rounds written out."""
    rows = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)
    steps, good, bad = [], *(f"SELECT host, {1 - DAMPING} * {seed} AS x FROM seeds" for seed in ("trusted", "blocked"))
    for k in range(rounds):
        for name, before, seed, src, dst in (("g", good, "trusted", "src", "dst"), ("b", bad, "blocked", "dst", "src")):
            steps.append(
                f"{name}{k} AS (SELECT host, {1 - DAMPING} * coalesce(seed, 0) + {DAMPING} * coalesce(got, 0) AS x FROM (SELECT host, {seed} AS seed FROM seeds) FULL JOIN "
                f"(SELECT {dst} AS host, sum(x * n / total) AS got FROM links JOIN (SELECT {src}, sum(n) AS total FROM links GROUP BY 1) USING ({src}) JOIN ({before}) s ON s.host = links.{src} GROUP BY 1) USING (host))"
            )
        good, bad = f"SELECT * FROM g{k}", f"SELECT * FROM b{k}"
    lower = f"translate({{}}, '{_UPPER}', '{_LOWER}')"
    attribute = LINK.replace("'", "''")
    return f"""
WITH rules(ruling, rhost, rpath) AS (VALUES {rows}),
parsed AS (SELECT row_number() OVER () AS r, page_id, html, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT r, page_id, html, {lower.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parsed),
ranked AS (SELECT split.*, rhost || rpath AS rule, ruling, row_number() OVER (PARTITION BY r ORDER BY length(rhost || rpath) DESC, rhost || rpath DESC) AS k
  FROM split LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)),
ruled AS (SELECT * FROM ranked WHERE k = 1),
seeds AS (SELECT host, count(*) FILTER (ruling = 'allow') / count(*) AS trusted, count(*) FILTER (ruling = 'block') / count(*) AS blocked FROM ruled GROUP BY 1),
links AS (SELECT src, dst, count(*) AS n FROM (SELECT host AS src, unnest(list_distinct(list_transform(regexp_extract_all(html, '{attribute}', 1), lambda h: {lower.format("h")}))) AS dst FROM split) WHERE src <> '' AND dst <> src GROUP BY 1, 2),
{", ".join(steps)}
SELECT page_id, ruled.host, path, rule, coalesce(ruling, CASE WHEN coalesce(b.x, 0) > 0 AND coalesce(b.x, 0) >= {THRESHOLD} * (coalesce(g.x, 0) + coalesce(b.x, 0) + CASE WHEN trusted + blocked > 0 THEN {1 - DAMPING} * (1 - trusted - blocked) ELSE 0 END) - 1e-12 THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled JOIN seeds USING (host) LEFT JOIN ({good}) g ON g.host = ruled.host LEFT JOIN ({bad}) b ON b.host = ruled.host"""
