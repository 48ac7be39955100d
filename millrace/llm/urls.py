"""URL verdicts from rules and from trust that travels over host links (DataFrame functions only).

A rule names a host (and all its subdomains) and the start of a path; the longest that fits decides.
Pages that no rule fits take their host's verdict: trust is a personalised PageRank that starts at hosts
with mostly allowed pages and follows links, distrust starts at hosts with mostly blocked pages and runs against them (who
links to a bad host is suspect).  Every seed starts with 1, whatever their number, so a host's ranks depend on its surroundings and
not on the size of the table.  A host is blocked where distrust exceeds both THRESHOLD and its trust.  A blocked host's distrust is
shared among all that link to it: a link to one that everybody links to says little.

Steps go on until less than SETTLED of all mass moves (each step moves at most DAMPING of what the one before did, so this ends).  Mass
that reaches a host without further links goes back to the seeds, which is the same as scaling the ranks to the seeds' mass at the end.

Links are the ``href`` targets of a page that name a host; links within a host carry nothing.  Pages are reduced to their own
distinct (host, target) pairs and those counted before any shuffle, so a host with a third of all pages costs a row
per task.  AT_ONCE steps at a time are written to the shared folder; hosts are never gathered on the driver.

Defined results: a null url or one without ``://`` has an empty host and path and no rule, and is judged like a host
without links; null html has no links; repeated rows stay; an empty table gives an empty table; only ``page_id``,
``url`` and ``html`` are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bounded, join_skewed, read

#: (verdict, host, start of the path), fixed by the query's contract.
RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]
DAMPING, SETTLED, THRESHOLD = 0.85, 1e-4, 1e-3
AT_ONCE = 3
#: A host is a seed if so many of its pages are allowed, or blocked, by rules.
SEED_SHARE = 0.5
MOST_BROADCAST = 500_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HREF = r"(?i)<a\s[^>]*?href\s*=\s*[\"']?(?:[a-z][a-z0-9+.\-]*:)?//([^/?#\"'>\s]*)"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def matched(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Rule text and verdict of the longest rule that fits, else null."""
    text = verdict = None
    for v, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text = F.when(fits, h + p) if text is None else text.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    if text is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return text, verdict


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): on how many pages of ``src`` there is a link to ``dst``."""
    host, _ = split_url(F.col("url"))
    targets = F.array_distinct(F.regexp_extract_all("html", F.lit(_HREF), 1))
    rows = pages.where(F.col("html").contains("//")).select(host.alias("src"), F.explode(targets).alias("dst"))
    rows = rows.select("src", F.translate("dst", _UPPER, _LOWER).alias("dst"))
    return rows.where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("weight"))


def _flow(ranks: DataFrame, edges: DataFrame, column: str, start: str, end: str) -> DataFrame:
    """What arrives at every host from its neighbours; edges carry their share of the sender's weight."""
    sent = edges.join(ranks.select(F.col("host").alias(start), column), start)
    return sent.groupBy(F.col(end).alias("host")).agg(F.sum(F.col(column) * F.col(f"{start}_share")).alias(column))


def host_verdicts(judged: DataFrame, pages: DataFrame) -> DataFrame:
    """(host, n_pages, trust, distrust, host_verdict) of all hosts; ``judged`` has host and the rules' verdict of every page."""
    scratch = Scratch(pages.sparkSession, "hosts")
    share = lambda v: F.avg(F.when(F.col("rule_verdict") == v, 1.0).otherwise(0.0))
    seed = lambda v: F.when(share(v) >= SEED_SHARE, 1.0).otherwise(0.0)
    seeds = judged.groupBy("host").agg(seed("allow").alias("good"), seed("block").alias("bad"), F.count("*").alias("n_pages"))
    edges = scratch.keep(host_links(pages))
    linked = edges.select(F.col("src").alias("host")).unionByName(edges.select(F.col("dst").alias("host"))).distinct()
    or_zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    hosts = seeds.join(linked, "host", "full").select("host", F.coalesce("n_pages", F.lit(0)).alias("n_pages"), or_zero("good"), or_zero("bad"))
    ranks = scratch.keep(hosts.withColumns({"trust": F.col("good"), "distrust": F.col("bad")}))
    scale = (1.0, 1.0)
    if edges.limit(1).count():
        out = edges.groupBy("src").agg(F.sum("weight").alias("out_w"))
        into = edges.groupBy("dst").agg(F.sum("weight").alias("in_w"))
        shares = scratch.keep(
            edges.join(out, "src")
            .join(into, "dst")
            .select(
                "src", "dst", (F.col("weight") / F.col("out_w")).alias("src_share"), (F.col("weight") / F.col("in_w")).alias("dst_share")
            )
        )
        following = lambda seed, got: (1 - DAMPING) * F.col(seed) + DAMPING * F.coalesce(got, F.lit(0.0))

        def step(now: DataFrame) -> DataFrame:
            trust = _flow(now, shares, "trust", "src", "dst").withColumnRenamed("trust", "t")
            distrust = _flow(now, shares, "distrust", "dst", "src").withColumnRenamed("distrust", "d")
            moved = now.join(trust, "host", "left").join(distrust, "host", "left")
            return moved.select(
                "host", "n_pages", "good", "bad", following("good", "t").alias("trust"), following("bad", "d").alias("distrust"),
                (F.abs(following("good", "t") - F.col("trust")) + F.abs(following("bad", "d") - F.col("distrust"))).alias("change"),
            )

        while True:
            now = ranks
            for _ in range(AT_ONCE):
                now = step(now)
            now = scratch.keep(now)
            scratch.drop(ranks)
            ranks = now
            total = now.agg(*[F.sum(c).alias(c) for c in ("change", "good", "bad", "trust", "distrust")]).first()
            if total.change <= SETTLED * (total.good + total.bad):
                break
        scale = (total.good / total.trust if total.trust else 1.0, total.bad / total.distrust if total.distrust else 1.0)
        scratch.drop(shares)
    scratch.drop(edges)
    ranks = ranks.select("host", "n_pages", *[(F.col(c) * F.lit(x)).alias(c) for c, x in zip(("trust", "distrust"), scale)])
    bad = (F.col("distrust") > THRESHOLD) & (F.col("distrust") > F.col("trust"))
    return ranks.select("*", F.when(bad, "block").otherwise("allow").alias("host_verdict"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust."""
    host, path = split_url(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = matched(F.col("host"), F.col("path"), RULES if rules is None else rules)
    judged = split.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("rule_verdict"))
    hosts = host_verdicts(judged, pages)
    met = judged.join(F.broadcast(hosts), "host") if bounded(hosts, MOST_BROADCAST) else join_skewed(judged, hosts, ["host"], "n_pages")
    return met.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", "host_verdict").alias("verdict"), "trust", "distrust")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust."""
    host, path = split_url(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = matched(F.col("host"), F.col("path"), RULES if rules is None else rules)
    judged = split.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("rule_verdict"))
    hosts = host_verdicts(judged, pages).select(F.col("host").alias("_host"), "trust", "distrust", "host_verdict")
    if bounded(hosts, MOST_BROADCAST):
        hosts = F.broadcast(hosts)
    return judged.join(hosts, judged.host == F.col("_host"), "left").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("rule_verdict", "host_verdict", F.lit("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"),
        F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _oracle_sql(steps: int = 63) -> str:
    """The query in SQL, its steps written out one after the other (as many as surely settle)."""
    upper, lower = f"'{_UPPER}'", f"'{_LOWER}'"
    href = r"""(?i)<a\s[^>]*?href\s*=\s*["'']?(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"''>\s]*)"""
    cases = {"rule": "", "verdict": ""}
    for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2])):
        fits = f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN "
        cases["rule"] += fits + f"'{h}{p}' "
        cases["verdict"] += fits + f"'{v}' "
    sql = f"""
WITH parts AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT page_id, html, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), {upper}, {lower}), '') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM parts),
j AS (SELECT *, CASE {cases["rule"]} END AS rule, CASE {cases["verdict"]} END AS rule_verdict FROM p),
links AS (SELECT host AS src, translate(target, {upper}, {lower}) AS dst FROM (SELECT host,
  unnest(list_distinct(regexp_extract_all(html, '{href}', 1))) AS target FROM p)),
edges AS (SELECT src, dst, count(*) AS weight FROM links WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY ALL),
shares AS MATERIALIZED (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS src_share,
  weight / sum(weight) OVER (PARTITION BY dst) AS dst_share FROM edges),
r0 AS MATERIALIZED (SELECT host, max(good) AS good, max(bad) AS bad, max(good) AS trust, max(bad) AS distrust FROM (
  SELECT host, CASE WHEN count(*) FILTER (WHERE rule_verdict = 'allow') >= {SEED_SHARE} * count(*) THEN 1.0::DOUBLE ELSE 0.0 END AS good,
    CASE WHEN count(*) FILTER (WHERE rule_verdict = 'block') >= {SEED_SHARE} * count(*) THEN 1.0::DOUBLE ELSE 0.0 END AS bad FROM j GROUP BY host
  UNION ALL SELECT src, 0.0, 0.0 FROM edges UNION ALL SELECT dst, 0.0, 0.0 FROM edges) GROUP BY host)"""
    for k in range(steps):
        sql += f""",
r{k + 1} AS MATERIALIZED (SELECT r.host, good, bad,
  CASE WHEN EXISTS (SELECT 1 FROM shares) THEN {1 - DAMPING} * good + {DAMPING} * coalesce(t, 0) ELSE trust END AS trust,
  CASE WHEN EXISTS (SELECT 1 FROM shares) THEN {1 - DAMPING} * bad + {DAMPING} * coalesce(d, 0) ELSE distrust END AS distrust FROM r{k} r
  LEFT JOIN (SELECT dst AS host, sum(trust * src_share) AS t FROM shares JOIN r{k} ON src = host GROUP BY dst) a ON a.host = r.host
  LEFT JOIN (SELECT src AS host, sum(distrust * dst_share) AS d FROM shares JOIN r{k} ON dst = host GROUP BY src) b ON b.host = r.host)"""
    return sql + f""",
r AS (SELECT host, trust * coalesce(sum(good) OVER () / nullif(sum(trust) OVER (), 0), 1) AS trust,
  distrust * coalesce(sum(bad) OVER () / nullif(sum(distrust) OVER (), 0), 1) AS distrust FROM r{steps})
SELECT page_id, j.host, path, rule, coalesce(rule_verdict, CASE WHEN distrust > {THRESHOLD} AND distrust > trust THEN 'block' ELSE 'allow' END) AS verdict
FROM j JOIN r ON r.host = j.host"""


ORACLE_SQL = _oracle_sql()
