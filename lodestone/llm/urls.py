"""URL verdicts by rules, else by trust that spreads over links between hosts. DataFrame functions only.

Trust starts at hosts of allowed pages and follows links (personalised PageRank); distrust starts at hosts of blocked
pages and follows links backwards, for who links to bad hosts is suspect. A host with more distrust than trust, times
RATIO, is blocked. Ranks are whole numbers of a fixed unit and all divisions are whole, so that any order of summing
gives the same verdicts. They grow from what seeds keep, round by round, until none changes: the least fixpoint. What a
round adds is DAMPING percent of what the one before added, so UNIT is used up after some 200 rounds on any graph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, materialize, table

#: (host, path, verdict)
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
UNIT = 10**15
#: Percent of a host's rank that it passes on; rounds in one query; distrust counts RATIO times.
DAMPING, CHUNK, RATIO = 85, 4, 1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)\b(?:href|src|action)\s*=\s*["']?\s*([a-z][a-z0-9+.-]*://[^\s"'<>]+)"""


def _rest(url: Column) -> Column:
    """What follows the first `://`; empty if there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    rule = verdict = F.when(F.lit(False), F.lit(""))
    for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = rule.when(fits, F.lit(h + p)), verdict.when(fits, F.lit(v))
    return rule, verdict


def _div(x: Column, y: Column) -> Column:
    return F.call_function("div", x, y)


def host_edges(pages: DataFrame) -> DataFrame:
    """Distinct (src, dst) of links from a page's html to another host; entities in links are left as they are."""
    links = pages.select(F.col("host").alias("src"), F.explode(F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)), host_of))).alias("dst"))
    return links.filter("src <> '' and dst <> '' and src <> dst").distinct()


def host_ranks(judged: DataFrame, edges: DataFrame) -> DataFrame:
    """(host, trust, distrust) of the hosts that either reaches."""
    side = F.when(F.col("verdict") == "allow", "t").otherwise("d")
    n = judged.filter("verdict is not null and host <> ''").groupBy(side.alias("side"), "host").agg(F.count("*").alias("n"))
    totals = {r["side"]: r["n"] for r in n.groupBy("side").agg(F.sum("n").alias("n")).collect()}  # two rows
    each = F.create_map(*[x for s in ("t", "d") for x in (F.lit(s), F.lit(UNIT // max(1, totals.get(s, 1))).cast("long"))])
    seeds = materialize(n.select("side", "host", (F.col("n") * each[F.col("side")]).alias("seed")), "seeds")
    ways = edges.select(F.lit("t").alias("side"), F.col("src").alias("host"), F.col("dst").alias("to")).unionByName(edges.select(F.lit("d").alias("side"), F.col("dst").alias("host"), F.col("src").alias("to")))
    out = ways.groupBy("side", "host").agg(F.count("*").alias("out"))
    ways = materialize(ways.join(out, ["side", "host"]), "ways")
    kept = seeds.select("side", "host", _div(F.col("seed") * (100 - DAMPING), F.lit(100)).alias("r"))
    ranks = materialize(kept, "ranks")
    while True:
        now = before = ranks
        for _ in range(CHUNK):
            before = now
            passed = now.join(ways, ["side", "host"]).select("side", F.col("to").alias("host"), _div(_div(F.col("r") * DAMPING, F.lit(100)), F.col("out")).alias("r"))
            now = kept.unionByName(passed).groupBy("side", "host").agg(F.sum("r").alias("r"))
        both = now.join(before.withColumnRenamed("r", "old"), ["side", "host"], "left").withColumn("old", F.coalesce("old", F.lit(-1)))
        new = materialize(both, "ranks")
        drop(ranks)
        ranks = new.select("side", "host", "r")
        ranks._lodestone_path = new._lodestone_path
        if new.filter("r <> old").isEmpty():  # rows that are new have -1 as old
            break
    drop(ways, seeds)
    is_side = lambda s: F.sum(F.when(F.col("side") == s, F.col("r")).otherwise(0))
    return ranks.groupBy("host").agg(is_side("t").alias("trust"), is_side("d").alias("distrust"))


def verdicts(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A row for each row of pages: page_id, host, path, rule, verdict, trust, distrust (of its host, in UNITs).

    A null url, or one without `://`, has an empty host and path; no rule fits, nothing reaches it, and it is allowed,
    as any host that neither trust nor distrust reaches, and one whose trust and distrust tie. A null or empty html has
    no links; urls and pages of any length are read whole. Pages that repeat an id, or have none, each get a row, and
    each counts as a seed. Other columns, whatever their names, are not read. An empty table gives no rows.
    """
    rules = RULES if rules is None else rules
    known = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = known.withColumn("rule", rule).withColumn("verdict", verdict)
    ranks = materialize(host_ranks(judged.drop("html"), materialize(host_edges(known), "host-edges")), "host-ranks")
    bad = F.coalesce(F.col("distrust") * RATIO > F.col("trust"), F.lit(False))
    out = judged.drop("html").join(ranks, "host", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.when(bad, "block").otherwise("allow")).alias("verdict"), F.coalesce("trust", F.lit(0)).cast("long").alias("trust"), F.coalesce("distrust", F.lit(0)).cast("long").alias("distrust"))


def op7_link_graph_filter(spark, sf_dir):
    return verdicts(table(spark, sf_dir, "pages"))


#: Rounds of the SQL, which has no way to stop: more than any graph needs.
SQL_ROUNDS = 300


def _sql() -> str:
    ladder = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    case = lambda k: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{(h + p, v)[k]}'" for h, p, v in ladder) + " END"
    url_host = lambda u: f"translate(coalesce(regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}')"
    link = LINK.replace("'", "''")
    q = f"""
WITH RECURSIVE p AS MATERIALIZED (
  SELECT *, {case(0)} AS rule, {case(1)} AS v FROM (
    SELECT page_id, html, {url_host("url")} AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)
), e AS MATERIALIZED (
  SELECT DISTINCT src, dst FROM (SELECT host AS src, {url_host("u")} AS dst FROM (SELECT host, unnest(regexp_extract_all(html, '{link}', 1)) AS u FROM p))
  WHERE src <> '' AND dst <> '' AND src <> dst
), w0 AS (SELECT 't' AS side, src AS host, dst AS dest FROM e UNION ALL SELECT 'd', dst, src FROM e),
w AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY side, host) AS n FROM w0),
s0 AS (SELECT CASE WHEN v = 'allow' THEN 't' ELSE 'd' END AS side, host, count(*) AS n FROM p WHERE v IS NOT NULL AND host <> '' GROUP BY ALL),
s AS MATERIALIZED (SELECT side, host, ({UNIT} // (sum(n) OVER (PARTITION BY side))::BIGINT) * n AS r FROM s0),
r AS (
  SELECT 0 AS k, side, host, r * {100 - DAMPING} // 100 AS r FROM s
  UNION ALL SELECT k + 1, side, host, sum(r)::BIGINT FROM (
    SELECT k, w.side, w.dest AS host, (r.r * {DAMPING} // 100) // w.n AS r FROM r JOIN w ON w.side = r.side AND w.host = r.host
    UNION ALL SELECT k, s.side, s.host, s.r * {100 - DAMPING} // 100 FROM s, (SELECT DISTINCT k FROM r)) WHERE k < {SQL_ROUNDS} GROUP BY k, side, host)"""
    return (
        q
        + f""",
k AS (SELECT host, sum(CASE WHEN side = 't' THEN r ELSE 0 END)::BIGINT AS trust, sum(CASE WHEN side = 'd' THEN r ELSE 0 END)::BIGINT AS distrust FROM r WHERE k = {SQL_ROUNDS} GROUP BY host)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN distrust * {RATIO} > trust THEN 'block' ELSE 'allow' END) AS verdict,
       coalesce(trust, 0)::BIGINT AS trust, coalesce(distrust, 0)::BIGINT AS distrust
FROM p LEFT JOIN k USING (host)"""
    )


SQL = _sql()
