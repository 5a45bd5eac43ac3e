"""Which pages a fetcher may ask for, and when: rules and delays of hosts, applied to a table of addresses. Nothing is fetched.

A host's file names agents, paths that they may or may not ask for, and a delay. The longest path that begins an
address's path decides, and allowing wins among equals; what no rule names is allowed. Each host's pages come in one
order, a delay apart.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StringType, StructField, StructType

from ..sources.sinks import with_ids

#: Seconds between requests to a host whose file names no delay.
DELAY = 1.0
RULES = ArrayType(StructType([StructField("agent", StringType()), StructField("path", StringType()), StructField("allow", BooleanType()), StructField("delay", DoubleType())]))


def host_of(url: Column) -> Column:
    """The host in lower case; empty for a null or an address without one."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def path_of(url: Column) -> Column:
    """Path and query; `/` if there is none."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    return F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))


def rules_in(text: str | None) -> list[dict]:
    """A file's rules, one for each agent and path; a group's delay is a rule without a path."""
    out, agents, open_group = [], [], False
    for line in (text or "").splitlines():
        name, colon, value = line.split("#", 1)[0].partition(":")
        name, value = name.strip().lower(), value.strip()
        if not colon:
            continue
        if name == "user-agent":
            agents = [*agents, value.lower()] if open_group else [value.lower()]
            open_group = True
            continue
        open_group = False
        if name in ("allow", "disallow") and value:
            out += [{"agent": a, "path": value, "allow": name == "allow", "delay": None} for a in agents]
        elif name == "crawl-delay" and value.replace(".", "", 1).isdigit():
            out += [{"agent": a, "path": None, "allow": None, "delay": float(value)} for a in agents]
    return out


@F.pandas_udf(RULES)
def parsed(text: pd.Series) -> pd.Series:
    return text.map(rules_in)


def host_rules(files: DataFrame, agent: str) -> DataFrame:
    """(host, rules, delay) of files (host, robots): the rules for an agent, those for `*` where it isn't named; a row for each host."""
    own = files.groupBy(F.lower("host").alias("host")).agg(F.max("robots").alias("robots")).select("host", parsed("robots").alias("all"))
    named = F.filter("all", lambda r: r["agent"] == agent.lower())
    chosen = F.when(F.size(named) > 0, named).otherwise(F.filter("all", lambda r: r["agent"] == "*"))
    paths = F.transform(F.filter("rules", lambda r: r["path"].isNotNull()), lambda r: F.struct(F.length(r["path"]).alias("long"), r["allow"].alias("allow"), r["path"].alias("path")))
    return own.select("host", chosen.alias("rules")).select("host", paths.alias("rules"), F.coalesce(F.array_max(F.transform("rules", lambda r: r["delay"])), F.lit(DELAY)).alias("delay"))


def judged(pages: DataFrame, files: DataFrame, agent: str = "*", url_col: str = "url") -> DataFrame:
    """pages with host, path, allowed, rule (the path that decided, or null) and delay. Hosts without a file allow all.

    An address without a host is not allowed. Each host's rules travel once; a host with many pages is joined as any
    skewed key is.
    """
    p = pages.withColumn("host", host_of(F.col(url_col))).withColumn("path", path_of(F.col(url_col)))
    out = p.join(host_rules(files, agent), "host", "left")
    best = F.array_max(F.filter(F.coalesce("rules", F.array().cast("array<struct<long:int,allow:boolean,path:string>>")), lambda r: F.startswith(F.col("path"), r["path"])))
    out = out.withColumn("_best", best)
    allowed = (F.col("host") != "") & F.coalesce(F.col("_best.allow"), F.lit(True))
    return out.select(*p.columns, allowed.alias("allowed"), F.col("_best.path").alias("rule"), F.coalesce("delay", F.lit(DELAY)).alias("delay"))


def schedule(told: DataFrame, order: list[str]) -> DataFrame:
    """The allowed rows of judged(), with place (from 0) and at (seconds from the start) of each within its host, by order.

    Rows are numbered by host and order over range partitions, so a host's pages needn't come together.
    """
    numbered = with_ids(told.filter("allowed"), ["host", *order], 0)
    first = numbered.groupBy("host").agg(F.min("id").alias("first"))
    place = F.col("id") - F.col("first")
    return numbered.join(first, "host").select(*told.columns, place.alias("place"), (place * F.col("delay")).alias("at"))
