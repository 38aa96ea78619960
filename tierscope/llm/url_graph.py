"""URL filters: path rules, and trust and distrust that propagate over links between hosts.

Hosts with most of their pages allowed by a rule are trusted seeds, hosts
with most of them blocked are blocked seeds.  Trust is a personalised
PageRank along the links; distrust runs against them, from blocked hosts to
those that link to them.  A host whose distrust exceeds its trust by
``MARGIN`` is blocked.  Everything is DataFrame operations: links are
extracted by built-in functions and summed to host edges before any join; a
round is one join on salted edges, one sum, and a checkpoint.

Defined results: a null url or one without ``://`` has empty host and path and
is allowed; null html has no links; repeated rows are judged alike and their
links count again; of rules that fit, the longest wins; an empty table gives
an empty result; other columns of the input do not matter.
"""

from __future__ import annotations

import string
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierscope.llm.common import SALTS, checkpoint
from tierscope.operators.skew import join_on_hot_keys

DAMPING = 0.85
STILL = 1e-6       # rounds end when no host changes by more; what is left to come is below 6e-6, far under MARGIN
ROUNDS = 500       # more mean an error
SQL_ROUNDS = 90    # of the oracle: 0.85 ** 90 is below STILL
MARGIN = 0.01
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


class Rule(NamedTuple):
    verdict: str    # allow or block
    host: str       # with all its subdomains
    path: str       # what the url's path must start with

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def _lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return tuple(F.coalesce(c, F.lit("")) for c in (_lower(F.regexp_extract(url, pattern, 1)), F.regexp_extract(url, pattern, 2)))


def _by_length(rules: tuple[Rule, ...]) -> list[Rule]:
    return sorted(rules, key=lambda r: (-len(r.text), r.text))


def rule_column(host: Column, path: Column, rules: tuple[Rule, ...], value) -> Column:
    """``value`` of the longest rule that fits, else null."""
    out = None
    for r in _by_length(rules):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(value(r))) if out is None else out.when(fits, F.lit(value(r)))
    return F.lit(None).cast("string") if out is None else out


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links from one host to another, one row a pair."""
    host, _ = parts(F.col("url"))
    links = pages.select(host.alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("dst"))
    return links.select("src", _lower(F.col("dst")).alias("dst")).filter("src <> dst and src <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(host, trust, distrust) from ``seeds`` (host, trust, distrust) over ``edges``."""
    def shares(of, to, kind):
        total = edges.groupBy(F.col(of).alias("from")).agg(F.sum("n").alias("total"))
        e = edges.select(F.col(of).alias("from"), F.col(to).alias("to"), "n").withColumn(
            "salt", F.pmod(F.xxhash64("to"), F.lit(SALTS)).cast("int"))
        total = total.withColumn("salt", F.explode(F.expr(f"sequence(0, {SALTS - 1})")))
        return e.join(total, ["from", "salt"]).select(F.lit(kind).alias("kind"), "from", "salt", "to", (F.col("n") / F.col("total")).alias("share"))

    edges = checkpoint(edges)
    # Trust goes along a link, distrust against it.
    flow = checkpoint(shares("src", "dst", "trust").union(shares("dst", "src", "distrust")))
    hosts = seeds.unionByName(edges.selectExpr("explode(array(src, dst)) as host").selectExpr("host", "0D as trust", "0D as distrust"))
    seed = checkpoint(hosts.groupBy("host").agg(F.max("trust").alias("trust"), F.max("distrust").alias("distrust"))
                      .selectExpr("host", "stack(2, 'trust', trust, 'distrust', distrust) as (kind, seed)"))
    state = seed.withColumn("rank", F.col("seed") * (1 - DAMPING))
    for n in range(ROUNDS + 1):
        if n == ROUNDS:
            raise RuntimeError(f"the ranks of hosts still move after {ROUNDS} rounds")
        given = (state.filter("rank > 0").select(F.col("host").alias("from"), "kind", "rank")
                 .withColumn("salt", F.explode(F.expr(f"sequence(0, {SALTS - 1})"))))
        got = (flow.join(given, ["kind", "from", "salt"])
               .groupBy("kind", F.col("to").alias("host")).agg(F.sum(F.col("share") * F.col("rank")).alias("got")))
        new = checkpoint(state.withColumnRenamed("rank", "old").join(got, ["kind", "host"], "left").select(
            "host", "kind", "seed", "old", (F.col("seed") * (1 - DAMPING) + DAMPING * F.coalesce("got", F.lit(0.0))).alias("rank")))
        state = new.drop("old")
        if (new.agg(F.max(F.abs(F.col("rank") - F.col("old")))).first()[0] or 0.0) <= STILL:
            break
    return state.groupBy("host").agg(F.sum(F.when(F.col("kind") == "trust", F.col("rank"))).alias("trust"),
                                    F.sum(F.when(F.col("kind") == "distrust", F.col("rank"))).alias("distrust"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    host, path = parts(F.col("url"))
    p = pages.select("page_id", host.alias("host"), path.alias("path"))
    p = p.withColumns({"rule": rule_column(F.col("host"), F.col("path"), rules, lambda r: r.text),
                       "by_rule": rule_column(F.col("host"), F.col("path"), rules, lambda r: r.verdict)})
    per_host = checkpoint(p.groupBy("host").agg(
        F.count("*").alias("n"), F.count_if(F.col("by_rule") == "allow").alias("allowed"), F.count_if(F.col("by_rule") == "block").alias("blocked")))
    seeds = per_host.select("host", (2 * F.col("allowed") > F.col("n")).cast("double").alias("trust"),
                            (2 * F.col("blocked") > F.col("n")).cast("double").alias("distrust")).filter("host <> ''")
    ranks = propagate(seeds, host_edges(pages))
    hosts = per_host.select("host", "n").join(ranks, "host", "left").select(
        "host", "n", F.when(F.col("distrust") > F.col("trust") + MARGIN, "block").otherwise("allow").alias("by_host"))
    return join_on_hot_keys(p, hosts, "host", "n").select(
        "page_id", "host", "path", "rule", F.coalesce("by_rule", "by_host").alias("verdict"))


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same in SQL: rounds as a chain of tables, over all pairs of seeds and edges."""
    def case(value):
        return "case " + " ".join(f"when (host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}') then '{value(r)}'"
                                  for r in _by_length(rules)) + " end"

    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    link = LINK.replace("(?i)", "").replace("'", "''")
    rounds = "".join(f""",
t{k + 1} as materialized (select s.host, {1 - DAMPING} * s.trust + {DAMPING} * coalesce((select sum(t.trust * n / out_n) from flow join t{k} t on t.host = src where dst = s.host), 0) as trust,
  {1 - DAMPING} * s.distrust + {DAMPING} * coalesce((select sum(t.distrust * n / in_n) from flow join t{k} t on t.host = dst where src = s.host), 0) as distrust from seed s)"""
                     for k in range(SQL_ROUNDS))
    return rf"""
with u as (select page_id, html, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{upper}', '{lower}'), '') as host,
             coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path from pages),
p as (select *, {case(lambda r: r.text)} as rule, {case(lambda r: r.verdict)} as by_rule from u),
links as (select host as src, translate(unnest(regexp_extract_all(html, '(?i){link}', 1)), '{upper}', '{lower}') as dst from u),
edges as (select src, dst, count(*) as n from links where src <> dst and src <> '' group by src, dst),
flow as materialized (select src, dst, n, sum(n) over (partition by src) as out_n, sum(n) over (partition by dst) as in_n from edges),
seed as materialized (select host, max(trust) as trust, max(distrust) as distrust from (
    select host, cast(2 * count_if(by_rule = 'allow') > count(*) as double) as trust, cast(2 * count_if(by_rule = 'block') > count(*) as double) as distrust
    from p where host <> '' group by host
    union all select src, 0, 0 from edges union all select dst, 0, 0 from edges) group by host),
t0 as materialized (select host, {1 - DAMPING} * trust as trust, {1 - DAMPING} * distrust as distrust from seed){rounds}
select page_id, p.host, path, rule, coalesce(by_rule, case when distrust > trust + {MARGIN} then 'block' else 'allow' end) as verdict
from p left join t{SQL_ROUNDS} t on t.host = p.host
"""
