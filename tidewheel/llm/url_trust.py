"""URL verdicts: rules first, and for the rest trust and distrust that flow over the edges between hosts.

Edges: the absolute links of the pages' HTML from one host to another, weighted by the pages that have them (links
inside a host are left out), and, weighted by a host's pages, edges both ways between a host of three or more labels
and its parent domain, the host without its first label, whether that has pages or not. Rules make seeds: a host's
trusted (blocked) seed is the share of its pages that rules allow (block). Trust is a personalised PageRank from the
trusted seeds along the edges; distrust is one from the blocked seeds against them, since who links to bad hosts is
suspect. Both are in units of a seed: an isolated host has its own seed's value. A host is blocked if its distrust
exceeds its trust by THRESHOLD.

Hosts and edges are aggregated before they are joined, so a host with a third of all pages is one row, and the edges
of a hub are dealt over many parts. Without edges no round runs. Null urls and urls without :// have an empty host and
path, no rule, and, as no edge or seed reaches an empty host, the verdict allow. Null HTML has no links. Repeated rows
count again as pages. An empty table gives an empty one. Only the named columns are read; kept columns named like a
result give way to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm._shared import ascii_lower, dealt_join, hot_keys, small, written

#: Share of a value that moves on in a round; most rounds, and rounds in one job; change of all values, as a share of their sum, at which they end; excess of distrust that blocks.
DAMPING, ROUNDS, AT_ONCE, STILL, THRESHOLD = 0.85, 64, 8, 2e-3, 0.5
LINK = r"""(?i)(?:href|src)\s*=\s*["']?\s*((?:https?:)?//[^"'\s>]+)"""
#: (host and path, verdict)
Rules = list[tuple[str, str]]


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.expr("substring(url__, instr(url__, '://') + 3)")
    has = F.coalesce(F.instr("url__", "://") > 0, F.lit(False))
    host = F.when(has, ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))).otherwise("")
    path = F.when(has, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")
    return host, path


def rule_of(rules: Rules) -> tuple[Column, Column]:
    """The longest rule that fits the columns host and path, and its verdict; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        host, _, path = name.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(f"/{path}")
        rule, verdict = F.when(fits, F.lit(name)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def link_hosts(pages: DataFrame, html: str) -> DataFrame:
    """from, to, pages: how many pages of a host have a link to another host."""
    links = pages.select("host", F.explode(F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit(LINK), F.lit(1)), lambda x: ascii_lower(F.regexp_extract(x, r"//([^/?#]*)", 1))))).alias("to"))
    return links.where("host != '' and to != '' and host != to").groupBy(F.col("host").alias("from"), "to").agg(F.count("*").alias("pages"))


def family_edges(hosts: DataFrame) -> DataFrame:
    """from, to, pages: both ways between hosts (host, n) and their parent domains, up to a domain of two labels."""
    lines = hosts.where("host rlike '[.][^.]+[.]' and not host rlike '^[0-9.]+(:[0-9]+)?$'").select("n", F.split("host", "[.]").alias("labels"))
    steps = lines.select("n", "labels", F.explode(F.sequence(F.lit(1), F.size("labels") - 2)).alias("i"))
    child, parent = F.expr("array_join(slice(labels, i, size(labels)), '.')"), F.expr("array_join(slice(labels, i + 1, size(labels)), '.')")
    steps = steps.groupBy(child.alias("child"), parent.alias("parent")).agg(F.sum("n").alias("pages")).where("child != '' and parent != ''")
    return steps.select(F.col("child").alias("from"), F.col("parent").alias("to"), "pages").unionByName(steps.select(F.col("parent").alias("from"), F.col("child").alias("to"), "pages"))


def node(kind: Column, host: str) -> Column:
    """A host's place in the graph of trust, or in that of distrust, as one text."""
    return F.concat_ws(" ", kind, F.col(host))


def flows(edges: DataFrame) -> DataFrame:
    """node, target, share: what of a node's value goes where, for trust along and distrust against the edges."""
    trust = edges.select(node(F.lit("trust"), "from").alias("node"), node(F.lit("trust"), "to").alias("target"), "pages")
    distrust = edges.select(node(F.lit("distrust"), "to").alias("node"), node(F.lit("distrust"), "from").alias("target"), "pages")
    return trust.unionByName(distrust).groupBy("node", "target").agg(F.sum("pages").alias("pages"))


def propagate(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """host, trust, distrust from seeds (host, trusted, blocked) and edges (from, to, pages)."""
    base = seeds.select("host", F.explode(F.create_map(F.lit("trust"), "trusted", F.lit("distrust"), "blocked")).alias("kind", "seed")).where("seed > 0")
    base = written(base.select(node(F.col("kind"), "host").alias("node"), F.col("seed").alias("value")))
    edges = written(flows(edges))
    value = base
    if not edges.isEmpty() and not base.isEmpty():
        out = written(edges.groupBy("node").agg(F.sum("pages").alias("all_pages"), F.count("*").alias("n")))
        hot = hot_keys(out, "node")
        edges = dealt_join(edges, out.select("node", "all_pages"), "node", hot, "target")
        edges = written(edges.select("node", "target", (DAMPING * F.col("pages") / F.col("all_pages")).alias("share")))
        for _ in range(0, ROUNDS, AT_ONCE):
            after = value
            for _ in range(AT_ONCE):
                moved = dealt_join(edges, after, "node", hot, "target").select(F.col("target").alias("node"), (F.col("value") * F.col("share")).alias("value"))
                after = moved.unionByName(base).groupBy("node").agg(F.sum("value").alias("value"))
            after = written(after)
            both = after.select("node", "value", F.col("value").alias("by")).unionByName(value.select("node", F.lit(0.0).alias("value"), (-F.col("value")).alias("by")))
            moved, whole = both.groupBy("node").agg(F.sum("value").alias("value"), F.abs(F.sum("by")).alias("by")).agg(F.sum("by"), F.sum("value")).first()
            value = after
            if moved <= STILL * whole:
                break
    name = F.split("node", " ", 2)
    value = value.select(name[0].alias("kind"), name[1].alias("host"), "value")
    of = {k: F.round(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("value"))), F.lit(0.0)), 9).alias(k) for k in ("trust", "distrust")}
    return value.groupBy("host").agg(*of.values())


def judge(pages: DataFrame, rules: Rules, url: str = "url", html: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """`keep`, host, path, rule, verdict, trust, distrust of every page."""
    results = ("host", "path", "rule", "verdict", "trust", "distrust")
    keep = tuple(c for c in keep if c.lower() not in results)
    src = pages.select(*keep, F.col(url).alias("url__"), F.col(html).alias("html__"))
    host, path = host_and_path(F.col("url__"))
    rule, verdict = rule_of(rules)
    src = src.select(*keep, host.alias("host"), path.alias("path"), "html__")
    ruled = src.withColumn("rule", rule).withColumn("ruling__", verdict)
    counted = written(ruled.where("host != ''").groupBy("host").agg(F.count("*").alias("n"), *[F.count(F.when(F.col("ruling__") == v, 1)).alias(v) for v in ("allow", "block")]))
    seeds = counted.select("host", (F.col("allow") / F.col("n")).alias("trusted"), (F.col("block") / F.col("n")).alias("blocked"))
    values = written(propagate(seeds, link_hosts(src, "html__").unionByName(family_edges(counted))))
    out = ruled.drop("html__").join(small(values), "host", "left")
    trust, distrust = (F.coalesce(x, F.lit(0.0)) for x in ("trust", "distrust"))
    found = F.coalesce("ruling__", F.when(distrust - trust >= THRESHOLD, "block").otherwise("allow"))
    return out.select(*keep, "host", "path", "rule", found.alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
