"""Operator 3 [native]: URL rules first, link-graph propagation for the rest.

Hosts form a graph: an edge for every absolute link of a page to another host
(weight: number of links), and edges both ways between a host and its parent
domain down to two labels (weight 1). Two personalised PageRanks run over it as
DataFrame joins: *trust* starts at hosts in proportion to their pages that a
rule allows and follows links; *distrust* starts at hosts of blocked pages and
runs against the links (who links to bad hosts is bad). Both ranks advance in
one table, written to the shared folder every ``EVERY`` rounds. They start at
the seeds' own share and only grow, and rounds go on until in ``EVERY`` rounds no
host's rank grew by more than ``TOLERANCE`` of itself. A host reached for the first time
counts as grown, so chains of any length are followed to their end. Mass that comes
to a host without outgoing edges ends there. A host is blocked if
its share ``distrust / (trust + distrust)`` is above the threshold by more than ``MARGIN``
of it; hosts that neither reaches are allowed.

Rules: null urls, and those without ``://``, have empty host and path; an empty
host takes no part in the graph; null html has no links. Every page gives one
row, repeated ids too. Ranks equal within the margin allow. Empty table: no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from upshelf.llm.common import forget, pick, written

DAMPING, EVERY, TOLERANCE, THRESHOLD, MARGIN = 0.85, 5, 1e-5, 0.5, 1e-3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"""[hH][rR][eE][fF][ \t\n\r]*=[ \t\n\r]*["']?(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#"' \t\n\r>]+)"""

Rule = tuple[str, str, str]     # (verdict, host, path)


def split_url(url: str) -> tuple[Column, Column]:
    part = lambda i: F.coalesce(F.regexp_extract(url, URL, i), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def apply_rules(rules: list[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits the columns host and path, else null."""
    name = verdict = None
    for v, host, path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
        name = F.when(fits, host + path) if name is None else name.when(fits, host + path)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return (name, verdict) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, w) from columns host and html."""
    out = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("dst"))
    links = (out.select("src", F.translate("dst", UPPER, LOWER).alias("dst")).where("src <> dst")
             .groupBy("src", "dst").agg(F.count("*").cast("double").alias("w")))
    hosts = (pages.where("host <> ''").select("host").distinct().union(links.select("dst")).distinct()
             .select(F.split("host", r"\.").alias("l")).where(F.size("l") > 2))
    up = hosts.select("l", F.explode(F.sequence(F.lit(1), F.size("l") - 2)).alias("i"))
    name = lambda a: F.array_join(F.slice("l", a, F.size("l")), ".")
    up = up.select(name(F.col("i")).alias("src"), name(F.col("i") + 1).alias("dst")).distinct()
    kin = up.union(up.select("dst", "src")).withColumn("w", F.lit(1.0))
    return links.union(kin).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def ranks(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust); seeds: (kind, host, mass) with kinds trust and distrust, mass summing to one each.

    Only whether some rank still grows reaches the driver."""
    both = (edges.select(F.lit("trust").alias("kind"), "src", "dst", "w")
            .union(edges.select(F.lit("distrust"), "dst", "src", "w")))
    share = both.groupBy("kind", "src").agg(F.sum("w").alias("all"))
    steps = written(both.join(share, ["kind", "src"]).select("kind", "src", "dst", (F.col("w") / F.col("all")).alias("p")), "rank-steps")
    zero = F.lit(0.0)
    start = written(seeds.select("kind", "host", (F.col("mass") * (1 - damping)).alias("score"), zero.alias("before")), "rank-seeds")
    now, rounds = start, 0
    while True:
        last, rounds = now, rounds + EVERY
        for i in range(EVERY):
            moved = (now.join(steps.withColumnRenamed("src", "host"), ["kind", "host"])
                     .select("kind", F.col("dst").alias("host"), (F.col("score") * F.col("p") * damping).alias("score"), zero.alias("before")))
            rows = moved.union(start)
            if i == EVERY - 1:
                rows = rows.union(last.select("kind", "host", zero, "score"))
            now = rows.groupBy("kind", "host").agg(F.sum("score").alias("score"), F.sum("before").alias("before"))
        now = written(now, f"rank-{rounds}")
        if last is not start:
            forget(last)
        if now.where(F.col("score") - F.col("before") > tolerance * F.col("score")).isEmpty():
            break
    forget(steps)
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0)).alias(kind)
    return now.groupBy("host").agg(of("trust"), of("distrust"))


def judge(pages: DataFrame, rules: list[Rule], threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page."""
    p = pick(pages, page_id="long", url="string", html="string")
    host, path = split_url("url")
    p = p.select("page_id", host.alias("host"), path.alias("path"), "html")
    rule, verdict = apply_rules(rules)
    ruled = p.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))
    count = (ruled.where("host <> '' and verdict is not null").groupBy("host", "verdict").agg(F.count("*").cast("double").alias("n"))
             .select(F.when(F.col("verdict") == "allow", "trust").otherwise("distrust").alias("kind"), "host", "n"))
    total = count.groupBy("kind").agg(F.sum("n").alias("all"))      # two rows at most
    seeds = count.join(F.broadcast(total), "kind").select("kind", "host", (F.col("n") / F.col("all")).alias("mass"))
    scored = ranks(host_edges(p.select("host", "html")), seeds)
    bad = scored.where(F.col("distrust") > threshold * (1 + MARGIN) * (F.col("trust") + F.col("distrust"))).select("host", F.lit("block").alias("by_rank"))
    return (ruled.join(bad, "host", "left")
            .select("page_id", "host", "path", "rule", F.coalesce("verdict", "by_rank", F.lit("allow")).alias("verdict")))


def oracle(rules: list[Rule], damping: float = DAMPING, threshold: float = THRESHOLD) -> str:
    """The same in DuckDB SQL: a rank is the sum of what each step adds, and steps go on until what a step
    adds to a host is below 1e-30, whatever number of rounds the Spark run took."""
    order = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    case = lambda pick_: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{t}') THEN '{pick_(v, h, t)}'" for v, h, t in order) + " END"
    url = URL.replace("(?s)", "")
    link = LINK.replace("'", "''")
    return f"""
WITH RECURSIVE u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '{url}', 1, 's'), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(url, '{url}', 2, 's'), '') AS path, html FROM pages
), r AS (SELECT page_id, host, path, html, {case(lambda v, h, t: h + t)} AS rule, {case(lambda v, h, t: v)} AS verdict FROM u),
c AS (SELECT CASE verdict WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host, count(*)::DOUBLE AS n
      FROM r WHERE host <> '' AND verdict IS NOT NULL GROUP BY ALL),
seeds AS (SELECT kind, host, n / sum(n) OVER (PARTITION BY kind) AS mass FROM c),
raw AS (SELECT host AS src, translate(unnest(regexp_extract_all(html, '{link}', 1)), '{UPPER}', '{LOWER}') AS dst FROM u WHERE host <> ''),
links AS (SELECT src, dst, count(*)::DOUBLE AS w FROM raw WHERE src <> dst GROUP BY ALL),
hosts AS (SELECT string_split(host, '.') AS l FROM (SELECT host FROM u WHERE host <> '' UNION SELECT dst FROM links)),
lv AS (SELECT l, unnest(range(1, len(l) - 1)) AS i FROM hosts WHERE len(l) > 2),
up AS (SELECT DISTINCT array_to_string(l[i:], '.') AS src, array_to_string(l[i + 1:], '.') AS dst FROM lv),
edges AS (SELECT src, dst, sum(w) AS w FROM (SELECT * FROM links UNION ALL SELECT src, dst, 1.0::DOUBLE FROM up
          UNION ALL SELECT dst, src, 1.0::DOUBLE FROM up) GROUP BY ALL),
two AS (SELECT 'trust' AS kind, src, dst, w FROM edges UNION ALL SELECT 'distrust', dst, src, w FROM edges),
steps AS (SELECT kind, src, dst, w / sum(w) OVER (PARTITION BY kind, src) AS p FROM two),
added AS (
  SELECT 0 AS i, kind, host, mass * {1 - damping} AS score FROM seeds
  UNION ALL
  SELECT a.i + 1, s.kind, s.dst, sum(a.score * s.p) * {damping} FROM added a JOIN steps s ON s.kind = a.kind AND s.src = a.host
  WHERE a.score > 1e-30 GROUP BY a.i, s.kind, s.dst
),
z AS (SELECT host, coalesce(sum(score) FILTER (kind = 'trust'), 0) AS t, coalesce(sum(score) FILTER (kind = 'distrust'), 0) AS d
      FROM added GROUP BY host)
SELECT r.page_id, r.host, r.path, r.rule, coalesce(r.verdict, CASE WHEN z.d > {threshold * (1 + MARGIN)} * (z.t + z.d) THEN 'block' ELSE 'allow' END) AS verdict
FROM r LEFT JOIN z ON z.host = r.host"""
