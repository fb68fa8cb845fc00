"""URL filters: rules by host and path first, and for the rest trust and distrust propagated over the graph of hosts.

* ``host_edges``: a page links its host to the hosts of its absolute links, each with the number of pages that do; and every host is linked both
  ways with the nearest of its parent domains that occurs, DOMAIN_WEIGHT each, as who runs a domain answers for what is under it.
* ``seeds``: a host's trusted (blocked) weight is the share of its pages that a rule allows (blocks).
* ``propagate``: personalised PageRank from the trusted seeds along the edges, and from the blocked seeds against them (who links to what is
  blocked inherits distrust). Both run together, one exchange a step and one table for CUT_EVERY steps, until no later step can move more than
  TOLERANCE of the sum. The mass of hosts without edges goes back to the seeds, which is the same as to let it go and to divide by the sum in the end.
* A host without a fitting rule is blocked where distrust > RATIO * trust and distrust is more than FLOOR times what an even share would be.

Defined results: a null url, or one without ``://``, has an empty host and path, no rule, and is allowed; hosts that nothing reaches are allowed;
null html has no links; rows that repeat a page are judged each by itself but count as one more page of their host; no rules mean that all is
allowed; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_hot, lower_ascii

DAMPING = 0.85
STEPS = 60
TOLERANCE = 1e-3
CUT_EVERY = 8
DOMAIN_WEIGHT = 1.0
RATIO = 1.0
FLOOR = 0.1

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"(?i)href\s*=\s*[\"']?\s*(?:https?:)?//([^/?#\"'\s>]+)"


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, _URL, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def _suffixes(host: Column) -> Column:
    """The host and all domains above it."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def rules_by_host(hosts: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """host, rules: all that fit it, as array<struct<size, rule, path, verdict>>, longest first. rules: (host, path, verdict)."""
    spark = hosts.sparkSession
    known = spark.createDataFrame([(h, h + p, p, v) for h, p, v in rules], "on string, rule string, path string, verdict string")
    named = hosts.select("host", F.explode(_suffixes(F.col("host"))).alias("on")).join(known, "on")
    return named.groupBy("host").agg(F.sort_array(F.collect_set(F.struct(F.length("rule").alias("size"), "rule", "path", "verdict")), asc=False).alias("rules"))


def fitting(rules: Column, path: Column) -> Column:
    """The longest rule whose path begins the path, or null."""
    return F.get(F.filter(rules, lambda r: path.startswith(r["path"])), F.lit(0))


def host_edges(pages: DataFrame, hosts: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """src, dst, weight; src and dst differ. A link to a host without pages makes that host a node too."""
    links = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(F.array_distinct(F.regexp_extract_all(F.col(html_col), F.lit(_LINK), 1))).alias("dst"))
    linked = links.withColumn("dst", lower_ascii(F.col("dst"))).filter("src <> '' and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    above = hosts.select("host", F.posexplode(_suffixes(F.col("host"))).alias("level", "up")).filter("level > 0")
    nearest = above.join(hosts.select(F.col("host").alias("up")), "up", "left_semi").groupBy("host").agg(F.min_by("up", "level").alias("up"))
    # siblings meet in the domain above them even where it has no page of its own
    parent = above.filter("level = 1 and instr(up, '.') > 0").join(nearest, "host", "left_anti").select("host", "up")
    tree = nearest.select("host", "up").unionByName(parent)
    w = F.lit(DOMAIN_WEIGHT).alias("weight")
    both = linked.unionByName(tree.select(F.col("host").alias("src"), F.col("up").alias("dst"), w)).unionByName(tree.select(F.col("up").alias("src"), F.col("host").alias("dst"), w))
    return both.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, steps: int = STEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """host, trust, distrust, each adding up to 1 over all hosts (0 where there is no such seed). seeds: host, trusted, blocked weights. The ranks are
    those of the limit but for ``tolerance`` of their sum; ValueError if ``steps`` steps do not come so far."""
    kinds = edges.select(F.lit("trust").alias("kind"), "src", "dst", "weight").unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    total = kinds.groupBy("kind", "src").agg(F.sum("weight").alias("total"))
    moves = cut(kinds.join(total, ["kind", "src"]).select("kind", "src", "dst", (damping * F.col("weight") / F.col("total")).alias("share")), "moves")
    start = seeds.select("host", F.explode(F.create_map(F.lit("trust"), "trusted", F.lit("distrust"), "blocked")).alias("kind", "w")).filter("w > 0")
    sums = start.groupBy("kind").agg(F.sum("w").alias("sum"))  # two rows
    start = cut(start.join(F.broadcast(sums), "kind").select("kind", "host", ((1 - damping) * F.col("w") / F.col("sum")).alias("in")), "seeds")
    rank = start.withColumnRenamed("in", "rank")
    for done in range(0, steps, CUT_EVERY):
        for _ in range(min(CUT_EVERY, steps - done)):
            before = rank
            moved = before.withColumnRenamed("host", "src").join(moves, ["kind", "src"]).select("kind", F.col("dst").alias("host"), (F.col("rank") * F.col("share")).alias("in"))
            rank = moved.unionByName(start).groupBy("kind", "host").agg(F.sum("in").alias("rank"))
        # the last step again, with the ranks before it in the same exchange
        was = before.select("kind", "host", F.lit(0.0).alias("in"), F.col("rank").alias("was"))
        both = moved.unionByName(start).withColumn("was", F.lit(0.0)).unionByName(was)
        rank = cut(both.groupBy("kind", "host").agg(F.sum("in").alias("rank"), F.sum("was").alias("was")), "rank")
        row = rank.agg(F.sum("rank").alias("all"), F.sum(F.abs(F.col("rank") - F.col("was"))).alias("change")).head()
        rank = rank.drop("was")
        # each step changes at most damping times what the one before changed, so all later ones together the sum of that series
        if (row["change"] or 0.0) * damping <= (1 - damping) * tolerance * (row["all"] or 0.0):
            break
    else:
        raise ValueError(f"the ranks still change after {steps} steps")
    sums = rank.groupBy("kind").agg(F.sum("rank").alias("sum"))  # two rows
    whole = rank.join(F.broadcast(sums), "kind").withColumn("rank", F.col("rank") / F.col("sum"))
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("rank")).otherwise(0.0)).alias(kind)
    return whole.groupBy("host").agg(of("trust"), of("distrust"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: the id, host, path, rule, verdict, trust, distrust."""
    placed = pages.select(F.col(id_col).alias("_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    paths = cut(placed.filter("host <> ''").groupBy("host", "path").agg(F.count(F.lit(1)).alias("n")), "paths")
    hosts = paths.select("host").distinct()
    by_host = cut(rules_by_host(hosts, rules), "rules")
    ruled = paths.join(by_host, "host", "left").withColumn("hit", fitting(F.col("rules"), F.col("path")))
    share = lambda v: (F.sum(F.when(F.col("hit.verdict") == v, F.col("n")).otherwise(0)) / F.sum("n")).alias
    seeds = cut(ruled.groupBy("host").agg(share("allow")("trusted"), share("block")("blocked"), F.sum("n").alias("pages")), "seeds")
    edges = cut(host_edges(pages, hosts, url_col, html_col), "edges")
    scores = cut(propagate(edges, seeds), "scores")
    even = F.lit(1.0) / F.greatest(scores.agg(F.count(F.lit(1))).scalar(), F.lit(1))
    known = seeds.select("host", "pages").join(by_host, "host", "left").join(scores, "host", "left")
    known = known.select("host", "pages", "rules", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"), (F.col("distrust") > FLOOR * even).alias("enough"))
    found = join_hot(placed, known, ["host"], "pages", "_id").withColumn("hit", fitting(F.col("rules"), F.col("path")))
    own = F.when(F.coalesce(F.col("enough") & (F.col("distrust") > RATIO * F.col("trust")), F.lit(False)), "block").otherwise("allow")
    return found.select(F.col("_id").alias(id_col), "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", own).alias("verdict"), "trust", "distrust")
