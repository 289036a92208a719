"""URL verdicts: rules first, then trust and distrust spread over the links between hosts.

Trust starts at hosts with allowed pages and follows links (personalised
PageRank); distrust starts at hosts with blocked pages and goes against the
links, to those that link to them. All of it is joins and sums of small host
tables; pages are read once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sparsight.session import materialize

#: verdict, host, path
RULES = (
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
)
DAMPING, ROUNDS = 0.85, 12
#: a host is blocked where its distrust exceeds this share of its trust and distrust together
SHARE = 0.5
LINK = r"""(?i)(?:href|src)\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, ASCII lower-cased; empty without it."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From behind the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does. Of equal lengths the first wins."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, F.lit(h + p)).otherwise(name)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame, html: str = "html") -> DataFrame:
    """``a, b, w``: links from the page's host to other hosts, and between a host and its parent domain.

    A host and its parent speak for each other as one link each way. Relative
    links stay within their host and are no edges.
    """
    linked = pages.where(F.col(html).rlike(r"""(?i)(?:href|src)\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//""")).select(
        F.col("host").alias("a"), F.explode(F.regexp_extract_all(html, F.lit(LINK), 1)).alias("b")
    ).withColumn("b", F.translate("b", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    linked = linked.groupBy("a", "b").agg(F.count("*").cast("double").alias("w"))
    hosts = pages.select("host").union(linked.select("b")).distinct()
    parent = F.regexp_extract("host", r"^[^.]+\.(.+\..+)$", 1)
    family = hosts.select(F.col("host").alias("a"), parent.alias("b"), F.lit(1.0).alias("w")).where("b <> ''")
    back = family.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")
    return (
        linked.unionByName(family).unionByName(back).where("a <> b and a <> '' and b <> ''")
        .groupBy("a", "b").agg(F.sum("w").alias("w"))
    )


def personalised(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """``host, rank``: PageRank that restarts at ``seeds`` (``host, seed``, summing to one).

    A fixed number of rounds; what reaches a host without links is lost. Every
    few rounds the ranks are written, so that the lineage stays short.
    """
    out = edges.groupBy("a").agg(F.sum("w").alias("total"))
    steps = materialize(edges.join(out, "a").select("a", "b", (F.col("w") / F.col("total")).alias("share")), "steps")
    start = seeds.select("host", (F.col("seed") * (1 - damping)).alias("rank"))
    rank = seeds.select("host", F.col("seed").alias("rank"))
    for i in range(rounds):
        moved = steps.join(rank, steps["a"] == rank["host"]).select(
            F.col("b").alias("host"), (F.col("rank") * F.col("share") * damping).alias("rank")
        )
        rank = moved.unionByName(start).groupBy("host").agg(F.sum("rank").alias("rank"))
        if i % 4 == 3:
            rank = materialize(rank, "rank")
    return rank


def verdicts(
    pages: DataFrame, url: str = "url", html: str = "html", rules: Sequence[tuple[str, str, str]] = RULES,
    rounds: int = ROUNDS, share: float = SHARE,
) -> DataFrame:
    """``pages`` with ``host, path, rule, verdict, trust, distrust`` in place of columns of these names.

    A page that a rule fits has the rule's verdict. Others are blocked where
    their host's distrust is above ``share`` of its trust and distrust; hosts
    that neither reaches, and null urls, are allowed. Trust and distrust are
    each a share of one over all hosts. Repeated pages count as often as they
    stand there.
    """
    host, path = host_of(F.col(url)), path_of(F.col(url))
    name, verdict = rule_of(F.col("__host"), F.col("__path"), rules)
    given = pages.withColumns({"__host": host, "__path": path}).withColumns({"__rule": name, "__verdict": verdict})
    counts = materialize(given.groupBy(F.col("__host").alias("host")).agg(
        F.count_if(F.col("__verdict") == "allow").alias("allowed"),
        F.count_if(F.col("__verdict") == "block").alias("blocked"), F.count("*").alias("pages"),
    ), "hosts")
    edges = materialize(host_edges(given.select(F.col("__host").alias("host"), F.col(html).alias("html"))), "edges")
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")
    ranks = []
    for column, graph, label in (("allowed", edges, "trust"), ("blocked", back, "distrust")):
        total = counts.agg(F.sum(column)).first()[0] or 1
        seeds = counts.where(f"{column} > 0 and host <> ''").select("host", (F.col(column) / total).alias("seed"))
        ranks.append(personalised(graph, seeds, rounds).withColumnRenamed("rank", label))
    known = materialize(
        ranks[0].join(ranks[1], "host", "full").na.fill(0.0, ["trust", "distrust"]).withColumnRenamed("host", "__host"), "ranks"
    )
    low = F.col("distrust") > share * (F.col("trust") + F.col("distrust"))
    judged = F.coalesce("__verdict", F.when(low, "block").otherwise("allow"))
    kept = [c for c in pages.columns if c not in {"host", "path", "rule", "verdict", "trust", "distrust"}]
    return given.drop("trust", "distrust").join(known, "__host", "left").select(
        *(F.col(f"`{c}`") for c in kept), F.col("__host").alias("host"), F.col("__path").alias("path"),
        F.col("__rule").alias("rule"), judged.alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
