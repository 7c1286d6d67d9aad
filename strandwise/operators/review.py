"""Change review: impact, tests, entry points, flows, their criticality and risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .analyze import degrees
from .graph import bfs, multi_bfs
from .iterate import settle

#: Rows of one task that are made distinct.
TASK_PAIRS = 500_000
#: Words in names that touch security. Fixed values.
SECURITY = ("auth", "login", "password", "token", "session", "crypt", "secret", "credential", "permission", "sql", "query", "execute", "connect", "socket", "request", "http", "sanitize", "validate", "encrypt", "decrypt", "hash", "sign", "verify", "admin", "privilege")


def touches_security(name: Column) -> Column:
    return F.exists(F.array(*[F.lit(k) for k in SECURITY]), lambda k: F.contains(F.lower(name), k))


def impact_radius(nodes: DataFrame, adj: DataFrame, files: list[str], depth: int = 2, most: int | None = None) -> DataFrame:
    """(id, depth) within `depth` steps of the nodes of changed files; with `most`, the first by depth and id."""
    reached = bfs(adj, nodes.where(F.col("source_file").isin(files)), depth)
    return reached if most is None else reached.orderBy("depth", "id").limit(most)


def transitive_tests(calls: DataFrame, tested_by: DataFrame, depth: int = 1) -> DataFrame:
    """(id, test): tests of a node and of what it calls within `depth`; calls (id, nbr), tested_by (test, id).

    Rows can be as many as nodes times tests. They are counted before they are
    made, and dealt into parts of TASK_PAIRS before they are made distinct, so
    no task holds more of a larger graph.
    """
    tested = settle(tested_by.select("id", "test").distinct())
    near = multi_bfs(calls, calls.select("id").unionByName(tested.select("id")).distinct(), depth)
    size = lambda df, name: df.groupBy("id").agg(F.count(F.lit(1)).alias(name))
    pairs = size(near, "n").join(size(tested, "k"), "id").agg(F.sum(F.col("n") * F.col("k")).alias("pairs")).first()["pairs"] or 0
    met = near.join(tested, "id").select(F.col("start").alias("id"), "test")
    return met.repartition(max(1, -(-pairs // TASK_PAIRS)), "id", "test").distinct()


def entry_points(functions: DataFrame, calls: DataFrame, name: str = "label", pattern: str = r"^(main|run|handle_|on_|test_)") -> DataFrame:
    """Functions that nothing calls, or whose name says they are entered from outside."""
    uncalled = functions.join(calls.select(F.col("nbr").alias("id")).distinct(), "id", "left_anti")
    return uncalled.unionByName(functions.where(F.col(name).rlike(pattern))).distinct()


def trace_flows(calls: DataFrame, entries: DataFrame, depth: int = 15) -> DataFrame:
    """(start, id, depth): what each entry point reaches, of flows of two nodes and more."""
    reached = multi_bfs(calls, entries, depth)
    return reached.join(calls.select(F.col("id").alias("start")).distinct(), "start", "left_semi")


def flow_criticality(flows: DataFrame, functions: DataFrame, tested: DataFrame, external: DataFrame) -> DataFrame:
    """(start, nodes, files, depth, criticality): file spread .30, external calls .20, security .25, missing tests .15, depth .10.

    functions: (id, label, source_file); tested: (id); external: (id, n) calls to unknown targets.
    """
    j = flows.join(functions.select("id", "label", "source_file"), "id").join(tested.select("id").distinct().withColumn("is_tested", F.lit(1)), "id", "left").join(external, "id", "left")
    s = j.groupBy("start").agg(
        F.count(F.lit(1)).alias("nodes"), F.countDistinct("source_file").alias("files"), F.max("depth").alias("depth"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("external"), F.count_if(touches_security(F.concat_ws(" ", "label", "id"))).alias("hits"), F.count("is_tested").alias("tested"),
    )
    capped = lambda x: F.least(x, F.lit(1.0))
    score = (
        0.30 * F.when(F.col("files") > 1, capped((F.col("files") - 1) / 4)).otherwise(0.0)
        + 0.20 * capped(F.col("external") / 5)
        + 0.25 * capped(F.col("hits") / F.col("nodes"))
        + 0.15 * (1 - F.col("tested") / F.col("nodes"))
        + 0.10 * capped(F.col("depth") / 10)
    )
    return s.select("start", "nodes", "files", "depth", F.round(score, 4).alias("criticality"))


def risk_scores(functions: DataFrame, calls: DataFrame, membership: DataFrame, tests: DataFrame, flows: DataFrame | None = None) -> DataFrame:
    """(id, risk): flows up to .25, callers of other communities up to .15, missing tests up to .30, security .20, callers up to .10.

    tests: (id, test) of transitive_tests; flows: (id, criticality) rows.
    """
    callers = calls.select(F.col("nbr").alias("id"), F.col("id").alias("caller"))
    own, other = membership.select("id", "community"), membership.select(F.col("id").alias("caller"), F.col("community").alias("theirs"))
    seen = callers.join(own, "id", "left").join(other, "caller", "left").groupBy("id").agg(
        F.count(F.lit(1)).alias("callers"), F.countDistinct(F.when(F.col("theirs") != F.col("community"), F.col("caller"))).alias("cross")
    )
    tested = tests.groupBy("id").agg(F.count(F.lit(1)).alias("tests"))
    j = functions.join(seen, "id", "left").join(tested, "id", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    score = F.least(n("cross") * 0.05, F.lit(0.15)) + 0.30 - F.least(n("tests") / 5, F.lit(1.0)) * 0.25
    score = score + F.when(touches_security(F.concat_ws(" ", "label", "id")), 0.20).otherwise(0.0) + F.least(n("callers") / 20, F.lit(0.10))
    if flows is not None:
        j = j.join(flows.groupBy("id").agg(F.sum("criticality").alias("critical")), "id", "left")
        score = score + F.least(F.coalesce("critical", F.lit(0.0)), F.lit(0.25))
    return j.select("id", F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 4).alias("risk"))


def risk_level(score: Column) -> Column:
    return F.when(score >= 30, "high").when(score >= 12, "medium").otherwise("low")


def community_impact(changed: DataFrame, impacted: DataFrame, hubs: DataFrame, membership: DataFrame) -> DataFrame:
    """(community, changed, impacted, hubs, score, level): 4 for a changed node, 1 for an impacted one, 2 for a hub."""
    tag = lambda df, name: df.select("id").distinct().withColumn(name, F.lit(1))
    j = membership.join(tag(changed, "c"), "id", "left").join(tag(impacted, "i"), "id", "left").join(tag(hubs, "h"), "id", "left").where("c is not null or i is not null")
    s = j.groupBy("community").agg(F.count("c").alias("changed"), F.count("i").alias("impacted"), F.count("h").alias("hubs"))
    score = 4 * F.col("changed") + F.col("impacted") + 2 * F.col("hubs")
    return s.withColumn("score", score).withColumn("level", risk_level(F.col("score")))


def risky_chains(starts: DataFrame, impacted: DataFrame, edges: DataFrame, adj: DataFrame, n: int = 20) -> DataFrame:
    """(a, b, c, degree): chains of one and two steps from the starts within the impacted nodes over uncertain links, by total degree.

    Sorted before the cut, so that the result doesn't depend on discovery.
    """
    deg = degrees(adj)
    links = edges.where(F.col("confidence").isin("AMBIGUOUS", "INFERRED")).select("src", "tgt")
    both = links.unionByName(links.select(F.col("tgt").alias("src"), F.col("src").alias("tgt"))).distinct().join(impacted.select(F.col("id").alias("tgt")), "tgt", "left_semi")
    one = starts.select(F.col("id").alias("a")).join(both.select(F.col("src").alias("a"), F.col("tgt").alias("b")), "a")
    two = one.join(both.select(F.col("src").alias("b"), F.col("tgt").alias("c")), "b").where("c != a").select("a", "b", "c")
    chains = one.select("a", "b", F.lit(None).cast("string").alias("c")).unionByName(two)
    for x in ("a", "b", "c"):
        chains = chains.join(deg.select(F.col("id").alias(x), F.col("degree").alias(f"d_{x}")), x, "left")
    total = sum((F.coalesce(f"d_{x}", F.lit(0)) for x in ("a", "b", "c")), F.lit(0))
    return chains.withColumn("degree", total.cast("long")).orderBy(F.desc("degree"), "a", "b", "c").limit(n).select("a", "b", "c", "degree")
