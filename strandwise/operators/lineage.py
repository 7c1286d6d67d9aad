"""Histories of commits: passes over a stream of them, and comparisons of the trees that they hold."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import graph
from .iterate import settle


class History(NamedTuple):
    """What passes have gathered: commits (oid, parents), complete (oid), gaps (oid, cause)."""

    commits: DataFrame
    complete: DataFrame
    gaps: DataFrame


def no_history(spark) -> History:
    empty = lambda schema: spark.createDataFrame([], schema)
    return History(empty("oid string, parents array<string>"), empty("oid string"), empty("oid string, cause string"))


def history_pass(held: History, batch: DataFrame, roots: DataFrame, shallow: DataFrame) -> History:
    """The history after one more batch (oid, parents) of a stream, walked from the roots (oid).

    A commit that is known stays as it was first said; one said twice with
    different parents in a batch takes the smaller. The walk ends at commits
    that an earlier pass found complete, at shallow bounds (oid), whose parents
    are cut off on purpose, and at parents that no batch has brought: those are
    gaps, `shallow` and `missing`. A commit is complete if it is reached and
    reaches no gap. Passes over a stream in any order and any batches end with
    what one pass over all of it finds; each walks only what isn't complete.
    """
    fresh = batch.groupBy("oid").agg(F.min("parents").alias("parents")).join(held.commits, "oid", "left_anti")
    commits = settle(held.commits.unionByName(fresh.select("oid", "parents")))
    bounds = settle(shallow.select("oid").distinct())
    ends = bounds.unionByName(held.complete)
    edges = commits.join(ends, "oid", "left_anti").select(F.col("oid").alias("id"), F.explode("parents").alias("nbr"))
    edges = settle(edges.where("nbr is not null and id != nbr"))
    reached = settle(graph.reach(edges, roots.select(F.col("oid").alias("id"))).select(F.col("id").alias("oid")))
    missing = reached.join(commits, "oid", "left_anti").select("oid", F.lit("missing").alias("cause"))
    cut = reached.join(bounds, "oid", "left_semi").join(commits, "oid", "left_semi").select("oid", F.lit("shallow").alias("cause"))
    gaps = settle(missing.unionByName(cut))
    inside = edges.join(reached.select(F.col("oid").alias("id")), "id", "left_semi")
    blocked = graph.reach(inside.select(F.col("nbr").alias("id"), F.col("id").alias("nbr")), gaps.select(F.col("oid").alias("id")))
    done = reached.join(blocked.select(F.col("id").alias("oid")), "oid", "left_anti")
    return History(commits, settle(held.complete.unionByName(done).distinct()), gaps)


def branch_members(history: History, heads: DataFrame) -> DataFrame:
    """(ref, oid): what each ref (ref, oid) reaches in the commits of a history, derived, not kept."""
    edges = settle(history.commits.select(F.col("oid").alias("id"), F.explode("parents").alias("nbr")).where("nbr is not null"))
    found = graph.multi_bfs(edges, heads.select(F.col("oid").alias("id")))
    return heads.select("ref", F.col("oid").alias("start")).distinct().join(found, "start").select("ref", F.col("id").alias("oid")).join(history.commits.select("oid"), "oid", "left_semi").select("ref", "oid")


def _digest_of(entries: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, tree): a digest of each group's entries (name, kind, oid) in any order: the digest of the sums of four parts of theirs, added up on the map side."""
    own = F.sha2(F.concat("kind", F.lit(" "), "name", F.lit("\x00"), "oid").cast("binary"), 256)
    part = lambda k: F.conv(F.substring("own", 15 * k + 1, 15), 16, 10).cast("decimal(38,0)")
    sums = entries.withColumn("own", own).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.sum(part(k)).alias(f"s{k}") for k in range(4)])
    whole = F.concat_ws(":", *[F.col(c).cast("string") for c in ("n", "s0", "s1", "s2", "s3")])
    return sums.select(*keys, F.sha2(whole.cast("binary"), 256).alias("tree"))


def merkle_trees(files: DataFrame, by: str = "commit") -> tuple[DataFrame, DataFrame]:
    """(roots, trees) of files (by, path, oid): a root (by, oid) for each value of `by`, and content-addressed entries (tree, name, kind, oid).

    Equal directories are one tree, wherever they are. Levels are made from the
    deepest up; a directory's entries are added up, never gathered, so one may
    hold most of the files.
    """
    level = settle(files.select(by, F.split("path", "/").alias("at"), F.lit("blob").alias("kind"), "oid").distinct())
    depth = level.agg(F.max(F.size("at"))).first()[0] or 0
    trees = files.sparkSession.createDataFrame([], "tree string, name string, kind string, oid string")
    for d in range(depth, 0, -1):
        entries = level.where(F.size("at") == d).select(by, F.slice("at", 1, d - 1).alias("at"), F.col("at")[d - 1].alias("name"), "kind", "oid")
        named = settle(_digest_of(entries, [by, "at"]))
        trees = trees.unionByName(entries.join(named, [by, "at"]).select("tree", "name", "kind", "oid"))
        level = level.where(F.size("at") < d).unionByName(named.select(by, "at", F.lit("tree").alias("kind"), F.col("tree").alias("oid")))
    return settle(level.where(F.size("at") == 0).select(by, "oid")), settle(trees.distinct())


CHANGES = T.StructType([T.StructField(n, T.StringType()) for n in ("pair", "path", "status", "old_oid", "new_oid")])


def compare_trees(pairs: DataFrame, trees: DataFrame) -> DataFrame:
    """(pair, path, status, old_oid, new_oid) of pairs (pair, before, after) of tree oids, null for no tree.

    Each round reads the entries of those directories that differ, a level for
    all pairs at once; a directory with equal oids is never looked into. A path
    that is a file on one side and a directory on the other is deleted as the
    one and added as the other.
    """
    front = settle(pairs.where("not (before <=> after)").select("pair", F.lit("").alias("at"), "before", "after"))
    found = pairs.sparkSession.createDataFrame([], CHANGES)
    while not front.isEmpty():
        old = front.where("before is not null").join(trees.withColumnRenamed("tree", "before"), "before").select("pair", "at", "name", "kind", F.col("oid").alias("old_oid"))
        new = front.where("after is not null").join(trees.withColumnRenamed("tree", "after"), "after").select("pair", "at", "name", "kind", F.col("oid").alias("new_oid"))
        both = settle(old.join(new, ["pair", "at", "name", "kind"], "full_outer").where("not (old_oid <=> new_oid)").withColumn("path", F.concat("at", "name")))
        status = F.when(F.col("old_oid").isNull(), "added").when(F.col("new_oid").isNull(), "deleted").otherwise("modified")
        found = found.unionByName(both.where("kind = 'blob'").select("pair", "path", status.alias("status"), "old_oid", "new_oid"))
        front = both.where("kind = 'tree'").select("pair", F.concat("path", F.lit("/")).alias("at"), F.col("old_oid").alias("before"), F.col("new_oid").alias("after"))
    return found


def compare_branches(files: DataFrame, parents: DataFrame, base: str, tip: str, kind: str = "contribution") -> tuple[str, DataFrame]:
    """(state, changes) between two commits of files (commit, path, oid) and parents (commit, parent, nth).

    `contribution` compares each best common ancestor with the tip, as pair
    `<ancestor>..<tip>`; without one the histories are `unrelated`. `current`
    compares base with tip, `parents` each parent of the tip with it, a root
    with no tree. A commit without a record leaves the state `partial`.
    """
    spark = files.sparkSession
    links = settle(parents.select(F.col("commit").alias("id"), F.col("parent").alias("nbr")))
    if kind == "contribution":
        ends = [r.id for r in graph.merge_bases(links, base, tip).collect()]  # a few at most
        if not ends:
            return "unrelated", spark.createDataFrame([], CHANGES)
    elif kind == "current":
        ends = [base]
    elif kind == "parents":
        ends = [r.parent for r in parents.where(F.col("commit") == tip).orderBy("nth").select("parent").collect()] or [None]
    else:
        raise ValueError(f"no such comparison: {kind}")
    wanted = spark.createDataFrame([(c,) for c in {*ends, tip} if c], "commit string")
    roots, trees = merkle_trees(files.join(F.broadcast(wanted), "commit", "left_semi"))
    of = {r.commit: r.oid for r in roots.collect()}  # a row for each of the commits named
    state = "complete" if all(c is None or c in of for c in [*ends, tip]) else "partial"
    pairs = spark.createDataFrame([(f"{c or ''}..{tip}", of.get(c), of.get(tip)) for c in ends if tip in of and (c is None or c in of)], "pair string, before string, after string")
    return state, compare_trees(pairs, trees)
