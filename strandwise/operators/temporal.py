"""Closed intervals: overlap, slices, as-of reads, bitemporal visibility and nearest matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .iterate import settle


def valid() -> Column:
    """A start, and no end or one at or after it. An end that is present but null makes the row invalid."""
    return F.col("t").isNotNull() & (~F.col("has_t_end") | (F.col("t_end").isNotNull() & (F.col("t_end") >= F.col("t"))))


def overlaps(low: Column, high: Column) -> Column:
    return valid() & (F.col("t") <= high) & (~F.col("has_t_end") | (F.col("t_end") >= low))


def as_of(rows: DataFrame, at: int) -> DataFrame:
    """Rows whose closed interval holds the instant."""
    return rows.where(overlaps(F.lit(at), F.lit(at)))


def window(rows: DataFrame, low: int, high: int) -> DataFrame:
    return rows.where(overlaps(F.lit(low), F.lit(high)))


def time_slice(nodes: DataFrame, edges: DataFrame, hyperedges: DataFrame, low: int, high: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes and edges that overlap the window; edges with both endpoints kept; hyperedges (id, member) all of whose members are."""
    kept = window(nodes, low, high)
    ids = kept.select("id")
    inside = window(edges, low, high).join(ids, edges["src"] == ids["id"], "left_semi").join(ids, edges["tgt"] == ids["id"], "left_semi")
    broken = hyperedges.join(ids.withColumnRenamed("id", "member"), "member", "left_anti").select("id").distinct()
    return kept, inside, hyperedges.join(broken, "id", "left_anti")


def without_tombstones(nodes: DataFrame, edges: DataFrame, dead_nodes: DataFrame, dead_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that no tombstone erases; a dead endpoint kills its edges."""
    dead = dead_nodes.select("id").distinct()
    live = edges.join(dead_edges, ["src", "tgt", "relation"], "left_anti")
    for end in ("src", "tgt"):
        live = live.join(dead, live[end] == dead["id"], "left_anti")
    return nodes.join(dead, "id", "left_anti"), live


def visible(rows: DataFrame, valid_at: int, recorded_by: int) -> DataFrame:
    """Bitemporal: recorded at or before a cursor, and valid at an instant."""
    return as_of(rows.where(F.col("cursor") <= recorded_by), valid_at)


def nearest(sessions: DataFrame, points: DataFrame, on: list[str], slack: int) -> DataFrame:
    """For each session (id, start, stop) the point (point_id, at) of the same key nearest to [start, stop], within slack.

    A point inside has distance 0; the later one, then the smaller id, wins a
    tie. Both sides are cut into time bins of the slack's width, so the join
    has equal keys and no task sees more than a key's bins nearby.
    """
    bin_of = lambda x: F.floor(x / slack).cast("long")
    reach = sessions.withColumn("bin", F.explode(F.sequence(bin_of(F.col("start") - slack), bin_of(F.col("stop") + slack))))
    j = reach.join(points.withColumn("bin", bin_of(F.col("at"))), [*on, "bin"])
    distance = F.when(F.col("at") < F.col("start"), F.col("start") - F.col("at")).when(F.col("at") > F.col("stop"), F.col("at") - F.col("stop")).otherwise(F.lit(0).cast("long"))
    near = j.withColumn("distance", distance).where(F.col("distance") <= slack)
    best = F.min(F.struct("distance", (-F.col("at")).alias("later"), "point_id"))
    return near.groupBy("id").agg(best.alias("b")).select("id", F.col("b.point_id"), F.col("b.distance"))


def line_overlap(changes: DataFrame, spans: DataFrame) -> DataFrame:
    """Pairs of a file's changed lines [start, stop] and its nodes' lines [line_start, line_end] that meet."""
    return changes.join(spans, "file").where((F.col("line_start") <= F.col("stop")) & (F.col("line_end") >= F.col("start")))


def suffix_paths(path: Column) -> Column:
    """All suffixes of a path that start at a folder or file name: an equal-key form of `ends with /other`."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def path_matches(left: DataFrame, right: DataFrame) -> DataFrame:
    """(path, other): equal, or one ends with a slash and the other.

    A whole path meets the suffixes of the other side, never a suffix
    suffixes, so an end that many paths share makes no pairs of its own.
    """
    a, b = settle(left.select("path").distinct()), settle(right.select("other").distinct())
    longer = a.select("path", F.explode(suffix_paths(F.col("path"))).alias("other")).join(b, "other").select("path", "other")
    shorter = b.select("other", F.explode(suffix_paths(F.col("other"))).alias("path")).where("path != other").join(a, "path").select("path", "other")
    return longer.distinct().unionByName(shorter.distinct())
