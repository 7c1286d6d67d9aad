"""Memory records as nodes of a stored graph, behind a cursor that only rises."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .iterate import settle
from .relational import topology_signature

#: What marks the nodes of memory, and the relation that a projection owns.
PREFIX, RELATION = "memory:", "memory_about"
_RECEIPT = "cursor long, digest string, n_nodes long, n_edges long, attached long, removed long"


class Projection(NamedTuple):
    """nodes (id, label, node_type, record_digest, scope_ref, citations), edges (src, tgt, relation, confidence), omitted (record_id, reason)."""

    nodes: DataFrame
    edges: DataFrame
    omitted: DataFrame


class Receipt(NamedTuple):
    """What a merge did: applied, stale or repeated; the cursor the store is at, memory nodes attached and removed by it."""

    outcome: str
    cursor: int
    attached: int
    removed: int


def _is_memory(c: str) -> Column:
    return F.col(c).startswith(PREFIX)


def project(candidates: DataFrame, nodes: DataFrame, erased: DataFrame) -> Projection:
    """The projection of candidates (record_id, record_digest, scope_ref, state, projection_eligible, authorized, eligible_now, code_targets, citations).

    A record is shown if it is accepted_current, has all three permissions
    (null: no) and isn't erased (record_id). Else it is omitted: `withheld` if
    accepted_current, by its state if not (null: `unknown`). Targets count once
    and only where nodes (id) has them and they aren't memory themselves. A
    record id that repeats, or an id, digest or scope that isn't well formed,
    is an error: a projection is whole or none.
    """
    sized = lambda c: F.coalesce(F.octet_length(c).between(1, 512), F.lit(False))
    valid = sized("record_id") & sized("scope_ref") & F.coalesce(F.col("record_digest").rlike("^sha256:[0-9a-f]{64}$"), F.lit(False))
    held = settle(candidates.withColumn("valid", valid))
    bad = held.where("not valid").select("record_id").first()
    if bad:
        raise ValueError(f"not a valid record: {bad.record_id!r}")
    twice = held.groupBy("record_id").count().where("count > 1").first()
    if twice:
        raise ValueError(f"record id repeats: {twice.record_id}")
    gone = erased.select("record_id").distinct().withColumn("gone", F.lit(True))
    current = F.coalesce(F.col("state") == "accepted_current", F.lit(False))
    allowed = F.coalesce(F.col("projection_eligible") & F.col("authorized") & F.col("eligible_now"), F.lit(False))
    judged = settle(held.join(gone, "record_id", "left").withColumn("shown", current & allowed & F.col("gone").isNull()))
    shown = judged.where("shown").withColumn("id", F.concat(F.lit(PREFIX), "record_id"))
    targets = shown.select(F.col("id").alias("src"), F.explode(F.array_distinct("code_targets")).alias("tgt")).where(~_is_memory("tgt"))
    live = targets.join(nodes.select(F.col("id").alias("tgt")), "tgt", "left_semi")
    return Projection(
        shown.select("id", F.col("record_id").alias("label"), F.lit("memory").alias("node_type"), "record_digest", "scope_ref", "citations"),
        live.select("src", "tgt", F.lit(RELATION).alias("relation"), F.lit("EXTRACTED").alias("confidence")),
        judged.where("not shown").select("record_id", F.when(current, "withheld").otherwise(F.coalesce("state", F.lit("unknown"))).alias("reason")),
    )


def _digest(p: Projection) -> str:
    named = F.to_json(F.struct("id", "record_digest", "scope_ref", "citations"))
    return topology_signature(p.nodes.select(named.alias("id")), p.edges).first().signature


def _at(path: str, cursor: int) -> str:
    return f"{path}/cursor={cursor}"


def _write(spark: SparkSession, path: str, cursor: int, nodes: DataFrame, edges: DataFrame, receipt: tuple) -> None:
    """A version, then its receipt in one file: a version without one doesn't count and is written again."""
    nodes.write.mode("overwrite").parquet(f"{_at(path, cursor)}/nodes")
    edges.write.mode("overwrite").parquet(f"{_at(path, cursor)}/edges")
    spark.createDataFrame([receipt], _RECEIPT).coalesce(1).write.mode("append").parquet(f"{path}/receipts")


def begin(path: str, nodes: DataFrame, edges: DataFrame) -> None:
    """A store of a graph, nodes (id, ...) and edges (src, tgt, relation, ...), before any projection, at cursor -1."""
    _write(nodes.sparkSession, path, -1, nodes, edges, (-1, "", 0, 0, 0, 0))


def _head(spark: SparkSession, path: str):
    return spark.read.schema(_RECEIPT).parquet(f"{path}/receipts").orderBy(F.desc("cursor")).first()


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The nodes and edges of the store's last whole version."""
    at = _at(path, _head(spark, path).cursor)
    return spark.read.parquet(f"{at}/nodes"), spark.read.parquet(f"{at}/edges")


def merge(spark: SparkSession, path: str, projection: Projection, cursor: int) -> Receipt:
    """Put a projection as of a cursor in the place of the one before.

    An older cursor than the store's is stale, the same with the same content
    repeated: neither changes anything; the same with other content is an
    error. Else memory that the projection doesn't show goes with all its
    edges, and every edge of the owned relation at memory goes before the new
    ones come, so none outlives a change of its record. Other nodes, edges
    between them, and edges of other relations at memory that stays are not
    touched. One writer at a time; a merge that dies leaves the version before.
    """
    if cursor < 0:
        raise ValueError("cursors begin at 0")
    head = _head(spark, path)
    if cursor < head.cursor:
        return Receipt("stale", head.cursor, 0, 0)
    fresh = Projection(settle(projection.nodes), settle(projection.edges), projection.omitted)
    digest = _digest(fresh)
    if cursor == head.cursor:
        if digest != head.digest:
            raise ValueError(f"two projections as of cursor {cursor}")
        return Receipt("repeated", cursor, 0, 0)
    nodes, edges = read(spark, path)
    code = nodes.where(~_is_memory("id"))
    before = nodes.where(_is_memory("id")).select("id")
    removed = settle(before.join(fresh.nodes, "id", "left_anti"))
    apart = ~_is_memory("src") & ~_is_memory("tgt")
    # only edges at memory meet the removed; the others pass by without a shuffle
    tied = edges.where(~apart & (F.col("relation") != RELATION))
    for end in ("src", "tgt"):
        tied = tied.join(removed.select(F.col("id").alias(end)), end, "left_anti")
    attached = fresh.edges.join(code.select(F.col("id").alias("tgt")), "tgt", "left_semi")
    n_nodes, n_edges, n_removed = fresh.nodes.count(), fresh.edges.count(), removed.count()
    n_attached = fresh.nodes.join(before, "id", "left_anti").count()
    _write(
        spark, path, cursor, code.unionByName(fresh.nodes, allowMissingColumns=True),
        edges.where(apart).unionByName(tied).unionByName(attached, allowMissingColumns=True),
        (cursor, digest, n_nodes, n_edges, n_attached, n_removed),
    )
    return Receipt("applied", cursor, n_attached, n_removed)
