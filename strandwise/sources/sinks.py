"""Sinks: graph documents, interchange formats, tables with upserts and tombstones, search indexes, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandwise.functions.text import escape_html


def graph_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(value): one JSON object for each node and edge, keys in order, nodes first; sorted when written by range."""
    n = nodes.select(F.lit(0).alias("part"), F.col("id").alias("key"), F.to_json(F.struct(*[F.col(c) for c in sorted(nodes.columns)])).alias("value"))
    e = edges.select(F.lit(1).alias("part"), F.concat_ws("|", "src", "tgt", "relation").alias("key"), F.to_json(F.struct(*[F.col(c) for c in sorted(edges.columns)])).alias("value"))
    return n.unionByName(e).orderBy("part", "key").select("value")


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Parquet tables `nodes` and `edges`; the primary form of a graph."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def cypher(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(value): MERGE statements, strings escaped."""
    q = lambda c: F.concat(F.lit("'"), F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))
    kind = F.regexp_replace(F.initcap("node_type"), r"\W", "_")
    n = nodes.select(F.concat(F.lit("MERGE (n:"), kind, F.lit(" {id: "), q("id"), F.lit("}) SET n.label = "), q("label"), F.lit(";")).alias("value"))
    relation = F.regexp_replace(F.upper("relation"), r"\W", "_")
    e = edges.select(F.concat(F.lit("MATCH (a {id: "), q("src"), F.lit("}), (b {id: "), q("tgt"), F.lit("}) MERGE (a)-[:"), relation, F.lit("]->(b);")).alias("value"))
    return n.unionByName(e)


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(value): the node and edge elements of a GraphML document."""
    n = nodes.select(F.concat(F.lit('<node id="'), escape_html(F.col("id")), F.lit('"><data key="label">'), escape_html(F.coalesce("label", F.lit(""))), F.lit("</data></node>")).alias("value"))
    e = edges.select(F.concat(F.lit('<edge source="'), escape_html(F.col("src")), F.lit('" target="'), escape_html(F.col("tgt")), F.lit('"><data key="relation">'), escape_html(F.col("relation")), F.lit("</data></edge>")).alias("value"))
    return n.unionByName(e)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], batch: str = "batch") -> DataFrame:
    """The newest row of each key by batch; columns of either side stay."""
    both = old.unionByName(new, allowMissingColumns=True)
    w = W.partitionBy(*keys).orderBy(F.desc(batch))
    return both.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def write_store(rows: DataFrame, path: str, namespace: str = "city") -> None:
    """Parquet by namespace, sorted by the start of the interval, so that as-of reads skip files by their ranges."""
    rows.repartitionByRange("t").sortWithinPartitions("t").write.mode("overwrite").partitionBy(namespace).parquet(path)


def write_search_index(docs: DataFrame, postings: DataFrame, adjacency: DataFrame, path: str, buckets: int = 64) -> None:
    """docs, postings sorted by term within ranges of terms, and adj."""
    docs.write.mode("overwrite").parquet(f"{path}/docs")
    postings.repartitionByRange(buckets, "term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
    adjacency.write.mode("overwrite").parquet(f"{path}/adj")


def report(summary: DataFrame, hubs: DataFrame, audit: DataFrame) -> str:
    """A Markdown report of small frames: one summary row, the hubs, the confidence shares."""
    s = summary.first()
    lines = ["# Graph report", "", f"{s.n_nodes} nodes, {s.n_edges} edges, mean degree {s.mean_degree}.", "", "## Hubs", ""]
    lines += [f"- {r.label} ({r.degree})" for r in hubs.limit(100).collect()]
    lines += ["", "## Confidence", ""] + [f"- {r.confidence}: {r.n} ({r.percent}%)" for r in audit.limit(10).collect()]
    return "\n".join(lines) + "\n"
