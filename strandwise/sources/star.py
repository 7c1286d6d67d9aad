"""The property graph of the driver tables: nodes, edge emissions, intervals and texts.

Nothing is collected: each function is a projection over Parquet scans, so
filters and column choices of a caller reach the files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node_id(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def epoch_ms(ts: str) -> Column:
    """Epoch milliseconds of a zoneless timestamp, whatever the session's zone."""
    return F.expr(
        f"unix_date(to_date({ts})) * 86400000L + hour({ts}) * 3600000L + minute({ts}) * 60000L + cast(floor(extract(second from {ts}) * 1000) as bigint)"
    )


def year_month(ts: str) -> Column:
    """yyyy-MM of a timestamp; a year of four digits needs no formatter."""
    y, m = F.year(ts), F.month(ts)
    return F.when(y.between(1000, 9999), F.concat(y.cast("string"), F.when(m < 10, "-0").otherwise("-"), m.cast("string"))).otherwise(F.date_format(ts, "yyyy-MM"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, node_type, source_file)"""

    def part(name: str, kind: str, key: str, label: Column, source: Column) -> DataFrame:
        return table(spark, sf_dir, name).select(
            node_id(kind, key).alias("id"), label.alias("label"), F.lit(kind).alias("node_type"), source.alias("source_file")
        )

    out = part("region", "region", "r_regionkey", F.col("r_name"), F.lit("geo/region.md"))
    for other in (
        part("nation", "nation", "n_nationkey", F.col("n_name"), F.lit("geo/nation.md")),
        part("customer", "customer", "c_custkey", F.col("c_name"), F.concat(F.lit("crm/"), F.lower("c_mktsegment"), F.lit(".py"))),
        part("supplier", "supplier", "s_suppkey", F.col("s_name"), F.lit("supply/supplier.ts")),
        part("part", "part", "p_partkey", F.col("p_name"), F.concat(F.lit("catalog/"), F.replace(F.lower("p_brand"), F.lit("#"), F.lit("")), F.lit(".json"))),
        part("orders", "order", "o_orderkey", F.concat(F.lit("order "), F.col("o_orderkey").cast("string")), F.concat(F.lit("sales/"), F.lower(F.substring("o_orderpriority", 1, 1)), F.lit(".sql"))),
    ):
        out = out.unionByName(other)
    return out


def emissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge emissions, parallel ones included: (src, tgt, relation, confidence, weight, source_file)."""

    def edges(df: DataFrame, src: Column, tgt: Column, relation: str, confidence: Column | None = None, weight: Column | None = None, source: Column | None = None) -> DataFrame:
        return df.select(
            src.alias("src"),
            tgt.alias("tgt"),
            F.lit(relation).alias("relation"),
            (F.lit("EXTRACTED") if confidence is None else confidence).alias("confidence"),
            (F.lit(None).cast("double") if weight is None else weight).alias("weight"),
            (F.lit("schema") if source is None else source).alias("source_file"),
        )

    t = lambda name: table(spark, sf_dir, name)
    line = t("lineitem")
    seen = F.when(F.col("l_returnflag") == "N", "EXTRACTED").when(F.col("l_returnflag") == "R", "INFERRED").otherwise("AMBIGUOUS")
    month = year_month("l_shipdate")
    out = edges(t("nation"), node_id("nation", "n_nationkey"), node_id("region", "n_regionkey"), "PART_OF")
    for other in (
        edges(t("customer"), node_id("customer", "c_custkey"), node_id("nation", "c_nationkey"), "LOCATED_IN"),
        edges(t("supplier"), node_id("supplier", "s_suppkey"), node_id("nation", "s_nationkey"), "LOCATED_IN"),
        edges(t("orders"), node_id("customer", "o_custkey"), node_id("order", "o_orderkey"), "PLACED"),
        edges(line, node_id("order", "l_orderkey"), node_id("part", "l_partkey"), "CONTAINS", seen, F.col("l_quantity"), month),
        edges(line, node_id("part", "l_partkey"), node_id("supplier", "l_suppkey"), "SUPPLIED_BY", seen, F.col("l_quantity"), month),
    ):
        out = out.unionByName(other)
    return out


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as closed intervals (id, owner, kind, t, t_end, has_t_end): each ends where its user's next one begins."""
    from pyspark.sql import Window as W

    by = W.partitionBy("user_id").orderBy("t", "event_id")
    flat = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", epoch_ms("ts").alias("t"))
    return flat.select(
        F.concat(F.lit("event:"), F.col("event_id").cast("string")).alias("id"),
        node_id("user", "user_id").alias("owner"),
        F.col("event_type").alias("kind"),
        "t",
        F.lead("t").over(by).alias("t_end"),
        F.lead("t").over(by).isNotNull().alias("has_t_end"),
    )


ORACLE_NODES = """nodes AS MATERIALIZED (
  SELECT 'region:' || r_regionkey AS id, r_name AS label, 'region' AS node_type, 'geo/region.md' AS source_file FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, n_name, 'nation', 'geo/nation.md' FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, c_name, 'customer', 'crm/' || lower(c_mktsegment) || '.py' FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, s_name, 'supplier', 'supply/supplier.ts' FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, p_name, 'part', 'catalog/' || replace(lower(p_brand), '#', '') || '.json' FROM part
  UNION ALL SELECT 'order:' || o_orderkey, 'order ' || o_orderkey, 'order', 'sales/' || lower(o_orderpriority[1]) || '.sql' FROM orders)"""

ORACLE_EMISSIONS = """line AS (
  SELECT *, CASE l_returnflag WHEN 'N' THEN 'EXTRACTED' WHEN 'R' THEN 'INFERRED' ELSE 'AMBIGUOUS' END AS seen,
    strftime(l_shipdate, '%Y-%m') AS ym FROM lineitem),
emissions AS (
  SELECT 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS tgt, 'PART_OF' AS relation, 'EXTRACTED' AS confidence, NULL::DOUBLE AS weight, 'schema' AS source_file FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'LOCATED_IN', 'EXTRACTED', NULL, 'schema' FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'LOCATED_IN', 'EXTRACTED', NULL, 'schema' FROM supplier
  UNION ALL SELECT 'customer:' || o_custkey, 'order:' || o_orderkey, 'PLACED', 'EXTRACTED', NULL, 'schema' FROM orders
  UNION ALL SELECT 'order:' || l_orderkey, 'part:' || l_partkey, 'CONTAINS', seen, l_quantity, ym FROM line
  UNION ALL SELECT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'SUPPLIED_BY', seen, l_quantity, ym FROM line)"""

ORACLE_EDGES = ORACLE_EMISSIONS + """,
edges AS MATERIALIZED (
  SELECT src, tgt, relation, max(weight) AS weight,
    CASE max(CASE confidence WHEN 'EXTRACTED' THEN 3 WHEN 'INFERRED' THEN 2 ELSE 1 END) WHEN 3 THEN 'EXTRACTED' WHEN 2 THEN 'INFERRED' ELSE 'AMBIGUOUS' END AS confidence,
    max(CASE confidence WHEN 'EXTRACTED' THEN 1.0 WHEN 'INFERRED' THEN 0.5 ELSE 0.2 END)::DOUBLE AS confidence_score,
    count(DISTINCT confidence || '|' || source_file) AS n_observations, min(source_file) AS source_file
  FROM emissions GROUP BY src, tgt, relation)"""

ORACLE_ADJ = ORACLE_EDGES + """,
adj AS MATERIALIZED (
  SELECT src AS id, tgt AS nbr FROM edges WHERE src <> tgt UNION SELECT tgt, src FROM edges WHERE src <> tgt)"""

ORACLE_INTERVALS = """flat AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) // 1000 AS t FROM events),
intervals AS (
  SELECT 'event:' || event_id AS id, 'user:' || user_id AS owner, event_type AS kind, t,
    lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS t_end,
    lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id) IS NOT NULL AS has_t_end
  FROM flat)"""
