"""Queries on graph construction and analysis over the star schema's graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.operators import analyze, build
from strandwise.operators.iterate import ranked
from strandwise.plans.registry import register
from strandwise.sources import star

QUERIES, ORACLES, query = register()


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    edges = build.merge_evidence(star.emissions(spark, sf_dir))
    return star.nodes(spark, sf_dir), edges, build.adjacency(star.emissions(spark, sf_dir))


@query(f"WITH {star.ORACLE_NODES} SELECT * FROM nodes")
def a6_records_to_nodes(spark, sf_dir):
    return star.nodes(spark, sf_dir).dropDuplicates(["id"])


@query(f"WITH {star.ORACLE_EDGES} SELECT src, tgt, relation, weight, confidence, confidence_score, n_observations, source_file FROM edges")
def e1_evidence_merge(spark, sf_dir):
    return build.count_evidence(star.emissions(spark, sf_dir))


@query(
    f"""WITH {star.ORACLE_NODES}, {star.ORACLE_EMISSIONS}
SELECT src, tgt, relation, count(*) AS n FROM emissions
WHERE src IN (SELECT id FROM nodes WHERE node_type <> 'part' OR source_file < 'catalog/brand3') AND tgt IN (SELECT id FROM nodes WHERE node_type <> 'part' OR source_file < 'catalog/brand3')
GROUP BY ALL"""
)
def d1_endpoint_integrity(spark, sf_dir):
    nodes = star.nodes(spark, sf_dir).where("node_type != 'part' or source_file < 'catalog/brand3'")
    kept = build.keep_live_endpoints(star.emissions(spark, sf_dir), nodes)
    return kept.groupBy(*build.EDGE_KEY).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {star.ORACLE_ADJ} SELECT id, count(*) AS degree FROM adj GROUP BY id")
def e2_degree(spark, sf_dir):
    return analyze.degrees(graph(spark, sf_dir)[2])


@query(
    f"""WITH {star.ORACLE_NODES}, {star.ORACLE_ADJ}
SELECT n.id, n.label, count(a.nbr) AS degree FROM nodes n LEFT JOIN adj a USING (id)
WHERE regexp_matches(n.source_file, '[^/]*[.][^/]*$') GROUP BY n.id, n.label ORDER BY degree DESC, n.id LIMIT 10"""
)
def f3_god_nodes(spark, sf_dir):
    nodes, _, adj = graph(spark, sf_dir)
    return analyze.god_nodes(nodes, adj)


_CATEGORY = "CASE WHEN {0}.source_file LIKE '%.py' OR {0}.source_file LIKE '%.ts' OR {0}.source_file LIKE '%.sql' THEN 'code' ELSE 'doc' END"


@query(
    f"""WITH {star.ORACLE_NODES}, {star.ORACLE_ADJ}, deg AS (SELECT id, count(*) AS d FROM adj GROUP BY id),
scored AS (
  SELECT e.src, e.tgt, e.relation, e.confidence,
    CASE e.confidence WHEN 'AMBIGUOUS' THEN 3 WHEN 'INFERRED' THEN 2 ELSE 1 END
    + CASE WHEN {_CATEGORY.format('u')} <> {_CATEGORY.format('v')} THEN 2 ELSE 0 END
    + CASE WHEN split_part(u.source_file, '/', 1) <> split_part(v.source_file, '/', 1) THEN 2 ELSE 0 END
    + CASE WHEN least(coalesce(du.d, 0), coalesce(dv.d, 0)) <= 2 AND greatest(coalesce(du.d, 0), coalesce(dv.d, 0)) >= 5 THEN 1 ELSE 0 END AS score
  FROM edges e JOIN nodes u ON e.src = u.id JOIN nodes v ON e.tgt = v.id LEFT JOIN deg du ON du.id = u.id LEFT JOIN deg dv ON dv.id = v.id
  WHERE u.source_file <> v.source_file)
SELECT src, tgt, relation, confidence, score::BIGINT AS score FROM scored ORDER BY score DESC, src, tgt, relation LIMIT 20"""
)
def f4_surprising_connections(spark, sf_dir):
    nodes, edges, adj = graph(spark, sf_dir)
    return analyze.surprises(nodes, edges, adj, n=20)


_BY_TYPE = "membership AS MATERIALIZED (SELECT id, dense_rank() OVER (ORDER BY split_part(source_file, '/', 1)) AS community FROM nodes)"


def by_folder(nodes: DataFrame) -> DataFrame:
    """A stand-in membership: the top folder's number in order."""
    names = nodes.select(analyze.top_dir(F.col("source_file")).alias("dir")).distinct()
    return nodes.withColumn("dir", analyze.top_dir(F.col("source_file"))).join(ranked(names, "dir", name="community"), "dir").select("id", "community")


@query(
    f"""WITH {star.ORACLE_NODES}, {star.ORACLE_EDGES}, {_BY_TYPE},
pairs AS (
  SELECT least(a.community, b.community) AS low, greatest(a.community, b.community) AS high, e.*,
    CASE e.confidence WHEN 'AMBIGUOUS' THEN 0 WHEN 'INFERRED' THEN 1 ELSE 2 END AS rank
  FROM edges e JOIN membership a ON a.id = e.src JOIN membership b ON b.id = e.tgt WHERE a.community <> b.community),
best AS (SELECT *, row_number() OVER (PARTITION BY low, high ORDER BY rank, src, tgt, relation) AS rn FROM pairs)
SELECT low, high, src, tgt, relation, confidence FROM best WHERE rn = 1 ORDER BY rank, src, tgt, relation LIMIT 5"""
)
def f5_cross_community(spark, sf_dir):
    nodes, edges, _ = graph(spark, sf_dir)
    return analyze.cross_community(edges, by_folder(nodes))


@query(
    f"""WITH {star.ORACLE_NODES}, {star.ORACLE_ADJ}, {_BY_TYPE},
ends AS MATERIALIZED (SELECT a.community AS x, b.community AS y FROM adj JOIN membership a ON a.id = adj.id JOIN membership b ON b.id = adj.nbr WHERE adj.id < adj.nbr),
inside AS (SELECT x AS community, count(*) AS pairs FROM ends WHERE x = y GROUP BY x),
sized AS (SELECT community, count(*) AS size FROM membership GROUP BY community)
SELECT community, size, round(CASE WHEN size <= 1 THEN 1.0 ELSE coalesce(pairs, 0) / (size * (size - 1) / 2.0) END, 6)::DOUBLE AS cohesion FROM sized LEFT JOIN inside USING (community)"""
)
def e3_cohesion(spark, sf_dir):
    nodes, _, adj = graph(spark, sf_dir)
    return analyze.cohesion(adj, by_folder(nodes))


@query(f"WITH {star.ORACLE_EDGES} SELECT confidence, count(*) AS n, floor(100 * count(*) / (SELECT count(*) FROM edges) + 0.5)::BIGINT AS percent FROM edges GROUP BY confidence")
def e4_confidence_audit(spark, sf_dir):
    return analyze.confidence_audit(graph(spark, sf_dir)[1])


@query(
    f"""WITH {star.ORACLE_NODES}, {star.ORACLE_ADJ}, deg AS (SELECT id, count(*) AS d FROM adj GROUP BY id), n AS (SELECT count(*) AS n FROM nodes)
SELECT n.n AS n_nodes, (SELECT count(*) FROM edges) AS n_edges, round((SELECT sum(d) FROM deg) / (n.n * (n.n - 1.0)), 8)::DOUBLE AS density,
  round((SELECT sum(d) FROM deg) / n.n, 4)::DOUBLE AS mean_degree, (SELECT id FROM deg ORDER BY d DESC, id LIMIT 1) AS top_hub FROM n"""
)
def e10_first_hop_summary(spark, sf_dir):
    return analyze.summary(*graph(spark, sf_dir))


_FACETS = ("p_brand", "p_type", "p_size", "p_name")


@query(
    "WITH long AS ("
    + " UNION ALL ".join(f"SELECT '{f}' AS field, {f}::VARCHAR AS value FROM part" for f in _FACETS)
    + """), counted AS (SELECT field, value, count(*) AS n FROM long WHERE value IS NOT NULL AND value <> '' GROUP BY field, value),
ok AS (SELECT field FROM counted GROUP BY field HAVING count(*) BETWEEN 2 AND 40 AND sum(n) >= 0.05 * (SELECT count(*) FROM part))
SELECT field, value, n FROM counted WHERE field IN (SELECT field FROM ok)"""
)
def e7_facets(spark, sf_dir):
    return analyze.facets(star.table(spark, sf_dir, "part"), list(_FACETS))


@query(
    """WITH ranked AS (SELECT p_type, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS rank, count(*) OVER (PARTITION BY p_type) AS total FROM part)
SELECT p_type, p_partkey, rank::INTEGER AS rank, greatest(total - 3, 0) AS hidden FROM ranked WHERE rank <= 3"""
)
def e8_groups_by_type(spark, sf_dir):
    part = star.table(spark, sf_dir, "part").select("p_type", "p_partkey", "p_retailprice")
    return analyze.first_by_type(part, "p_type", [F.desc("p_retailprice"), "p_partkey"], 3).select("p_type", "p_partkey", "rank", "hidden")


@query(
    f"""WITH {star.ORACLE_NODES}, {star.ORACLE_ADJ}, top AS (SELECT n.id FROM nodes n LEFT JOIN adj a USING (id) GROUP BY n.id ORDER BY count(a.nbr) DESC, n.id LIMIT 2000)
SELECT src, tgt, relation FROM edges WHERE src IN (SELECT id FROM top) AND tgt IN (SELECT id FROM top)"""
)
def f6_degree_window(spark, sf_dir):
    nodes, edges, adj = graph(spark, sf_dir)
    return analyze.degree_window(nodes, edges, adj)[1].select("src", "tgt", "relation")


@query(
    """WITH extracted AS (
  SELECT 'customer:' || c_custkey AS id, c_name AS label, NULL::VARCHAR AS status, c_mktsegment AS kind, 1 AS ordinal FROM customer
  UNION ALL SELECT 'customer:' || o_custkey, NULL, o_orderstatus, CASE WHEN o_totalprice > 300000 THEN o_orderpriority END, 1 + o_orderkey FROM orders)
SELECT id, arg_max(label, ordinal) FILTER (label IS NOT NULL) AS label, arg_max(status, ordinal) FILTER (status IS NOT NULL) AS status,
  arg_max(kind, ordinal) FILTER (kind IS NOT NULL) AS kind FROM extracted GROUP BY id"""
)
def g1_last_write_wins(spark, sf_dir):
    base = star.table(spark, sf_dir, "customer").select(
        star.node_id("customer", "c_custkey").alias("id"), F.col("c_name").alias("label"), F.lit(None).cast("string").alias("status"), F.col("c_mktsegment").alias("kind"), F.lit(1).cast("long").alias("ordinal")
    )
    later = star.table(spark, sf_dir, "orders").select(
        star.node_id("customer", "o_custkey").alias("id"), F.lit(None).cast("string").alias("label"), F.col("o_orderstatus").alias("status"),
        F.when(F.col("o_totalprice") > 300000, F.col("o_orderpriority")).alias("kind"), (F.col("o_orderkey") + 1).alias("ordinal"),
    )
    return build.merge_nodes(base.unionByName(later))


_LABELS = r"""chunked AS MATERIALIZED (SELECT CASE WHEN node_type = 'part' AND length(label) % 3 = 0 THEN id || '_c' || (length(label) % 7) ELSE id END AS id, label, source_file FROM nodes),
keyed AS MATERIALIZED (SELECT *, regexp_matches(id, '_c[0-9]+$') AS chunk, trim(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g')) AS norm FROM chunked WHERE NOT regexp_full_match(trim(label), '[A-Z0-9][A-Z0-9._/-]{1,11}')),
named AS MATERIALIZED (SELECT * FROM keyed WHERE length(replace(norm, ' ', '')) > 3),
one AS MATERIALIZED (SELECT id AS old, new FROM (SELECT id, first_value(id) OVER (PARTITION BY source_file, norm ORDER BY chunk, length(id), id) AS new FROM named) WHERE id <> new),
two AS MATERIALIZED (SELECT id AS old, new FROM (SELECT id, chunk, first_value(id) OVER (PARTITION BY norm ORDER BY chunk, length(id), id) AS new FROM named WHERE id NOT IN (SELECT old FROM one)) WHERE id <> new AND chunk),
mapping AS (SELECT one.old, coalesce(two.new, one.new) AS new FROM one LEFT JOIN two ON two.old = one.new UNION ALL SELECT old, new FROM two)"""


def chunked_nodes(spark, sf_dir):
    """All nodes; some ids have the suffix of an extraction in chunks."""
    size = F.length("label")
    some = F.when((F.col("node_type") == "part") & (size % 3 == 0), F.concat("id", F.lit("_c"), (size % 7).cast("string"))).otherwise(F.col("id"))
    return star.nodes(spark, sf_dir).select(some.alias("id"), "label", "source_file")


@query(f"WITH {star.ORACLE_NODES}, {_LABELS} SELECT old, new FROM mapping")
def g2_label_dedup(spark, sf_dir):
    return build.canonical_labels(chunked_nodes(spark, sf_dir))


@query(
    f"""WITH {star.ORACLE_EMISSIONS}, mapping AS (
  SELECT 'supplier:' || s_suppkey AS old, 'supplier:' || CASE WHEN s_suppkey % 2 = 0 THEN 2 ELSE 1 END AS new FROM supplier WHERE s_suppkey > 2
  UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation WHERE n_nationkey % 5 = 0)
SELECT * FROM (SELECT coalesce(a.new, e.src) AS src, coalesce(b.new, e.tgt) AS tgt, relation, count(*) AS n FROM emissions e LEFT JOIN mapping a ON a.old = e.src LEFT JOIN mapping b ON b.old = e.tgt GROUP BY ALL) WHERE src <> tgt"""
)
def g3_remap_endpoints(spark, sf_dir):
    """All links; a supplier goes to the one two before it, and so on to the first two, some nations to their regions, which makes loops."""
    key = F.col("s_suppkey")
    chain = star.table(spark, sf_dir, "supplier").where(key > 2).select(star.node_id("supplier", "s_suppkey").alias("old"), F.concat(F.lit("supplier:"), (key - 2).cast("string")).alias("new"))
    places = star.table(spark, sf_dir, "nation").where("n_nationkey % 5 = 0").select(star.node_id("nation", "n_nationkey").alias("old"), star.node_id("region", "n_regionkey").alias("new"))
    return build.remap(star.emissions(spark, sf_dir), chain.unionByName(places)).groupBy(*build.EDGE_KEY).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {star.ORACLE_NODES}, {star.ORACLE_EMISSIONS}, gone AS (SELECT 'crm/building.py' AS source_file UNION ALL SELECT '1995-03'),
kept AS (SELECT id FROM nodes WHERE source_file NOT IN (SELECT source_file FROM gone))
SELECT src, tgt, relation, count(*) AS n FROM emissions WHERE source_file NOT IN (SELECT source_file FROM gone) AND src IN (SELECT id FROM kept) AND tgt IN (SELECT id FROM kept) GROUP BY ALL"""
)
def g4_merge_with_prune(spark, sf_dir):
    gone = spark.createDataFrame([("crm/building.py",), ("1995-03",)], "source_file string")
    _, edges = build.prune_sources(star.nodes(spark, sf_dir), star.emissions(spark, sf_dir), gone)
    return edges.groupBy(*build.EDGE_KEY).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {star.ORACLE_EDGES} SELECT least(src, tgt) AS src, greatest(src, tgt) AS tgt, relation, max(weight) AS weight, count(*) AS n FROM edges GROUP BY 1, 2, 3")
def g10_undirected(spark, sf_dir):
    return build.undirected(graph(spark, sf_dir)[1])


@query(
    """WITH old AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01'), new AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01')
SELECT *, 'added' AS change FROM (SELECT * FROM new EXCEPT SELECT * FROM old) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM old EXCEPT SELECT * FROM new)"""
)
def d16_graph_diff(spark, sf_dir):
    line = star.table(spark, sf_dir, "lineitem")
    cut = F.lit("1996-01-01").cast("timestamp_ntz")
    return build.diff(line.where(F.col("l_shipdate") < cut), line.where(F.col("l_shipdate") >= cut), ["l_partkey", "l_suppkey"])


@query(
    f"""WITH {star.ORACLE_NODES}, {star.ORACLE_EMISSIONS}, kept AS (SELECT id FROM nodes WHERE node_type <> 'supplier')
SELECT concat_ws(' ', src, relation, tgt) AS subject, 'src doesn''t exist' AS problem FROM emissions WHERE src NOT IN (SELECT id FROM kept)
UNION ALL SELECT concat_ws(' ', src, relation, tgt), 'tgt doesn''t exist' FROM emissions WHERE tgt NOT IN (SELECT id FROM kept)"""
)
def c1_validate(spark, sf_dir):
    return build.validate(star.nodes(spark, sf_dir).where("node_type != 'supplier'"), star.emissions(spark, sf_dir))


@query(
    """WITH seen AS (SELECT l_partkey AS id, l_linestatus AS status, l_returnflag AS flag, CASE l_returnflag WHEN 'N' THEN 3 WHEN 'R' THEN 2 ELSE 1 END AS rank FROM lineitem)
SELECT id, arg_min(status, (-rank, status)) AS status, arg_min(flag, (-rank, flag)) AS flag,
  concat_ws(',', CASE WHEN count(DISTINCT status) > 1 THEN 'status' END, CASE WHEN count(DISTINCT flag) > 1 THEN 'flag' END) AS conflicts FROM seen GROUP BY id"""
)
def g6_lattice_merge(spark, sf_dir):
    line = star.table(spark, sf_dir, "lineitem")
    seen = F.when(F.col("l_returnflag") == "N", "EXTRACTED").when(F.col("l_returnflag") == "R", "INFERRED").otherwise("AMBIGUOUS")
    rows = line.select(F.col("l_partkey").alias("id"), F.col("l_linestatus").alias("status"), F.col("l_returnflag").alias("flag"), seen.alias("confidence"))
    return build.lattice_merge(rows, ["status", "flag"])
