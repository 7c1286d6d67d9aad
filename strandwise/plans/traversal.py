"""Queries on iterative graph operators and change review."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandwise.operators import analyze, build, graph, review
from strandwise.operators.iterate import settle
from strandwise.operators.search import weighted_adjacency
from strandwise.plans.construction import by_folder
from strandwise.plans.registry import register
from strandwise.sources import star

QUERIES, ORACLES, query = register()

PLACES = ("LOCATED_IN", "PART_OF")
_PLACES = star.ORACLE_EDGES + """, geo AS (SELECT src AS id, tgt AS nbr FROM edges WHERE relation IN ('LOCATED_IN', 'PART_OF') AND src NOT LIKE 'customer:%' UNION SELECT tgt, src FROM edges WHERE relation IN ('LOCATED_IN', 'PART_OF') AND src NOT LIKE 'customer:%')"""


def adjacency(spark, sf_dir):
    return build.adjacency(star.emissions(spark, sf_dir))


def places(spark, sf_dir):
    """Suppliers, nations and regions."""
    return build.adjacency(star.emissions(spark, sf_dir).where(F.col("relation").isin(*PLACES) & ~F.col("src").startswith("customer:")))


_CALLS = """calls_all AS (SELECT p_partkey AS i, p_partkey * 7 % 997 + 1 AS j FROM part WHERE p_partkey % 3 = 0 UNION SELECT p_partkey, p_partkey * 13 % 499 + 1 FROM part WHERE p_partkey % 4 = 1),
calls AS (SELECT 'part:' || i AS id, 'part:' || j AS nbr FROM calls_all WHERE i <> j AND j IN (SELECT p_partkey FROM part)),
external AS (SELECT 'part:' || i AS id, count(*) AS n FROM calls_all WHERE j NOT IN (SELECT p_partkey FROM part) GROUP BY 1),
tested_by AS (SELECT 'part:' || p_partkey AS test, 'part:' || (p_partkey * 11 % 997 + 1) AS id FROM part WHERE p_size <= 5 AND p_partkey * 11 % 997 + 1 IN (SELECT p_partkey FROM part)),
fn AS (SELECT 'part:' || p_partkey AS id, p_name AS label, 'catalog/' || replace(lower(p_brand), '#', '') || '.json' AS source_file FROM part)"""


def call_graph(spark, sf_dir):
    """(functions, calls, external, tested_by): a call graph over parts by arithmetic on their keys."""
    part = star.table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    pairs = part.where(k % 3 == 0).select(k.alias("i"), (k * 7 % 997 + 1).alias("j")).unionByName(part.where(k % 4 == 1).select(k.alias("i"), (k * 13 % 499 + 1).alias("j"))).distinct()
    keys = part.select(k.alias("j"))
    calls = pairs.where("i != j").join(keys, "j", "left_semi").select(star.node_id("part", "i").alias("id"), star.node_id("part", "j").alias("nbr"))
    external = pairs.join(keys, "j", "left_anti").groupBy(star.node_id("part", "i").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    tests = part.where("p_size <= 5").select(star.node_id("part", "p_partkey").alias("test"), (k * 11 % 997 + 1).alias("j")).join(keys, "j", "left_semi")
    functions = star.nodes(spark, sf_dir).where("node_type = 'part'").select("id", "label", "source_file")
    return functions, calls, external, tests.select("test", star.node_id("part", "j").alias("id"))


def one(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


_BFS = "bfs AS (SELECT '{0}' AS id, 0 AS depth UNION SELECT nbr, depth + 1 FROM bfs JOIN adj USING (id) WHERE depth < {1}), near AS MATERIALIZED (SELECT id, min(depth) AS depth FROM bfs GROUP BY id)"


@query(f"WITH RECURSIVE {star.ORACLE_ADJ}, {_BFS.format('supplier:1', 3)} SELECT id, depth FROM near")
def h1_bfs(spark, sf_dir):
    return graph.bfs(adjacency(spark, sf_dir), one(spark, "supplier:1"), 3)


@query(
    f"""WITH RECURSIVE {star.ORACLE_ADJ}, {_BFS.format('region:0', 8)}, par AS MATERIALIZED (SELECT a.nbr AS id, min(a.id) AS parent FROM adj a JOIN near x ON x.id = a.id JOIN near y ON y.id = a.nbr WHERE x.depth = y.depth - 1 GROUP BY a.nbr),
path AS (SELECT depth AS hop, id FROM near WHERE id = 'part:17' UNION ALL SELECT hop - 1, parent FROM path JOIN par USING (id)) SELECT hop, id FROM path"""
)
def h4_shortest_path(spark, sf_dir):
    return graph.shortest_path(adjacency(spark, sf_dir), "region:0", "part:17")


@query(f"WITH RECURSIVE {_CALLS}, adj AS (SELECT id, nbr FROM calls UNION SELECT nbr, id FROM calls), reach AS (SELECT id, id AS root FROM adj UNION SELECT nbr, root FROM reach JOIN adj USING (id)) SELECT id, min(root) AS component FROM reach GROUP BY id")
def h9_components(spark, sf_dir):
    return graph.components(call_graph(spark, sf_dir)[1])


def _ppr_sql(rounds: int) -> str:
    sql = f"""WITH {_PLACES}, nodes AS (SELECT DISTINCT id FROM geo), tot AS (SELECT id, count(*)::DOUBLE AS total FROM geo GROUP BY id),
p AS (SELECT id, CASE id WHEN 'region:1' THEN 2.0 / 3 WHEN 'nation:3' THEN 1.0 / 3 ELSE 0.0 END::DOUBLE AS p FROM nodes), r0 AS (SELECT id, p AS rank FROM p)"""
    for k in range(1, rounds + 1):
        sql += f""", s{k} AS (SELECT geo.nbr AS id, sum(rank / total) AS got FROM r{k - 1} JOIN geo USING (id) JOIN tot USING (id) GROUP BY geo.nbr),
r{k} AS (SELECT id, 0.15::DOUBLE * p + 0.85::DOUBLE * 0.6::DOUBLE * rank + 0.85::DOUBLE * 0.4::DOUBLE * coalesce(got, 0) AS rank FROM p JOIN r{k - 1} USING (id) LEFT JOIN s{k} USING (id))"""
    return sql + f" SELECT id, round(rank, 8) AS rank FROM r{rounds}"


@query(_ppr_sql(6))
def h6_personalized_rank(spark, sf_dir):
    adj = places(spark, sf_dir).withColumn("w", F.lit(1.0))
    seeds = spark.createDataFrame([("region:1", 2.0), ("nation:3", 1.0)], "id string, mass double")
    return graph.personalized_rank(adj, adj.select("id"), seeds, rounds=6, tolerance=0.0).select("id", F.round("rank", 8).alias("rank"))


@query()
def h7_communities(spark, sf_dir):
    """All links of all nodes, hubs left out above the 99th percentile; which partition is best is no matter of SQL, the rules are tested by hand."""
    adj = weighted_adjacency(build.merge_edges(star.emissions(spark, sf_dir)))
    return graph.cluster(adj, star.nodes(spark, sf_dir), hub_percentile=99.0)


@query(
    f"""WITH RECURSIVE {_PLACES}, d AS (SELECT id AS s, id, 0 AS k FROM (SELECT DISTINCT id FROM geo) UNION SELECT s, nbr, k + 1 FROM d JOIN geo USING (id) WHERE k < 6), m AS (SELECT s, id, min(k) AS k FROM d GROUP BY s, id),
b AS (SELECT x.id, count(*) AS n FROM m st JOIN m x ON x.s = st.s JOIN m y ON y.s = x.id AND y.id = st.id WHERE x.k + y.k = st.k AND x.id <> st.s AND x.id <> st.id AND st.s <> st.id GROUP BY x.id)
SELECT id, coalesce(n, 0)::DOUBLE AS score FROM (SELECT DISTINCT id FROM geo) LEFT JOIN b USING (id)"""
)
def h8_betweenness(spark, sf_dir):
    adj = places(spark, sf_dir)
    return graph.betweenness(adj, adj.select("id").distinct()).select("id", F.round("score", 6).alias("score"))


@query(
    f"""WITH RECURSIVE arcs AS (SELECT 'region:' || n_regionkey AS parent, 'nation:' || n_nationkey AS child FROM nation UNION SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey FROM customer),
h AS (SELECT DISTINCT parent AS id, 0 AS depth, '' AS path FROM arcs WHERE parent NOT IN (SELECT child FROM arcs) UNION ALL SELECT child, depth + 1, path || '/' || parent FROM h JOIN arcs ON parent = h.id) SELECT id, depth, path FROM h"""
)
def h18_hierarchy(spark, sf_dir):
    nation, customer = star.table(spark, sf_dir, "nation"), star.table(spark, sf_dir, "customer")
    arcs = nation.select(star.node_id("region", "n_regionkey").alias("parent"), star.node_id("nation", "n_nationkey").alias("child")).unionByName(
        customer.select(star.node_id("nation", "c_nationkey").alias("parent"), star.node_id("customer", "c_custkey").alias("child"))
    )
    out = graph.hierarchy(arcs)
    return out.select("id", "depth", F.array_join(F.transform("path", lambda p: F.concat(F.lit("/"), p)), "").alias("path"))


_DAG = "dag AS (SELECT event_id::VARCHAR AS id, (event_id // 2)::VARCHAR AS nbr FROM events WHERE event_id > 0 UNION SELECT event_id::VARCHAR, (event_id // 3)::VARCHAR FROM events WHERE event_id > 0)"


def commit_dag(spark, sf_dir):
    """A history over events: each has two earlier ones as parents."""
    e = star.table(spark, sf_dir, "events").where("event_id > 0")
    parent = lambda k: e.select(F.col("event_id").cast("string").alias("id"), F.expr(f"cast(event_id div {k} as string)").alias("nbr"))
    return parent(2).unionByName(parent(3)).distinct()


@query(
    f"""WITH RECURSIVE {_DAG}, seeds AS (SELECT event_id::VARCHAR AS id FROM events ORDER BY event_id DESC LIMIT 3), r AS (SELECT id AS start, id, 0 AS depth FROM seeds UNION SELECT start, nbr, depth + 1 FROM r JOIN dag USING (id))
SELECT start, id, min(depth)::INTEGER AS depth FROM r GROUP BY start, id"""
)
def h20_reachability(spark, sf_dir):
    seeds = star.table(spark, sf_dir, "events").orderBy(F.desc("event_id")).limit(3).select(F.col("event_id").cast("string").alias("id"))
    return graph.multi_bfs(commit_dag(spark, sf_dir), seeds)


@query(
    f"""WITH RECURSIVE {_DAG}, r AS (SELECT x AS start, x AS id FROM (SELECT unnest(['900', '611']) AS x) UNION SELECT start, nbr FROM r JOIN dag USING (id)), common AS (SELECT id FROM r GROUP BY id HAVING count(DISTINCT start) = 2)
SELECT id FROM common WHERE id NOT IN (SELECT nbr FROM common JOIN dag USING (id))"""
)
def g11_merge_bases(spark, sf_dir):
    return graph.merge_bases(commit_dag(spark, sf_dir), "900", "611")


@query(
    f"""WITH {star.ORACLE_NODES}, p AS (SELECT id, source_file FROM nodes WHERE node_type = 'part'), linked AS (SELECT DISTINCT 'part:' || l_partkey AS id FROM lineitem WHERE l_quantity >= 50),
c AS (SELECT id AS anchor, n.source_file, row_number() OVER (PARTITION BY n.source_file ORDER BY id) - 1 AS slot, count(*) OVER (PARTITION BY n.source_file) AS n FROM nodes n JOIN part ON id = 'part:' || p_partkey WHERE p_size >= 48),
o AS (SELECT id, source_file, row_number() OVER (PARTITION BY source_file ORDER BY id) - 1 AS no, count(*) OVER (PARTITION BY source_file) AS orphans FROM p WHERE id NOT IN (SELECT id FROM linked) AND id NOT IN (SELECT anchor FROM c))
SELECT id, anchor FROM o JOIN c ON c.source_file = o.source_file AND slot = no % least(n, ceil(sqrt(orphans))::BIGINT)"""
)
def h10_orphan_attachment(spark, sf_dir):
    part = star.nodes(spark, sf_dir).where("node_type = 'part'").select("id", "source_file")
    linked = star.table(spark, sf_dir, "lineitem").where("l_quantity >= 50").select(star.node_id("part", "l_partkey").alias("id"))
    big = star.table(spark, sf_dir, "part").where("p_size >= 48").select(star.node_id("part", "p_partkey").alias("id"))
    return graph.attach_orphans(part, linked, part.join(big, "id", "left_semi"))


@query(
    f"""WITH RECURSIVE {star.ORACLE_NODES}, {star.ORACLE_ADJ}, bfs AS (SELECT id, 0 AS depth FROM nodes WHERE source_file = 'catalog/brand11.json' UNION SELECT nbr, depth + 1 FROM bfs JOIN adj USING (id) WHERE depth < 2)
SELECT id, min(depth) AS depth FROM bfs GROUP BY id ORDER BY depth, id LIMIT 200"""
)
def h11_impact_radius(spark, sf_dir):
    return review.impact_radius(star.nodes(spark, sf_dir), adjacency(spark, sf_dir), ["catalog/brand11.json"], 2, 200)


@query(
    f"""WITH RECURSIVE {star.ORACLE_NODES}, {star.ORACLE_ADJ}, {_BFS.format('nation:3', 1)}
SELECT src, tgt, relation FROM edges WHERE src IN (SELECT id FROM near) AND tgt IN (SELECT id FROM near)"""
)
def h21_focus_subgraph(spark, sf_dir):
    edges = build.merge_evidence(star.emissions(spark, sf_dir))
    near = graph.bfs(adjacency(spark, sf_dir), one(spark, "nation:3"), 1)
    return build.keep_live_endpoints(edges, near).select("src", "tgt", "relation")


@query(
    f"""WITH {_CALLS}, near AS (SELECT id AS start, id FROM (SELECT id FROM calls UNION SELECT id FROM tested_by) UNION SELECT id, nbr FROM calls)
SELECT DISTINCT start AS id, test FROM near JOIN tested_by ON tested_by.id = near.id"""
)
def h13_transitive_tests(spark, sf_dir):
    _, calls, _, tested = call_graph(spark, sf_dir)
    return review.transitive_tests(calls, tested)


@query(f"WITH {_CALLS} SELECT id FROM fn WHERE id NOT IN (SELECT nbr FROM calls) OR regexp_matches(label, '^(main|run|handle_|on_|test_)')")
def h14_entry_points(spark, sf_dir):
    functions, calls, *_ = call_graph(spark, sf_dir)
    return review.entry_points(functions, calls).select("id")


_FLOWS = """entries AS (SELECT id FROM fn WHERE id NOT IN (SELECT nbr FROM calls)), r AS (SELECT id AS start, id, 0 AS depth FROM entries UNION SELECT start, nbr, depth + 1 FROM r JOIN calls USING (id) WHERE depth < 15),
flows AS (SELECT start, id, min(depth) AS depth FROM r WHERE start IN (SELECT id FROM calls) GROUP BY start, id)"""


def flows(spark, sf_dir):
    functions, calls, external, tested = call_graph(spark, sf_dir)
    return review.trace_flows(calls, review.entry_points(functions, calls)), functions, calls, external, tested


@query(f"WITH RECURSIVE {_CALLS}, {_FLOWS} SELECT start, id, depth FROM flows")
def h15_call_flows(spark, sf_dir):
    return flows(spark, sf_dir)[0]


_SECURE = "list_has_any([contains(lower(label || ' ' || id), k) FOR k IN [" + ", ".join(f"'{k}'" for k in review.SECURITY) + "]], [true])"
_CRITICAL = f"""s AS (SELECT start, count(*) AS nodes, count(DISTINCT source_file) AS files, max(depth) AS depth, coalesce(sum(n), 0)::DOUBLE AS ext, count(*) FILTER ({_SECURE}) AS hits, count(*) FILTER (flows.id IN (SELECT id FROM tested_by)) AS tested
  FROM flows JOIN fn USING (id) LEFT JOIN external USING (id) GROUP BY start),
critical AS (SELECT start, nodes, files, depth, round(0.3::DOUBLE * CASE WHEN files > 1 THEN least((files - 1) / 4, 1.0::DOUBLE) ELSE 0 END + 0.2::DOUBLE * least(ext / 5, 1.0::DOUBLE) + 0.25::DOUBLE * least(hits / nodes, 1.0::DOUBLE) + 0.15::DOUBLE * (1 - tested / nodes) + 0.1::DOUBLE * least(depth / 10, 1.0::DOUBLE), 4) AS criticality FROM s)"""


def critical_flows(spark, sf_dir):
    traced, functions, calls, external, tested = flows(spark, sf_dir)
    return review.flow_criticality(traced, functions, tested, external), traced, functions, calls, tested


@query(f"WITH RECURSIVE {_CALLS}, {_FLOWS}, {_CRITICAL} SELECT start, nodes, files, depth, criticality FROM critical")
def h16_flow_criticality(spark, sf_dir):
    return critical_flows(spark, sf_dir)[0]


@query(f"WITH RECURSIVE {_CALLS}, {_FLOWS}, {_CRITICAL} SELECT start, criticality, nodes FROM critical ORDER BY criticality DESC, nodes DESC, start LIMIT 50")
def f17_flow_listing(spark, sf_dir):
    return critical_flows(spark, sf_dir)[0].select("start", "criticality", "nodes").orderBy(F.desc("criticality"), F.desc("nodes"), "start").limit(50)


@query(f"WITH RECURSIVE {_CALLS}, {_FLOWS} SELECT DISTINCT start FROM flows JOIN fn USING (id) WHERE source_file IN ('catalog/brand11.json', 'catalog/brand12.json')")
def d21_affected_flows(spark, sf_dir):
    traced, functions, *_ = flows(spark, sf_dir)
    changed = functions.where(F.col("source_file").isin("catalog/brand11.json", "catalog/brand12.json")).select("id")
    return traced.join(changed, "id", "left_semi").select("start").distinct()


@query(
    f"""WITH {_CALLS}, membership AS (SELECT id, source_file AS community FROM fn), near AS (SELECT id AS start, id FROM (SELECT id FROM calls UNION SELECT id FROM tested_by) UNION SELECT id, nbr FROM calls),
tests AS (SELECT start AS id, count(DISTINCT test) AS tests FROM near JOIN tested_by ON tested_by.id = near.id GROUP BY start),
c AS (SELECT nbr AS id, count(*) AS callers, count(DISTINCT CASE WHEN a.community <> b.community THEN calls.id END) AS cross_callers FROM calls JOIN membership a ON a.id = calls.id JOIN membership b ON b.id = calls.nbr GROUP BY nbr)
SELECT id, round(least(greatest(least(coalesce(cross_callers, 0) * 0.05::DOUBLE, 0.15::DOUBLE) + 0.3::DOUBLE - least(coalesce(tests, 0) / 5, 1.0::DOUBLE) * 0.25::DOUBLE + CASE WHEN {_SECURE} THEN 0.2::DOUBLE ELSE 0 END + least(coalesce(callers, 0) / 20, 0.1::DOUBLE), 0), 1), 4) AS risk
FROM fn LEFT JOIN c USING (id) LEFT JOIN tests USING (id)"""
)
def h17_change_risk(spark, sf_dir):
    functions, calls, _, tested = call_graph(spark, sf_dir)
    membership = functions.select("id", F.col("source_file").alias("community"))
    return review.risk_scores(functions, calls, membership, review.transitive_tests(calls, tested))


@query(
    f"""WITH {star.ORACLE_NODES}, {star.ORACLE_ADJ}, membership AS (SELECT id, dense_rank() OVER (ORDER BY split_part(source_file, '/', 1)) AS community FROM nodes), ch AS (SELECT id FROM nodes WHERE source_file = 'catalog/brand11.json'),
im AS (SELECT DISTINCT nbr AS id FROM adj WHERE id IN (SELECT id FROM ch) AND nbr NOT IN (SELECT id FROM ch)), hub AS (SELECT id FROM adj GROUP BY id HAVING count(*) >= 50),
s AS (SELECT community, count(*) FILTER (id IN (SELECT id FROM ch)) AS changed, count(*) FILTER (id IN (SELECT id FROM im)) AS impacted, count(*) FILTER (id IN (SELECT id FROM hub)) AS hubs FROM membership WHERE id IN (SELECT id FROM ch UNION SELECT id FROM im) GROUP BY community)
SELECT community, changed, impacted, hubs, 4 * changed + impacted + 2 * hubs AS score, CASE WHEN 4 * changed + impacted + 2 * hubs >= 30 THEN 'high' WHEN 4 * changed + impacted + 2 * hubs >= 12 THEN 'medium' ELSE 'low' END AS level FROM s"""
)
def e24_community_impact(spark, sf_dir):
    nodes, adj = star.nodes(spark, sf_dir), adjacency(spark, sf_dir)
    near = review.impact_radius(nodes, adj, ["catalog/brand11.json"], 1)
    hubs = analyze.degrees(adj).where("degree >= 50")
    return review.community_impact(near.where("depth = 0"), near.where("depth > 0"), hubs, by_folder(nodes))


@query(
    f"""WITH {star.ORACLE_NODES}, {star.ORACLE_ADJ}, deg AS (SELECT id, count(*) AS d FROM adj GROUP BY id), st AS (SELECT id FROM nodes WHERE id IN ('supplier:1', 'supplier:2')), im AS (SELECT nbr AS id FROM adj WHERE id IN (SELECT id FROM st) UNION SELECT id FROM st),
l AS (SELECT src, tgt FROM edges WHERE confidence <> 'EXTRACTED' UNION SELECT tgt, src FROM edges WHERE confidence <> 'EXTRACTED'), b AS (SELECT * FROM l WHERE tgt IN (SELECT id FROM im)),
one AS (SELECT src AS a, tgt AS b FROM b WHERE src IN (SELECT id FROM st)), ch AS (SELECT a, b, NULL AS c FROM one UNION ALL SELECT one.a, one.b, b.tgt FROM one JOIN b ON b.src = one.b AND b.tgt <> one.a)
SELECT ch.a, ch.b, ch.c, (coalesce(x.d, 0) + coalesce(y.d, 0) + coalesce(z.d, 0))::BIGINT AS degree FROM ch LEFT JOIN deg x ON x.id = a LEFT JOIN deg y ON y.id = b LEFT JOIN deg z ON z.id = c ORDER BY degree DESC, a, b, c NULLS FIRST LIMIT 20"""
)
def f16_risky_chains(spark, sf_dir):
    emissions, starts = star.emissions(spark, sf_dir), settle(one(spark, "supplier:1", "supplier:2"))
    near = build.adjacency(build.touching(emissions, starts)).join(starts, "id").select(F.col("nbr").alias("id")).unionByName(starts).distinct()
    near = settle(near)
    around = settle(build.touching(emissions.drop("source_file"), near))  # all emissions of the nodes that a chain can have
    return review.risky_chains(starts, near, build.merge_edges(around), build.adjacency(around))
