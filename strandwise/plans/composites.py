"""Queries on composites."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandwise.operators import analyze, build, composite, relational, resolve, review
from strandwise.plans.construction import by_folder
from strandwise.plans.registry import register
from strandwise.plans.retrieval import _BM25, _SUPPLY, benchmark_bm25, supply_adjacency
from strandwise.plans.traversal import _CALLS, call_graph, places
from strandwise.sources import star

QUERIES, ORACLES, query = register()


def t(spark, sf_dir, name):
    return star.table(spark, sf_dir, name)


@query()
def i3_answer_pack(spark, sf_dir):
    """The neighbourhood of two seeds among suppliers, nations and regions; power iterations to convergence have no SQL."""
    adj = places(spark, sf_dir).withColumn("w", F.lit(1.0))
    nodes = star.nodes(spark, sf_dir).where(F.col("node_type").isin("supplier", "nation", "region"))
    seeds = spark.createDataFrame([("supplier:1", 2.0), ("supplier:2", 1.0)], "id string, mass double")
    return composite.answer_pack(nodes, adj, seeds, rounds=25)


@query(
    f"""WITH {star.ORACLE_NODES}, {star.ORACLE_ADJ}, m AS MATERIALIZED (SELECT id, dense_rank() OVER (ORDER BY split_part(source_file, '/', 1)) AS community FROM nodes), deg AS MATERIALIZED (SELECT id, count(*) AS degree FROM adj GROUP BY id),
ends AS MATERIALIZED (SELECT a.community AS x, b.community AS y FROM adj JOIN m a ON a.id = adj.id JOIN m b ON b.id = adj.nbr WHERE adj.id < adj.nbr), ins AS (SELECT x AS community, count(*) AS pairs FROM ends WHERE x = y GROUP BY x), sized AS (SELECT community, count(*) AS size FROM m GROUP BY community),
coh AS (SELECT community, size, round(CASE WHEN size <= 1 THEN 1.0 ELSE coalesce(pairs, 0) / (size * (size - 1) / 2.0) END, 6) AS cohesion FROM sized LEFT JOIN ins USING (community)),
hubs AS (SELECT id FROM deg ORDER BY degree DESC, id LIMIT 5), e2 AS (SELECT src AS id FROM edges WHERE confidence = 'INFERRED' UNION ALL SELECT tgt FROM edges WHERE confidence = 'INFERRED')
SELECT * FROM (SELECT 'ambiguous_edge' AS kind, src || ' ' || tgt AS subject, relation AS detail FROM edges WHERE confidence = 'AMBIGUOUS' ORDER BY src, tgt, relation LIMIT 7)
UNION ALL SELECT 'verify_inferred', id, count(*)::VARCHAR FROM e2 WHERE id IN (SELECT id FROM hubs) GROUP BY id HAVING count(*) >= 2
UNION ALL SELECT * FROM (SELECT 'isolated_node', id, '' FROM nodes WHERE id NOT IN (SELECT id FROM deg WHERE degree > 1) ORDER BY id LIMIT 7)
UNION ALL SELECT * FROM (SELECT 'low_cohesion', community::VARCHAR, size::VARCHAR FROM coh WHERE cohesion < 0.15 AND size >= 5 ORDER BY cohesion, community LIMIT 7)"""
)
def f14_suggested_questions(spark, sf_dir):
    nodes, emissions = star.nodes(spark, sf_dir), star.emissions(spark, sf_dir)
    adj = build.adjacency(emissions)
    return composite.suggested_questions(nodes, build.merge_evidence(emissions), adj, analyze.cohesion(adj, by_folder(nodes)))


@query(
    r"""WITH p AS (SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN 'Mr. ' WHEN 1 THEN 'Mrs. ' ELSE '' END || p_name || CASE WHEN p_partkey % 5 = 0 THEN ' (wife)' ELSE '' END || ' ' || (p_partkey % 4) AS label, p_type AS kind FROM part),
w AS (SELECT *, list_filter(string_split(regexp_replace(regexp_replace(lower(label), '\([^)]*\)', ' ', 'g'), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '') AS t FROM p),
j AS (SELECT a.k AS l, b.k AS r, a.label AS la, b.label AS lb, len(list_intersect(a.t, b.t)) AS shared, list_filter(a.t, lambda x: regexp_matches(x, '[0-9]')) AS na, list_filter(b.t, lambda x: regexp_matches(x, '[0-9]')) AS nb FROM w a JOIN w b ON a.kind = b.kind AND b.k BETWEEN a.k + 1 AND a.k + 60)
SELECT l, r, CASE WHEN (la LIKE 'Mr. %' AND lb LIKE 'Mrs. %') OR (la LIKE 'Mrs. %' AND lb LIKE 'Mr. %') THEN 'opposite titles' WHEN shared > 0 AND (la LIKE '%(wife)%' OR lb LIKE '%(wife)%') THEN 'relative in parentheses'
  WHEN shared > 0 AND len(na) > 0 AND len(nb) > 0 AND NOT list_has_any(na, nb) THEN 'numbers differ' ELSE '' END AS reason FROM j"""
)
def i7_precision_guards(spark, sf_dir):
    k = F.col("p_partkey")
    title = F.when(k % 3 == 0, "Mr. ").when(k % 3 == 1, "Mrs. ").otherwise("")
    label = F.concat(title, "p_name", F.when(k % 5 == 0, " (wife)").otherwise(""), F.lit(" "), (k % 4).cast("string"))
    p = t(spark, sf_dir, "part").select(k.alias("k"), label.alias("label"), F.col("p_type").alias("kind"), F.explode(F.array(F.floor(k / 60), F.floor(k / 60) + 1)).alias("bin"))
    a = p.where(F.col("bin") == F.floor(F.col("k") / 60)).select(F.col("k").alias("l"), F.col("label").alias("la"), "kind", F.explode(F.array("bin", F.col("bin") + 1)).alias("bin"))
    b = p.where(F.col("bin") == F.floor(F.col("k") / 60)).select(F.col("k").alias("r"), F.col("label").alias("lb"), "kind", "bin")
    pairs = a.join(b, ["kind", "bin"]).where("r between l + 1 and l + 60")
    return pairs.select("l", "r", F.coalesce(composite.different_entities(F.col("la"), F.col("lb")), F.lit("")).alias("reason"))


@query(
    f"""WITH {_SUPPLY}, deg AS (SELECT id, count(*) AS d FROM sup GROUP BY id), inf AS MATERIALIZED (SELECT sup.* FROM sup JOIN deg ON deg.id = nbr WHERE d <= 50), own AS MATERIALIZED (SELECT id, count(*) AS n FROM inf GROUP BY id),
b AS MATERIALIZED (SELECT l.id AS a, r.id AS b, count(*) AS shared FROM inf l JOIN inf r ON l.nbr = r.nbr AND l.id < r.id GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT a AS "left", b AS "right", least(0.65, 0.5 + 0.05 + CASE WHEN shared >= 6 THEN 0.05 ELSE 0 END)::DOUBLE AS score FROM b JOIN own x ON x.id = a JOIN own y ON y.id = b
WHERE x.n >= 3 AND y.n >= 3 AND shared / (x.n + y.n - shared) >= 0.1 AND split_part(a, ':', 2)::INT % 3 <> split_part(b, ':', 2)::INT % 3 AND split_part(a, ':', 1) = split_part(b, ':', 1)"""
)
def i6_structural_matches(spark, sf_dir):
    adj = supply_adjacency(spark, sf_dir)
    pairs = resolve.structural_pairs(adj)
    same = pairs.where(F.substring_index("left", ":", 1) == F.substring_index("right", ":", 1))
    ids = adj.select("id").distinct()
    profiles = ids.select("id", F.array(F.substring_index("id", ":", 1)).alias("profile"))
    sources = ids.select("id", F.array((F.substring_index("id", ":", -1).cast("int") % 3).cast("string")).alias("sources"))
    direct = adj.select(F.col("id").alias("left"), F.col("nbr").alias("right"))
    return resolve.structural_matches(same, profiles, sources, direct, least=0.1)


@query(
    f"WITH {star.ORACLE_NODES}, c AS (SELECT * FROM (VALUES ('customer', 'party'), ('customer', 'zz'), ('supplier', 'party'), ('nation', 'place'), ('region', 'place')) v(t, class)), f AS (SELECT t, min(class) AS class FROM c GROUP BY t) SELECT class, count(*) AS n, min(id) AS first, max(id) AS last FROM nodes JOIN f ON t = node_type GROUP BY class"
)
def h19_class_members(spark, sf_dir):
    classes = spark.createDataFrame([("customer", "party"), ("customer", "zz"), ("supplier", "party"), ("nation", "place"), ("region", "place")], "type string, class string")
    return composite.class_members(star.nodes(spark, sf_dir), classes)[0]


@query(
    """WITH b AS (SELECT l_orderkey AS pr, CASE WHEN l_linenumber % 3 = 0 THEN 'old' ELSE 'h' || l_orderkey END AS sha, l_linenumber FROM lineitem), r AS (SELECT o_orderkey AS pr, 'h' || o_orderkey AS head FROM orders)
SELECT pr, count(*) AS rejected FROM b WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.pr = b.pr AND r.head = b.sha) GROUP BY pr"""
)
def d19_check_batch_join(spark, sf_dir):
    line = t(spark, sf_dir, "lineitem")
    sha = F.when(F.col("l_linenumber") % 3 == 0, "old").otherwise(F.concat(F.lit("h"), F.col("l_orderkey").cast("string")))
    requests = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pr"), F.concat(F.lit("h"), F.col("o_orderkey").cast("string")).alias("head"))
    rejected = composite.batch_join(line.select(F.col("l_orderkey").alias("pr"), sha.alias("sha")), requests)[1]
    return rejected.groupBy("pr").agg(F.count(F.lit(1)).alias("rejected"))


@query(
    """WITH m AS (SELECT o_custkey AS lot, epoch_us(o_orderdate) // 1000 + 86400000::BIGINT * 60 AS f, CASE WHEN l_linestatus = 'O' AND l_linenumber = 1 THEN NULL ELSE epoch_us(l_shipdate) // 1000 END AS d FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
s AS (SELECT lot, count(*) AS targets, count(*) FILTER (NOT d > f) AS on_time, count(*) FILTER (d > f) AS late, count(*) FILTER (d IS NULL) AS unknown FROM m GROUP BY lot)
SELECT *, CASE WHEN unknown > 0 THEN 'unknown' WHEN late > 0 THEN 'late' ELSE 'on time' END AS verdict FROM s"""
)
def e20_milestones(spark, sf_dir):
    j = t(spark, sf_dir, "lineitem").join(t(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    done = F.when(~((F.col("l_linestatus") == "O") & (F.col("l_linenumber") == 1)), star.epoch_ms("l_shipdate"))
    return composite.milestones(j.select(F.col("o_custkey").alias("lot"), (star.epoch_ms("o_orderdate") + 60 * 86_400_000).alias("forecast_ms"), done.alias("done_ms")))


@query(f"WITH {star.ORACLE_EDGES} SELECT 'part:17' AS id UNION SELECT 'part:18' UNION SELECT src FROM edges WHERE relation = 'CONTAINS' AND tgt IN ('part:17', 'part:18')")
def d20_relation_expansion(spark, sf_dir):
    changed = spark.createDataFrame([("part:17",), ("part:18",)], "id string")
    return composite.expand_by_relation(changed, star.emissions(spark, sf_dir), "CONTAINS")


@query(
    """WITH f AS (SELECT l_orderkey AS doc, 's' || (l_partkey % 200) AS span, l_linenumber AS start FROM lineitem), k AS (SELECT 's' || (p_partkey % 200) AS span, 'r' || (p_partkey % 70) AS record_id FROM part GROUP BY ALL)
SELECT record_id, count(DISTINCT doc) AS documents, count(*) AS mentions, min(doc) AS first FROM f JOIN k USING (span) GROUP BY record_id"""
)
def d25_occurrence_summary(spark, sf_dir):
    span = lambda c: F.concat(F.lit("s"), (F.col(c) % 200).cast("string"))
    found = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), span("l_partkey").alias("span"), F.col("l_linenumber").alias("start"))
    linked = t(spark, sf_dir, "part").select(span("p_partkey").alias("span"), F.concat(F.lit("r"), (F.col("p_partkey") % 70).cast("string")).alias("record_id")).distinct()
    return composite.occurrence_summary(found, linked)


@query("WITH c AS (SELECT sum(greatest(1, length(text) // 4))::BIGINT AS corpus_tokens FROM documents), a AS (SELECT avg(greatest(1, length(text) // 4)) AS answer_tokens FROM benchmark) SELECT corpus_tokens, round(answer_tokens, 4) AS answer_tokens, round(corpus_tokens / answer_tokens, 4) AS reduction FROM c, a")
def e22_token_reduction(spark, sf_dir):
    return composite.token_reduction(t(spark, sf_dir, "documents"), "text", t(spark, sf_dir, "benchmark").select(F.length("text").alias("chars")))


@query(
    f"""WITH {star.ORACLE_NODES}, {star.ORACLE_EMISSIONS} SELECT id AS subject, 'undeclared type' AS problem FROM nodes WHERE node_type IN ('region')
UNION ALL SELECT concat_ws(' ', src, relation, tgt), 'undeclared relation' FROM emissions WHERE relation IN ('PART_OF', 'LOCATED_IN') AND NOT (relation = 'LOCATED_IN' AND src LIKE 'customer:%')"""
)
def c16_profile_validation(spark, sf_dir):
    nodes = star.nodes(spark, sf_dir)
    declared = {"LOCATED_IN": ("customer", "nation"), "PLACED": ("customer", "order"), "CONTAINS": ("order", "part"), "SUPPLIED_BY": ("part", "supplier")}
    return composite.validate_profile(nodes, star.emissions(spark, sf_dir), ["nation", "customer", "supplier", "part", "order"], declared)


@query(
    f"WITH {_BM25}, line AS (SELECT query, doc_id, rank, 'all' AS list FROM ranked WHERE rank <= 10 UNION ALL SELECT query, doc_id, rank, 'head' FROM ranked WHERE rank <= 3) SELECT query, doc_id, round(sum(1 / (60 + rank)), 9) AS score FROM line GROUP BY query, doc_id"
)
def i2_fused_seeds(spark, sf_dir):
    hits = benchmark_bm25(spark, sf_dir)
    lists = hits.select("query", "doc_id", "rank").unionByName(hits.where("rank <= 3").select("query", "doc_id", "rank"))
    return lists.groupBy("query", "doc_id").agg(F.round(F.sum(1 / (60 + F.col("rank"))), 9).alias("score"))


@query(
    f"""WITH {star.ORACLE_NODES}, {star.ORACLE_ADJ}, ch AS (SELECT id FROM nodes WHERE source_file = 'catalog/brand12.json'), im AS (SELECT nbr AS id FROM adj WHERE id IN (SELECT id FROM ch) UNION SELECT id FROM ch), deg AS (SELECT id, count(*) AS d FROM adj GROUP BY id)
SELECT node_type, count(*) AS impacted, count(*) FILTER (d >= 50) AS hubs, count(DISTINCT source_file) AS files FROM im JOIN nodes USING (id) LEFT JOIN deg USING (id) GROUP BY node_type"""
)
def h12_review_delta(spark, sf_dir):
    nodes, adj = star.nodes(spark, sf_dir), build.adjacency(star.emissions(spark, sf_dir))
    near = review.impact_radius(nodes, adj, ["catalog/brand12.json"], 1)
    j = near.join(nodes, "id").join(analyze.degrees(adj), "id", "left")
    return j.groupBy("node_type").agg(F.count(F.lit(1)).alias("impacted"), F.count_if(F.col("degree") >= 50).alias("hubs"), F.countDistinct("source_file").alias("files"))


@query(f"WITH {_CALLS} SELECT id FROM fn WHERE id NOT IN (SELECT id FROM tested_by) AND source_file IN ('catalog/brand11.json', 'catalog/brand12.json')")
def h12_test_gaps(spark, sf_dir):
    functions, _, _, tested = call_graph(spark, sf_dir)
    changed = functions.where(F.col("source_file").isin("catalog/brand11.json", "catalog/brand12.json"))
    return changed.join(tested.select("id"), "id", "left_anti").select("id")


@query(
    f"""WITH {star.ORACLE_EDGES}, c AS (SELECT id, unnest(list_sort(list_distinct(list(rel)))) AS relation FROM (SELECT src AS id, relation AS rel FROM edges UNION ALL SELECT tgt, relation FROM edges) GROUP BY id)
SELECT relation, count(*) AS nodes FROM c GROUP BY relation"""
)
def c8_relation_filter(spark, sf_dir):
    ends = star.emissions(spark, sf_dir).select(F.explode(F.array("src", "tgt")).alias("id"), "relation").distinct()
    return ends.groupBy("relation").agg(F.count(F.lit(1)).alias("nodes"))


@query(
    """WITH n AS (SELECT event_id, user_id AS owner, event_type AS scope, epoch_us(ts) // 1000 AS t FROM events WHERE event_id % 13 <> 0) SELECT event_id, owner, scope FROM n WHERE (owner = 3 OR scope = 'signup') AND scope IN ('signup', 'view', 'click') AND t BETWEEN 1704500000000 AND 1705500000000"""
)
def c12_note_filter(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("owner"), F.col("event_type").alias("scope"), star.epoch_ms("ts").alias("t"))
    live = e.join(e.where("event_id % 13 = 0").select("event_id"), "event_id", "left_anti")
    return live.where("(owner = 3 or scope = 'signup') and scope in ('signup', 'view', 'click') and t between 1704500000000 and 1705500000000").select("event_id", "owner", "scope")


@query(
    """WITH o AS (SELECT 'order:' || l_orderkey AS id, 'supplier:' || l_suppkey AS member FROM lineitem), k AS (SELECT 'supplier:' || s_suppkey AS id FROM supplier WHERE s_suppkey % 7 <> 0) SELECT id FROM o GROUP BY id HAVING bool_and(member IN (SELECT id FROM k))"""
)
def d5_hyperedges_whole(spark, sf_dir):
    members = t(spark, sf_dir, "lineitem").select(star.node_id("order", "l_orderkey").alias("id"), star.node_id("supplier", "l_suppkey").alias("member"))
    kept = t(spark, sf_dir, "supplier").where("s_suppkey % 7 != 0").select(star.node_id("supplier", "s_suppkey").alias("id"))
    return relational.hyperedges_within(members, kept)
