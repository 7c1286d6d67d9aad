"""Queries on relational operators over records."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandwise.operators import analyze, build, journal, relational, resolve, search
from strandwise.operators.iterate import ranked
from strandwise.plans.construction import by_folder
from strandwise.plans.registry import register
from strandwise.sources import star

QUERIES, ORACLES, query = register()


def t(spark, sf_dir, name):
    return star.table(spark, sf_dir, name)


@query(
    f"""WITH {star.ORACLE_NODES}, {star.ORACLE_EDGES}, x AS (SELECT src AS node, 'out' AS direction, relation, tgt AS id FROM edges WHERE src IN ('part:1', 'supplier:1', 'nation:3') UNION ALL SELECT tgt, 'in', relation, src FROM edges WHERE tgt IN ('part:1', 'supplier:1', 'nation:3'))
SELECT node, direction, relation, id, label FROM x JOIN nodes USING (id)"""
)
def d2_neighbours(spark, sf_dir):
    edges = build.merge_evidence(star.emissions(spark, sf_dir))
    return relational.neighbours(edges, star.nodes(spark, sf_dir), ["part:1", "supplier:1", "nation:3"])


@query("SELECT doc_id, regexp_replace(source, '\\\\', '/', 'g') || '/' || lang AS path FROM documents")
def c2_paths(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.concat(F.replace("source", F.lit("\\"), F.lit("/")), F.lit("/"), "lang").alias("path"))


@query(
    f"""WITH {star.ORACLE_NODES} SELECT id, source_file = '' OR NOT contains(split_part(source_file, '/', -1), '.') AS is_concept, source_file LIKE '%.json' AND lower(label) IN ('name', 'id', 'type') AS is_key,
CASE WHEN source_file LIKE '%.py' OR source_file LIKE '%.ts' OR source_file LIKE '%.sql' THEN 'code' ELSE 'doc' END AS category, split_part(source_file, '/', 1) AS area FROM nodes"""
)
def c4_node_predicates(spark, sf_dir):
    source = F.col("source_file")
    return star.nodes(spark, sf_dir).select("id", analyze.is_concept_node().alias("is_concept"), analyze.is_json_key_node().alias("is_key"), analyze.file_category(source).alias("category"), analyze.top_dir(source).alias("area"))


@query(f"WITH {star.ORACLE_EDGES} SELECT src, tgt, relation FROM edges WHERE confidence = 'EXTRACTED' AND contains(lower(relation), 'suppl')")
def c13_strong_edges(spark, sf_dir):
    edges = build.merge_evidence(star.emissions(spark, sf_dir))
    return edges.where((F.col("confidence") == "EXTRACTED") & F.contains(F.lower("relation"), F.lit("suppl"))).select("src", "tgt", "relation")


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 0")
def c7_facet_filter(spark, sf_dir):
    chosen = {"c_mktsegment": "BUILDING", "c_nationkey": "all"}
    kept = t(spark, sf_dir, "customer").where("c_acctbal >= 0")
    for field, value in chosen.items():
        if value != "all":
            kept = kept.where(F.col(field) == value)
    return kept.select("c_custkey", "c_name")


@query("SELECT event_type, count(*) AS n FROM events WHERE event_id % 13 <> 0 GROUP BY event_type")
def e5_group_counts(spark, sf_dir):
    e = t(spark, sf_dir, "events").withColumn("id", F.col("event_id"))
    return relational.group_counts(e, "event_type", e.where("event_id % 13 = 0").select("id"))


_CITED = """cited AS (SELECT 'part:' || l_partkey AS node, 'm' || strftime(l_shipdate, '%Y-%m') AS source_file, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_linenumber::VARCHAR END AS page, CASE WHEN l_linenumber > 4 THEN l_returnflag END AS section, NULL::VARCHAR AS paragraph FROM lineitem),
u AS (SELECT DISTINCT node, source_file, coalesce(page, '') AS page, coalesce(section, '') AS section, '' AS paragraph FROM cited)"""


def cited(spark, sf_dir):
    no = F.col("l_linenumber")
    return t(spark, sf_dir, "lineitem").select(
        star.node_id("part", "l_partkey").alias("node"), F.concat(F.lit("m"), F.date_format("l_shipdate", "yyyy-MM")).alias("source_file"),
        F.when(no % 3 != 0, no.cast("string")).alias("page"), F.when(no > 4, F.col("l_returnflag")).alias("section"), F.lit(None).cast("string").alias("paragraph"),
    )


@query(f"WITH {_CITED} SELECT node, count(*) AS citations FROM u GROUP BY node")
def e9_citation_union(spark, sf_dir):
    return relational.union_citations(cited(spark, sf_dir)).groupBy("node").agg(F.count(F.lit(1)).alias("citations"))


@query(
    f"""WITH {_CITED}, n AS (SELECT *, row_number() OVER (PARTITION BY node, source_file ORDER BY page, section, paragraph) AS nth FROM u),
r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY CASE WHEN nth = 1 THEN 0 WHEN page <> '' OR section <> '' THEN 1 ELSE 2 END, source_file, page, section, paragraph) AS rank FROM n)
SELECT node, rank::INTEGER AS rank, source_file, page, section, paragraph FROM r WHERE rank <= 5"""
)
def f8_top_citations(spark, sf_dir):
    return relational.top_citations(cited(spark, sf_dir), 5)


@query(
    """WITH m AS (SELECT 'order:' || l_orderkey AS id, l_linenumber AS ordinal, 'supplier:' || l_suppkey AS member FROM lineitem), f AS (SELECT id, member, min(ordinal) AS first_at FROM m GROUP BY id, member)
SELECT id, string_agg(member, ',' ORDER BY first_at, member) AS members FROM f GROUP BY id"""
)
def e13_hyperedge_merge(spark, sf_dir):
    m = t(spark, sf_dir, "lineitem").select(star.node_id("order", "l_orderkey").alias("id"), F.col("l_linenumber").alias("ordinal"), star.node_id("supplier", "l_suppkey").alias("member"))
    return relational.merge_hyperedges(m).select("id", F.array_join("members", ",").alias("members"))


@query(
    """WITH a AS (SELECT o_orderkey AS id, o_custkey AS k, CASE o_orderstatus WHEN 'F' THEN 'true' WHEN 'O' THEN 'false' ELSE 'unknown' END AS status, epoch_us(o_orderdate) // 1000 AS moment FROM orders)
SELECT l.id AS "left", r.id AS "right", CASE WHEN l.status <> 'unknown' AND r.status <> 'unknown' THEN 'contradicts' WHEN l.status <> 'unknown' THEN CASE WHEN l.moment > r.moment THEN 'left_supersedes_right' ELSE 'needs_adjudication' END
  ELSE CASE WHEN r.moment > l.moment THEN 'right_supersedes_left' ELSE 'needs_adjudication' END END AS relation FROM a l JOIN a r ON l.k = r.k AND l.id < r.id AND l.status <> r.status"""
)
def d24_assertion_pairs(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "true").when(F.col("o_orderstatus") == "O", "false").otherwise("unknown")
    a = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("k"), status.alias("status"), star.epoch_ms("o_orderdate").alias("at"))
    return relational.pair_assertions(a, ["k"])


@query(
    f"WITH {star.ORACLE_EDGES}, e AS (SELECT src AS id, 'out:' || relation AS p FROM edges UNION SELECT tgt, 'in:' || relation FROM edges) SELECT id, string_agg(p, ',' ORDER BY p) AS profile FROM e GROUP BY id"
)
def e23_relation_profiles(spark, sf_dir):
    return relational.relation_profiles(star.emissions(spark, sf_dir)).select("id", F.array_join("profile", ",").alias("profile"))


@query(
    r"""WITH tok AS (SELECT DISTINCT p_partkey AS id, unnest(list_filter(string_split(regexp_replace(lower(p_name), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '')) AS token FROM part)
SELECT token, count(*) AS df, round(ln((SELECT count(DISTINCT id) FROM tok) / count(*)), 6) AS idf FROM tok GROUP BY token"""
)
def e12_token_idf(spark, sf_dir):
    return relational.token_idf(t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.explode(resolve.name_tokens(F.col("p_name"))).alias("token")))


@query(
    """WITH d AS (SELECT DISTINCT p_type AS k, p_brand || '/' || p_size AS file FROM part), s AS (SELECT k, count(*) AS files FROM d GROUP BY k), r AS (SELECT *, row_number() OVER (ORDER BY files DESC, k) AS rank, count(*) OVER () AS groups FROM s),
n AS (SELECT k, CASE WHEN groups <= 4 OR rank < 4 THEN k ELSE 'overflow:mixed' END AS kept FROM r) SELECT kept AS k, count(DISTINCT file) AS files FROM d JOIN n USING (k) GROUP BY kept"""
)
def e25_commit_groups(spark, sf_dir):
    d = t(spark, sf_dir, "part").select(F.col("p_type").alias("k"), F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("file"))
    return relational.group_with_overflow(d, "k", 4)


@query(
    """WITH c AS (SELECT l_suppkey, p_brand, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL) SELECT l_suppkey, p_brand FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, p_brand) AS rn FROM c) WHERE rn = 1"""
)
def e25_dominant_value(spark, sf_dir):
    rows = t(spark, sf_dir, "lineitem").join(t(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    return relational.dominant(rows, "l_suppkey", "p_brand")


@query(
    """WITH RECURSIVE n AS MATERIALIZED (SELECT p_partkey AS id, p_brand AS community FROM part), o AS MATERIALIZED (SELECT p_partkey AS id, p_size % 17 * 2 AS previous FROM part WHERE p_partkey % 5 <> 0),
b AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY n DESC, previous, community) AS rn FROM (SELECT community, previous, count(*) AS n FROM n JOIN o USING (id) GROUP BY ALL)),
g AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS olds, []::VARCHAR[] AS news UNION ALL
  SELECT i + 1, CASE WHEN list_contains(olds, previous) OR list_contains(news, community) THEN olds ELSE list_append(olds, previous) END,
    CASE WHEN list_contains(olds, previous) OR list_contains(news, community) THEN news ELSE list_append(news, community) END FROM g JOIN b ON rn = i + 1),
m AS (SELECT unnest(news) AS community, unnest(olds) AS number FROM g WHERE i = (SELECT max(i) FROM g)),
fresh AS (SELECT community, row_number() OVER (ORDER BY count(*) DESC, min(id)) AS place FROM n WHERE community NOT IN (SELECT community FROM m) GROUP BY community),
free AS (SELECT number, row_number() OVER (ORDER BY number) AS place FROM range(100) r(number) WHERE number NOT IN (SELECT number FROM m))
SELECT community, number::BIGINT AS number FROM m UNION ALL SELECT community, number::BIGINT FROM fresh JOIN free USING (place)"""
)
def d17_community_remap(spark, sf_dir):
    part = t(spark, sf_dir, "part")
    new = part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("community"))
    old = part.where("p_partkey % 5 != 0").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 17 * 2).alias("community"))
    return relational.remap_communities(new, old)


@query(
    f"""WITH {star.ORACLE_NODES}, m AS (SELECT id, dense_rank() OVER (ORDER BY split_part(source_file, '/', 1)) AS community FROM nodes)
SELECT id, CASE WHEN community = 2 THEN 'customers' ELSE 'Community ' || community END AS label FROM m"""
)
def d22_community_labels(spark, sf_dir):
    known = spark.createDataFrame([(2, "customers")], "community long, name string")
    m = by_folder(star.nodes(spark, sf_dir)).join(known, "community", "left")
    return m.select("id", F.coalesce("name", F.concat(F.lit("Community "), F.col("community").cast("string"))).alias("label"))


@query(
    f"""WITH {star.ORACLE_NODES}, raw AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'prt:' || p_partkey ELSE 'part:' || p_partkey END AS id, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_name END AS label, p_brand AS brand FROM part UNION ALL SELECT 'prt:' || p_partkey, p_type, NULL FROM part WHERE p_partkey % 2 = 0),
c AS (SELECT CASE WHEN id LIKE 'prt:%' THEN 'part' || substr(id, 4) ELSE id END AS new_id, * FROM raw)
SELECT new_id AS id, arg_min(label, (id, label)) FILTER (coalesce(label, '') <> '') AS label, arg_min(brand, (id, brand)) FILTER (coalesce(brand, '') <> '') AS brand FROM c GROUP BY new_id"""
)
def g9_schema_hygiene(spark, sf_dir):
    part, k = t(spark, sf_dir, "part"), F.col("p_partkey")
    third = k % 3 == 0
    a = part.select(F.concat(F.when(third, "prt:").otherwise("part:"), k.cast("string")).alias("id"), F.when(~third, F.col("p_name")).alias("label"), F.col("p_brand").alias("brand"))
    b = part.where(k % 2 == 0).select(F.concat(F.lit("prt:"), k.cast("string")).alias("id"), F.col("p_type").alias("label"), F.lit(None).cast("string").alias("brand"))
    return relational.schema_hygiene(a.unionByName(b), {"prt": "part"})


@query(
    f"""WITH {star.ORACLE_NODES}, u AS (SELECT *, 1 AS o, 'a' AS repo FROM nodes WHERE node_type IN ('nation', 'region', 'supplier') UNION ALL SELECT id, upper(label), node_type, source_file, 2, 'b' FROM nodes WHERE node_type IN ('nation', 'customer'))
SELECT id, arg_max(label, o) AS label, arg_max(repo, o) AS repo FROM u GROUP BY id"""
)
def g7_multi_repo_merge(spark, sf_dir):
    n = star.nodes(spark, sf_dir)
    a = n.where(F.col("node_type").isin("nation", "region", "supplier")).withColumns({"ordinal": F.lit(1), "repo": F.lit("a")})
    b = n.where(F.col("node_type").isin("nation", "customer")).withColumns({"label": F.upper("label"), "ordinal": F.lit(2), "repo": F.lit("b")})
    return build.merge_nodes(a.unionByName(b)).select("id", "label", "repo")


@query(
    """WITH c AS (SELECT 'd' || doc_id AS path, n_chars AS mtime, md5(text) AS hash FROM documents WHERE doc_id % 11 <> 0), m AS (SELECT 'd' || doc_id AS path, CASE WHEN doc_id % 5 = 0 THEN n_chars + 1 ELSE n_chars END AS mtime, CASE WHEN doc_id % 10 = 0 THEN 'old' ELSE md5(text) END AS hash FROM documents WHERE doc_id % 7 <> 0)
SELECT coalesce(c.path, m.path) AS path, CASE WHEN c.path IS NULL THEN 'deleted' WHEN m.path IS NULL THEN 'new' WHEN c.mtime = m.mtime OR c.hash = m.hash THEN 'unchanged' ELSE 'changed' END AS change FROM c FULL JOIN m ON c.path = m.path"""
)
def a3_incremental_scan(spark, sf_dir):
    d, k = t(spark, sf_dir, "documents"), F.col("doc_id")
    path, digest = F.concat(F.lit("d"), k.cast("string")), F.md5(F.col("text").cast("binary"))
    current = d.where(k % 11 != 0).select(path.alias("path"), F.col("n_chars").alias("mtime"), digest.alias("hash"))
    manifest = d.where(k % 7 != 0).select(path.alias("path"), F.when(k % 5 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("mtime"), F.when(k % 10 == 0, "old").otherwise(digest).alias("hash"))
    return relational.incremental(current, manifest)


@query(
    "SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'user') AS user_turns, count(*) FILTER (role = 'assistant') AS assistant_turns, coalesce(sum(length(text)), 0)::BIGINT AS chars, min(turn) AS first_turn, max(turn) AS last_turn FROM conversations GROUP BY conv_id"
)
def e26_session_aggregates(spark, sf_dir):
    return relational.session_aggregates(t(spark, sf_dir, "conversations"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS content_key FROM documents WHERE sha256(coalesce(text, '')) NOT IN (SELECT sha256(coalesce(text, '')) FROM documents WHERE lang = 'fr')")
def a16_cache_split(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    key = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    keyed = d.select("doc_id", "lang", key.alias("content_key"))
    return keyed.join(keyed.where("lang = 'fr'").select("content_key").distinct(), "content_key", "left_anti").select("doc_id", "content_key")


@query(
    f"""WITH {star.ORACLE_NODES}, {star.ORACLE_EDGES}, a AS (SELECT count(*) AS n, sum(('0x' || substr(sha256(id), 1, 15))::BIGINT::HUGEINT) AS hn FROM nodes), b AS (SELECT count(*) AS e, sum(('0x' || substr(sha256(src || '|' || tgt || '|' || relation), 1, 15))::BIGINT::HUGEINT) AS he FROM edges)
SELECT n, e, 'sha256:' || sha256('topo/2;n=' || n || ';e=' || e || ';' || hn || '|' || he) AS signature FROM a, b"""
)
def j16_topology_signature(spark, sf_dir):
    return relational.topology_signature(star.nodes(spark, sf_dir), star.emissions(spark, sf_dir).select("src", "tgt", "relation").distinct())


@query(
    """WITH r AS (SELECT 'user:' || user_id AS record_id, max(epoch_us(ts) // 1000) AS t_end, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY count(*) DESC, 'user:' || user_id)) AS score FROM events GROUP BY user_id),
s AS (SELECT record_id, exp(-ln(2.0::DOUBLE) * greatest(0, 1709000000000 - least(1709000000000, t_end)) / 2592000000.0::DOUBLE) AS recency, score / max(score) OVER () AS share FROM r)
SELECT record_id, round(0.85::DOUBLE * share + 0.15::DOUBLE * recency, 6) AS score, round(recency, 6) AS recency FROM s ORDER BY 0.85::DOUBLE * share + 0.15::DOUBLE * recency DESC, recency DESC, record_id LIMIT 2000"""
)
def f9_recall_ranking(spark, sf_dir):
    e = t(spark, sf_dir, "events").groupBy(star.node_id("user", "user_id").alias("record_id")).agg(F.max(star.epoch_ms("ts")).alias("t_end"), F.count(F.lit(1)).alias("n"))
    fused = search.fuse(ranked(e, F.desc("n"), "record_id").select("record_id", "rank"), [], "record_id")
    return journal.recall(fused, e.select("record_id", "t_end"), 1_709_000_000_000)


@query("SELECT o_orderkey, place::INTEGER AS place FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place BETWEEN 201 AND 300")
def f10_pagination(spark, sf_dir):
    return journal.page(t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 100, 2).select("o_orderkey", "place")


@query(
    f"""WITH {star.ORACLE_NODES}, {star.ORACLE_ADJ}, d AS (SELECT n.node_type, a.id, count(*) AS degree FROM adj a JOIN nodes n USING (id) GROUP BY n.node_type, a.id)
SELECT node_type, count(*) AS n_nodes, sum(degree)::BIGINT AS ends, round(avg(degree), 4) AS mean_degree, arg_max(id, (degree, id)) AS top_hub FROM d GROUP BY node_type"""
)
def e11_focus_metrics(spark, sf_dir):
    deg = analyze.degrees(build.adjacency(star.emissions(spark, sf_dir))).join(star.nodes(spark, sf_dir).select("id", "node_type"), "id")
    return deg.groupBy("node_type").agg(
        F.count(F.lit(1)).alias("n_nodes"), F.sum("degree").alias("ends"), F.round(F.avg("degree"), 4).alias("mean_degree"), F.max(F.struct("degree", "id"))["id"].alias("top_hub")
    )
