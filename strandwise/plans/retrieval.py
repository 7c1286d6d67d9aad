"""Queries on text functions, retrieval, entity resolution and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandwise.functions import text as tx
from strandwise.operators import analyze, build, resolve, search, vector
from strandwise.plans.registry import register
from strandwise.sources import star

QUERIES, ORACLES, query = register()

_TERMS = r"list_filter(regexp_extract_all(lower(coalesce({0}, '')), '[\p{{L}}\p{{N}}_]+'), lambda w: NOT regexp_matches(w, '^[a-z]{{1,2}}$'))"
_STOP = "(" + ", ".join(f"'{w}'" for w in tx.STOPWORDS) + ")"


@query(f"SELECT doc_id, len({_TERMS.format('text')})::BIGINT AS n_terms, len(list_distinct({_TERMS.format('text')}))::BIGINT AS n_distinct FROM documents")
def j2_query_terms(spark, sf_dir):
    t = tx.query_terms(F.col("text"))
    return star.table(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("long").alias("n_terms"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


@query(
    f"""WITH t AS (SELECT item_id, {_TERMS.format('text')} AS t FROM benchmark), k AS (SELECT item_id, t, list_filter(t, lambda w: w NOT IN {_STOP}) AS kept FROM t)
SELECT item_id, array_to_string(CASE WHEN len(kept) > 0 THEN kept ELSE t END, ' ') AS terms FROM k"""
)
def j3_stopwords(spark, sf_dir):
    return star.table(spark, sf_dir, "benchmark").select("item_id", F.array_join(tx.drop_stopwords(tx.query_terms(F.col("text"))), " ").alias("terms"))


@query("SELECT item_id, lower(strip_accents(text)) AS folded FROM benchmark")
def j1_fold_accents(spark, sf_dir):
    return star.table(spark, sf_dir, "benchmark").select("item_id", tx.fold_accents("text").alias("folded"))


@query(r"SELECT page_id, regexp_replace(regexp_replace(lower(url), '[^\p{L}\p{N}]+', '_', 'g'), '^_+|_+$', '', 'g') AS node_id FROM pages")
def j8_node_id(spark, sf_dir):
    return star.table(spark, sf_dir, "pages").select("page_id", tx.node_id_part(F.col("url")).alias("node_id"))


@query(
    """SELECT page_id, substr(regexp_replace(html, '[\\x00-\\x1f\\x7f]', '', 'g'), 1, 256) AS label,
replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS escaped, greatest(1, length(html) // 4)::BIGINT AS tokens FROM pages"""
)
def j23_sanitise(spark, sf_dir):
    p = star.table(spark, sf_dir, "pages")
    return p.select("page_id", tx.clean_label(F.col("html")).alias("label"), tx.escape_html(F.col("html")).alias("escaped"), tx.token_estimate(F.col("html")).alias("tokens"))


@query(
    """WITH l AS (SELECT item_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no FROM benchmark)
SELECT item_id, no::INTEGER AS no, line FROM l WHERE trim(line) <> ''"""
)
def a13_source_lines(spark, sf_dir):
    return tx.parse_source(star.table(spark, sf_dir, "benchmark"), "item_id", "text").select("item_id", "no", "line")


@query(
    f"""WITH {star.ORACLE_NODES}
SELECT id FROM nodes WHERE node_type = 'part' AND (lower(label) LIKE '%' || split_part(lower(label), ' ', 1) || '%') AND source_file LIKE '%brand1%'"""
)
def c6_text_match(spark, sf_dir):
    n = star.nodes(spark, sf_dir).where("node_type = 'part'")
    label = F.lower("label")
    return n.where(tx.matches_all(F.concat_ws(" ", label, "source_file"), F.array(F.substring_index(label, " ", 1), F.lit("brand1")))).select("id")


@query(
    f"""WITH {star.ORACLE_NODES}, s AS (SELECT id, lower(label) AS l, lower(source_file) AS f FROM nodes)
SELECT id, CASE WHEN l = 'nation 1' THEN 100 WHEN l LIKE 'nation 1 %' OR l LIKE '% nation 1' THEN 20 ELSE 0 END + CASE WHEN f = 'nation 1' THEN 40 WHEN f LIKE '%/nation 1' THEN 10 ELSE 0 END
  + (CASE WHEN contains(l, 'nation') THEN 1 ELSE 0 END + CASE WHEN contains(l, '1') THEN 1 ELSE 0 END)::DOUBLE + 0.5::DOUBLE * (CASE WHEN contains(f, 'nation') THEN 1 ELSE 0 END + CASE WHEN contains(f, '1') THEN 1 ELSE 0 END) AS score FROM s"""
)
def j4_search_score(spark, sf_dir):
    terms = F.array(F.lit("nation"), F.lit("1"))
    return star.nodes(spark, sf_dir).select("id", tx.search_score(F.lower("label"), F.lower("source_file"), terms).cast("double").alias("score"))


_POSTINGS = f"""tok AS (SELECT doc_id, 'label' AS field, unnest({_TERMS.format("coalesce(source, '') || ' ' || coalesce(lang, '')")}) AS term FROM documents UNION ALL SELECT doc_id, 'description', unnest({_TERMS.format('text')}) FROM documents),
post AS (SELECT doc_id, term, field, count(*) AS tf FROM tok GROUP BY ALL)"""


def doc_fields() -> dict:
    return {"label": F.concat(F.coalesce("source", F.lit("")), F.lit(" "), F.coalesce("lang", F.lit(""))), "description": F.col("text")}


@query(f"WITH {_POSTINGS} SELECT term, field, count(DISTINCT doc_id) AS df, sum(tf)::BIGINT AS tf FROM post GROUP BY term, field")
def e6_bm25_index(spark, sf_dir):
    p = search.postings(star.table(spark, sf_dir, "documents"), "doc_id", doc_fields())
    return p.groupBy("term", "field").agg(F.countDistinct("doc_id").alias("df"), F.sum("tf").alias("tf"))


_BM25 = f"""{_POSTINGS},
len AS (SELECT doc_id, 'label' AS field, len({_TERMS.format("coalesce(source, '') || ' ' || coalesce(lang, '')")}) AS length FROM documents UNION ALL SELECT doc_id, 'description', len({_TERMS.format('text')}) FROM documents),
mean AS (SELECT field, avg(length) AS mean, count(*) AS n FROM len GROUP BY field),
q AS (SELECT DISTINCT item_id AS query, unnest({_TERMS.format('text')}) AS term FROM benchmark),
hits AS (SELECT * FROM post WHERE term IN (SELECT term FROM q)), df AS (SELECT term, count(DISTINCT doc_id) AS df FROM hits GROUP BY term),
sat AS (SELECT doc_id, term, max(n) AS n, sum((CASE field WHEN 'label' THEN 3.0::DOUBLE ELSE 1.5::DOUBLE END) * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / CASE WHEN mean > 0 THEN mean ELSE 1 END)))) AS sat FROM hits JOIN len USING (doc_id, field) JOIN mean USING (field) GROUP BY doc_id, term),
each AS (SELECT doc_id, term, greatest(0.0::DOUBLE, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))) * sat AS s FROM sat JOIN df USING (term)),
scored AS (SELECT query, doc_id, round(sum(s), 6) AS score FROM q JOIN each USING (term) WHERE s > 0 GROUP BY query, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS rank FROM scored)"""


def benchmark_bm25(spark, sf_dir):
    q = star.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.explode(tx.query_terms(F.col("text"))).alias("term")).distinct()
    return search.bm25_top(star.table(spark, sf_dir, "documents"), q, "doc_id", doc_fields(), 10)


@query(f"WITH {_BM25} SELECT query, doc_id, score, rank::INTEGER AS rank FROM ranked WHERE rank <= 10")
def f2_bm25_top_hits(spark, sf_dir):
    return benchmark_bm25(spark, sf_dir)


_LISTS = " UNION ALL ".join(
    f"SELECT p_type, '{c}' AS list, p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY {c} DESC, p_partkey) AS rank FROM part" for c in ("p_retailprice", "p_size", "p_name")
)


@query(f"WITH lists AS ({_LISTS}) SELECT p_type, p_partkey, round(sum(1 / (60 + rank)), 9) AS score FROM lists GROUP BY p_type, p_partkey")
def f1_rank_fusion(spark, sf_dir):
    part, lists = star.table(spark, sf_dir, "part"), None
    for c in ("p_retailprice", "p_size", "p_name"):
        w = W.partitionBy("p_type").orderBy(F.desc(c), "p_partkey")
        one = part.select("p_type", F.lit(c).alias("list"), "p_partkey", F.row_number().over(w).alias("rank"))
        lists = one if lists is None else lists.unionByName(one)
    return search.fuse(lists, ["p_type"], "p_partkey").select("p_type", "p_partkey", F.round("score", 9).alias("score"))


@query(
    f"""WITH {star.ORACLE_EDGES}, w AS (SELECT least(src, tgt) AS a, greatest(src, tgt) AS b, sum(coalesce(weight, CASE confidence WHEN 'EXTRACTED' THEN 1.0 WHEN 'INFERRED' THEN 0.6 ELSE 0.3 END)) AS w FROM edges WHERE src <> tgt GROUP BY 1, 2)
SELECT a AS id, b AS nbr, w::DOUBLE AS w FROM w UNION ALL SELECT b, a, w::DOUBLE FROM w"""
)
def i1_weighted_adjacency(spark, sf_dir):
    return search.weighted_adjacency(build.merge_evidence(star.emissions(spark, sf_dir)))


@query(
    f"""WITH {star.ORACLE_NODES}, tok AS (SELECT DISTINCT id, unnest({_TERMS.format("label || ' ' || replace(source_file, '/', ' ')")}) AS token FROM nodes),
pairs AS (SELECT token, asked FROM (SELECT DISTINCT token FROM tok), (SELECT unnest(['brand1', 'supplier', 'geo', '7']) AS asked) WHERE token = asked OR (length(asked) >= 3 AND contains(token, asked)))
SELECT id, count(DISTINCT asked) AS score FROM tok JOIN pairs USING (token) GROUP BY id"""
)
def f18_workspace_search(spark, sf_dir):
    n = star.nodes(spark, sf_dir)
    tokens = n.select("id", F.explode(tx.query_terms(F.concat_ws(" ", "label", F.replace("source_file", F.lit("/"), F.lit(" "))))).alias("token")).distinct()
    return search.workspace_search(n, tokens, ["brand1", "supplier", "geo", "7"])


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no FROM documents),
r AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY no) AS used FROM l) SELECT doc_id, count(*) AS kept, max(used)::BIGINT AS used FROM r WHERE used <= 600 GROUP BY doc_id"""
)
def f13_budgeted_lines(spark, sf_dir):
    cut = star.table(spark, sf_dir, "documents").select("doc_id", search.leading_lines(F.col("text"), 200).alias("cut"))
    return cut.select("doc_id", "cut.kept", "cut.used").where("kept > 0")


_PARTS = r"""parts AS (SELECT 'part:' || p_partkey AS id, p_type AS type, list_filter(string_split(regexp_replace(regexp_replace(lower(p_name), '\([^)]*\)', ' ', 'g'), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda t: t <> '') AS tokens FROM part)"""


def part_names(spark, sf_dir):
    return star.table(spark, sf_dir, "part").select(star.node_id("part", "p_partkey").alias("id"), F.col("p_type").alias("type"), resolve.name_tokens(F.col("p_name")).alias("tokens"))


@query(
    f"""WITH {_PARTS}, d AS (SELECT id, type, list_sort(list_distinct(tokens)) AS t FROM parts),
one AS (SELECT id, type, unnest(t) AS token, len(t) AS n FROM d),
keyed AS (SELECT id, type, token AS key FROM one WHERE n < 2 UNION SELECT a.id, a.type, a.token || ' ' || b.token FROM one a JOIN one b ON a.id = b.id AND a.token < b.token)
SELECT DISTINCT l.id AS "left", r.id AS "right" FROM keyed l JOIN keyed r ON l.type = r.type AND l.key = r.key AND l.id < r.id"""
)
def d14_blocked_pairs(spark, sf_dir):
    return resolve.block_pairs(part_names(spark, sf_dir))


@query(
    f"""WITH {_PARTS}, j AS (SELECT l.id AS a, r.id AS b, l.tokens AS x, r.tokens AS y, len(list_intersect(l.tokens, r.tokens)) AS inter, len(list_distinct(l.tokens || r.tokens)) AS either, least(len(list_distinct(l.tokens)), len(list_distinct(r.tokens))) AS small,
  list_filter(list_distinct(l.tokens || r.tokens), lambda t: NOT (list_contains(l.tokens, t) AND list_contains(r.tokens, t))) AS rest FROM parts l JOIN parts r ON l.type = r.type AND l.id < r.id AND len(list_intersect(l.tokens, r.tokens)) >= 2),
o AS (SELECT *, len(list_filter(rest, lambda t: NOT (regexp_matches(t, '^[0-9]+$') OR length(t) = 1 OR (length(t) <= 4 AND regexp_matches(t, '^(x{{0,3}})(ix|iv|v?i{{0,3}})$'))))) AS solid,
  len(list_filter(x || y, lambda t: regexp_matches(t, '^[0-9]+$') OR length(t) = 1 OR (length(t) <= 4 AND regexp_matches(t, '^(x{{0,3}})(ix|iv|v?i{{0,3}})$')))) AS ordinals FROM j)
SELECT a AS "left", b AS "right", CASE WHEN x = y THEN 0.9 WHEN inter = small THEN 0.75 ELSE 0.7 END::DOUBLE AS score FROM o
WHERE len(x) >= 2 AND len(y) >= 2 AND NOT (inter > 0 AND len(rest) > 0 AND solid = 0) AND NOT (x <> y AND len(x) = len(y) AND inter = small AND ordinals > 0) AND (x = y OR inter = small OR inter / either >= 0.6)"""
)
def i5_fuzzy_matches(spark, sf_dir):
    return resolve.fuzzy_matches(part_names(spark, sf_dir))


@query(
    """WITH t AS (SELECT 'customer:' || c_custkey AS id, c_mktsegment AS type, 'n' || (c_custkey % 700) AS term, true AS is_label FROM customer UNION ALL SELECT 'customer:' || c_custkey, c_mktsegment, 'n' || (c_custkey * 7 % 1100), false FROM customer)
SELECT l.id AS "left", r.id AS "right", max(CASE WHEN l.is_label AND r.is_label THEN 1.0 ELSE 0.85 END)::DOUBLE AS score FROM t l JOIN t r ON l.type = r.type AND l.term = r.term AND l.id < r.id GROUP BY 1, 2"""
)
def i4_exact_matches(spark, sf_dir):
    c = star.table(spark, sf_dir, "customer")
    term = lambda x: F.concat(F.lit("n"), x.cast("string"))
    one = lambda x, label: c.select(star.node_id("customer", "c_custkey").alias("id"), F.col("c_mktsegment").alias("type"), term(x).alias("term"), F.lit(label).alias("is_label"))
    return resolve.exact_matches(one(F.col("c_custkey") % 700, True).unionByName(one(F.col("c_custkey") * 7 % 1100, False)))


_SUPPLY = "sup AS (SELECT DISTINCT 'supplier:' || l_suppkey AS id, 'part:' || l_partkey AS nbr FROM lineitem UNION SELECT DISTINCT 'part:' || l_partkey, 'supplier:' || l_suppkey FROM lineitem)"


def supply_adjacency(spark, sf_dir):
    line = star.table(spark, sf_dir, "lineitem")
    a, b = star.node_id("supplier", "l_suppkey"), star.node_id("part", "l_partkey")
    return line.select(a.alias("id"), b.alias("nbr")).unionByName(line.select(b.alias("id"), a.alias("nbr"))).distinct()


@query(
    f"""WITH {_SUPPLY}, deg AS (SELECT id, count(*) AS d FROM sup GROUP BY id), inf AS (SELECT sup.* FROM sup JOIN deg ON deg.id = nbr WHERE d <= 50), own AS (SELECT id, count(*) AS n FROM inf GROUP BY id),
b AS (SELECT l.id AS a, r.id AS b, count(*) AS shared FROM inf l JOIN inf r ON l.nbr = r.nbr AND l.id < r.id GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT a AS "left", b AS "right", shared, round(shared / (x.n + y.n - shared), 6) AS jaccard FROM b JOIN own x ON x.id = a JOIN own y ON y.id = b WHERE x.n >= 3 AND y.n >= 3"""
)
def d15_structural_pairs(spark, sf_dir):
    return resolve.structural_pairs(supply_adjacency(spark, sf_dir))


_REGISTRY = "reg AS (SELECT 'r' || p_partkey AS record_id, lower(split_part(p_name, ' ', 1)) || ' ' || (p_partkey % 300) AS key, true AS is_label FROM part UNION ALL SELECT 'r' || p_partkey, lower(split_part(p_name, ' ', 2)) || ' ' || (p_partkey % 450), false FROM part)"


@query(
    f"""WITH {_REGISTRY}, spans AS (SELECT DISTINCT key AS span FROM reg UNION SELECT 'x ' || p_partkey FROM part),
h AS (SELECT span, list_sort(list(DISTINCT record_id) FILTER (is_label)) AS labels, list_sort(list(DISTINCT record_id) FILTER (NOT is_label)) AS aliases FROM spans JOIN reg ON span = key GROUP BY span),
f AS (SELECT span, CASE WHEN len(labels) > 0 THEN labels ELSE coalesce(aliases, []) END AS found FROM spans LEFT JOIN h USING (span))
SELECT span, CASE WHEN len(found) = 1 THEN 'linked' WHEN len(found) > 1 THEN 'ambiguous' ELSE 'unlinked' END AS resolution, CASE WHEN len(found) = 1 THEN found[1] END AS record_id, len(found)::BIGINT AS n FROM f"""
)
def d11_registry_linking(spark, sf_dir):
    part = star.table(spark, sf_dir, "part")
    word = lambda k: F.lower(F.coalesce(F.get(F.split("p_name", " "), F.lit(k)), F.lit("")))
    key = lambda k, m: F.concat(word(k), F.lit(" "), (F.col("p_partkey") % m).cast("string"))
    rid = F.concat(F.lit("r"), F.col("p_partkey").cast("string"))
    registry = part.select(rid.alias("record_id"), key(0, 300).alias("key"), F.lit(True).alias("is_label")).unionByName(part.select(rid.alias("record_id"), key(1, 450).alias("key"), F.lit(False).alias("is_label")))
    spans = registry.select(F.col("key").alias("span")).unionByName(part.select(F.concat(F.lit("x "), F.col("p_partkey").cast("string")).alias("span")))
    return resolve.link(spans, registry)


@query()
def d12_lexicon_detection(spark, sf_dir):
    """Hits of the test items' first two words in all texts; the items are the registry."""
    items = star.table(spark, sf_dir, "benchmark").select(F.lower(F.array_join(F.slice(F.split("text", r"\s+"), 1, 2), " ")).alias("term"))
    return resolve.detect_lexicon(star.table(spark, sf_dir, "documents"), items.where("length(term) > 4"), "doc_id")


@query(
    """WITH s AS (SELECT a.vec_id AS query, b.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query, vec_id, score, rank::INTEGER AS rank FROM r WHERE rank <= 10"""
)
def f15_vector_top_k(spark, sf_dir):
    rows = star.table(spark, sf_dir, "embeddings")
    return vector.top_k(rows, rows.where("vec_id % 50 = 0"))


@query(
    f"""WITH {star.ORACLE_NODES}, {star.ORACLE_ADJ}, deg AS (SELECT id, count(*) AS degree FROM adj GROUP BY id),
s AS (SELECT id, lower(label) AS l, t FROM nodes, (SELECT unnest(['brown', 'nation']) AS t)), hits AS (SELECT id, t AS term, CASE WHEN l = t THEN 101 WHEN l LIKE t || ' %' OR l LIKE '% ' || t THEN 21 ELSE 1 END AS score FROM s WHERE contains(l, t)),
best AS (SELECT id FROM (SELECT id, sum(score) AS score FROM hits GROUP BY id) ORDER BY score DESC, id LIMIT 3),
each AS (SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY term ORDER BY score DESC, coalesce(degree, 0) DESC, id) AS rn FROM hits LEFT JOIN deg USING (id)) WHERE rn = 1)
SELECT id, max(why) AS why FROM (SELECT id, 'top' AS why FROM best UNION ALL SELECT id, 'term' FROM each) GROUP BY id"""
)
def f7_seed_picking(spark, sf_dir):
    n = star.nodes(spark, sf_dir)
    label, t = F.lower("label"), F.col("term")
    hits = n.select("id", "label", F.explode(F.array(F.lit("brown"), F.lit("nation"))).alias("term")).where(F.contains(label, t))
    scored = hits.select("id", "term", tx.search_score(label, F.lit(""), F.array(t)).alias("score"))
    total = scored.groupBy("id").agg(F.sum("score").alias("score"))
    return search.pick_seeds(total, scored, analyze.degrees(build.adjacency(star.emissions(spark, sf_dir))))
