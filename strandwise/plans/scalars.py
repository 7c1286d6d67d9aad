"""Queries on scalar functions, gates and small parsers."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandwise.functions import text as tx
from strandwise.operators import build, journal, temporal, timing
from strandwise.operators.search import cut_to_budget
from strandwise.plans.history import waits
from strandwise.plans.registry import register
from strandwise.sources import files, star

QUERIES, ORACLES, query = register()


def t(spark, sf_dir, name):
    return star.table(spark, sf_dir, name)


@query(
    """WITH e AS (SELECT event_id, epoch_us(ts) // 1000 AS a, lead(epoch_us(ts) // 1000, 3) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)
SELECT event_id, CASE WHEN b - a > 0 AND (b - a) % 1000 = 0 THEN (b - a) // 1000 ELSE -1 END AS seconds, CASE WHEN b IS NULL THEN 'missing' WHEN b - a < 0 THEN 'negative' WHEN b = a THEN 'zero' WHEN (b - a) % 1000 <> 0 THEN 'not whole seconds' ELSE '' END AS reason FROM e"""
)
def j13_durations(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("event_id", "user_id", "ts", star.epoch_ms("ts").alias("a"))
    b = e.withColumn("b", F.lead("a", 3).over(W.partitionBy("user_id").orderBy("ts", "event_id")))
    return b.select("event_id", F.coalesce(timing.whole_seconds(F.col("a"), F.col("b")), F.lit(-1)).alias("seconds"), F.coalesce(timing.duration_reason(F.col("a"), F.col("b")), F.lit("")).alias("reason"))


@query("SELECT o_orderkey, 'sha256:' || sha256(concat_ws('|', o_orderkey::VARCHAR, o_orderstatus, o_orderpriority)) AS digest, 'commit:repo:' || md5(o_orderkey::VARCHAR) AS commit_id FROM orders")
def j17_digests(spark, sf_dir):
    key = F.col("o_orderkey").cast("string")
    return t(spark, sf_dir, "orders").select(
        "o_orderkey", F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("|", key, "o_orderstatus", "o_orderpriority").cast("binary"), 256)).alias("digest"), F.concat(F.lit("commit:repo:"), F.md5(key.cast("binary"))).alias("commit_id")
    )


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_partkey ELSE -1 END::INTEGER AS start, CASE WHEN p_partkey % 4 = 0 THEN p_partkey + CASE WHEN p_partkey % 8 = 0 THEN p_size ELSE 0 END ELSE -1 END::INTEGER AS stop FROM part"""
)
def j19_line_ranges(spark, sf_dir):
    k = F.col("p_partkey")
    told = F.when(k % 8 == 0, F.concat(F.lit("L"), k.cast("string"), F.lit("-"), (k + F.col("p_size")).cast("string"))).when(k % 4 == 0, F.concat(F.lit("L"), k.cast("string"))).otherwise("none")
    r = t(spark, sf_dir, "part").select("p_partkey", tx.line_range(told).alias("r"))
    return r.select("p_partkey", F.coalesce("r.start", F.lit(-1)).alias("start"), F.coalesce("r.stop", F.lit(-1)).alias("stop"))


_SAID = ("validates", "Tests", "validatedBy", "imports", "extends", "inheritsFrom", "subclass of", "realizes", "implements-interface", " calls ", "  ")
_KEPT = ("TESTED_BY", "TESTED_BY", "TESTED_BY", "IMPORTS_FROM", "INHERITS", "INHERITS", "INHERITS", "IMPLEMENTS", "IMPLEMENTS", "CALLS", "RELATED_TO")


@query(
    f"""SELECT DISTINCT p_type, upper(regexp_replace(regexp_replace('is ' || p_type || 'Of', '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '[\\s-]+', '_', 'g')) AS relation,
([{", ".join(f"'{x}'" for x in _KEPT)}])[p_size % {len(_KEPT)} + 1] AS other FROM part"""
)
def j20_relation_names(spark, sf_dir):
    said = F.element_at(F.array(*map(F.lit, _SAID)), F.col("p_size") % len(_SAID) + 1)
    part = t(spark, sf_dir, "part")
    return part.select("p_type", tx.canonical_relation(F.concat(F.lit("is "), "p_type", F.lit("Of"))).alias("relation"), tx.canonical_relation(said).alias("other")).distinct()


@query("SELECT doc_id, trim(substr(text, greatest(1, 201 - 60), 120)) AS quote FROM documents")
def j25_quote_windows(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", tx.quote_window(F.col("text"), F.lit(200)).alias("quote"))


@query("SELECT page_id, CASE WHEN url LIKE '%.pdf' THEN 'paper' WHEN regexp_matches(lower(split_part(url, '/', -1)), '[.](py|ts|js|sql)$') THEN 'code' WHEN regexp_matches(lower(split_part(url, '/', -1)), '[.](md|txt|html)$') THEN 'document' ELSE '' END AS kind FROM pages")
def a2_file_classes(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", F.coalesce(files.classify(F.col("url")), F.lit("")).alias("kind"))


@query(
    "WITH d AS (SELECT p_brand AS doc, 10 * p_size AS start, 10 * p_size + p_partkey % 5 AS stop, p_partkey FROM part) SELECT doc, 'src/' || lower(doc) || '.py' AS file, start::INTEGER AS start, (start + greatest(p_partkey % 5, 1) - 1)::INTEGER AS stop FROM d"
)
def j18_diff_hunks(spark, sf_dir):
    part = t(spark, sf_dir, "part")
    head = part.select(F.col("p_brand").alias("doc"), F.lit(-1).cast("long").alias("no"), F.concat(F.lit("+++ b/src/"), F.lower("p_brand"), F.lit(".py")).alias("line")).distinct()
    hunk = F.concat(F.lit("@@ -1,2 +"), (10 * F.col("p_size")).cast("string"), F.lit(","), (F.col("p_partkey") % 5).cast("string"), F.lit(" @@"))
    return tx.parse_diff(head.unionByName(part.select(F.col("p_brand").alias("doc"), F.col("p_partkey").alias("no"), hunk.alias("line"))))


@query(
    """WITH w AS (SELECT o_orderpriority AS priority, date_diff('day', o_orderdate, l_shipdate) AS days FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT priority, count(*) AS n, CASE WHEN count(*) * 0.05 >= 5 THEN quantile_disc(days, 0.5) ELSE -1 END AS p50, CASE WHEN count(*) * 0.05 >= 5 THEN quantile_disc(days, 0.95) ELSE -1 END AS p95 FROM w GROUP BY priority"""
)
def e19_quantile_sets(spark, sf_dir):
    """Quantiles only where the sample supports its tail."""
    q = timing.nearest_rank(waits(spark, sf_dir), ["priority"], "days", {"p50": "0.5", "p95": "0.95"})
    ok = F.col("n") * 5 >= 5 * 100
    pick = lambda c: F.when(ok, F.col(c)).otherwise(F.lit(-1).cast("long")).alias(c)
    return q.select("priority", "n", pick("p50"), pick("p95"))


@query(
    f"""WITH {star.ORACLE_EMISSIONS}, a AS (SELECT src, tgt, relation, max(weight) AS weight, count(*) AS c FROM emissions WHERE source_file < '1996' OR relation <> 'CONTAINS' GROUP BY ALL), b AS (SELECT src, tgt, relation, max(weight) AS weight, count(*) AS c FROM emissions WHERE source_file >= '1995-06' AND relation = 'CONTAINS' GROUP BY ALL)
SELECT src, tgt, relation, greatest(max(a.weight), max(b.weight)) AS weight, greatest(coalesce(max(a.c), 0), coalesce(max(b.c), 0)) AS citations FROM a FULL JOIN b USING (src, tgt, relation) GROUP BY src, tgt, relation"""
)
def g8_merge_driver(spark, sf_dir):
    """A two-way union: the larger weight and count of either side."""
    e = star.emissions(spark, sf_dir)
    side = lambda df: df.groupBy(*build.EDGE_KEY).agg(F.max("weight").alias("weight"), F.count(F.lit(1)).alias("citations"))
    ours = side(e.where("source_file < '1996' or relation != 'CONTAINS'"))
    theirs = side(e.where("source_file >= '1995-06' and relation = 'CONTAINS'"))
    return ours.unionByName(theirs).groupBy(*build.EDGE_KEY).agg(F.max("weight").alias("weight"), F.max("citations").alias("citations"))


@query(
    """WITH q AS (SELECT c_custkey AS id, c_name AS label, c_acctbal AS score, c_mktsegment AS tier FROM customer), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS place FROM q WHERE tier IN ('BUILDING', 'MACHINERY') AND score >= 100 AND contains(lower(label), '1'))
SELECT id, place::INTEGER AS place FROM r WHERE place BETWEEN 51 AND 100"""
)
def c11_queue_page(spark, sf_dir):
    q = t(spark, sf_dir, "customer").where("c_mktsegment in ('BUILDING', 'MACHINERY') and c_acctbal >= 100").where(F.contains(F.lower("c_name"), F.lit("1")))
    return journal.page(q.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("score")), [F.desc("score"), F.col("id")], 50, 1).select("id", "place")


@query(
    """WITH u AS (SELECT user_id AS id, min(epoch_us(ts) // 1000) AS t, max(epoch_us(ts) // 1000) AS t_end, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY user_id)
SELECT id FROM u WHERE errors % 3 <> 0 AND t <= 1705000000000 AND t_end >= 1705000000000 AND id NOT IN (SELECT user_id FROM events WHERE event_id % 211 = 0)"""
)
def c15_projection_gate(spark, sf_dir):
    """Records that are eligible, valid now and not erased."""
    e = t(spark, sf_dir, "events").withColumn("ms", star.epoch_ms("ts"))
    u = e.groupBy(F.col("user_id").alias("id")).agg(F.min("ms").alias("t"), F.max("ms").alias("t_end"), F.count_if(F.col("event_type") == "error").alias("errors")).withColumn("has_t_end", F.lit(True))
    live = temporal.as_of(u.where("errors % 3 != 0"), 1_705_000_000_000)
    return live.join(e.where("event_id % 211 = 0").select(F.col("user_id").alias("id")), "id", "left_anti").select("id")


@query(
    r"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]+ [a-z]+')) AS span FROM documents), k AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Z][a-z]+ [a-z]+')) AS span FROM benchmark) SELECT doc_id, span, count(*) AS n FROM m WHERE span IN (SELECT span FROM k WHERE span <> '') GROUP BY doc_id, span"""
)
def d13_pattern_detection(spark, sf_dir):
    """Spans of a pattern that are members of a registry."""
    pattern = F.lit("[A-Z][a-z]+ [a-z]+")
    members = t(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", pattern, F.lit(0))).alias("span")).distinct()
    found = t(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", pattern, F.lit(0))).alias("span"))
    return found.join(members, "span", "left_semi").groupBy("doc_id", "span").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH c AS (SELECT conv_id, turn, text, sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn) AS used FROM conversations WHERE role = 'user') SELECT conv_id, count(*) AS turns FROM c WHERE used <= 3000 GROUP BY conv_id"""
)
def h3_budgeted_question(spark, sf_dir):
    user = t(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("line"))
    return cut_to_budget(user, "conv_id", "turn", 1000).groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"))


@query("SELECT event_id, least(greatest(value, -1e9), 1e9)::DECIMAL(27, 12)::VARCHAR AS weight FROM events WHERE abs(value) < 1e12")
def j22_decimal_weights(spark, sf_dir):
    v = F.col("value").cast("decimal(27,12)")
    return t(spark, sf_dir, "events").where("abs(value) < 1e12").select("event_id", v.cast("string").alias("weight"))


@query(
    """WITH s AS (SELECT o_custkey AS id, o_orderkey AS k, o_orderstatus AS st, o_orderpriority AS pr FROM orders) SELECT id, arg_min(st, k) AS first_status, arg_max(pr, k) AS last_priority, count(*) AS n FROM s GROUP BY id"""
)
def g5_simple_merge(spark, sf_dir):
    return t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.min_by("o_orderstatus", "o_orderkey").alias("first_status"), F.max_by("o_orderpriority", "o_orderkey").alias("last_priority"), F.count(F.lit(1)).alias("n"))


@query(
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN epoch_us(ts) // 1000 WHEN 1 THEN epoch_us(ts) // 1000 WHEN 2 THEN epoch_us(ts) // 1000 - 7200000 END AS millis FROM events"""
)
def j14_timestamps(spark, sf_dir):
    """Integers and times with a zone are instants; times without one, padded numbers and words aren't."""
    k, iso = F.col("event_id") % 6, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS")
    said = F.when(k == 0, star.epoch_ms("ts").cast("string")).when(k == 1, F.concat(iso, F.lit("Z"))).when(k == 2, F.concat(iso, F.lit("+02:00"))).when(k == 3, iso).when(k == 4, "007").otherwise("yesterday")
    return t(spark, sf_dir, "events").select("event_id", tx.parse_instant(said).alias("millis"))


@query(
    """SELECT o_orderkey, '{"a":{"z":"' || o_orderstatus || '","é":' || o_custkey || '},"k":[' || o_orderkey || ',null],"p":"' || o_orderpriority || '"}' AS canonical FROM orders"""
)
def j15_canonical_json(spark, sf_dir):
    """Keys sorted at every depth, whatever order they came in."""
    text = F.format_string('{"p": "%s", "k": [%d.0, null], "a": {"z": "%s", "é": %d}}', "o_orderpriority", "o_orderkey", "o_orderstatus", "o_custkey")
    return t(spark, sf_dir, "orders").select("o_orderkey", tx.canonical_json(text).alias("canonical"))


@query(
    """SELECT o_orderkey, 'commit:repo:local/' || o_orderstatus || '@' || md5(o_orderkey::VARCHAR) AS "commit", 'branch:repo:local/' || o_orderstatus || '#' || o_orderpriority AS branch, 'pr:repo:local/' || o_orderstatus || '#' || o_orderkey AS request FROM orders"""
)
def j27_ids(spark, sf_dir):
    repo = F.concat(F.lit("repo:local/"), "o_orderstatus")
    return t(spark, sf_dir, "orders").select(
        "o_orderkey", tx.commit_id(repo, F.md5(F.col("o_orderkey").cast("string").cast("binary"))).alias("commit"),
        tx.branch_id(repo, F.col("o_orderpriority")).alias("branch"), tx.request_id(repo, F.col("o_orderkey")).alias("request"),
    )
