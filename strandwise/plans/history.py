"""Queries on intervals, journals and timing."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandwise.operators import journal, temporal, timing
from strandwise.plans.registry import register
from strandwise.sources import star

QUERIES, ORACLES, query = register()

LOW, HIGH, AT = 1_704_800_000_000, 1_705_200_000_000, 1_705_000_000_000
_OVERLAP = "t <= {1} AND (NOT has_t_end OR t_end >= {0})"
_LINKS = """links AS (
  SELECT id AS src, lead(id) OVER (PARTITION BY owner ORDER BY t, id) AS tgt, 'NEXT' AS relation, t, t_end, has_t_end FROM intervals)"""


def links(spark, sf_dir):
    """Each event and its user's next one, over the first one's interval."""
    by = W.partitionBy("owner").orderBy("t", "id")
    rows = star.intervals(spark, sf_dir)
    return rows.select(F.col("id").alias("src"), F.lead("id").over(by).alias("tgt"), F.lit("NEXT").alias("relation"), "t", "t_end", "has_t_end").where("tgt is not null")


@query(f"WITH {star.ORACLE_INTERVALS} SELECT id, owner, kind, t, t_end FROM intervals WHERE {_OVERLAP.format(LOW, HIGH)}")
def d4_interval_overlap(spark, sf_dir):
    return temporal.window(star.intervals(spark, sf_dir), LOW, HIGH).select("id", "owner", "kind", "t", "t_end")


@query(
    f"""WITH {star.ORACLE_INTERVALS}, {_LINKS}, kept AS (SELECT id FROM intervals WHERE {_OVERLAP.format(LOW, HIGH)})
SELECT src, tgt FROM links WHERE tgt IS NOT NULL AND {_OVERLAP.format(LOW, HIGH)} AND src IN (SELECT id FROM kept) AND tgt IN (SELECT id FROM kept)"""
)
def d5_time_slice(spark, sf_dir):
    rows = star.intervals(spark, sf_dir)
    hyper = rows.select(F.col("owner").alias("id"), F.col("id").alias("member"))
    return temporal.time_slice(rows, links(spark, sf_dir), hyper, LOW, HIGH)[1].select("src", "tgt")


@query(
    f"""WITH {star.ORACLE_INTERVALS}, kept AS (SELECT id FROM intervals WHERE {_OVERLAP.format(0, AT)})
SELECT concat_ws(':', owner, kind, (t // 86400000)::VARCHAR) AS id, count(*) AS members FROM intervals GROUP BY 1 HAVING bool_and(id IN (SELECT id FROM kept))"""
)
def d5_hyperedge_slice(spark, sf_dir):
    rows = star.intervals(spark, sf_dir)
    hyper = rows.select(F.concat_ws(":", "owner", "kind", F.floor(F.col("t") / 86_400_000).cast("string")).alias("id"), F.col("id").alias("member"))
    kept = temporal.time_slice(rows, links(spark, sf_dir), hyper, 0, AT)[2]
    return kept.groupBy("id").agg(F.count(F.lit(1)).alias("members"))


@query(f"WITH {star.ORACLE_INTERVALS} SELECT id, owner, kind, t FROM intervals WHERE {_OVERLAP.format(AT, AT)}")
def d6_recall_as_of(spark, sf_dir):
    return temporal.as_of(star.intervals(spark, sf_dir), AT).select("id", "owner", "kind", "t")


@query(
    f"""WITH {star.ORACLE_INTERVALS}, {_LINKS}, dead AS (SELECT id FROM intervals WHERE kind = 'error')
SELECT src, tgt FROM links WHERE tgt IS NOT NULL AND src NOT IN (SELECT id FROM dead) AND tgt NOT IN (SELECT id FROM dead) AND NOT (src LIKE '%7')"""
)
def d3_tombstones(spark, sf_dir):
    rows, edges = star.intervals(spark, sf_dir), links(spark, sf_dir)
    dead = rows.where("kind = 'error'").select("id")
    cut = edges.where("src like '%7'").select("src", "tgt", "relation")
    return temporal.without_tombstones(rows, edges, dead, cut)[1].select("src", "tgt")


@query(f"WITH {star.ORACLE_INTERVALS} SELECT id, t FROM intervals WHERE split_part(id, ':', 2)::BIGINT <= 5000 AND {_OVERLAP.format(AT, AT)}")
def d8_bitemporal(spark, sf_dir):
    rows = star.intervals(spark, sf_dir).withColumn("cursor", F.substring_index("id", ":", -1).cast("long"))
    return temporal.visible(rows, AT, 5000).select("id", "t")


_SLACK = 6 * 3_600_000


@query(
    f"""WITH {star.ORACLE_INTERVALS}, s AS (SELECT id, owner, t AS start, t + 600000 AS stop FROM intervals WHERE kind = 'signup'),
p AS (SELECT id AS point_id, owner, t AS moment FROM intervals WHERE kind = 'purchase'),
j AS (SELECT s.id, p.point_id, p.moment, CASE WHEN moment < start THEN start - moment WHEN moment > stop THEN moment - stop ELSE 0 END AS distance FROM s JOIN p USING (owner) WHERE moment BETWEEN start - {_SLACK} AND stop + {_SLACK}),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, moment DESC, point_id) AS rn FROM j)
SELECT id, point_id, distance::BIGINT AS distance FROM r WHERE rn = 1"""
)
def d26_nearest_match(spark, sf_dir):
    rows = star.intervals(spark, sf_dir)
    sessions = rows.where("kind = 'signup'").select("id", "owner", F.col("t").alias("start"), (F.col("t") + 600_000).alias("stop"))
    points = rows.where("kind = 'purchase'").select(F.col("id").alias("point_id"), "owner", F.col("t").alias("at"))
    return temporal.nearest(sessions, points, ["owner"], _SLACK)


@query(
    """WITH c AS (SELECT DISTINCT p_brand AS file, (l_linenumber * 10)::BIGINT AS start, (l_linenumber * 10 + l_quantity % 4)::BIGINT AS stop FROM lineitem JOIN part ON l_partkey = p_partkey),
s AS (SELECT p_brand AS file, p_partkey AS id, (p_partkey % 97)::BIGINT AS line_start, (p_partkey % 97 + p_size)::BIGINT AS line_end FROM part)
SELECT id, count(*) AS hits FROM c JOIN s USING (file) WHERE line_start <= stop AND line_end >= start GROUP BY id"""
)
def d9_line_overlap(spark, sf_dir):
    part, line = star.table(spark, sf_dir, "part"), star.table(spark, sf_dir, "lineitem")
    changes = line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_brand").alias("file"), (F.col("l_linenumber") * 10).cast("long").alias("start"), (F.col("l_linenumber") * 10 + F.col("l_quantity") % 4).cast("long").alias("stop")
    )
    spans = part.select(F.col("p_brand").alias("file"), F.col("p_partkey").alias("id"), (F.col("p_partkey") % 97).alias("line_start"), (F.col("p_partkey") % 97 + F.col("p_size")).alias("line_end"))
    return temporal.line_overlap(changes.distinct(), spans).groupBy("id").agg(F.count(F.lit(1)).alias("hits"))


@query(
    """WITH a AS (SELECT DISTINCT regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages), b AS (SELECT DISTINCT substr(path, strpos(path, '/') + 1) AS other FROM a WHERE strpos(path, '/') > 0)
SELECT path, other FROM a, b WHERE path = other OR path LIKE '%/' || other OR other LIKE '%/' || path"""
)
def d10_suffix_paths(spark, sf_dir):
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    left = star.table(spark, sf_dir, "pages").select(path.alias("path")).distinct()
    right = left.where(F.instr("path", "/") > 0).select(F.expr("substr(path, instr(path, '/') + 1)").alias("other"))
    return temporal.path_matches(left, right)


_JOURNAL = """journal AS (
  SELECT event_id AS cursor, 'e' || event_id AS event_id, 'user:' || user_id AS record_id,
    CASE WHEN event_type IN ('signup', 'purchase') THEN 'accepted_current' WHEN event_type = 'error' AND event_id % 97 = 0 THEN 'tombstoned' ELSE 'historical' END AS to_state,
    md5('e' || event_id) AS event_hash, CASE WHEN event_id % 1000 = 7 THEN 'lost' ELSE md5('e' || (event_id - 1)) END AS previous_event_hash
  FROM events)"""


def events_as_journal(spark, sf_dir):
    e = star.table(spark, sf_dir, "events")
    name = F.concat(F.lit("e"), F.col("event_id").cast("string"))
    before = F.concat(F.lit("e"), (F.col("event_id") - 1).cast("string"))
    state = (
        F.when(F.col("event_type").isin("signup", "purchase"), journal.CURRENT)
        .when((F.col("event_type") == "error") & (F.col("event_id") % 97 == 0), journal.DEAD)
        .otherwise("historical")
    )
    return e.select(
        F.col("event_id").alias("cursor"), name.alias("event_id"), star.node_id("user", "user_id").alias("record_id"), state.alias("to_state"),
        F.md5(name.cast("binary")).alias("event_hash"), F.when(F.col("event_id") % 1000 == 7, "lost").otherwise(F.md5(before.cast("binary"))).alias("previous_event_hash"),
    )


_FOLD = """SELECT record_id, CASE WHEN bool_or(to_state = 'tombstoned') THEN 'tombstoned' ELSE arg_max(to_state, cursor) END AS state, max(cursor) AS cursor, bool_or(to_state = 'tombstoned') AS terminal, count(*) AS n_events FROM journal"""


@query(f"WITH {_JOURNAL} {_FOLD} GROUP BY record_id")
def k9_journal_fold(spark, sf_dir):
    twice = events_as_journal(spark, sf_dir)
    return journal.fold(journal.first_copies(twice.unionByName(twice.where("cursor % 5 = 0"))))


_RUNS = """marked AS (SELECT *, to_state = 'accepted_current' AND NOT coalesce(bool_or(to_state = 'tombstoned') OVER (PARTITION BY record_id ORDER BY cursor ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS is_on FROM journal),
turns AS (SELECT * FROM (SELECT *, coalesce(lag(is_on) OVER (PARTITION BY record_id ORDER BY cursor), false) AS was FROM marked) WHERE is_on <> was),
runs AS (SELECT record_id, cursor AS accepted_cursor, lead(cursor) OVER (PARTITION BY record_id ORDER BY cursor) - 1 AS last_current_cursor, is_on FROM turns)"""


@query(f"WITH {_JOURNAL}, {_RUNS} SELECT record_id, accepted_cursor, last_current_cursor FROM runs WHERE is_on")
def f11_currentness(spark, sf_dir):
    return journal.currentness(events_as_journal(spark, sf_dir))


@query(
    f"""WITH {_JOURNAL}, thin AS (SELECT * FROM journal WHERE cursor % 501 <> 3), j AS (SELECT a.cursor, a.previous_event_hash, b.event_hash FROM thin a LEFT JOIN thin b ON b.cursor = a.cursor - 1 WHERE a.cursor > (SELECT min(cursor) FROM thin))
SELECT cursor, CASE WHEN event_hash IS NULL THEN 'gap' ELSE 'broken link' END AS problem FROM j WHERE event_hash IS NULL OR event_hash <> previous_event_hash"""
)
def f12_hash_chain(spark, sf_dir):
    return journal.chain_breaks(events_as_journal(spark, sf_dir).where("cursor % 501 != 3"))


_RECORDS = "records AS (SELECT owner AS record_id, min(t) AS t, max(t) AS t_end, count(*) % 3 > 0 AS has_t_end FROM intervals GROUP BY owner)"


def user_records(spark, sf_dir):
    return star.intervals(spark, sf_dir).groupBy(F.col("owner").alias("record_id")).agg(F.min("t").alias("t"), F.max("t").alias("t_end"), (F.count(F.lit(1)) % 3 > 0).alias("has_t_end"))


@query(
    f"""WITH {star.ORACLE_INTERVALS}, {_JOURNAL}, {_RECORDS}, f AS ({_FOLD} WHERE cursor <= 6000 GROUP BY record_id)
SELECT record_id, t, t_end FROM records WHERE record_id IN (SELECT record_id FROM f WHERE state = 'accepted_current') AND {_OVERLAP.format(AT, AT)}"""
)
def k10_accepted_snapshot(spark, sf_dir):
    return journal.snapshot(events_as_journal(spark, sf_dir), user_records(spark, sf_dir), AT, 6000).select("record_id", "t", "t_end")


@query(
    """WITH b AS (SELECT 'part:' || l_partkey AS record_id, CASE l_returnflag WHEN 'N' THEN 'add' WHEN 'R' THEN 'remove' ELSE CASE WHEN l_orderkey % 11 = 0 THEN 'tombstone' ELSE 'add' END END AS action, l_orderkey * 10 + l_linenumber AS cursor FROM lineitem)
SELECT record_id, CASE WHEN bool_or(action = 'tombstone') THEN 'tombstone' ELSE arg_max(action, cursor) END AS action, max(cursor) AS cursor FROM b GROUP BY record_id"""
)
def k11_projection_batches(spark, sf_dir):
    line = star.table(spark, sf_dir, "lineitem")
    action = F.when(F.col("l_returnflag") == "N", "add").when(F.col("l_returnflag") == "R", "remove").when(F.col("l_orderkey") % 11 == 0, "tombstone").otherwise("add")
    return journal.projection_fold(line.select(star.node_id("part", "l_partkey").alias("record_id"), action.alias("action"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("cursor")))


@query(
    """WITH d AS (SELECT user_id AS axis, max(event_id) AS doubt FROM events WHERE event_type = 'error' GROUP BY 1), c AS (SELECT user_id AS axis, max(event_id) AS start FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT DISTINCT user_id AS axis, start IS NOT NULL AND start > coalesce(doubt, -1) AS current FROM events LEFT JOIN d ON d.axis = user_id LEFT JOIN c ON c.axis = user_id"""
)
def k3_axis_certification(spark, sf_dir):
    e = star.table(spark, sf_dir, "events")
    doubts = e.where("event_type = 'error'").select(F.col("user_id").alias("axis"), F.col("event_id").alias("seq"))
    done = e.where("event_type = 'purchase'").select(F.col("user_id").alias("axis"), F.col("event_id").alias("start_seq"))
    return journal.certify(e.select(F.col("user_id").alias("axis")).distinct(), doubts, done)


_WAIT = "wait AS (SELECT o_orderpriority AS priority, date_diff('day', o_orderdate, l_shipdate) AS days, l_quantity::DECIMAL(18, 6) AS w FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"
_SHARES = {"p50": "0.5", "p80": "0.8", "p95": "0.95"}


def waits(spark, sf_dir):
    line, orders = star.table(spark, sf_dir, "lineitem"), star.table(spark, sf_dir, "orders")
    return line.join(orders, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderpriority").alias("priority"), F.date_diff("l_shipdate", "o_orderdate").cast("long").alias("days"), F.col("l_quantity").alias("w")
    )


@query(f"WITH {_WAIT} SELECT priority, count(*) AS n, quantile_disc(days, 0.5) AS p50, quantile_disc(days, 0.8) AS p80, quantile_disc(days, 0.95) AS p95, max(days) AS max FROM wait GROUP BY priority")
def e16_nearest_rank(spark, sf_dir):
    return timing.nearest_rank(waits(spark, sf_dir), ["priority"], "days", _SHARES)


@query(
    f"""WITH {_WAIT}, s AS (SELECT priority, days, sum(w) AS w FROM wait GROUP BY ALL), r AS (SELECT *, sum(w) OVER (PARTITION BY priority ORDER BY days) AS upto, sum(w) OVER (PARTITION BY priority) AS total FROM s)
SELECT priority, min(days) FILTER (upto * 2 >= total) AS p50, min(days) FILTER (upto * 5 >= total * 4) AS p80, min(days) FILTER (upto * 20 >= total * 19) AS p95 FROM r GROUP BY priority"""
)
def e17_weighted_ecdf(spark, sf_dir):
    return timing.weighted_ecdf(waits(spark, sf_dir), ["priority"], "days", "w", _SHARES)


@query(f"WITH {_WAIT} SELECT priority, round(sum(w)::DOUBLE * sum(w)::DOUBLE / sum(w * w)::DOUBLE, 6) AS n_eff, sum(w)::DOUBLE * sum(w)::DOUBLE / sum(w * w)::DOUBLE * 0.05 >= 5 AS tail_ok FROM wait GROUP BY priority")
def e18_effective_size(spark, sf_dir):
    return timing.effective_size(waits(spark, sf_dir), ["priority"], "w")


@query(
    """WITH c AS (SELECT l_orderkey AS pr, CASE WHEN l_returnflag = 'N' THEN 'success' WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN 'failure' WHEN l_returnflag = 'A' AND l_linenumber = 2 THEN 'queued' ELSE 'stale' END AS c FROM lineitem),
s AS (SELECT pr, count(*) AS checks_total, count(*) FILTER (c = 'success') AS checks_passed, count(*) FILTER (c = 'failure') AS checks_failed, count(*) FILTER (c = 'queued') AS checks_pending, count(*) FILTER (c = 'stale') AS checks_other FROM c GROUP BY pr)
SELECT *, CASE WHEN checks_failed > 0 THEN 'FAILURE' WHEN checks_pending > 0 THEN 'PENDING' WHEN checks_other > 0 THEN 'MIXED' ELSE 'SUCCESS' END AS checks_conclusion FROM s"""
)
def e14_check_rollup(spark, sf_dir):
    flag, no = F.col("l_returnflag"), F.col("l_linenumber")
    c = F.when(flag == "N", "success").when((flag == "R") & (no == 1), "failure").when((flag == "A") & (no == 2), "queued").otherwise("stale")
    return timing.check_rollup(star.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pr"), c.alias("conclusion")), ["pr"])


@query(
    """WITH s AS (SELECT l_orderkey AS pr, epoch_us(o_orderdate) // 1000 AS a, epoch_us(l_shipdate) // 1000 AS b FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate > o_orderdate AND (epoch_us(l_shipdate) // 1000 - epoch_us(o_orderdate) // 1000) % 1000 = 0)
SELECT pr, (max(b) - min(a)) // 1000 AS envelope_seconds, sum((b - a) // 1000)::BIGINT AS service_seconds FROM s GROUP BY pr"""
)
def e15_ci_envelope(spark, sf_dir):
    line, orders = star.table(spark, sf_dir, "lineitem"), star.table(spark, sf_dir, "orders")
    spans = line.join(orders, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("l_orderkey").alias("pr"), star.epoch_ms("o_orderdate").alias("start_ms"), star.epoch_ms("l_shipdate").alias("end_ms"))
    return timing.ci_envelope(spans, ["pr"])


@query(
    """WITH g AS (SELECT DISTINCT lang, doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 0), r AS (SELECT DISTINCT lang, doc_id FROM documents JOIN labels USING (doc_id) WHERE length(text) - length(translate(text, '#*$%&|<>', '')) > 20),
j AS (SELECT coalesce(g.lang, r.lang) AS lang, g.doc_id AS a, r.doc_id AS b FROM g FULL JOIN r ON g.lang = r.lang AND g.doc_id = r.doc_id),
s AS (SELECT lang, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS true_positive, count(*) FILTER (a IS NULL) AS false_positive, count(*) FILTER (b IS NULL) AS false_negative FROM j GROUP BY lang)
SELECT *, round(CASE WHEN true_positive + false_positive > 0 THEN true_positive / (true_positive + false_positive) END, 6) AS precision,
  round(CASE WHEN true_positive + false_negative > 0 THEN true_positive / (true_positive + false_negative) END, 6) AS recall,
  round(CASE WHEN 2 * true_positive + false_positive + false_negative > 0 THEN 2 * true_positive / (2 * true_positive + false_positive + false_negative) END, 6) AS f1 FROM s"""
)
def e21_evaluation(spark, sf_dir):
    docs, labels = star.table(spark, sf_dir, "documents"), star.table(spark, sf_dir, "labels")
    seen = docs.join(labels, "doc_id")
    return timing.precision_recall(seen.where("quality = 0"), seen.where("length(text) - length(translate(text, '#*$%&|<>', '')) > 20"), ["doc_id"], ["lang"])
