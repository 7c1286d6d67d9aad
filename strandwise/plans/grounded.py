"""Queries that ground, compare and attribute whole texts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strandwise.functions import surface
from strandwise.operators import grounding, lineage, linking, projection, revisions
from strandwise.operators.iterate import shared_folder
from strandwise.plans.registry import register
from strandwise.sources import star

QUERIES, ORACLES, query = register()


def item_nodes(spark, sf_dir):
    """Benchmark items as concepts: the first three words name them, the last two are an alias, the middle is their rationale."""
    w = F.split(F.trim("text"), r"\s+")
    middle = F.array_join(F.slice(w, 4, 8), " ")
    return star.table(spark, sf_dir, "benchmark").where("trim(text) != ''").select(
        F.concat(F.lit("item:"), F.col("item_id").cast("string")).alias("id"),
        F.lit("concept").alias("node_type"),
        F.array_join(F.slice(w, 1, 3), " ").alias("label"),
        F.array(F.array_join(F.slice(w, F.greatest(F.lit(1), F.size(w) - 1), 2), " ")).alias("aliases"),
        F.concat(F.lit("“"), middle, F.lit("”")).alias("rationale"),
    )


def document_sources(spark, sf_dir):
    return star.table(spark, sf_dir, "documents").select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("source"), "text")


@query()
def i10_citation_grounding(spark, sf_dir):
    return grounding.ground(item_nodes(spark, sf_dir), document_sources(spark, sf_dir))[0]


def document_history(spark, sf_dir):
    """(tree, blobs, parents), a blob for each file of each commit: five commits over all documents, made of their lines by the first digit of their digests.

    c0 lacks the lines of digits 0 to 3; c1 has those of 0 and 1, c2 those of 2
    and 3; c3 merges both; c4 repeats the first line at the end.
    """
    docs = star.table(spark, sf_dir, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.split(F.coalesce("text", F.lit("")), "\n").alias("l"))
    without = lambda digits: F.filter("l", lambda x: ~F.substring(F.md5(x.cast("binary")), 1, 1).isin(*digits))
    versions = {"c0": without("0123"), "c1": without("23"), "c2": without("01"), "c3": F.col("l"), "c4": F.concat("l", F.slice("l", 1, 1))}
    each = F.array(*[F.struct(F.lit(c).alias("commit"), F.array_join(F.transform(v, lambda x: F.concat(x, F.lit("\n"))), "").alias("text")) for c, v in versions.items()])
    files = docs.select("path", F.inline(each)).withColumn("oid", F.sha2(F.col("text").cast("binary"), 256))
    parents = spark.createDataFrame([("c1", "c0", 0), ("c2", "c0", 0), ("c3", "c1", 0), ("c3", "c2", 1), ("c4", "c3", 0)], "commit string, parent string, nth int")
    return files.select("commit", "path", "oid"), files.select("oid", "text"), parents


_LINES = "lines AS (SELECT 'doc/' || doc_id AS path, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS no FROM documents)"


@query(
    f"""WITH {_LINES}, origins AS (
  SELECT path, CASE WHEN substr(md5(line), 1, 1) IN ('0', '1') THEN 'c1' WHEN substr(md5(line), 1, 1) IN ('2', '3') THEN 'c2' ELSE 'c0' END AS origin FROM lines
  UNION ALL SELECT DISTINCT path, 'c4' FROM lines)
SELECT path, origin, count(*)::BIGINT AS n_lines FROM origins GROUP BY ALL"""
)
def k16_line_attribution(spark, sf_dir):
    tree, blobs, parents = document_history(spark, sf_dir)
    found = revisions.attribute_lines(tree, blobs, parents)
    return found.where("commit = 'c4'").groupBy("path", "origin").agg(F.count(F.lit(1)).alias("n_lines"))


@query(
    f"""WITH {_LINES}, counted AS (
  SELECT path, count(*) + 1 - count(*) FILTER (substr(md5(line), 1, 1) NOT IN ('0', '1', '2', '3')) AS added,
    string_agg(line || chr(10), '' ORDER BY no) || min(line || chr(10)) FILTER (no = 0) AS applied FROM lines GROUP BY path)
SELECT path, added::BIGINT AS added, 0::BIGINT AS removed, sha256(applied) AS applied_sha256 FROM counted"""
)
def k16_text_diffs(spark, sf_dir):
    tree, blobs, _ = document_history(spark, sf_dir)
    blobs = blobs.dropDuplicates(["oid"])
    side = lambda c, name: tree.where(F.col("commit") == c).join(blobs, "oid").select("path", F.col("text").alias(name))
    found = revisions.text_diffs(side("c0", "old").join(side("c4", "new"), "path"))
    count = lambda sign: F.size(F.filter(F.flatten(F.transform("hunks", lambda h: h["lines"])), lambda x: F.startswith(x, F.lit(sign)))).cast("long")
    return found.select("path", count("+").alias("added"), count("-").alias("removed"), F.sha2(F.col("applied").cast("binary"), 256).alias("applied_sha256"))


@query(
    f"""WITH {_LINES}, versions AS (
  SELECT path, coalesce(sha256(string_agg(line || chr(10), '' ORDER BY no) FILTER (substr(md5(line), 1, 1) NOT IN ('0', '1', '2', '3'))), sha256('')) AS a,
    sha256(string_agg(line || chr(10), '' ORDER BY no)) AS b FROM lines GROUP BY path)
SELECT path, 'modified' AS status FROM versions WHERE a <> b"""
)
def k16_file_changes(spark, sf_dir):
    tree, _, _ = document_history(spark, sf_dir)
    at = lambda c: tree.where(F.col("commit") == c).select("path", "oid")
    return revisions.file_changes(at("c0"), at("c3")).select("path", "status")


_VERSIONS = f"""{_LINES}, texts AS (
  SELECT path, no, line, substr(md5(line), 1, 1) AS d FROM lines), versions AS (
  SELECT path, coalesce(string_agg(line || chr(10), '' ORDER BY no) FILTER (d NOT IN ('0', '1', '2', '3')), '') AS a,
    coalesce(string_agg(line || chr(10), '' ORDER BY no) FILTER (d NOT IN ('2', '3')), '') AS b FROM texts GROUP BY path)"""


@query(
    f"""WITH {_VERSIONS}, placed AS (
  SELECT coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' || doc_id AS path, a, b FROM versions JOIN documents ON path = 'doc/' || doc_id)
SELECT 'c0..c1' AS pair, path, CASE WHEN a = '' THEN 'added' WHEN b = '' THEN 'deleted' ELSE 'modified' END AS status,
  CASE WHEN a <> '' THEN sha256(a) END AS old_oid, CASE WHEN b <> '' THEN sha256(b) END AS new_oid FROM placed WHERE a <> b"""
)
def h23_branch_comparison(spark, sf_dir):
    """What branch c1 of the documents' history contributes since it left c2; a file without lines isn't there."""
    tree, _, parents = document_history(spark, sf_dir)
    docs = star.table(spark, sf_dir, "documents")
    none = lambda c: F.coalesce(c, F.lit("none"))
    named = docs.select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.concat_ws("/", none(F.col("source")), none(F.col("lang")), F.col("doc_id").cast("string")).alias("place"))
    files = tree.where(F.col("oid") != F.sha2(F.lit("").cast("binary"), 256)).join(named, "path").select("commit", F.col("place").alias("path"), "oid")
    return lineage.compare_branches(files, parents, "c2", "c1")[1]


@query(
    """WITH RECURSIVE dag AS (SELECT event_id AS id, event_id // 2 AS nbr FROM events WHERE event_id // 2 > 0 UNION SELECT event_id, event_id // 3 FROM events WHERE event_id // 3 > 0),
seeds AS (SELECT event_id AS id FROM events ORDER BY event_id DESC LIMIT 3),
r1 AS (SELECT id FROM seeds UNION SELECT nbr FROM r1 JOIN dag USING (id) WHERE id % 2 = 1),
blocked AS (SELECT id FROM r1 WHERE id % 2 = 0 UNION SELECT dag.id FROM blocked JOIN dag ON dag.nbr = blocked.id WHERE dag.id % 2 = 1 AND dag.id IN (SELECT id FROM r1)),
r2 AS (SELECT id FROM seeds UNION SELECT nbr FROM r2 JOIN dag USING (id))
SELECT 1 AS pass, id::VARCHAR AS oid, 'missing' AS state FROM r1 WHERE id % 2 = 0
UNION ALL SELECT 1, id::VARCHAR, 'complete' FROM r1 WHERE id NOT IN (SELECT id FROM blocked)
UNION ALL SELECT 2, id::VARCHAR, 'complete' FROM r2"""
)
def k14_history_pass(spark, sf_dir):
    """Two passes over events as commits with two parents each: odd ones come first, then the others."""
    e = star.table(spark, sf_dir, "events")
    above = F.array_distinct(F.filter(F.array(F.expr("event_id div 2"), F.expr("event_id div 3")), lambda p: p > 0))
    commits = e.select("event_id", F.col("event_id").cast("string").alias("oid"), F.transform(above, lambda p: p.cast("string")).alias("parents"))
    roots = e.orderBy(F.desc("event_id")).limit(3).select(F.col("event_id").cast("string").alias("oid"))
    held, none = lineage.no_history(spark), roots.limit(0)
    out = None
    for k, odd in ((1, 1), (2, 0)):
        held = lineage.history_pass(held, commits.where(F.pmod("event_id", F.lit(2)) == odd).select("oid", "parents"), roots, none)
        found = held.complete.select(F.lit(k).alias("pass"), "oid", F.lit("complete").alias("state")).unionByName(held.gaps.select(F.lit(k).alias("pass"), "oid", F.col("cause").alias("state")))
        out = found if out is None else out.unionByName(found)
    return out


def item_registry(spark, sf_dir):
    """Benchmark items as records: the first two words are the label, the next two an alias; the partition is a language, by turns."""
    w = F.split(F.trim("text"), r"\s+")
    items = star.table(spark, sf_dir, "benchmark").where("trim(text) != ''")
    turn = F.element_at(F.array(F.lit("en"), F.lit("fr"), F.lit("en"), F.lit("de")), (F.col("item_id") % 4 + 1).cast("int"))
    row = lambda at, label: F.struct(F.array_join(F.slice(w, at, 2), " ").alias("surface"), F.lit(label).alias("is_label"))
    return items.select(F.lit("items").alias("registry"), F.concat(F.lit("r"), F.col("item_id").cast("string")).alias("record_id"), turn.alias("partition"), F.inline(F.array(row(1, True), row(3, False))))


KINDS = (linking.LinkType("opening", "items", pattern=r"\b\w+ \w+"), linking.LinkType("local", "items", partitioned=True, path_segment=0))


@query()
def i9_entity_linking(spark, sf_dir):
    """All documents, under the folder of their language, against the benchmark's items."""
    docs = star.table(spark, sf_dir, "documents")
    sources = docs.select(F.concat(F.coalesce("lang", F.lit("")), F.lit("/"), F.col("doc_id").cast("string")).alias("source"), "text")
    return linking.link_entities(sources, KINDS, item_registry(spark, sf_dir))[0]


def user_memory(spark, sf_dir, moved: int, judged: bool):
    """Users as records about their customer and a nation; where judged, by their events."""
    e = star.table(spark, sf_dir, "events")
    u = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    key = F.col("user_id").cast("string")
    return u.select(
        key.alias("record_id"),
        F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("|", key, F.col("n").cast("string")).cast("binary"), 256)).alias("record_digest"),
        F.lit("users").alias("scope_ref"),
        F.when(F.lit(judged) & (F.col("errors") % 3 == 0), "superseded").otherwise("accepted_current").alias("state"),
        (~F.lit(judged) | (F.col("n") % 5 != 0)).alias("projection_eligible"),
        F.lit(True).alias("authorized"),
        F.lit(True).alias("eligible_now"),
        F.array(star.node_id("customer", "user_id"), F.concat(F.lit("nation:"), ((F.col("user_id") + moved) % 30).cast("string"))).alias("code_targets"),
        F.array(F.concat(F.lit("events/"), key)).alias("citations"),
    )


@query(
    f"""WITH {star.ORACLE_NODES}, {star.ORACLE_EDGES}, u AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY user_id),
shown AS (SELECT user_id, 'memory:' || user_id AS src FROM u WHERE errors % 3 <> 0 AND n % 5 <> 0 AND user_id NOT IN (SELECT user_id FROM events WHERE event_id % 211 = 0)),
about AS (SELECT src, 'customer:' || user_id AS tgt FROM shown UNION ALL SELECT src, 'nation:' || (user_id + 1) % 30 FROM shown),
live AS (SELECT src, tgt FROM about WHERE tgt IN (SELECT id FROM nodes))
SELECT src, tgt, 1::BIGINT AS n FROM live UNION ALL SELECT src, '' AS tgt, 1::BIGINT FROM shown
UNION ALL SELECT 'nodes', '', (SELECT count(*) FROM nodes) + (SELECT count(*) FROM shown)
UNION ALL SELECT 'edges', '', (SELECT count(*) FROM (SELECT DISTINCT src, tgt, relation FROM edges)) + (SELECT count(*) FROM live)"""
)
def i12_memory_projection(spark, sf_dir):
    """A store after a projection, a second that moves and withdraws records, and the first once more, which is stale."""
    nodes = star.nodes(spark, sf_dir)
    erased = star.table(spark, sf_dir, "events").where("event_id % 211 = 0").select(F.col("user_id").cast("string").alias("record_id"))
    path = f"{shared_folder(spark)}/projected-{uuid.uuid4().hex}"
    projection.begin(path, nodes, star.emissions(spark, sf_dir).select("src", "tgt", "relation").distinct())
    first = projection.project(user_memory(spark, sf_dir, 0, False), nodes, erased.limit(0))
    second = projection.project(user_memory(spark, sf_dir, 1, True), nodes, erased)
    for cursor, p in ((1, first), (2, second), (1, first)):
        projection.merge(spark, path, p, cursor)
    held, edges = projection.read(spark, path)
    row = lambda df, src, tgt: df.select(src.alias("src"), tgt.alias("tgt"), F.lit(1).cast("long").alias("n"))
    total = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("src"), F.lit("").alias("tgt"), "n")
    memory = F.lit(projection.PREFIX)
    return (
        row(edges.where(F.startswith("src", memory)), F.col("src"), F.col("tgt"))
        .unionByName(row(held.where(F.startswith("id", memory)), F.col("id"), F.lit("")))
        .unionByName(total(held, "nodes"))
        .unionByName(total(edges, "edges"))
    )


def titled_parts(spark, sf_dir):
    """Parts under their names, some led by titles, some with the brand in parentheses."""
    led = F.element_at(F.array(*[F.lit(x) for x in ("", "Dr. ", "The Captain ", "Prof ")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    brand = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(" ("), "p_brand", F.lit(")"))).otherwise("")
    return star.table(spark, sf_dir, "part").select(star.node_id("part", "p_partkey").alias("id"), F.concat(led, "p_name", brand).alias("label"))


_TITLED = """parts AS (SELECT 'part:' || p_partkey AS id, p_name, p_brand, ['', 'Dr. ', 'The Captain ', 'Prof '][p_partkey % 4 + 1] || p_name AS plain, CASE WHEN p_size % 3 = 0 THEN ' (' || p_brand || ')' ELSE '' END AS brand FROM part),
once AS (SELECT *, regexp_replace(plain, '^(dr|the|prof)\\.? +', '', 'i') AS one FROM parts), unled AS (SELECT *, regexp_replace(one, '^captain ', '', 'i') AS two FROM once),
forms AS (SELECT DISTINCT id, lower(unnest([plain, one, two, plain || brand, one || brand, two || brand])) AS term FROM unled)"""


@query(f"WITH {_TITLED} SELECT id, string_agg(term, '|' ORDER BY term) AS terms FROM forms GROUP BY id")
def j7_label_terms(spark, sf_dir):
    return titled_parts(spark, sf_dir).select("id", F.array_join(surface.label_terms(F.col("label")), "|").alias("terms"))


@query("SELECT 'part:' || p_partkey AS id, min('part:' || p_partkey) OVER (PARTITION BY lower(p_name)) AS entity FROM part")
def j7_alias_classes(spark, sf_dir):
    """Parts that a chain of shared terms leads to: those of one name, whatever leads or follows it."""
    return surface.alias_classes(titled_parts(spark, sf_dir))
