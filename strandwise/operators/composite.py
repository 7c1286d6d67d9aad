"""Composites: answer packs, graph questions, suggested questions, guards, class hierarchies, milestones, batch joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .analyze import degrees
from .build import join_ends
from .graph import bfs, personalized_rank
from .iterate import settle

#: Node types whose nodes are structure and no answers, and what their specificity is multiplied by.
STRUCTURAL_TYPE, DEMOTION, PRIOR = r"(?i)chapter|work|section|document|file", 0.2, 1.0
PATH_DECAY = 0.8
#: Titles of opposite gender, and cues of a relative in parentheses. Fixed values.
OPPOSITE_TITLES = {"mr": "mrs", "mrs": "mr", "lord": "lady", "lady": "lord", "king": "queen", "queen": "king"}
RELATIVES = ("wife", "husband", "son", "daughter", "mother", "father", "brother", "sister", "widow")


def answer_pack(nodes: DataFrame, adj: DataFrame, seeds: DataFrame, size: int = 20, rounds: int = 100, prior: float = PRIOR) -> DataFrame:
    """(id, rank, ppr, specificity, hops): the neighbourhood of seeds (id, mass), by the lift of their rank over the background's.

    Structural types are demoted. hops are those from the first node; its
    reliability is 0.8 to their power. No seed gives no rows.
    """
    n = max(1, nodes.count())
    if seeds.where("mass > 0").isEmpty():
        return nodes.sparkSession.createDataFrame([], "id string, rank int, ppr double, specificity double, hops int, reliability double")
    ppr = personalized_rank(adj, nodes, seeds, rounds)
    background = personalized_rank(adj, nodes, seeds.limit(0), rounds).withColumnRenamed("rank", "background")
    lift = F.col("ppr") / (F.col("background") + prior / n)
    scored = (
        ppr.withColumnRenamed("rank", "ppr").where("ppr > 0").join(background, "id").join(nodes.select("id", "node_type"), "id")
        .withColumn("specificity", F.round(lift * F.when(F.col("node_type").rlike(STRUCTURAL_TYPE), DEMOTION).otherwise(1.0), 9))
    )
    top = settle(scored.orderBy(F.desc("specificity"), "id").limit(size).withColumn("rank", F.row_number().over(W.orderBy(F.desc("specificity"), "id"))).select("id", "rank", "ppr", "specificity"))
    near = bfs(adj.select("id", "nbr"), top.where("rank = 1").select("id"), 8)
    return top.join(near.withColumnRenamed("depth", "hops"), "id", "left").withColumn("reliability", F.round(F.pow(F.lit(PATH_DECAY), F.col("hops")), 6))


def suggested_questions(nodes: DataFrame, edges: DataFrame, adj: DataFrame, cohesion: DataFrame, n: int = 7) -> DataFrame:
    """(kind, subject, detail): ambiguous links, hubs of inferred links, weakly linked nodes, loose communities; n of each at most.

    Each kind is a top list of its own, so no kind hides another.
    """
    deg = degrees(adj)
    ambiguous = edges.where("confidence = 'AMBIGUOUS'").orderBy("src", "tgt", "relation").limit(n).select(F.lit("ambiguous_edge").alias("kind"), F.concat_ws(" ", "src", "tgt").alias("subject"), F.col("relation").alias("detail"))
    hubs = deg.orderBy(F.desc("degree"), "id").limit(5)
    ends = edges.where("confidence = 'INFERRED'").select(F.explode(F.array("src", "tgt")).alias("id"))
    inferred = ends.join(F.broadcast(hubs.select("id")), "id").groupBy("id").agg(F.count(F.lit(1)).alias("k")).where("k >= 2")  # five hubs
    verify = inferred.select(F.lit("verify_inferred").alias("kind"), F.col("id").alias("subject"), F.col("k").cast("string").alias("detail"))
    lonely = nodes.join(deg.where("degree > 1").select("id"), "id", "left_anti").orderBy("id").limit(n).select(F.lit("isolated_node").alias("kind"), F.col("id").alias("subject"), F.lit("").alias("detail"))
    loose = cohesion.where("cohesion < 0.15 and size >= 5").orderBy("cohesion", "community").limit(n).select(F.lit("low_cohesion").alias("kind"), F.col("community").cast("string").alias("subject"), F.col("size").cast("string").alias("detail"))
    return ambiguous.unionByName(verify).unionByName(lonely).unionByName(loose)


def different_entities(left: Column, right: Column) -> Column:
    """Why two labels can't be one entity, or null: opposite titles, a relative in parentheses, differing numbers over shared words."""
    title = lambda x: F.lower(F.regexp_extract(x, r"^\s*([A-Za-z]+)\.?\s", 1))
    words = lambda x: F.filter(F.split(F.regexp_replace(F.regexp_replace(F.lower(x), r"\([^)]*\)", " "), r"[^\p{L}\p{N}]+", " "), " "), lambda t: t != "")
    paren = lambda x: F.split(F.lower(F.regexp_extract(x, r"\(([^)]*)\)", 1)), r"\W+")
    shared = F.array_intersect(words(left), words(right))
    opposite = F.element_at(F.create_map(*[F.lit(x) for pair in OPPOSITE_TITLES.items() for x in pair]), F.when(title(left).isin(*OPPOSITE_TITLES), title(left)).otherwise("mr"))
    cues = F.array(*[F.lit(r) for r in RELATIVES])
    number = lambda x: F.filter(words(x), lambda t: t.rlike(r"\d"))
    return (
        F.when(title(left).isin(*OPPOSITE_TITLES) & (opposite == title(right)), "opposite titles")
        .when((F.size(shared) > 0) & (F.arrays_overlap(paren(left), cues) | F.arrays_overlap(paren(right), cues)), "relative in parentheses")
        .when((F.size(shared) > 0) & (F.size(number(left)) > 0) & (F.size(number(right)) > 0) & ~F.arrays_overlap(number(left), number(right)), "numbers differ")
    )


def class_members(nodes: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(class, n, first, last) of classes (type, class): a type's first class by name; and one row with the nodes of no class."""
    first = classes.groupBy("type").agg(F.min("class").alias("class"))
    j = nodes.join(first, nodes["node_type"] == first["type"], "left")
    members = j.where("class is not null").groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))
    return members, j.where("class is null").agg(F.count(F.lit(1)).alias("unattached"))


def batch_join(batches: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Check batches (pr, sha) that name a request's head, and those that don't."""
    heads = requests.select("pr", F.col("head").alias("sha"))
    return batches.join(heads, ["pr", "sha"], "left_semi"), batches.join(heads, ["pr", "sha"], "left_anti")


def milestones(lots: DataFrame) -> DataFrame:
    """(lot, targets, on_time, late, unknown, verdict) of targets (lot, forecast_ms, done_ms): the first failing reason decides."""
    late = F.col("done_ms") > F.col("forecast_ms")
    s = lots.groupBy("lot").agg(F.count(F.lit(1)).alias("targets"), F.count_if(~late).alias("on_time"), F.count_if(late).alias("late"), F.count_if(F.col("done_ms").isNull()).alias("unknown"))
    return s.withColumn("verdict", F.when(F.col("unknown") > 0, "unknown").when(F.col("late") > 0, "late").otherwise("on time"))


def expand_by_relation(changed: DataFrame, edges: DataFrame, relation: str) -> DataFrame:
    """Changed ids and, over one hop of a relation, what re-exports them."""
    over = edges.where(F.col("relation") == relation).join(changed, edges["tgt"] == changed["id"], "left_semi").select(F.col("src").alias("id"))
    return changed.select("id").unionByName(over).distinct()


def occurrence_summary(found: DataFrame, linked: DataFrame) -> DataFrame:
    """(record_id, documents, mentions, first) of occurrences (doc, span, start) joined to records by span."""
    j = found.join(linked, "span")
    return j.groupBy("record_id").agg(F.countDistinct("doc").alias("documents"), F.count(F.lit(1)).alias("mentions"), F.min(F.struct("doc", "start"))["doc"].alias("first"))


def token_reduction(corpus: DataFrame, text: str, answer_chars: DataFrame) -> DataFrame:
    """One row: tokens of the corpus, mean tokens of an answer (chars), and their ratio; four characters are a token."""
    tokens = lambda c: F.greatest(F.lit(1), F.floor(c / 4))
    whole = corpus.agg(F.sum(tokens(F.length(text))).cast("long").alias("corpus_tokens"))
    answer = answer_chars.agg(F.avg(tokens(F.col("chars"))).alias("answer_tokens"))
    return whole.crossJoin(answer).select("corpus_tokens", F.round("answer_tokens", 4).alias("answer_tokens"), F.round(F.col("corpus_tokens") / F.col("answer_tokens"), 4).alias("reduction"))


def validate_profile(nodes: DataFrame, edges: DataFrame, types: list[str], relations: dict[str, tuple[str, str]]) -> DataFrame:
    """(subject, problem): node types and relation ends that a profile doesn't declare. The profile is a few names; ids are unique.

    Distinct ends meet their nodes, and only those that are missing or of a
    type that their relation doesn't declare meet the edges.
    """
    bad_nodes = nodes.where(~F.col("node_type").isin(types)).select(F.col("id").alias("subject"), F.lit("undeclared type").alias("problem"))
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("src").alias("id")), F.struct(F.lit(1).alias("side"), F.col("tgt").alias("id")))
    ends = edges.select("relation", F.inline(sides)).distinct()
    declared, known = F.lit(False), list(relations)
    for name, (s, t) in relations.items():
        declared = declared | ((F.col("relation") == name) & (F.col("node_type") == F.when(F.col("side") == 0, s).otherwise(t)))
    missing = F.col("here").isNull()
    found = ends.join(nodes.select("id", "node_type", F.lit(True).alias("here")), "id", "left")
    odd = settle(found.where(missing | (F.col("relation").isin(known) & ~declared)).select("relation", "side", "id", missing.alias("missing")).distinct())
    at = lambda side, end: odd.where(F.col("side") == side).select("relation", F.col("id").alias(end), F.col("missing").alias(f"{end}_missing"))
    e = edges.select("src", "relation", "tgt").where("src is not null and tgt is not null")
    for side, end in enumerate(("src", "tgt")):
        e = join_ends(e, at(side, end), ["relation", end], "left")
    wrong = F.coalesce(~F.col("relation").isin(known), F.lit(False)) | F.col("src_missing").isNotNull() | F.col("tgt_missing").isNotNull()
    here = ~F.coalesce("src_missing", F.lit(False)) & ~F.coalesce("tgt_missing", F.lit(False))
    bad_edges = e.where(wrong & here).select(F.concat_ws(" ", "src", "relation", "tgt").alias("subject"), F.lit("undeclared relation").alias("problem"))
    return bad_nodes.unionByName(bad_edges)
