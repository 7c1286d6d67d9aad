"""Relational operators on records: neighbours, counts, citations, hyperedges, pairing, profiles, grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .iterate import ranked, settle


def neighbours(edges: DataFrame, nodes: DataFrame, ids: list[str]) -> DataFrame:
    """(node, direction, relation, id, label): the out and in links of some nodes."""
    side = lambda a, b, name: edges.where(F.col(a).isin(ids)).select(F.col(a).alias("node"), F.lit(name).alias("direction"), "relation", F.col(b).alias("id"))
    return side("src", "tgt", "out").unionByName(side("tgt", "src", "in")).join(nodes.select("id", "label"), "id")


def group_counts(records: DataFrame, axis: str, dead: DataFrame) -> DataFrame:
    """(axis, n): live records by value; records erased by a tombstone (id) don't count."""
    return records.join(dead, "id", "left_anti").groupBy(axis).agg(F.count(F.lit(1)).alias("n"))


CITATION = ["source_file", "page", "section", "paragraph"]


def union_citations(citations: DataFrame) -> DataFrame:
    """(node, *locator): distinct citations of each node by locator; a null part is an empty one."""
    return citations.select("node", *[F.coalesce(c, F.lit("")).alias(c) for c in CITATION]).distinct()


def top_citations(citations: DataFrame, k: int) -> DataFrame:
    """The k citations of each node: one for each source first, then fine locators, then coarse ones, in order."""
    distinct = union_citations(citations)
    order = [F.col(c) for c in CITATION]
    first = distinct.withColumn("nth", F.row_number().over(W.partitionBy("node", "source_file").orderBy(*order)))
    fine = (F.col("page") != "") | (F.col("section") != "") | (F.col("paragraph") != "")
    tier = F.when(F.col("nth") == 1, 0).when(fine, 1).otherwise(2)
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("node").orderBy(tier, *order)))
    return ranked.where(F.col("rank") <= k).select("node", "rank", *CITATION)


def merge_hyperedges(members: DataFrame) -> DataFrame:
    """(id, members): each hyperedge's members once, in the order of first appearance (id, ordinal, member)."""
    first = members.groupBy("id", "member").agg(F.min("ordinal").alias("at"))
    return first.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "member"))), lambda x: x["member"]).alias("members"))


def hyperedges_within(members: DataFrame, kept: DataFrame) -> DataFrame:
    """Hyperedges (id) all of whose members are kept (id)."""
    broken = members.join(kept.select(F.col("id").alias("member")), "member", "left_anti").select("id").distinct()
    return members.select("id").distinct().join(broken, "id", "left_anti")


def relate_status(left: Column, left_at: Column, right: Column, right_at: Column) -> Column:
    """Of two differing statuses: both concrete contradict; the later concrete one supersedes an unknown; else a person decides."""
    known_left, known_right = left != "unknown", right != "unknown"
    return (
        F.when(left == right, None)
        .when(known_left & known_right, "contradicts")
        .when(known_left, F.when(left_at > right_at, "left_supersedes_right").otherwise("needs_adjudication"))
        .otherwise(F.when(right_at > left_at, "right_supersedes_left").otherwise("needs_adjudication"))
    )


def pair_assertions(records: DataFrame, keys: list[str]) -> DataFrame:
    """(left, right, relation) of assertions (id, status, at) that share their keys, ids in order."""
    l = records.select(*keys, *[F.col(c).alias(f"l_{c}") for c in ("id", "status", "at")])
    r = records.select(*keys, *[F.col(c).alias(f"r_{c}") for c in ("id", "status", "at")])
    told = relate_status(F.col("l_status"), F.col("l_at"), F.col("r_status"), F.col("r_at"))
    return l.join(r, keys).where("l_id < r_id").select(F.col("l_id").alias("left"), F.col("r_id").alias("right"), told.alias("relation")).where("relation is not null")


def relation_profiles(edges: DataFrame) -> DataFrame:
    """(id, profile): the sorted directions and relations of each node's links."""
    ends = edges.select(F.col("src").alias("id"), F.concat(F.lit("out:"), "relation").alias("p")).unionByName(edges.select(F.col("tgt").alias("id"), F.concat(F.lit("in:"), "relation").alias("p")))
    return ends.groupBy("id").agg(F.array_sort(F.collect_set("p")).alias("profile"))


def token_idf(tokens: DataFrame) -> DataFrame:
    """(token, df, idf): ln(n / df) over records (id, token)."""
    n = tokens.select("id").distinct().agg(F.count(F.lit(1)).alias("n"))
    df = tokens.distinct().groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(F.broadcast(n)).select("token", "df", F.round(F.log(F.col("n") / F.col("df")), 6).alias("idf"))


def group_with_overflow(drafts: DataFrame, key: str, n: int) -> DataFrame:
    """(key, files): groups by size; all beyond the first n - 1 are one overflow group, if there are more than n.

    drafts: (key, file). Sizes are ranked, not rows.
    """
    sizes = settle(drafts.groupBy(key).agg(F.countDistinct("file").alias("files")))
    if sizes.count() <= n:
        return sizes
    first = sizes.orderBy(F.desc("files"), key).limit(n - 1)  # a top list of n - 1 rows, which bounds the broadcast
    named = drafts.join(F.broadcast(first.select(key, F.col(key).alias("kept"))), key, "left")
    return named.groupBy(F.coalesce("kept", F.lit("overflow:mixed")).alias(key)).agg(F.countDistinct("file").alias("files"))


def dominant(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value): the commonest value of each key, the smallest in a tie."""
    counts = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(value).alias("v"))).alias("b")).select(key, F.col("b.v").alias(value))


def remap_communities(new: DataFrame, old: DataFrame) -> DataFrame:
    """(community, number): greedy one-to-one match of new communities with the old ones' numbers.

    Pairs are taken by overlap, largest first, then by the smaller old number,
    then by the smaller new one, each side once. In rounds, all pairs that are
    the best of both their sides are taken at once, which is the same match.
    Communities without one get the least numbers that no match took, larger
    ones first, then by their smallest member.
    """
    both = new.select("id", "community").join(old.select("id", F.col("community").alias("previous")), "id").groupBy("community", "previous").agg(F.count(F.lit(1)).alias("n"))
    left, matched = settle(both), None
    while not left.isEmpty():
        order = F.struct((-F.col("n")).alias("n"), "previous", "community")
        by_new = left.groupBy("community").agg(F.min(order).alias("b")).select("b.*")
        by_old = left.groupBy("previous").agg(F.min(order).alias("b")).select("b.*")
        best = settle(by_new.intersect(by_old).select("community", "previous"))
        matched = best if matched is None else matched.unionByName(best)
        left = settle(left.join(best.select("community"), "community", "left_anti").join(best.select("previous"), "previous", "left_anti"))
    sizes = new.groupBy("community").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("first"))
    if matched is None:
        fresh = sizes
    else:
        fresh = sizes.join(matched.select("community"), "community", "left_anti")
    fresh = ranked(fresh, F.desc("size"), "first", name="place").select("community", "place")
    if matched is None:
        return fresh.select("community", (F.col("place") - 1).cast("long").alias("number"))
    # the place-th number that is free: as many as the places plus the taken ones below always hold it
    taken = matched.select(F.col("previous").cast("long").alias("number"))
    free = new.sparkSession.range(fresh.count() + taken.count()).select(F.col("id").alias("number")).join(taken, "number", "left_anti")
    named = ranked(free, "number", name="place").join(fresh, "place").select("community", "number")
    return matched.select("community", F.col("previous").cast("long").alias("number")).unionByName(named)


def canonical_prefix(value: Column, synonyms: dict[str, str]) -> Column:
    """An id with its prefix, before the first colon, in canonical form."""
    prefix, out = F.substring_index(value, ":", 1), value
    for old, new in synonyms.items():
        out = F.when(F.contains(value, F.lit(":")) & (prefix == old), F.concat(F.lit(new), F.substring(value, len(old) + 1, 1 << 20))).otherwise(out)
    return out


def schema_hygiene(nodes: DataFrame, synonyms: dict[str, str]) -> DataFrame:
    """Nodes under canonical ids; of those that meet, the first non-empty value of each attribute by original id."""
    values = [c for c in nodes.columns if c != "id"]
    named = nodes.withColumn("new_id", canonical_prefix(F.col("id"), synonyms))
    first = lambda c: F.min(F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.struct("id", F.col(c).alias("v"))))["v"].alias(c)
    return named.groupBy(F.col("new_id").alias("id")).agg(*[first(c) for c in values])


def incremental(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, change): new, changed, unchanged or deleted files of (path, mtime, hash) against a manifest."""
    old = manifest.select("path", F.col("mtime").alias("old_mtime"), F.col("hash").alias("old_hash"), F.lit(True).alias("known"))
    j = current.withColumn("here", F.lit(True)).join(old, "path", "full")
    same = (F.col("mtime") == F.col("old_mtime")) | (F.col("hash") == F.col("old_hash"))
    return j.select("path", F.when(F.col("here").isNull(), "deleted").when(F.col("known").isNull(), "new").when(same, "unchanged").otherwise("changed").alias("change"))


def session_aggregates(turns: DataFrame) -> DataFrame:
    """(conv_id, turns, user_turns, assistant_turns, chars, first_turn, last_turn) of a conversation log."""
    return turns.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("turns"), F.count_if(F.col("role") == "user").alias("user_turns"), F.count_if(F.col("role") == "assistant").alias("assistant_turns"),
        F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("long").alias("chars"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"),
    )


def topology_signature(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(n, e, signature): counts and an order-free digest: sums of 60 bits of each key's SHA-256.

    A sum needs no row to meet another, where a sorted listing would pass the
    whole graph through one task.
    """
    part = lambda key: F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    a = nodes.agg(F.count(F.lit(1)).alias("n"), F.sum(part(F.col("id"))).alias("hn"))
    b = edges.agg(F.count(F.lit(1)).alias("e"), F.sum(part(F.concat_ws("|", "src", "tgt", "relation"))).alias("he"))
    text = F.concat(F.lit("topo/2;n="), F.col("n").cast("string"), F.lit(";e="), F.col("e").cast("string"), F.lit(";"), F.col("hn").cast("string"), F.lit("|"), F.col("he").cast("string"))
    return a.crossJoin(b).select("n", "e", F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256)).alias("signature"))
