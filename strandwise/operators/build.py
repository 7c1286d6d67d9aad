"""Graph construction: evidence merge, node merge, integrity, set operations and remapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandwise.functions.text import nfkc

from .iterate import ranked, settle

EDGE_KEY = ["src", "tgt", "relation"]
#: Ends that are broadcast to the edges; rows of one task where they are too many.
BROADCAST_ENDS, TASK_EDGES = 2_000_000, 500_000
#: Different observations (source_file, confidence) that an edge can mark as bits.
MOST_MARKS = 512
#: Confidence scores of an edge's evidence; search weights have a table of their own.
EVIDENCE_SCORE = {"EXTRACTED": 1.0, "INFERRED": 0.5, "AMBIGUOUS": 0.2}


def confidence_rank(confidence: Column) -> Column:
    return F.when(confidence == "EXTRACTED", 3).when(confidence == "INFERRED", 2).when(confidence == "AMBIGUOUS", 1).otherwise(0)


def evidence_score(confidence: Column, score: Column | None = None) -> Column:
    known = F.lit(1.0)
    for name, value in EVIDENCE_SCORE.items():
        known = F.when(confidence == name, F.lit(value)).otherwise(known)
    return known if score is None else F.coalesce(score, known)


def merge_evidence(emissions: DataFrame) -> DataFrame:
    """One edge for each (src, tgt, relation).

    Emissions with equal content are one observation. The edge has the largest
    weight, the strongest confidence (the smaller name in a tie), the largest
    score and the observations in order; its source_file is that of the
    smallest observation. All of these are max, min and set aggregates, so a
    hot edge is merged on the map side before the shuffle, and merging again
    changes nothing.
    """
    observation = F.struct("source_file", "confidence", evidence_score(F.col("confidence")).alias("confidence_score"))
    best = F.max(F.struct(confidence_rank(F.col("confidence")).alias("rank"), F.col("confidence").alias("name")))
    return (
        emissions.groupBy(*EDGE_KEY)
        .agg(
            F.max("weight").alias("weight"),
            best["name"].alias("confidence"),
            F.max(evidence_score(F.col("confidence"))).alias("confidence_score"),
            F.array_sort(F.collect_set(observation)).alias("evidence"),
        )
        .withColumn("n_observations", F.size("evidence").cast("long"))
        .withColumn("source_file", F.col("evidence")[0]["source_file"])
    )


def merge_edges(emissions: DataFrame) -> DataFrame:
    """(src, tgt, relation, weight, confidence) of `merge_evidence`, for those that need no evidence.

    Names of confidences are numbered by strength first, so that only numbers
    are aggregated: Spark hashes such groups, and sorts those with names.
    """
    names = emissions.where("confidence is not null").select("confidence").distinct()
    names = settle(ranked(names, confidence_rank(F.col("confidence")), "confidence", name="strength"))
    merged = join_ends(emissions.select(*EDGE_KEY, "weight", "confidence"), names, ["confidence"], "left").groupBy(*EDGE_KEY)
    merged = merged.agg(F.max("weight").alias("weight"), F.max("strength").alias("strength"))
    return join_ends(merged, names, ["strength"], "left").select(*EDGE_KEY, "weight", "confidence")


def count_evidence(emissions: DataFrame) -> DataFrame:
    """`merge_evidence` without the observations, of which only the number and the first source stay.

    Where a corpus has up to MOST_MARKS different observations, these are
    numbered in order and an edge marks its own as bits, so that it is merged
    by numbers only, on the map side too, and nothing is sorted. Beyond, the
    observations of an edge are gathered.
    """
    seen = settle(emissions.select("source_file", "confidence").distinct())
    n = seen.count()
    if n > MOST_MARKS:
        return merge_evidence(emissions).drop("evidence")
    name, confidence = F.asc_nulls_first("confidence"), F.col("confidence")
    place = F.row_number().over(W.orderBy(F.asc_nulls_first("source_file"), name)) - 1  # MOST_MARKS rows at most
    strength = F.dense_rank().over(W.orderBy(confidence_rank(confidence), name))
    marks = seen.select("*", place.alias("mark"), strength.alias("strength"), evidence_score(confidence).alias("score"))
    same = emissions["source_file"].eqNullSafe(marks["source_file"]) & emissions["confidence"].eqNullSafe(marks["confidence"])
    words = [f"_{w}" for w in range(-(-n // 64))]
    bit = F.expr("shiftleft(1L, mark % 64)")
    bits = [F.bit_or(F.when(F.expr("mark div 64") == w, bit).otherwise(F.lit(0).cast("long"))).alias(c) for w, c in enumerate(words)]
    merged = (
        emissions.join(F.broadcast(marks), same)
        .groupBy(*EDGE_KEY)
        .agg(F.max("weight").alias("weight"), F.max("strength").alias("strength"), F.max("score").alias("confidence_score"), F.min("mark").alias("mark"), *bits)
    )
    named = merged.join(F.broadcast(marks.select("strength", "confidence").distinct()), "strength").join(F.broadcast(marks.select("mark", "source_file")), "mark")
    total = sum((F.bit_count(c) for c in words), F.lit(0)).cast("long")
    return named.select(*EDGE_KEY, "weight", "confidence", "confidence_score", total.alias("n_observations"), "source_file")


def merge_intervals(observed: DataFrame, keys: list[str]) -> DataFrame:
    """The closed interval of a merged edge: the least t, the largest t_end, open if any member is; invalid members don't count."""
    valid = observed.where(F.col("t").isNotNull() & (~F.col("has_t_end") | (F.col("t_end").isNotNull() & (F.col("t_end") >= F.col("t")))))
    merged = valid.groupBy(*keys).agg(F.min("t").alias("t"), F.max("t_end").alias("last"), F.max(~F.col("has_t_end")).alias("open"))
    return merged.select(*keys, "t", F.when(~F.col("open"), F.col("last")).alias("t_end"), (~F.col("open")).alias("has_t_end"))


def missing_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id): ends of edges that are no nodes, settled. Each task merges its ends before they are shuffled, and no edge is sorted."""
    ends = edges.select(F.explode(F.array("src", "tgt")).alias("id"), F.lit(1).alias("side"))
    return settle(ends.unionByName(nodes.select("id", F.lit(0).alias("side"))).groupBy("id").agg(F.min("side").alias("side")).where("side = 1 and id is not null").select("id"))


def join_ends(edges: DataFrame, ends: DataFrame, on: list[str], how: str) -> DataFrame:
    """Edges joined to settled ends, which are broadcast up to a measured number; beyond it, parts are as many as edges need.

    Spark would choose by bytes after compression, and ids of one form are a small part of what they take in memory.
    """
    if ends.count() <= BROADCAST_ENDS:
        return edges.join(F.broadcast(ends), on, how)
    parts = max(1, -(-edges.count() // TASK_EDGES))
    return edges.repartition(parts, *on).join(ends.repartition(parts, *on).hint("merge"), on, how)


def touching(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with an end among settled, distinct ids (id)."""
    out = edges
    for end in ("src", "tgt"):
        out = join_ends(out, ids.select(F.col("id").alias(end), F.lit(True).alias(f"at_{end}")), [end], "left")
    return out.where("at_src or at_tgt").select(*edges.columns)


def keep_live_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose endpoints are nodes: those without an end that is missing."""
    gone = missing_ends(edges, nodes)
    kept = edges.where("src is not null and tgt is not null")
    for end in ("src", "tgt"):
        kept = join_ends(kept, gone.select(F.col("id").alias(end)), [end], "left_anti")
    return kept.select(*edges.columns)


def merge_nodes(extracted: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """One node for each id, the last given value of each attribute winning; a null is no value."""
    values = [c for c in extracted.columns if c not in ("id", ordinal)]
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(ordinal))).alias(c)
    return extracted.groupBy("id").agg(*[last(c) for c in values])


def adjacency(edges: DataFrame) -> DataFrame:
    """Distinct neighbours in both directions, without loops: (id, nbr).

    Pairs are made distinct with their ends in order, so that only one row of
    each pair is shuffled; both directions follow after it.
    """
    pairs = edges.where("src != tgt").select(F.least("src", "tgt").alias("a"), F.greatest("src", "tgt").alias("b")).distinct()
    both = F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("nbr")), F.struct(F.col("b").alias("id"), F.col("a").alias("nbr")))
    return pairs.select(F.inline(both))


def undirected(edges: DataFrame) -> DataFrame:
    """Edges with their endpoints in order, merged: (src, tgt, relation, weight, n)."""
    return (
        edges.select(F.least("src", "tgt").alias("src"), F.greatest("src", "tgt").alias("tgt"), "relation", "weight")
        .groupBy(*EDGE_KEY)
        .agg(F.max("weight").alias("weight"), F.count(F.lit(1)).alias("n"))
    )


def resolve_mapping(mapping: DataFrame) -> DataFrame:
    """(old, new) followed to its end; an old id has one new one at most.

    Each round doubles the steps that are taken at once, so n pairs without a
    cycle end in log n rounds. What hasn't ended by then is a cycle, an error.
    """
    at = settle(mapping.where("old != new"))
    for _ in range(at.count().bit_length() + 1):
        on = at.select(F.col("old").alias("new"), F.col("new").alias("further"))
        stepped = settle(at.join(on, "new", "left").select("old", F.coalesce("further", "new").alias("new"), F.col("further").isNotNull().alias("moved")))
        at = stepped.select("old", "new")
        if stepped.where("moved").isEmpty():
            return at
    raise ValueError("a mapping of ids has a cycle")


def remap(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges with endpoints replaced through (old, new), followed to its end; loops that this makes go, and those that were stay."""
    final = resolve_mapping(mapping)
    out = edges.withColumn("was_loop", F.col("src") == F.col("tgt"))
    for end in ("src", "tgt"):
        step = final.select(F.col("old").alias(end), F.col("new").alias("to"))
        out = out.join(step, end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
    return out.where("was_loop or src != tgt").drop("was_loop").select(*edges.columns)


#: Ids that an extraction in chunks tells apart by a suffix.
CHUNK_SUFFIX = r"_c\d+$"


#: A label that is a code of its own, not a name.
CODE_LABEL = r"^[A-Z0-9][A-Z0-9._/-]{1,11}$"


def _label_key(nodes: DataFrame) -> DataFrame:
    """Nodes with the key of their label (or id): letters and digits of its NFKC in lower case; without codes and ASCII keys of three or fewer."""
    raw = F.trim(F.coalesce("label", "id"))
    keyed = nodes.withColumn("norm", F.trim(F.regexp_replace(F.lower(nfkc(raw)), r"[^\p{L}\p{N}]+", " ")))
    short = raw.rlike(r"^[\x20-\x7E]*$") & (F.length(F.replace("norm", F.lit(" "), F.lit(""))) <= 3)
    return keyed.where((F.col("norm") != "") & ~short & ~raw.rlike(CODE_LABEL))


def _to_preferred(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(old, new) within each key: ids without a chunk suffix first, then shorter, then smaller ones; an aggregate, so no group is gathered."""
    order = F.struct(F.col("id").rlike(CHUNK_SUFFIX).alias("chunk"), F.length("id").alias("size"), F.col("id").alias("id"))
    best = nodes.groupBy(*keys).agg(F.min(order)["id"].alias("new"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    same = [nodes[k].eqNullSafe(best[k]) for k in keys]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return nodes.join(best, on).where("id != new").select(F.col("id").alias("old"), "new")


def canonical_labels(nodes: DataFrame) -> DataFrame:
    """(old, new) of nodes with one label, case, spaces and punctuation apart, in two passes.

    First those of one source go to the preferred id; then, across sources,
    those whose id has a chunk suffix go to the preferred one of the same
    label. Nodes with different registry identities never meet: where
    `registry` is a column, it is part of the key. Ids are followed to the
    end, so none that is replaced stands as new.
    """
    own = ["registry"] if "registry" in nodes.columns else []
    labelled = _label_key(nodes)
    first = settle(_to_preferred(labelled, ["source_file", "norm", *own]))
    left = labelled.join(first.select(F.col("old").alias("id")), "id", "left_anti")
    across = _to_preferred(left, ["norm", *own]).where(F.col("old").rlike(CHUNK_SUFFIX))
    return resolve_mapping(first.unionByName(across))


def diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are in only one of two frames: (*keys, change). Nulls are equal.

    Both sides are told apart by a flag and merged by one aggregate, so a key
    is shuffled once for each task that has it and nothing is sorted.
    """
    side = lambda df, flag: df.select(*keys, F.lit(flag).alias("side"))
    sides = side(old, 0).unionByName(side(new, 1)).groupBy(*keys).agg(F.min("side").alias("first"), F.max("side").alias("last"))
    return sides.where("first = last").select(*keys, F.when(F.col("first") == 1, "added").otherwise("removed").alias("change"))


def prune_sources(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without those of the sources in `gone` (source_file); edges of a node that goes, go."""
    gone = settle(gone.select("source_file").distinct())
    kept = join_ends(nodes, gone, ["source_file"], "left_anti")
    return kept, keep_live_endpoints(join_ends(edges, gone, ["source_file"], "left_anti"), kept)


def validate(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(subject, problem): missing fields, unknown confidences, dangling endpoints; `commit:` and `branch:` ids are external."""
    external = F.col("id").rlike("^(commit|branch):")
    gone = missing_ends(edges, nodes).where(~external)
    say = lambda df, subject, problem: df.select(subject.alias("subject"), F.lit(problem).alias("problem"))
    name = F.concat_ws(" ", "src", "relation", "tgt")
    out = say(nodes.where("id is null or label is null or source_file is null"), F.coalesce("id", F.lit("")), "node misses a field")
    out = out.unionByName(say(edges.where("confidence is null or confidence not in ('EXTRACTED', 'INFERRED', 'AMBIGUOUS')"), name, "unknown confidence"))
    for end in ("src", "tgt"):
        dangling = join_ends(edges, gone.select(F.col("id").alias(end)), [end], "left_semi")
        out = out.unionByName(say(dangling, name, f"{end} doesn't exist"))
    return out


def lattice_merge(extracted: DataFrame, fields: list[str]) -> DataFrame:
    """One row per id: each field's smallest value of the strongest confidence, and the fields on which sources differ."""
    rank = confidence_rank(F.col("confidence"))
    aggregates = []
    for f in fields:
        aggregates += [F.min(F.when(F.col(f).isNotNull(), F.struct((-rank).alias("r"), F.col(f).alias("v")))).alias(f), F.countDistinct(f).alias(f"n_{f}")]
    merged = extracted.groupBy("id").agg(*aggregates)
    conflicts = F.concat_ws(",", *[F.when(F.col(f"n_{f}") > 1, F.lit(f)) for f in fields])
    return merged.select("id", *[F.col(f)["v"].alias(f) for f in fields], conflicts.alias("conflicts"))
