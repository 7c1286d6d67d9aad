"""Iterative graph operators: frontiers, paths, components, ranks, communities and closures.

Every loop joins a frontier with the adjacency on the node and stops when the
frontier is empty; each round is settled in the shared folder. A round shuffles
the frontier's steps and the ids visited so far, against which they are held.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .iterate import ranked, resolve_chains, settle

#: Communities of more than a share of all nodes, and of LEAST_SPLIT nodes, are split; so are those of LOOSE_SIZE nodes with less than a share of their possible links. Fixed values.
LARGEST_SHARE, LEAST_SPLIT, LOOSE, LOOSE_SIZE = 0.25, 10, 0.05, 50
#: Nodes whose communities may be broadcast for a join, by number and by name; nodes that tasks of a round may hold, at some 50 bytes each.
BROADCAST_NODES, BROADCAST_NAMES, HELD_NODES = 1_000_000, 500_000, 4_000_000
#: Links of one task of a round; turns that a number's bits hold.
LINKS_A_TASK, MOST_TURNS = 100_000, 31


def _beside(df: DataFrame, n: int, most: int) -> DataFrame:
    """df of n rows for a join with links, broadcast where these are no more than the most."""
    return F.broadcast(df) if n <= most else df


def bfs(adj: DataFrame, starts: DataFrame, depth: int | None = None) -> DataFrame:
    """(id, depth): nodes within `depth` steps of the starts (id), or within any, each at its least depth."""
    adj = settle(adj)  # read by every round
    seen = settle(starts.select("id").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for d in count(1) if depth is None else range(1, depth + 1):
        reached = frontier.join(adj, "id").select(F.col("nbr").alias("id")).distinct().join(seen.select("id"), "id", "left_anti")
        frontier = settle(reached.withColumn("depth", F.lit(d)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def multi_bfs(edges: DataFrame, starts: DataFrame, depth: int | None = None) -> DataFrame:
    """(start, id, depth) from every start at once, along directed edges (id, nbr), up to a depth if one is given."""
    edges = settle(edges)  # read by every round
    seen = settle(starts.select(F.col("id").alias("start"), "id").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for d in count(1) if depth is None else range(1, depth + 1):
        reached = frontier.join(edges, "id").select("start", F.col("nbr").alias("id")).distinct()
        frontier = settle(reached.join(seen.select("start", "id"), ["start", "id"], "left_anti").withColumn("depth", F.lit(d)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def reach(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(id): what the starts (id) reach along directed edges (id, nbr), themselves included.

    Chains are drawn together first: a node whose only edge leads to a node
    without another edge to it, which is no start, is reached just where that
    one's chain begins. So a search takes as many rounds as a path has forks
    and joins, and the logarithm of the longest chain, whatever its length.
    """
    edges = settle(edges.select("id", "nbr").where("id != nbr").distinct())
    starts = settle(starts.select("id").distinct())
    out = edges.groupBy("id").agg(F.count(F.lit(1)).alias("out"))
    into = edges.groupBy("nbr").agg(F.count(F.lit(1)).alias("into"))
    single = edges.join(out.where("out = 1"), "id", "left_semi").join(into.where("into = 1"), "nbr", "left_semi").join(starts.withColumnRenamed("id", "nbr"), "nbr", "left_anti")
    nodes = settle(edges.select("id").unionByName(edges.select(F.col("nbr").alias("id"))).unionByName(starts).distinct())
    pointed = nodes.join(single.select("id", F.struct(F.col("nbr").alias("id")).alias("to")), "id", "left").withColumn("chain", F.col("id"))
    chains = resolve_chains(pointed, ["id"], ["chain"])
    # a cycle of single edges has no end: its nodes are no start, and nothing else leads to them
    named = lambda side, name: chains.select(F.col("id").alias(side), F.col("chain").alias(name))
    forks = edges.join(single.select("id"), "id", "left_anti").join(named("id", "a"), "id").join(named("nbr", "b"), "nbr").select(F.col("a").alias("id"), F.col("b").alias("nbr")).distinct()
    found = bfs(forks, starts.join(chains, "id").select(F.col("chain").alias("id")))
    return chains.join(found.select(F.col("id").alias("chain")), "chain", "left_semi").select("id")


def shortest_path(adj: DataFrame, source: str, target: str, max_hops: int = 8) -> DataFrame:
    """(hop, id) of the shortest path, smallest parents first; empty if there is none within max_hops."""
    spark, adj = adj.sparkSession, settle(adj)
    levels = [settle(spark.createDataFrame([(source, None)], "id string, parent string"))]
    seen = levels[0].select("id")
    for _ in range(max_hops):
        step = levels[-1].select("id").join(adj, "id").groupBy(F.col("nbr").alias("node")).agg(F.min("id").alias("parent"))
        levels.append(settle(step.join(seen, step["node"] == seen["id"], "left_anti").select(F.col("node").alias("id"), "parent")))
        found = levels[-1].where(F.col("id") == target)
        if not found.isEmpty():
            break
        if levels[-1].isEmpty():
            return spark.createDataFrame([], "hop int, id string")
        seen = seen.unionByName(levels[-1].select("id"))
    else:
        return spark.createDataFrame([], "hop int, id string")
    path, at = [], target
    for hop in range(len(levels) - 1, -1, -1):  # one row a hop
        path.append((hop, at))
        at = levels[hop].where(F.col("id") == at).first().parent
    return spark.createDataFrame(path, "hop int, id string")


def components(pairs: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest node reachable, for all nodes of the pairs (id, nbr), by alternating star steps."""
    edges = settle(pairs.select(F.greatest("id", "nbr").alias("u"), F.least("id", "nbr").alias("v")).where("u != v").distinct())
    last = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        near = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(near, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v"))).where("u != v")
        edges = settle(small.distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = pairs.select("id").unionByName(pairs.select(F.col("nbr").alias("id"))).distinct()
    return nodes.join(edges.select(F.col("u").alias("id"), F.col("v").alias("root")), "id", "left").select("id", F.coalesce("root", "id").alias("component"))


def personalized_rank(adj: DataFrame, nodes: DataFrame, seeds: DataFrame, rounds: int = 100, tolerance: float = 1e-6, alpha: float = 0.85, lazy: float = 0.6) -> DataFrame:
    """(id, rank): lazy personalised PageRank of weighted adjacency (id, nbr, w) from seeds (id, mass).

    Mass of nodes without edges goes back to the seeds; no seeds means all
    nodes alike. Stops when the ranks change by the tolerance at most in sum.
    """
    mass = seeds.where("mass > 0").groupBy("id").agg(F.sum("mass").alias("mass"))
    total = mass.agg(F.sum("mass")).first()[0]
    base = nodes.select("id").distinct().join(mass, "id", "left")
    if total:
        base = base.select("id", (F.coalesce("mass", F.lit(0.0)) / total).alias("p"))
    else:
        base = base.select("id", F.lit(1.0 / max(1, nodes.select("id").distinct().count())).alias("p"))
    adj = settle(adj)
    out = adj.groupBy("id").agg(F.sum("w").alias("total"))
    state = settle(base.join(out, "id", "left").select("id", "p", "total", F.col("p").alias("rank")))
    steps = settle(adj.join(out, "id").select("id", "nbr", (F.col("w") / F.col("total")).alias("share")))
    for _ in range(rounds):
        sent = state.select("id", "rank").join(steps, "id").groupBy(F.col("nbr").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        dangling = state.where("total is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("d"))
        new = (1 - alpha) * F.col("p") + alpha * F.col("d") * F.col("p")
        walk = F.when(F.col("total").isNotNull(), alpha * lazy * F.col("rank")).otherwise(0.0) + alpha * (1 - lazy) * F.coalesce("got", F.lit(0.0))
        nxt = settle(state.join(sent, "id", "left").crossJoin(F.broadcast(dangling)).select("id", "p", "total", (new + walk).alias("rank"), F.col("rank").alias("was")))
        delta = nxt.agg(F.sum(F.abs(F.col("rank") - F.col("was")))).first()[0]
        state = nxt.drop("was")
        if delta is None or delta <= tolerance:
            break
    return state.select("id", "rank")


def _round(links: DataFrame, state: DataFrame, r: int, few: bool, resolution: float) -> DataFrame:
    """(id, k, community, moved) after one more round of links (id, nbr, w, k, total, turns) and state (id, k, community).

    Links lie by id and hold each node itself, at no weight, for staying. With
    few nodes their communities are broadcast, and no link is shuffled.
    """
    mass = state.groupBy("community").agg(F.sum("k").alias("mass"))
    at = state.select(F.col("id").alias("nbr"), "community").join(F.broadcast(mass) if few else mass, "community")
    options = links.join(F.broadcast(at) if few else at, "nbr").groupBy("id", "community").agg(
        F.sum("w").alias("w"), F.max(F.col("id") == F.col("nbr")).alias("own"), *[F.max(c).alias(c) for c in ("mass", "k", "total", "turns")]
    )
    others = F.col("mass") - F.when(F.col("own"), F.col("k")).otherwise(0.0)
    gain = F.round(F.col("w") - resolution * F.col("k") * others / F.col("total"), 9)
    best = options.groupBy("id").agg(
        F.min(F.struct((-gain).alias("g"), "community"))["community"].alias("new"), F.max(F.when(F.col("own"), F.col("community"))).alias("was"), F.max("k").alias("k"), F.max("turns").alias("turns")
    )
    turn = F.shiftright("turns", r // 2).bitwiseAND(F.lit(1)) == r % 2
    return best.select("id", "k", F.when(turn, F.col("new")).otherwise(F.col("was")).alias("community"), (turn & (F.col("new") != F.col("was"))).alias("moved"))


def _summed(key: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key, where = np.unique(key, return_inverse=True)
    return key, np.bincount(where, weights=w, minlength=len(key))


def _held_rounds(links: DataFrame, node: DataFrame, rounds: int, resolution: float) -> DataFrame:
    """(id, community) after rounds over links (id, nbr, w), which lie by id, of at most HELD_NODES nodes (id, k, total, turns).

    Links are packed into blocks of places of their nodes once. Where each node
    is goes to tasks by broadcast, so that a round is one stage over blocks,
    without a shuffle; only what moves comes back.
    """
    spark = node.sparkSession
    held = node.select("id", "k", "total", "turns").toArrow()
    ids = held["id"].to_numpy()
    order = np.argsort(ids)
    ids, k, total, turns = (held[c].to_numpy()[order] for c in ("id", "k", "total", "turns"))
    fixed = spark.sparkContext.broadcast((ids, k, total, turns))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = fixed.value[0]
        for batch in batches:
            places = [np.searchsorted(ids, batch[c].to_numpy()).astype(np.int32).tobytes() for c in ("id", "nbr")]
            yield pd.DataFrame([(*places, batch["w"].to_numpy().tobytes())], columns=["at", "to", "w"])

    def moves(shared, r: int):
        def move(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, k, total, turns = fixed.value
            community, mass = shared.value
            n, found = len(ids), []
            takes_turn = ((turns >> (r // 2)) & 1) == r % 2
            for row in (row for batch in batches for row in batch.itertuples(index=False)):
                at = np.frombuffer(row.at, dtype=np.int32).astype(np.int64)
                turn = takes_turn[at]
                to = community[np.frombuffer(row.to, dtype=np.int32)[turn]]
                found.append(_summed(at[turn] * n + to, np.frombuffer(row.w)[turn]))
            if not found:
                return
            key, w = map(np.concatenate, zip(*found))
            own = np.unique(key // n)
            # a node may stay, at no weight of its own
            key, w = _summed(np.concatenate([key, own * n + community[own]]), np.concatenate([w, np.zeros(len(own))]))
            at, to = key // n, key % n
            others = mass[to] - np.where(community[at] == to, k[at], 0.0)
            gain = np.round(w - resolution * k[at] * others / total[at], 9)
            best = np.lexsort((to, -gain, at))
            at, to = at[best], to[best]
            goes = np.append(True, at[1:] != at[:-1])[: len(at)] & (to != community[at])
            yield pd.DataFrame({"at": at[goes], "to": to[goes]})

        return move

    blocks = links.select("id", "nbr", "w").mapInPandas(pack, "at binary, to binary, w binary").persist()
    community = np.arange(len(ids))
    for r in range(rounds):
        shared = spark.sparkContext.broadcast((community, np.bincount(community, weights=k, minlength=len(ids))))
        moved = blocks.mapInPandas(moves(shared, r), "at long, to long").toArrow()
        shared.unpersist()
        community = community.copy()
        community[moved["at"].to_numpy()] = moved["to"].to_numpy()
        if r % 2 and not moved.num_rows:
            break
    blocks.unpersist()
    fixed.unpersist()
    return spark.createDataFrame(pd.DataFrame({"id": ids, "community": ids[community]}), "id long, community long")


def _local_moves(adj: DataFrame, nodes: DataFrame, rounds: int, resolution: float = 1.0) -> DataFrame:
    """(id, community): nodes move to the neighbouring community of most modularity gain, by turns.

    adj: (id, nbr, w) by number; nodes: (id, name, part). Turns are by the
    parity of the name's and the round's hash, so that a pair doesn't swap for
    ever; the smallest community wins a tie. Each part is a graph of its own; no
    link joins two. Links are dealt out by id once for all rounds.
    """
    weighted = settle(nodes.join(adj.groupBy("id").agg(F.sum("w").alias("k")), "id"))
    n = weighted.count()
    few = n <= BROADCAST_NODES
    totals = weighted.groupBy("part").agg(F.sum("k").alias("total"))
    bits = [F.shiftleft(F.pmod(F.xxhash64("name", F.lit(h)), F.lit(2)), h) for h in range((rounds + 1) // 2)]
    turns = bits[0]
    for bit in bits[1:]:
        turns = turns.bitwiseOR(bit)
    node = settle(weighted.join(totals, "part").select("id", "k", "total", turns.alias("turns")))
    between = adj.where("id != nbr").select("id", "nbr", "w")
    if n <= HELD_NODES:
        links = between.repartition(1 + between.count() // LINKS_A_TASK, "id").sortWithinPartitions("id", "nbr")
        state = settle(_held_rounds(links, node, rounds, resolution))
    else:
        each = between.unionByName(node.select("id", F.col("id").alias("nbr"), F.lit(0.0).alias("w")))
        links = settle(each.join(node, "id"))
        links = links.repartition(1 + links.count() // LINKS_A_TASK, "id").persist()
        state = node.select("id", "k", F.col("id").alias("community"))
        for r in range(rounds):
            nxt = settle(_round(links, state, r, few, resolution))
            state = nxt.drop("moved")
            if r % 2 and nxt.where("moved").isEmpty():
                break
        links.unpersist()
    return state.select("id", "community")


def communities(adj: DataFrame, rounds: int = 12, levels: int = 3, resolution: float = 1.0) -> DataFrame:
    """(id, community) of weighted adjacency in both directions, by local modularity moves and contraction, level by level.

    Each level's graph is that of the communities before. A column `part`, if
    adj has one, makes a graph of its own of each of its values, all searched at
    once. Nodes are numbered in the order of their ids, and rounds go by these
    numbers; there are 1 to 62 of them. The partition is
    deterministic; it needn't be that of a sequential search.
    """
    if not 1 <= rounds <= 2 * MOST_TURNS:
        raise ValueError(f"rounds are 1 to {2 * MOST_TURNS}")
    part = F.min("part") if "part" in adj.columns else F.lit(0)
    names = settle(ranked(adj.groupBy("id").agg(part.alias("part")), "id", name="no"))
    n = names.count()
    number = lambda side: _beside(names.select(F.col("id").alias(side), F.col("no").alias(f"{side}_no")), n, BROADCAST_NAMES)
    adj = settle(adj.join(number("id"), "id").join(number("nbr"), "nbr").select(F.col("id_no").alias("id"), F.col("nbr_no").alias("nbr"), "w"))
    nodes = names.select(F.col("no").alias("id"), F.col("id").alias("name"), "part")
    member = None
    for _ in range(levels):
        named = _local_moves(adj, nodes, rounds, resolution)
        heads = named.select(F.col("community").alias("id")).distinct()
        before, after = named.count(), heads.count()
        member = named if member is None else settle(member.join(named.select(F.col("id").alias("community"), F.col("community").alias("new")), "community").select("id", F.col("new").alias("community")))
        if after in (before, 1):
            break
        to = lambda side, name: _beside(named.select(F.col("id").alias(side), F.col("community").alias(name)), before, BROADCAST_NODES)
        adj = settle(adj.join(to("id", "a"), "id").join(to("nbr", "b"), "nbr").groupBy(F.col("a").alias("id"), F.col("b").alias("nbr")).agg(F.sum("w").alias("w")))
        nodes = nodes.join(heads, "id", "left_semi")
    called = lambda side: names.select(F.col("no").alias(side), F.col("id").alias(f"{side}_name"))
    return member.join(called("id"), "id").join(called("community"), "community").select(F.col("id_name").alias("id"), F.col("community_name").alias("community"))


def hubs(adj: DataFrame, nodes: DataFrame, percentile: float) -> DataFrame:
    """(id): nodes with more links than the node at that place of all nodes in order of their links.

    The place is found over the counts of nodes by degree, a row a degree.
    """
    degree = settle(nodes.select("id").distinct().join(adj.where("id != nbr").groupBy("id").agg(F.countDistinct("nbr").alias("degree")), "id", "left").fillna(0, ["degree"]))
    upto = W.orderBy("degree").rowsBetween(W.unboundedPreceding, W.currentRow)
    counted = degree.groupBy("degree").agg(F.count(F.lit(1)).alias("n")).select("degree", F.sum("n").over(upto).alias("upto"))
    place = max(0, int(degree.count() * percentile // 100) - 1)
    least = counted.where(F.col("upto") > place).agg(F.min("degree")).first()[0]
    return degree.where(F.col("degree") > F.lit(least)).select("id")


def attach_hubs(adj: DataFrame, member: DataFrame, hub: DataFrame) -> DataFrame:
    """(id, community) of the hubs: that of most of a hub's neighbours, the smallest of those that tie; its own without any.

    Hubs vote in the order of their ids: one counts for those after it. Votes
    are counted for all of them at once, again until nothing changes, which is
    the result of asking one after the other.
    """
    links = settle(adj.where("id != nbr").join(_beside(hub, hub.count(), BROADCAST_NAMES), "id").select("id", "nbr").distinct())
    plain = settle(links.join(member.select(F.col("id").alias("nbr"), "community"), "nbr").groupBy("id", "community").agg(F.count(F.lit(1)).alias("votes")))
    between = settle(links.join(hub.select(F.col("id").alias("nbr")), "nbr").where("nbr < id"))
    now = None
    while True:
        votes = plain
        if now is not None:
            votes = plain.unionByName(between.join(now.select(F.col("id").alias("nbr"), "community"), "nbr").groupBy("id", "community").agg(F.count(F.lit(1)).alias("votes")))
        summed = votes.groupBy("id", "community").agg(F.sum("votes").alias("votes"))
        best = summed.groupBy("id").agg(F.min(F.struct((-F.col("votes")).alias("v"), "community"))["community"].alias("community"))
        nxt = settle(hub.join(best, "id", "left").select("id", F.coalesce("community", "id").alias("community")))
        if now is not None and nxt.exceptAll(now).isEmpty():
            return nxt
        now = nxt


def split_communities(adj: DataFrame, member: DataFrame, wanted: DataFrame, rounds: int, levels: int) -> DataFrame:
    """(id, community): member with each of the wanted communities searched as a graph of its own, all at once.

    A community without a link inside falls into single nodes; one that the
    search leaves whole stays.
    """
    of = settle(member.join(wanted, "community", "left_semi"))
    n = of.count()
    side = lambda x, name: _beside(of.select(F.col("id").alias(x), F.col("community").alias(name)), n, BROADCAST_NAMES)
    inside = settle(adj.where("id != nbr").join(side("id", "part"), "id").join(side("nbr", "other"), "nbr").where("part = other").select("id", "nbr", "w", "part"))
    if inside.isEmpty():
        found = of.select("id", F.col("id").alias("piece"))
    else:
        found = of.join(communities(inside, rounds, levels).withColumnRenamed("community", "piece"), "id", "left").select("id", F.coalesce("piece", "id").alias("piece"))
    return settle(member.join(found, "id", "left").select("id", F.coalesce("piece", "community").alias("community")))


def cluster(
    adj: DataFrame,
    nodes: DataFrame,
    hub_percentile: float | None = None,
    rounds: int = 12,
    levels: int = 3,
    resolution: float = 1.0,
    largest_share: float = LARGEST_SHARE,
    least_split: int = LEAST_SPLIT,
    loose: float = LOOSE,
    loose_size: int = LOOSE_SIZE,
) -> DataFrame:
    """(id, community): every node's community, numbered from 0 by size, then by the smallest member.

    Nodes above the percentile of degrees are left out of the search and
    attached to the community of most of their neighbours. Then communities of
    more than a share of all nodes are split, and after them those of many
    nodes with few of their possible links. Nodes without a link are alone.
    """
    adj = settle(adj.select("id", "nbr", "w"))
    every = settle(nodes.select("id").distinct())
    inner, hub = adj, None
    if hub_percentile is not None:
        hub = settle(hubs(adj, every, hub_percentile))
        out = _beside(hub, hub.count(), BROADCAST_NAMES)
        inner = adj.join(out, "id", "left_anti").join(out.select(F.col("id").alias("nbr")), "nbr", "left_anti").select("id", "nbr", "w")
        every = every.join(hub, "id", "left_anti")
    inner = settle(inner.where("id != nbr"))
    named = every.withColumn("community", F.col("id"))
    member = named if inner.isEmpty() else every.join(communities(inner, rounds, levels, resolution), "id", "left").select("id", F.coalesce("community", "id").alias("community"))
    member = settle(member)
    if hub is not None:
        member = settle(member.unionByName(attach_hubs(adj, member, hub)))
    most = max(least_split, int(member.count() * largest_share))
    large = settle(member.groupBy("community").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("community"))
    if not large.isEmpty():
        member = split_communities(adj, member, large, rounds, levels)
    scattered = settle(_loose(adj, member, loose, loose_size))
    if not scattered.isEmpty():
        member = split_communities(adj, member, scattered, rounds, levels)
    sizes = ranked(member.groupBy("community").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least")), F.desc("n"), "least", name="no")
    return member.join(sizes.select("community", (F.col("no") - 1).alias("no")), "community").select("id", F.col("no").alias("community"))


def _loose(adj: DataFrame, member: DataFrame, loose: float, size: int) -> DataFrame:
    """(community): those of at least `size` nodes with less than a share of their possible links."""
    n = member.count()
    side = lambda x, name: _beside(member.select(F.col("id").alias(x), F.col("community").alias(name)), n, BROADCAST_NAMES)
    inside = adj.where("id < nbr").join(side("id", "community"), "id").join(side("nbr", "other"), "nbr").where("community = other").select("community", "id", "nbr").distinct()
    links = inside.groupBy("community").agg(F.count(F.lit(1)).alias("links"))
    sizes = member.groupBy("community").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= size)
    possible = F.col("n").cast("double") * (F.col("n") - 1) / 2
    return sizes.join(links, "community", "left").where(F.coalesce("links", F.lit(0)) / possible < loose).select("community")


def modularity(adj: DataFrame, membership: DataFrame) -> DataFrame:
    """One row: the modularity of a membership over weighted adjacency in both directions."""
    m = lambda side: membership.select(F.col("id").alias(side), F.col("community").alias(f"c_{side}"))
    j = adj.join(m("id"), "id").join(m("nbr"), "nbr")
    by = j.groupBy(F.col("c_id").alias("community")).agg(F.sum("w").alias("degree"), F.sum(F.when(F.col("c_id") == F.col("c_nbr"), F.col("w")).otherwise(0.0)).alias("inside"))
    total = adj.agg(F.sum("w").alias("total"))
    return by.crossJoin(F.broadcast(total)).agg(F.sum(F.col("inside") / F.col("total") - F.pow(F.col("degree") / F.col("total"), 2)).alias("modularity"))


def betweenness(adj: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, score): Brandes' dependencies summed over the sources, all of which advance together.

    A node whose only neighbour has others is on no path between two others:
    it is folded into that neighbour, as a target and, if it is one, a source
    more there, and what paths from or to it add to the neighbour is counted.
    The state is a row for each of the other sources and node that it reaches:
    give all nodes as sources for exact scores where these are few, a block of
    them at a time, or a sample, for a large graph; scores of blocks add up.
    """
    adj = settle(adj.select("id", "nbr"))
    ends = adj.select("id", "nbr", F.lit(1).alias("n")).unionByName(adj.select(F.col("nbr").alias("id"), F.col("id").alias("nbr"), F.lit(1).alias("n")))
    single = ends.groupBy("id").agg(F.min("nbr").alias("hub"), F.max("nbr").alias("other"), F.count(F.lit(1)).alias("n")).where("hub = other and hub != id and n = 2")
    both = adj.join(adj.select(F.col("nbr").alias("id"), F.col("id").alias("nbr")), ["id", "nbr"], "left_semi")
    # one link each way; of two nodes that have only one another, neither is folded
    leaf = single.select("id", "hub").join(both.select("id", F.col("nbr").alias("hub")), ["id", "hub"], "left_semi")
    leaf = settle(leaf.join(single.select(F.col("id").alias("hub")), "hub", "left_anti").select("id", "hub"))
    asked = sources.select("id").distinct().withColumn("asked", F.lit(1))
    member = ends.select("id").unionByName(sources.select("id")).distinct().join(leaf, "id", "left").join(asked, "id", "left")
    member = settle(member.select("id", F.coalesce("hub", "id").alias("core"), F.col("hub").isNotNull().cast("long").alias("leaf"), F.coalesce("asked", F.lit(0)).cast("long").alias("asked")))
    core = settle(
        member.groupBy(F.col("core").alias("id")).agg(F.count(F.lit(1)).alias("targets"), F.sum("asked").alias("asked"), F.sum("leaf").alias("leaves"), F.sum(F.col("leaf") * F.col("asked")).alias("asked_leaves"))
    )
    adj = settle(adj.join(leaf, "id", "left_anti").join(leaf.select(F.col("id").alias("nbr")), "nbr", "left_anti").select("id", "nbr"))
    front = settle(core.where("asked > 0").select(F.col("id").alias("s"), "id", F.lit(1.0).alias("paths")))
    levels, seen = [front], front.select("s", "id")
    while True:
        step = levels[-1].join(adj, "id").groupBy("s", F.col("nbr").alias("id")).agg(F.sum("paths").alias("paths"))
        nxt = settle(step.join(seen, ["s", "id"], "left_anti"))
        if nxt.isEmpty():
            break
        levels.append(nxt)
        seen = seen.unionByName(nxt.select("s", "id"))
    weight = core.select("id", "targets")
    flow = levels[-1].withColumn("score", F.lit(0.0))
    total = flow.select("s", "id", "score").where("false")
    for level in reversed(levels[:-1]):
        total = total.unionByName(flow.select("s", "id", "score"))
        give = flow.join(weight, "id").select("s", F.col("id").alias("nbr"), ((F.col("targets") + F.col("score")) / F.col("paths")).alias("unit"))
        back = level.join(adj, "id").join(give, ["s", "nbr"]).groupBy("s", "id").agg(F.sum(F.col("paths") * F.col("unit")).alias("score"))
        flow = settle(level.join(back, ["s", "id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0))))
    asking = core.select(F.col("id").alias("s"), "asked")
    between = total.where("s != id").join(asking, "s").groupBy("id").agg(F.sum(F.col("score") * F.col("asked")).alias("score"))
    # sources that come to a node from elsewhere, and targets that its own sources go to
    come = seen.where("s != id").join(asking, "s").groupBy("id").agg(F.sum("asked").alias("come"))
    go = seen.join(weight, "id").groupBy(F.col("s").alias("id")).agg(F.sum("targets").alias("go"))
    at = settle(core.join(between, "id", "left").join(come, "id", "left").join(go, "id", "left").fillna(0, ["score", "come", "go"]))
    own = F.col("leaves") * F.col("come") + F.when(F.col("asked_leaves") > 0, F.col("asked_leaves") * (F.col("go") - 2)).otherwise(0)
    whole = at.select(F.col("id").alias("core"), (F.col("score") + own).alias("score"), (F.col("come") + F.col("asked")).alias("reach"))
    scored = member.join(whole, "core").where(F.col("reach") > F.col("asked"))
    return scored.select("id", F.when(F.col("leaf") == 1, 0.0).otherwise(F.col("score")).alias("score"))


def hierarchy(arcs: DataFrame) -> DataFrame:
    """(id, depth, path): each node below the roots of (parent, child) arcs with its ancestors, root first.

    A child of several parents takes the path smallest in order; an arc that
    would close a cycle is not followed.
    """
    parents, children = arcs.select(F.col("parent").alias("id")).distinct(), arcs.select(F.col("child").alias("id")).distinct()
    level = settle(parents.join(children, "id", "left_anti").select("id", F.array().cast("array<string>").alias("path")))
    out = level.withColumn("depth", F.lit(0))
    for d in count(1):  # ends, since no level has a node of one before
        step = level.join(arcs, level["id"] == arcs["parent"]).select(F.col("child").alias("id"), F.concat("path", F.array("parent")).alias("path"))
        step = step.where(~F.array_contains("path", F.col("id"))).groupBy("id").agg(F.min("path").alias("path"))
        level = settle(step.join(out.select("id"), "id", "left_anti"))
        if level.isEmpty():
            break
        out = out.unionByName(level.withColumn("depth", F.lit(d)))
    return out


def merge_bases(parents: DataFrame, left: str, right: str) -> DataFrame:
    """(id): common ancestors of two commits that no other common ancestor descends from; parents: (id, nbr)."""
    spark = parents.sparkSession
    reach = lambda x: bfs(parents, spark.createDataFrame([(x,)], "id string")).select("id")
    common = settle(reach(left).intersect(reach(right)))
    dominated = common.join(parents, "id").select(F.col("nbr").alias("id")).distinct()
    return common.join(dominated, "id", "left_anti")


def attach_orphans(nodes: DataFrame, pairs: DataFrame, containers: DataFrame) -> DataFrame:
    """(id, anchor): nodes without neighbours, dealt over the first ceil(sqrt(n)) containers of their source."""
    lonely = nodes.join(pairs.select("id").distinct(), "id", "left_anti").join(containers.select(F.col("id")), "id", "left_anti")
    by = W.partitionBy("source_file").orderBy("id")
    anchors = containers.select("source_file", F.col("id").alias("anchor"), (F.row_number().over(by) - 1).alias("slot"), F.count(F.lit(1)).over(W.partitionBy("source_file")).alias("n"))
    width = F.least(F.col("n"), F.ceil(F.sqrt(F.col("orphans"))))
    counted = lonely.select("source_file", "id", (F.row_number().over(by) - 1).alias("no"), F.count(F.lit(1)).over(W.partitionBy("source_file")).alias("orphans"))
    sized = counted.join(anchors.groupBy("source_file").agg(F.max("n").alias("n")), "source_file").withColumn("slot", F.pmod(F.col("no"), width).cast("int"))
    return sized.join(anchors.select("source_file", "slot", "anchor"), ["source_file", "slot"]).select("id", "anchor")
