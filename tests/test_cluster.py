"""Rules around the community search: hubs, votes, splits, numbers."""

import random
from collections import Counter, defaultdict

from strandwise.operators import graph
from strandwise.operators.build import merge_evidence
from strandwise.operators.search import weighted_adjacency
from strandwise.plans.traversal import QUERIES
from strandwise.sources import star

SF = "/root/testdata/sf0.001"


def both(spark, links):
    return spark.createDataFrame([(a, b, w) for x, y, w in links for a, b in ((x, y), (y, x))], "id string, nbr string, w double")


def nodes_of(spark, names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def test_hubs_and_votes_by_hand(spark):
    rng = random.Random(5)
    names = [f"n{k:02}" for k in range(60)]
    links = {tuple(sorted(rng.sample(names, 2))) for _ in range(90)}
    links |= {tuple(sorted((h, n))) for h in ("n07", "n30", "n31") for n in rng.sample(names, 25) if n != h} | {("n30", "n31"), ("n07", "n31")}
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    adj = both(spark, [(a, b, 1.0) for a, b in links])
    for percentile in (50.0, 90.0, 97.0, 100.0):
        degrees = sorted(len(near[n]) for n in names)
        least = degrees[max(0, int(len(degrees) * percentile // 100) - 1)]
        want = {n for n in names if len(near[n]) > least}
        hub = graph.hubs(adj, nodes_of(spark, names), percentile)
        assert {r.id for r in hub.collect()} == want
        member = {n: f"c{k % 4}" for k, n in enumerate(names) if n not in want}
        rows = spark.createDataFrame(list(member.items()), "id string, community string")
        got = {r.id: r.community for r in graph.attach_hubs(adj, rows, hub).collect()}
        for h in sorted(want):
            votes = Counter(member[n] for n in near[h] if n in member)
            member[h] = min(votes, key=lambda c: (-votes[c], c)) if votes else h
        assert got == {h: member[h] for h in want}


def clique(names, w=1.0):
    return [(a, b, w) for i, a in enumerate(names) for b in names[i + 1 :]]


def test_splits_numbers_and_isolates(spark):
    groups = [[f"{g}{k:02}" for k in range(n)] for g, n in (("a", 12), ("b", 9), ("c", 7))]
    links = [x for g in groups for x in clique(g)] + [("a00", "b00", 0.1), ("b01", "c01", 0.1)]
    names = [n for g in groups for n in g] + ["lonely", "zero"]
    got = {r.id: r.community for r in graph.cluster(both(spark, links), nodes_of(spark, names)).collect()}
    assert [{got[n] for n in g} for g in groups] == [{0}, {1}, {2}] and (got["lonely"], got["zero"]) == (3, 4)
    # two communities joined by force are taken apart again, each as its own graph, and a third one stays as it is
    member = spark.createDataFrame([(n, "x" if n[0] in "ab" else "y") for n in names], "id string, community string")
    wanted = spark.createDataFrame([("x",)], "community string")
    apart = {r.id: r.community for r in graph.split_communities(both(spark, links), member, wanted, 12, 3).collect()}
    assert len({apart[n] for n in groups[0]}) == len({apart[n] for n in groups[1]}) == 1 and apart["a00"] != apart["b00"]
    assert {apart[n] for n in groups[2]} == {"y"} and apart["lonely"] == "y"
    none = spark.createDataFrame([("p", "x"), ("q", "x")], "id string, community string")
    assert {r.community for r in graph.split_communities(both(spark, links), none, wanted, 4, 1).collect()} == {"p", "q"}
    assert graph.cluster(both(spark, links).limit(0), nodes_of(spark, ["p", "q"])).count() == 2


def test_loose_communities(spark):
    ring = [(f"r{k:02}", f"r{(k + 1) % 60:02}", 1.0) for k in range(60)]
    member = spark.createDataFrame([(f"r{k:02}", "ring") for k in range(60)] + [(f"q{k}", "few") for k in range(20)], "id string, community string")
    assert [r.community for r in graph._loose(both(spark, ring), member, 0.05, 50).collect()] == ["ring"]
    assert graph._loose(both(spark, ring), member, 0.03, 50).count() == 0


def test_all_links(spark):
    adj = weighted_adjacency(merge_evidence(star.emissions(spark, SF)))
    found = QUERIES["h7_communities"](spark, SF).cache()
    nodes = star.nodes(spark, SF)
    assert found.count() == nodes.count() == found.select("id").distinct().count()
    sizes = [r["count"] for r in found.groupBy("community").count().orderBy("community").collect()]
    assert sizes == sorted(sizes, reverse=True) and sizes[0] <= max(10, nodes.count() * 0.25)
    assert graph.modularity(adj, found).first().modularity > 0.2
