"""Rounds of the community search: one stage each while nodes are few, the same moves by joins beyond."""

import random

import pytest

from strandwise.operators import graph


def both(spark, links):
    return spark.createDataFrame([(a, b, w) for x, y, w in links for a, b in ((x, y), (y, x))], "id string, nbr string, w double")


def some_links(seed, n=40, m=110):
    rng = random.Random(seed)
    return [(*sorted(rng.sample([f"n{k:02}" for k in range(n)], 2)), rng.choice([0.3, 0.6, 1.0, 7.0])) for _ in range(m)] + [("n00", "n00", 2.0)]


def last_job(spark):
    spark.range(1).count()
    return max(spark.sparkContext.statusTracker().getJobIdsForGroup(None))


def test_a_round_is_a_job(spark):
    adj = both(spark, some_links(1)).cache()
    jobs = {}
    for rounds in (2, 12):
        first = last_job(spark)
        graph.communities(adj, rounds, 1).count()
        jobs[rounds] = last_job(spark) - first
    assert jobs[12] - jobs[2] <= 2 * 10, jobs


@pytest.mark.parametrize("seed", [2])
def test_rounds_by_joins_are_the_same(spark, monkeypatch, seed):
    adj = both(spark, some_links(seed)).cache()
    nodes = spark.createDataFrame([(f"n{k:02}",) for k in range(42)], "id string")
    want = sorted(map(tuple, graph.cluster(adj, nodes, 90.0, 6, 2).collect()))
    parts = adj.where("substr(id, 2, 1) = substr(nbr, 2, 1)").withColumn("part", adj.id.substr(2, 1))
    apart = sorted(map(tuple, graph.communities(parts, 6, 2).collect()))
    for bound in ("BROADCAST_NODES", "BROADCAST_NAMES", "HELD_NODES"):
        monkeypatch.setattr(graph, bound, 0)
    assert sorted(map(tuple, graph.cluster(adj, nodes, 90.0, 6, 2).collect())) == want and len({c for _, c in want}) > 3
    assert sorted(map(tuple, graph.communities(parts, 6, 2).collect())) == apart and apart
