"""Edges meet only those of their ends that are missing or odd, by broadcast up to a number and in parts beyond it."""

import pytest

from strandwise.operators import build, composite

NODES = [("a", "x"), ("b", "y"), ("c", "x"), ("n", None)]
EDGES = [("a", "b", "r"), ("b", "a", "r"), ("a", "gone", "r"), ("gone", "b", "q"), ("a", "c", "q"), ("a", None, "r"), (None, "b", "r"), ("commit:1", "a", "r"), ("a", "b", None), ("n", "b", "r"), ("n", "b", "q"), ("lost", "lost", "r")] * 2


def frames(spark):
    nodes = spark.createDataFrame([(i, t, i, "f") for i, t in NODES], "id string, node_type string, label string, source_file string")
    return nodes, spark.createDataFrame([(s, t, r, "EXTRACTED", "f") for s, t, r in EDGES], "src string, tgt string, relation string, confidence string, source_file string")


@pytest.fixture(params=[2_000_000, 0])
def most(request, monkeypatch):
    monkeypatch.setattr(build, "BROADCAST_ENDS", request.param)
    monkeypatch.setattr(build, "TASK_EDGES", 5)
    return request.param


def test_live(spark, most):
    nodes, edges = frames(spark)
    ids = {i for i, _ in NODES}
    kept = build.keep_live_endpoints(edges, nodes)
    assert kept.columns == edges.columns
    assert sorted((r[0], r[1], r[2] or "") for r in kept.collect()) == sorted((s, t, r or "") for s, t, r in EDGES if s in ids and t in ids)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert ("SortMergeJoin" in plan) == (most == 0) and ("BroadcastHashJoin" in plan) == (most > 0)


def test_dangling(spark, most):
    nodes, edges = frames(spark)
    ids = {i for i, _ in NODES}
    want = [(" ".join((s, r, t)), f"{name} doesn't exist") for s, t, r in EDGES if None not in (s, t, r) for name, x in (("src", s), ("tgt", t)) if x not in ids and not x.startswith("commit:")]
    assert sorted(r for r in map(tuple, build.validate(nodes, edges).collect()) if "exist" in r[1] and "None" not in r[0] and r[0].count(" ") == 2) == sorted(want)


def test_profile(spark, most):
    nodes, edges = frames(spark)
    got = composite.validate_profile(nodes, edges, ["x", "y"], {"r": ("x", "y")})
    assert sorted(r["subject"] for r in got.collect()) == sorted(["b r a", "a q c", "n q b"] * 2)


def test_sources_that_go_are_broadcast(spark):
    nodes, edges = frames(spark)
    gone = spark.createDataFrame([("f",), ("g",)], "source_file string")
    left, links = build.prune_sources(nodes, edges, gone)
    assert left.count() == links.count() == 0
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
    left, links = build.prune_sources(nodes, edges, gone.where("source_file = 'g'"))
    assert left.count() == len(NODES) and links.count() == build.keep_live_endpoints(edges, nodes).count()
