"""Projections of memory: gates, reasons, merges by brute force; stale and repeated cursors, half-written versions."""

import random

import pytest

from strandwise.operators import projection as mp

NODES, EDGES = "id string, node_type string", "src string, tgt string, relation string"
CANDIDATE = "record_id string, record_digest string, scope_ref string, state string, projection_eligible boolean, authorized boolean, eligible_now boolean, code_targets array<string>, citations array<string>"
DIGEST = "sha256:" + "0a" * 32


def record(key, targets=(), state="accepted_current", eligible=True, authorized=True, now=True):
    return (key, DIGEST, "scope", state, eligible, authorized, now, list(targets) if targets is not None else None, ["c"])


def projected(spark, records, ids, erased=()):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    return mp.project(frame(records, CANDIDATE), frame([(i,) for i in ids], "id string"), frame([(e,) for e in erased], "record_id string"))


def state(spark, path):
    nodes, edges = mp.read(spark, path)
    return sorted(r.id for r in nodes.collect()), sorted((e.src, e.tgt, e.relation) for e in edges.collect())


def test_gates_targets_and_reasons(spark):
    records = [
        record("a", ["x", "x", "y", "none", "memory:b"]), record("b", None), record("c", ["x"], authorized=None), record("d", ["x"], state="superseded"),
        record("e", ["x"], state=None), record("f", ["x"]), record("g", ["x"], now=False), record("h", ["x"], eligible=False),
    ]
    p = projected(spark, records, ["x", "y", "x", "memory:b"], erased=["f", "f"])
    assert sorted(r.id for r in p.nodes.collect()) == ["memory:a", "memory:b"]
    assert sorted((e.src, e.tgt, e.relation) for e in p.edges.collect()) == [("memory:a", "x", "memory_about"), ("memory:a", "y", "memory_about")]
    assert {r.record_id: r.reason for r in p.omitted.collect()} == {"c": "withheld", "d": "superseded", "e": "unknown", "f": "withheld", "g": "withheld", "h": "withheld"}


@pytest.mark.parametrize("bad", [("", DIGEST, "s"), ("k" * 513, DIGEST, "s"), (None, DIGEST, "s"), ("k", "sha256:00", "s"), ("k", DIGEST, "")])
def test_a_malformed_record_refuses_the_whole(spark, bad):
    with pytest.raises(ValueError, match="not a valid record"):
        projected(spark, [record("fine"), (*bad, *record("x")[3:])], ["x"])


def test_a_repeated_record_refuses_the_whole(spark):
    with pytest.raises(ValueError, match="repeats"):
        projected(spark, [record("a"), record("a", ["x"])], ["x"])


def test_merges_equal_brute_force_in_any_delivery(spark, tmp_path):
    rng, ids = random.Random(5), [f"n{k}" for k in range(8)]
    base = [("n0", "n1", "calls"), ("n1", "n2", "memory_about"), ("memory:r1", "n3", "cites"), ("n4", "memory:r2", "memory_about"), ("memory:r1", "memory:r2", "near")]
    path = str(tmp_path / "store")
    mp.begin(path, spark.createDataFrame([(i, "code") for i in [*ids, "memory:r1", "memory:r2"]], NODES), spark.createDataFrame(base, EDGES))
    nodes, edges, at, past = {*ids, "memory:r1", "memory:r2"}, set(base), -1, {}
    for cursor in (3, 3, 1, 7, 5, 7, 9):
        if cursor not in past:
            past[cursor] = [record(f"r{k}", rng.sample([*ids, "gone"], 3), state=rng.choice(["accepted_current"] * 3 + ["expired"])) for k in range(5)]
        got = mp.merge(spark, path, projected(spark, past[cursor], ids), cursor)
        if cursor <= at:
            assert got == ("stale" if cursor < at else "repeated", at, 0, 0)
        else:
            shown = {f"memory:{r[0]}": r[7] for r in past[cursor] if r[3] == "accepted_current"}
            mem = lambda x: x.startswith("memory:")
            old = {n for n in nodes if mem(n)}
            assert got == ("applied", cursor, len(shown.keys() - old), len(old - shown.keys()))
            nodes = {n for n in nodes if not mem(n)} | shown.keys()
            edges = {e for e in edges if e[0] in nodes and e[1] in nodes and not (e[2] == "memory_about" and (mem(e[0]) or mem(e[1])))}
            edges |= {(m, t, "memory_about") for m, ts in shown.items() for t in ts if t in nodes}
            at = cursor
        assert state(spark, path) == (sorted(nodes), sorted(edges))
    with pytest.raises(ValueError, match="two projections"):
        mp.merge(spark, path, projected(spark, [record("other")], ids), 9)
    assert state(spark, path) == (sorted(nodes), sorted(edges))


def test_a_merge_that_died_leaves_the_version_before_and_can_be_repeated(spark, tmp_path):
    path = str(tmp_path / "store")
    mp.begin(path, spark.createDataFrame([("x", "code")], NODES), spark.createDataFrame([], EDGES))
    spark.createDataFrame([("half", "code")], NODES).write.parquet(f"{path}/cursor=4/nodes")
    assert state(spark, path) == (["x"], [])
    assert mp.merge(spark, path, projected(spark, [record("a", ["x"])], ["x"]), 4).outcome == "applied"
    assert state(spark, path) == (["memory:a", "x"], [("memory:a", "x", "memory_about")])
    assert mp.merge(spark, path, projected(spark, [], ["x"]), 5) == ("applied", 5, 0, 1)
    assert state(spark, path) == (["x"], [])
