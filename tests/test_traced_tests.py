"""Tests of what a node calls are made distinct in parts of a bounded number of rows."""

from strandwise.operators import review


def test_parts_follow_pairs(spark, monkeypatch):
    calls = spark.createDataFrame([(f"a{k}", f"b{k % 3}") for k in range(12)] + [("a0", "b1")], "id string, nbr string")
    tested = spark.createDataFrame([(f"t{k}", f"b{k % 3}") for k in range(9)] + [("t0", "b1"), ("t0", "b1")], "test string, id string")
    want = sorted({(a, t) for a, b in [(f"a{k}", f"b{k % 3}") for k in range(12)] + [("a0", "b1")] + [(f"b{k}", f"b{k}") for k in range(3)] for t, x in {(f"t{k}", f"b{k % 3}") for k in range(9)} | {("t0", "b1")} if x == b})
    monkeypatch.setattr(review, "TASK_PAIRS", 10)
    found = review.transitive_tests(calls, tested)
    assert sorted(map(tuple, found.collect())) == want
    assert found.rdd.getNumPartitions() == 6
    assert review.transitive_tests(calls, tested.limit(0)).count() == 0
