"""Pairs of versions are compared once each, in tasks dealt by number, by digests of their lines."""

from pyspark.sql import functions as F

from strandwise.operators import revisions as R


def lines_of(spark, texts):
    return spark.createDataFrame(list(texts.items()), "oid string, text string").select("oid", R.line_digests(F.col("text")).alias("lines"))


def test_digests_follow_lines(spark):
    texts = {"e": "", "n": None, "a": "x\n\ny", "b": "x\n", "c": "x", "d": "\n\n"}
    sizes = {r["oid"]: len(r["lines"]) for r in lines_of(spark, texts).collect()}
    assert sizes == {k: len(R.split_lines(t)) for k, t in texts.items()}
    first = {r["oid"]: [bytes(x) for x in r["lines"]][:1] for r in lines_of(spark, texts).collect()}
    assert first["a"] == first["b"] != first["c"]


def test_stretches_and_tasks(spark, monkeypatch):
    monkeypatch.setattr(R, "TASK_PAIRS", 2)
    monkeypatch.setattr(R, "HELD_LINES", 3)
    texts = {"a": "1\n2\n3\n4\n", "b": "1\n2\nx\n4\n", "c": "2\n3\n4\n1\n", "d": ""}
    pairs = [(x, y) for x in texts for y in texts if x != y]
    found = R.compare(spark.createDataFrame(pairs, "oid string, from_oid string"), lines_of(spark, texts))
    got = {(r["oid"], r["from_oid"]): [(x["line"] + k, x["at_line"] + k) for x in r["runs"] for k in range(x["n"])] for r in found.collect()}
    want = {(x, y): [(j + 1, i + 1) for i, j in R.matched_lines(R.split_lines(texts[y]), R.split_lines(texts[x]))] for x, y in pairs}
    assert got == want
    assert found.rdd.getNumPartitions() == 6
