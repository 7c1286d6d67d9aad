"""Paths meet by whole paths: an end that many share, even the empty one of a closing slash, makes no pairs of its own."""

from strandwise.operators import temporal


def test_shared_ends(spark):
    paths = ["a/b/c/", "b/c/", "c/", "x/b/c", "b/c", "c", "a//c", "", "/"] + [f"h/{k}/" for k in range(20)]
    others = [p[p.index("/") + 1 :] for p in paths if "/" in p]
    found = temporal.path_matches(spark.createDataFrame([(p,) for p in paths], "path string"), spark.createDataFrame([(p,) for p in others], "other string"))
    want = {(p, o) for p in paths for o in others if p == o or p.endswith("/" + o) or o.endswith("/" + p)}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_joins_are_on_whole_paths(spark):
    one = spark.createDataFrame([(f"h/{k}/",) for k in range(3)], "path string")
    plan = temporal.path_matches(one, one.selectExpr("path as other"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 2 and " OR " not in plan
