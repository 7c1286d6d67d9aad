"""Edges merged by numbers only, and the emissions around a few nodes."""

import contextlib
import io

from strandwise.operators import build
from strandwise.operators.iterate import settle

EMISSIONS = "src string, tgt string, relation string, confidence string, weight double, source_file string"
ROWS = [
    ("a", "b", "r", "AMBIGUOUS", 1.0, "f"),
    ("a", "b", "r", "INFERRED", None, "e"),
    ("a", "b", "s", "guess", 2.0, "f"),
    ("a", "b", "s", "hunch", 1.0, "f"),
    ("a", "b", "s", None, 3.0, None),
    ("b", "c", "r", None, None, "f"),
    ("b", None, "r", "hunch", 1.0, "f"),
    ("b", None, "r", "EXTRACTED", 0.5, "f"),
    ("d", "d", "r", "INFERRED", 0.5, "f"),
]


def shown(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


def test_merged_edges_are_those_with_evidence_and_nothing_is_sorted(spark):
    emissions = spark.createDataFrame(ROWS * 3, EMISSIONS)
    columns = [*build.EDGE_KEY, "weight", "confidence"]
    merged = build.merge_edges(emissions)
    assert sorted(map(str, merged.collect())) == sorted(map(str, build.merge_evidence(emissions).select(columns).collect()))
    assert "SortAggregate" not in shown(merged) and "HashAggregate" in shown(merged)


def test_touching_gives_each_emission_of_an_end_once(spark):
    emissions = spark.createDataFrame(ROWS, EMISSIONS)
    for ids in (["a"], ["b", "c"], ["d"], ["x"]):
        found = build.touching(emissions, settle(spark.createDataFrame([(i,) for i in ids], "id string")))
        assert sorted(map(str, map(tuple, found.collect()))) == sorted(str(r) for r in ROWS if r[0] in ids or r[1] in ids)


def test_risky_chains_merge_only_what_is_near(spark):
    from strandwise.plans import catalogue

    assert "SortAggregate" not in shown(catalogue.QUERIES["f16_risky_chains"](spark, "/root/testdata/sf0.001"))


def test_counted_evidence_is_that_of_the_gathered(spark, monkeypatch):
    many = [("a", "b", "r", c, 1.0, f"f{i % 90:02d}") for i in range(270) for c in ("EXTRACTED", "guess")]
    emissions = spark.createDataFrame(ROWS * 2 + many, EMISSIONS)
    gathered = build.merge_evidence(emissions).drop("evidence")
    counted = build.count_evidence(emissions)
    assert "ObjectHashAggregate" not in shown(counted) and "SortAggregate" not in shown(counted)
    expected = sorted(map(str, gathered.collect()))
    assert sorted(map(str, counted.select(gathered.columns).collect())) == expected
    monkeypatch.setattr(build, "MOST_MARKS", 5)
    assert sorted(map(str, build.count_evidence(emissions).select(gathered.columns).collect())) == expected
