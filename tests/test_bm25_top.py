"""The best documents of each query, found in parts and blocks, are those of scoring all pairs, and no task gathers pairs."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandwise.functions.text import term_counts
from strandwise.operators import search

WORDS = "alpha beta gamma delta omega kappa".split()


def brute(docs, asked, n):
    """(query, rank, doc_id, score), a pair at a time, by the formula."""
    tokens = {d: {"label": (label or "").split(), "description": (text or "").split()} for d, label, text in docs}
    mean = {f: sum(len(t[f]) for t in tokens.values()) / len(tokens) for f in ("label", "description")}
    df, out = Counter(w for t in tokens.values() for w in set(t["label"] + t["description"])), []
    for q in {q for q, _ in asked}:
        scores = []
        for d, t in tokens.items():
            score = 0.0
            for w in {w for x, w in asked if x == q and df[w]}:
                tf = {f: t[f].count(w) for f in t}
                sat = sum(search.FIELD_WEIGHTS[f] * tf[f] * 2.2 / (tf[f] + 1.2 * (0.25 + 0.75 * len(t[f]) / mean[f])) for f in t if tf[f])
                score += math.log(1 + (len(tokens) - df[w] + 0.5) / (df[w] + 0.5)) * sat
            if score > 0:
                scores.append((-round(score, 6), d))
        out += [(q, rank + 1, d, -s) for rank, (s, d) in enumerate(sorted(scores)[:n])]
    return sorted(out)


def test_terms_are_counted_in_the_row(spark):
    df = spark.createDataFrame([(1, ["b", "a", "b", "c", "b"]), (2, []), (3, ["x"])], "id int, t array<string>")
    got = {r["id"]: [tuple(x) for x in r["n"]] for r in df.select("id", term_counts(F.col("t")).alias("n")).collect()}
    assert got == {1: [("a", 1), ("b", 3), ("c", 1)], 2: [], 3: [("x", 1)]}


@pytest.mark.parametrize("parts, pairs, queries, terms, cells", [(1_000, 10_000, 500, 1_000_000, 2_000_000), (7, 5, 3, 0, 20)])
def test_parts_and_blocks_give_the_same(spark, monkeypatch, parts, pairs, queries, terms, cells):
    for name, value in (("PART_DOCS", parts), ("BLOCK_PAIRS", pairs), ("BLOCK_QUERIES", queries), ("BROADCAST_TERMS", terms), ("CELLS", cells)):
        monkeypatch.setattr(search, name, value)
    texts = [" ".join(WORDS[(k * (j + 3) + j) % (2 + k % 5)] for j in range(1 + k % 9)) for k in range(60)] + ["", None, "alpha beta"]
    docs = [(k, WORDS[k % 6] if k % 4 else None, x) for k, x in enumerate(texts)]
    asked = [(q, w) for q in range(8) for w in WORDS[q % 4 : q % 4 + 1 + q % 3]] + [(9, "absent"), (3, WORDS[3]), (3, WORDS[3])]
    got = search.bm25_top(
        spark.createDataFrame(docs, "doc_id long, label string, text string"), spark.createDataFrame(asked, "query long, term string"), "doc_id", {"label": F.col("label"), "description": F.col("text")}, 5
    )
    want = brute(docs, asked, 5)
    assert sorted((r["query"], r["rank"], r["doc_id"], round(r["score"], 6)) for r in got.collect()) == want
    assert len(want) > 30


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "alpha")], "query long, term string")
    assert search.bm25_top(docs, asked, "doc_id", {"description": F.col("text")}, 5).count() == 0
