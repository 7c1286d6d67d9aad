"""Queries that SQL can't express, against plain Python."""

import numpy as np

from strandwise.operators import composite, resolve
from strandwise.plans.composites import QUERIES as COMPOSITES
from strandwise.plans.retrieval import QUERIES as RETRIEVAL
from strandwise.plans.traversal import places

SF = "/root/testdata/sf0.001"


def scan(text, terms):
    """Leftmost, longest first; a hit that fails its boundaries is consumed."""
    text, at, out = (text or "").lower(), 0, []
    terms = sorted(terms, key=lambda t: (-len(t), t))
    word = lambda c: c.isalnum() or c == "_"
    while at < len(text):
        hit = next((t for t in terms if text.startswith(t, at)), None)
        if hit is None:
            at += 1
            continue
        end = at + len(hit)
        if not (at and word(text[at - 1])) and not (end < len(text) and word(text[end])):
            out.append((hit, at))
        at = end
    return out


def test_lexicon_detection(spark):
    terms = ["new york", "new york city", "york", "city of", "a"]
    texts = [(1, "New York City of a yorkshire new yorkers"), (2, None), (3, "xnew york city"), (4, "a a york, a-york")]
    forms = spark.createDataFrame([(x,) for x in terms], "term string")
    for size in (4_000_000, 12):
        got = sorted((r.id, r.term, r.start) for r in resolve.detect_lexicon(spark.createDataFrame(texts, "id long, text string"), forms, lexicon_bytes=size).collect())
        assert got == sorted((i, *h) for i, t in texts for h in scan(t, terms))
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = {" ".join(r.text.split()[:2]).lower() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    items = [x for x in items if len(x) > 4]
    found = sorted((r.doc_id, r.term, r.start) for r in RETRIEVAL["d12_lexicon_detection"](spark, SF).collect())
    assert found == sorted((d, *h) for d, t in docs.items() for h in scan(t, items))


def dense_rank(pairs, nodes, seeds, rounds):
    at = {n: i for i, n in enumerate(nodes)}
    w = np.zeros((len(nodes), len(nodes)))
    for a, b in pairs:
        w[at[a], at[b]] = 1
    out = w.sum(1)
    p = np.zeros(len(nodes))
    for n, m in seeds.items():
        p[at[n]] = m
    p = p / p.sum() if p.sum() else np.full(len(nodes), 1 / len(nodes))
    r = p.copy()
    for _ in range(rounds):
        step = np.divide(r, out, where=out > 0, out=np.zeros_like(r))
        new = 0.15 * p + 0.85 * r[out == 0].sum() * p + 0.85 * (0.6 * np.where(out > 0, r, 0) + 0.4 * step @ w)
        delta, r = np.abs(new - r).sum(), new
        if delta <= 1e-6:
            break
    return dict(zip(nodes, r))


def test_answer_pack(spark):
    pairs = [tuple(r) for r in places(spark, SF).collect()]
    every = [r.id for r in composite_nodes(spark)]
    ppr = dense_rank(pairs, every, {"supplier:1": 2.0, "supplier:2": 1.0}, 25)
    background = dense_rank(pairs, every, {}, 25)
    lift = {n: round(ppr[n] / (background[n] + 1 / len(every)), 9) for n in every if ppr[n] > 0}
    want = sorted(lift, key=lambda n: (-lift[n], n))[:20]
    got = COMPOSITES["i3_answer_pack"](spark, SF).orderBy("rank").collect()
    assert [r.id for r in got] == want
    assert all(abs(r.specificity - lift[r.id]) < 1e-6 for r in got)
    assert got[0].hops == 0 and got[0].reliability == 1.0


def composite_nodes(spark):
    from strandwise.sources import star

    return star.nodes(spark, SF).where("node_type in ('supplier', 'nation', 'region')").collect()


def test_answer_pack_refuses_without_seeds(spark):
    adj = places(spark, SF).selectExpr("id", "nbr", "1.0D as w")
    nodes = adj.selectExpr("id", "'nation' as node_type").distinct()
    assert composite.answer_pack(nodes, adj, spark.createDataFrame([], "id string, mass double")).count() == 0
