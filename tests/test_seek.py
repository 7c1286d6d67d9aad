"""The search that tasks hold against plain search, and what linking and grounding leave on disk."""

import random
from pathlib import Path

from strandwise.operators import grounding as G
from strandwise.operators import linking as L
from strandwise.operators import seek
from strandwise.operators.iterate import shared_folder
from strandwise.plans.grounded import KINDS, QUERIES, document_sources, item_nodes, item_registry

SF = "/root/testdata/sf0.001"


def held(spark):
    """Files of the shared folder with their sizes."""
    return {p: p.stat().st_size for p in Path(shared_folder(spark).removeprefix("file:")).rglob("*.parquet")}


def test_places_by_brute_force():
    rng = random.Random(2)
    for letters in ("ab ", "aé😀\ud800 "):
        for _ in range(40):
            text = "".join(rng.choice(letters) for _ in range(rng.randrange(60)))
            some = [text[k : k + n] for k, n in ((rng.randrange(60), rng.randrange(1, 40)) for _ in range(20))]
            texts = sorted({t for t in [*some, "b", "zz", "ab" * 9] if t})
            want = sorted(((a, k) for k, t in enumerate(texts) for a in range(len(text)) if text.startswith(t, a)), key=lambda x: (x[0], -len(texts[x[1]])))
            assert seek.Places(texts).of(text) == want
    assert seek.Places([]).of("a") == [] and seek.Places(["a"]).of("") == []


def test_folded_is_fold():
    for text in ("", "a  b", "é è . x", "… a", "J. R. R. é", " ¨ x ", "œ\nÆ"):
        assert G.folded(text) == G.fold(text)[0]


def test_linking_writes_no_text(spark):
    before = held(spark)
    found = QUERIES["i9_entity_linking"](spark, SF).count()
    wrote = sum(n for p, n in held(spark).items() if p not in before)
    texts = Path(f"{SF}/documents.parquet").stat().st_size
    assert found and wrote < texts / 4, (wrote, texts)


def test_linking_beyond_what_is_held(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("concat(lang, '/', doc_id) AS source", "text").where("doc_id < 60")
    registry = item_registry(spark, SF)
    want = sorted(map(tuple, L.link_entities(docs, KINDS, registry)[0].collect()), key=str)
    monkeypatch.setattr(seek, "HELD_TEXTS", 0)
    assert sorted(map(tuple, L.link_entities(docs, KINDS, registry)[0].collect()), key=str) == want and want


def test_grounding_writes_no_text(spark):
    before = held(spark)
    found = QUERIES["i10_citation_grounding"](spark, SF).count()
    wrote = sum(n for p, n in held(spark).items() if p not in before)
    texts = Path(f"{SF}/documents.parquet").stat().st_size
    assert found and wrote < texts / 2, (wrote, texts)


def test_grounding_beyond_what_is_held(spark, monkeypatch):
    nodes, docs = item_nodes(spark, SF), document_sources(spark, SF).where("cast(substring(source, 5) AS int) < 60")
    want = [sorted(map(tuple, df.collect()), key=str) for df in G.ground(nodes, docs)]
    monkeypatch.setattr(seek, "HELD_TEXTS", 0)
    assert [sorted(map(tuple, df.collect()), key=str) for df in G.ground(nodes, docs)] == want and all(want[:1])


def test_a_source_of_several_rows_has_one_order(spark):
    nodes = spark.createDataFrame([("n", "tool", "lathe", None, None)], "id string, node_type string, label string, aliases array<string>, rationale string")
    texts = [("s", "\n\n".join(f"{k} a lathe stands {x}" for k in range(5))) for x in "ab"] + [("t", "no lathe")]
    cited = G.ground(nodes, spark.createDataFrame(texts, "source string, text string").repartition(3))[0].collect()
    assert sorted((r.source, r["rank"]) for r in cited) == [("s", k) for k in range(1, 7)] + [("t", 1)]
    assert len({r.quote for r in cited}) == 7
