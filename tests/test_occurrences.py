"""Terms in texts against plain search, without a shuffle of the texts' words."""

import random
import re

from strandwise.operators import grounding as G


def test_all_places_and_no_shuffle(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "b", "ab", " ", "-", "é", ". "]) for _ in range(400)) for _ in range(6)] + ["", " - ", "ab"]
    terms = sorted({G.folded(t[k : k + n]) for t in texts[:3] for k, n in ((5, 9), (40, 3), (77, 1), (120, 70), (300, 12))} | {"ab", "b-a", "zz", "a b"})
    rows = [("x", k, t, re.findall(r"\w+", t), next((m.start() for m in re.finditer(r"\w", t)), 0)) for k, t in enumerate(terms) if re.search(r"\w", t)]
    asked = spark.createDataFrame(rows, "id string, order int, term string, words array<string>, at int")
    units = spark.createDataFrame([(f"s{k}", t) for k, t in enumerate(texts)], "source string, text string")
    found = G.occurrences(asked, G.source_units(units))
    plan = G._places(asked, G.source_units(units), None)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan, plan
    want = set()
    for r in G.source_units(units).select("source", "unit", "folded").collect():
        want |= {(k, r.source, r.unit, at) for _, k, t, _, _ in rows for at in range(len(r.folded)) if r.folded.startswith(t, at)}
    got = [(r.order, r.source, r.unit, r["at"]) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
