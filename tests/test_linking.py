"""Entity linking against a plain walk over every paragraph."""

import re

from strandwise.operators import grounding as G
from strandwise.operators import linking as L
from strandwise.plans.grounded import KINDS, QUERIES, item_registry

SF = "/root/testdata/sf0.001"


def by_hand(sources, kinds, registry, fronts, proposals=()):
    word = lambda c: c.isalnum() or c == "_"
    found, issues = {}, []
    for source, text in sources.items():
        for k in kinds:
            named = (fronts.get(source, {}).get(k.front_key or "") or "").strip() or None
            if not named and k.path_segment is not None:
                parts = [p for p in source.split("/") if p]
                named = parts[k.path_segment].strip() if k.path_segment < len(parts) else None
            if k.partitioned and not named:
                issues.append(("partition_unresolved", k.node_type, source, None))
                continue
            mine = [r for r in registry if r["registry"] == k.registry and (not k.partitioned or r["partition"] == named) and G.folded(r["surface"] or "")]
            forms = sorted({G.folded(r["surface"]) for r in mine}, key=lambda t: (-len(t), t))
            spans = []
            for page, _, a, b in G.paragraphs(text, source.endswith(".md")):
                form, at = G.fold(text[a:b])
                i = 0
                while i < len(form):
                    hit = next((t for t in forms if form.startswith(t, i)), None)
                    if hit is None:
                        i += 1
                        continue
                    end = i + len(hit)
                    if not (i and word(form[i - 1])) and not (end < len(form) and word(form[end])):
                        spans.append((a + int(at[i]), a + int(at[end - 1]) + 1, page, "lexicon"))
                    i = end
                for m in re.finditer(k.pattern, text[a:b]) if k.pattern else ():
                    if G.folded(m.group()) in forms:
                        spans.append((a + m.start(), a + m.end(), page, "pattern"))
            for s, kind, x, y in proposals:
                if (s, kind) == (source, k.node_type):
                    if 0 <= x < y <= len(text):
                        spans.append((x, y, max([p for p, _, a, _ in G.paragraphs(text, source.endswith(".md")) if a <= x], default=1), "proposal"))
                    else:
                        issues.append(("not_in_source", kind, source, x))
            for x, y, page, detector in sorted(spans, key=lambda s: L.DETECTORS.index(s[3])):
                if (k.node_type, source, x, y) in found:
                    continue
                form = G.folded(text[x:y])
                hit = lambda label: sorted({r["record_id"] for r in mine if r["is_label"] == label and G.folded(r["surface"]) == form})
                records = hit(True) or hit(False)
                how = "linked" if len(records) == 1 else "ambiguous" if records else "unlinked"
                found[k.node_type, source, x, y] = (page, text[x:y], form, detector, how, records[0] if len(records) == 1 else None, named if k.partitioned else None, len(records))
                if how == "ambiguous":
                    issues.append(("ambiguous", k.node_type, source, x))
    return found, issues


def rows(occurrences):
    return {(r.node_type, r.source, r.start, r.end): (r.page, r.raw_span, r.normalized, r.detector, r.resolution, r.record_id, r.partition, r.candidates) for r in occurrences.collect()}


REGISTRY = [
    ("cities", "c1", "New York", True, "us"),
    ("cities", "c1", "Big  Apple", False, "us"),
    ("cities", "c2", "New York City", True, "us"),
    ("cities", "c3", "York", True, "uk"),
    ("cities", "c4", "york", True, "uk"),
    ("cities", "c5", "Éire", True, None),
    ("codes", "k1", "AB-12", True, None),
    ("codes", "k2", "AB-13", True, None),
    ("codes", "k3", "", True, None),
]
SOURCES = {
    "a/us.md": "---\nregion: us\n---\nnew york  city and NEW YORK,\nnew yorkers; the big\napple. AB-12 AB-99\n---\nÉire New York",
    "uk/b.txt": "In York, (york) and Yorkshire. AB-13xAB-12 eire",
    "c.md": "York without a region, AB-12",
    "/d.md": "",
}


def test_small_sources(spark):
    kinds = (L.LinkType("city", "cities", True, "region", 0), L.LinkType("code", "codes", pattern=r"AB-\d\d"), L.LinkType("place", "cities"))
    proposals = [("a/us.md", "city", 19, 27), ("a/us.md", "code", 70, 900), ("uk/b.txt", "place", 3, 7), ("c.md", "city", 0, 4)]
    sources = spark.createDataFrame([*SOURCES.items(), ("null.md", None)], "source string, text string")
    registry = spark.createDataFrame(REGISTRY, "registry string, record_id string, surface string, is_label boolean, partition string")
    asked = spark.createDataFrame(proposals, "source string, node_type string, start int, end int")
    occurrences, issues = L.link_entities(sources, kinds, registry, asked)
    want, noted = by_hand(SOURCES, kinds, [r.asDict() for r in registry.collect()], {"a/us.md": {"region": "us"}}, proposals)
    assert rows(occurrences) == want
    assert sorted(map(str, ((r.code, r.node_type, r.source, r.start) for r in issues.collect()))) == sorted(map(str, noted))
    assert {v[4] for v in want.values()} == {"linked", "ambiguous", "unlinked"} and {v[3] for v in want.values()} >= {"lexicon", "proposal"}
    assert L.link_entities(sources.limit(0), kinds, registry)[0].count() == 0 and L.link_entities(sources, kinds, registry.limit(0))[0].count() == 0


def test_query_by_hand(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want, _ = by_hand({f"{r.lang or ''}/{r.doc_id}": r.text for r in docs}, KINDS, [r.asDict() for r in item_registry(spark, SF).collect()], {})
    got = rows(QUERIES["i9_entity_linking"](spark, SF))
    assert got == want and got
