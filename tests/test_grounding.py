"""Citation grounding against plain Python over every node and paragraph."""

import re

from strandwise.operators import grounding as G
from strandwise.plans.grounded import QUERIES, document_sources, item_nodes

SF = "/root/testdata/sf0.001"

NOTES = """---
title: Notes
lang: en
---
# Grands  Systèmes
The Éclair  project,
run by J. R. R.  Tolkien (see [12]), began in 1999.

## Marie Curie
She wrote that “radium glows in the dark” and left.

![plan](x.png)
---
Œuvre NASA and a nasal tone; RADIUM GLOWS in
the   dark again.
"""
PLAIN = "CHAPTER ONE\nA first line about the éclair project.\nIt goes on.\n\nTHE END OF IT\nNASA once more " + "word " * 200 + "tail\n"


def citations_by_hand(node, source, text, markdown):
    units = [(page, section, a, b, text[a:b], G.folded(text[a:b])) for page, section, a, b in G.paragraphs(text, markdown)]
    kind = (node["node_type"] or "").lower()
    terms = G.terms_of(kind, node["id"], node["label"] or "", [x for x in node["aliases"] or [] if x])
    out, seen = [], set()

    def offer(stage, k, at, needle):
        page, section, a, _, raw, form = units[k]
        x, y, quote = G.quote_at(raw, at)
        core = G.folded(re.sub(r"\s*…$", "", re.sub(r"^…\s*", "", quote)))
        brief = G.folded(quote)[:60]
        if core and core in form and G.folded(needle) in G.folded(quote):
            out.append((stage, k, a + x, a + y, quote, brief, page, section, "EXTRACTED"))

    for _, how, term in terms:
        for k, (_, section, _, _, raw, form) in enumerate(units):
            if how == "section" and f" {' '.join(re.findall('[a-z0-9]+', term))} " in f" {' '.join(re.findall('[a-z0-9]+', section.lower()))} ":
                offer(1, k, 0, "")
            if how == "raw" and term in raw:
                offer(2, k, raw.index(term), term)
    for k, (*_, raw, form) in enumerate(units):
        hit = next(((form.index(t), t) for _, how, t in terms if how == "text" and t in form), None)
        word = next((t for _, how, t in terms if how == "word"), None)
        if hit:
            offer(3, k, int(G.fold(raw)[1][hit[0]]), hit[1])
        elif word and re.search(rf"\b{word}\b", raw):
            offer(3, k, raw.index(word), word)
    whole = (node["rationale"] or "").strip()
    marked = [m.strip() for m in re.findall("[«\"“]([^«»\"“”]{8,})[»\"”]", whole)]
    tries = [(k, True, m) for k, m in enumerate(marked)] + ([(len(marked), False, whole)] if whole else [])
    any_marked = False
    for order, quoted, said in tries:
        said = " ".join(said.split())[: G.LONGEST]
        form = G.folded(said)
        hit = next((k for k, u in enumerate(units) if form and form in u[5]), None)
        if hit is None or (not quoted and any_marked):
            continue
        any_marked = any_marked or quoted
        page, section, a, _, raw, f = units[hit]
        places, at = G.fold(raw)[1], f.index(form)
        out.append((4 + order, hit, a + int(places[at]), a + int(places[at + len(form) - 1]) + 1, said, form[:60], page, section, "EXTRACTED" if kind == "quote" else "INFERRED"))
    kept = []
    for c in sorted(out, key=lambda c: c[:3]):
        if c[5] not in seen:
            seen.add(c[5])
            kept.append(c)
    return [(node["id"], source, k, c[6], c[7], c[1], c[2], c[3], c[4], c[8]) for k, c in enumerate(kept[: G.TOP], 1)]


def compare(nodes, sources, citations, markdown):
    want = sorted(c for n in nodes for s, t in sources.items() for c in citations_by_hand(n, s, t, markdown(s)))
    got = sorted(map(tuple, citations.select("id", "source", "rank", "page", "section", "unit", "start", "end", "quote", "confidence").collect()))
    assert got == want
    for id_, source, *_, start, end, quote, _ in got:
        core = G.folded(quote.strip("… ").rstrip(" …"))
        assert core in G.folded(sources[source][start:end])
    return got


NODES = [
    ("a", "project", "Éclair project (pilot)", ["eclair"], None),
    ("b", "person", "Marie Curie", None, "she said “radium glows in the dark” once"),
    ("c", "reference", "Some book [12]", [], None),
    ("d", "organisation", "NASA", None, "a paraphrase that stands nowhere"),
    ("e", "person", "J. R. R. Tolkien", None, None),
    ("f", "quote", "q1", None, "Radium glows in the dark again"),
    ("g", "concept", "Nothing Like It", [], None),
    ("h", None, None, None, None),
    ("i", "tool", "the", ["lair proj", "99"], None),
]
SCHEMA = "id string, node_type string, label string, aliases array<string>, rationale string"


def test_small_sources(spark):
    sources = {"notes.md": NOTES, "plain.txt": PLAIN, "empty.md": "", "copy.md": NOTES}
    nodes = spark.createDataFrame(NODES, SCHEMA)
    rows = spark.createDataFrame([*sources.items(), ("null.md", None)], "source string, text string")
    citations, issues = G.ground(nodes, rows)
    got = compare([r.asDict() for r in nodes.collect()], sources, citations, lambda s: s.endswith(".md"))
    by = {(c[0], c[1]) for c in got}
    assert {("a", "notes.md"), ("b", "notes.md"), ("c", "copy.md"), ("d", "plain.txt"), ("e", "notes.md"), ("f", "notes.md"), ("i", "notes.md")} <= by
    assert not {c[0] for c in got} & {"g", "h"}
    assert next(c for c in got if c[0] == "f" and c[1] == "notes.md")[3] == 2  # the page after the rule
    asked = spark.createDataFrame([("a", "notes.md"), ("g", "notes.md"), ("d", "notes.md")], "id string, source string")
    some, issues = G.ground(nodes, rows, asked)
    assert sorted(map(tuple, some.collect())) == sorted(c for c in got if c[:2] in {("a", "notes.md"), ("d", "notes.md")})
    assert [tuple(r) for r in issues.collect()] == [("g", "notes.md", "ungrounded")]
    assert G.ground(nodes.limit(0), rows)[0].count() == 0 and G.ground(nodes, rows.limit(0))[0].count() == 0


def test_query_by_brute_force(spark):
    nodes = [r.asDict() for r in item_nodes(spark, SF).collect()]
    sources = {r.source: r.text for r in document_sources(spark, SF).collect()}
    assert compare(nodes, sources, QUERIES["i10_citation_grounding"](spark, SF), lambda s: False)


def test_fold_keeps_places():
    for text in ("", " ", "Œuvre  Ébène", "J. R. R. T", "x\n\n y", "éa", "ﬁn"):
        form, at = G.fold(text)
        assert len(form) == len(at) and form == G.folded(text)
        for c, k in zip(form, at):
            assert c == " " or c in G.folded(text[k])
