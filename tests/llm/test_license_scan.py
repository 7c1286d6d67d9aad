import random
import re

from strandwise.llm import license_scan as ls
from strandwise.llm.license_texts import PHRASES, TEMPLATES

SCHEMA = "doc_id long, text string, n_words string, labels int"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text):
    words = brute_words(text)
    places = []
    for phrase, label in PHRASES:
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_base_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in ls.license_scan(docs).collect()}
    want = {r.doc_id: brute(r.text) for r in docs.collect()}
    assert got == want and any(w[1] for w in want.values())


def test_matching_statistics_against_brute_force():
    draw = random.Random(5)
    for _ in range(60):
        pick = lambda n: [bytes([97 + draw.randrange(3)]) for _ in range(n)]
        sequences = [pick(draw.randint(1, 12)) for _ in range(3)]
        automaton = ls.Automaton(sequences, [pick(2)])
        # the oracle: all substrings
        subs = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        text = pick(40)
        _, matches = automaton.scan(text, 2)
        for start, n, state in matches:
            match = tuple(text[start : start + n])
            assert match in subs or len(match) == 2
            assert start + n == len(text) or tuple(text[start : start + n + 1]) not in subs
            for k, end in automaton.ends[state]:
                assert tuple(sequences[k][end - n : end]) == match


def test_whole_and_altered_templates_get_their_labels(spark):
    filler = " zq" * 40 + " "
    data, want = [], {}
    for i, (label, texts) in enumerate(TEMPLATES.items()):
        words = texts[0].split()
        altered = " ".join(w for k, w in enumerate(words) if k % 19 != 7)
        data += [(i, filler + texts[0] + filler, None, None), (100 + i, filler + altered + filler, None, None)]
        want[i] = want[100 + i] = label
    got = {r.doc_id: r for r in ls.license_scan(spark.createDataFrame(data, SCHEMA)).collect()}
    for i, label in want.items():
        assert label in got[i].labels.split(","), (i, got[i])
    assert all(got[i].score == 1.0 for i in range(len(TEMPLATES)))
    assert got[0].spans[0].first == 40 and got[0].spans[0].label == "mit"


def test_edges(spark):
    texts = [None, "", " - ", "MIT License", "mit\nlicense mit LICENSE", "é mit license", "mitlicense", "mit " * 50000 + "license"]
    data = [(i, t, "c", 1) for i, t in enumerate(texts)] + [(None, "mit license", None, None), (3, "MIT License", None, None)]
    got = sorted((str(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in ls.license_scan(spark.createDataFrame(data, SCHEMA)).collect())
    assert got == sorted((str(i), *brute(t)) for i, t, *_ in data)
    assert ls.license_scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_clean_documents_get_no_added_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = ls.license_scan(docs).collect()
    assert all(r.labels == r.base_labels for r in out if not r.n_base)


def spans_of(spark, *texts):
    rows = ls.license_scan(spark.createDataFrame([(k, t, None, None) for k, t in enumerate(texts)], SCHEMA)).orderBy("doc_id").collect()
    return [[(s.label, s.first, s.last) for s in r.spans] for r in rows]


def test_parts_of_short_notices_name_no_licence(spark):
    none = (
        "This software is released under the BSD terms",
        "under the terms of the GNU Free Documentation License",
        "This work is licensed under a Creative License of our own",
        "without warranties or conditions of any kind",
        "permission is hereby granted to all who read on and to no one else",
    )
    assert spans_of(spark, *none) == [[]] * len(none)
    assert spans_of(spark, "This software is released under the MIT License") == [[("mit", 0, 8)]]


def test_every_copy_of_a_template_is_a_span(spark):
    mit, bsd = TEMPLATES["mit"][0], TEMPLATES["bsd"][0]
    n, m = len(ls.words_of(mit)), len(ls.words_of(bsd))
    text = f"{mit} {'zq ' * 20} {mit} {bsd}"
    assert spans_of(spark, text)[0] == [("mit", 0, n), ("mit", n + 20, 2 * n + 20), ("bsd", 2 * n + 20, 2 * n + 20 + m)]
    row = ls.digests(ls.license_scan(spark.createDataFrame([(1, text, None, None)], SCHEMA))).first()
    assert [(s.label, s.first, s.last, s.share) for s in row.spans] == [("mit", 0, n, 1.0), ("mit", n + 20, 2 * n + 20, 1.0), ("bsd", 2 * n + 20, 2 * n + 20 + m, 1.0)]
    # back to back, they are two as well
    assert spans_of(spark, f"{mit} {mit}")[0] == [("mit", 0, n), ("mit", n, 2 * n)]
