import math
import random
import re
from collections import Counter

import numpy as np
from strandwise.llm import decontaminate as dc

SCHEMA = "doc_id long, text string, item_id string, score int"


def split(text):
    """Words by their definition, apart from the operator's code."""
    return [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text.casefold())) if w]


def grams(words):
    return [tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))]


def masses(items):
    """Of each item its terms' BM25 masses, as shares of the item's."""
    words = {i: split(t or "") for i, t in items}
    words = {i: w for i, w in words.items() if w}
    df = Counter(t for w in words.values() for t in set(w))
    mean = sum(map(len, words.values())) / len(words)
    out = {}
    for i, w in words.items():
        tf = Counter(w)
        of = {t: math.log(1 + (len(words) - df[t] + 0.5) / (df[t] + 0.5)) * k * 2.2 / (k + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t, k in tf.items()}
        out[i] = {t: m / sum(of.values()) for t, m in of.items()}
    return words, out


def brute(docs, items, stride=64):
    """Every passage against every item: {(doc, item): (score, overlap) of the best passage}."""
    words, mass = masses(items)
    texts = dict(items)
    out = {}
    for doc, text in docs:
        said = split(text or "")
        for a in range(0, max(1, len(said)), stride):
            passage = said[a : a + 2 * stride]
            terms, held = set(passage), set(grams(passage))
            for i, shares in mass.items():
                score = sum(m for t, m in shares.items() if t in terms)
                if score < dc.THRESHOLD:
                    continue
                hits = [g in held for g in grams(words[i])]
                question = len(split(texts[i].rstrip().rpartition("\n")[0])) or (len(words[i]) + 1) // 2
                cut = max(1, min(question - 2, len(hits) - 1)) if len(hits) > 1 else 1
                parts = [sum(x) / len(x) if x else 1.0 for x in (hits, hits[:cut], hits[cut:])]
                if parts[0] >= dc.MIN_OVERLAP and min(parts[1:]) >= dc.MIN_PART:
                    out[doc, i] = max(out.get((doc, i), (0.0, 0.0)), (round(score, 6), round(parts[0], 6)))
    return out


def found_by(df):
    return {(r.doc_id, r.item_id): (r.score, r.overlap) for r in df.collect()}


def close(got, want):
    assert set(got) == set(want)
    assert all(abs(a - b) < 2e-6 for k in want for a, b in zip(got[k], want[k]))


def test_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [tuple(r) for r in bench.collect()])
    assert want
    close(found_by(dc.benchmark_leaks(docs, bench)), want)


def altered(spark, draw):
    """Items of sf0.01 with a share of their words changed, in other words."""
    items = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    docs = []
    for i, t in items:
        for k, share in enumerate((0.0, 0.02, 0.05, 0.1)):
            said = [draw.choice(("zub", "rov", "the")) if draw.random() < share else w for w in t.split()]
            filler = [f"{draw.choice('bcdfg')}{draw.randrange(999)}" for _ in range(draw.randrange(200))]
            docs.append((10 * i + k, " ".join(filler + said + filler[:20])))
    return items, docs


def test_altered_copies_against_brute_force(spark):
    items, docs = altered(spark, random.Random(4))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    got = found_by(dc.benchmark_leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench))
    close(got, want)  # the search misses none
    # the share found of items with 0, 2, 5 and 10 % of their words changed: what the shingle overlap of 0.8 leaves
    shares = [sum((10 * i + k, i) in got for i, _ in items) / len(items) for k in range(4)]
    assert shares[0] == 1 and shares == sorted(shares, reverse=True)


def test_statistics_do_not_depend_on_the_number_of_indexes(spark):
    items, docs = altered(spark, random.Random(6))
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert len(dc.Benchmark(bench, index_bytes=3000)) > 1
    many = dc.benchmark_leaks(frame, bench, index_bytes=3000)
    close(found_by(many), brute(docs, items))
    gone = {d for d, _ in found_by(many)}
    assert {r.doc_id for r in dc.drop_leaked(frame, bench, index_bytes=3000).collect()} == {d for d, _ in docs} - gone


def test_a_long_item_widens_its_own_passages_only(spark):
    draw = random.Random(9)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(5))
    long = " ".join(word() for _ in range(3000))
    items, docs = altered(spark, draw)
    bench = spark.createDataFrame([*items, (999, long)], "item_id long, text string")
    frame = spark.createDataFrame([*docs, (7, f"x {long} y"), (8, long[: len(long) // 2])], "doc_id long, text string")
    held = dc.Benchmark(bench)
    assert sorted(held.index(k).stride for k in range(len(held))) == [64, 4096]
    got = found_by(dc.benchmark_leaks(frame, bench))
    assert (7, 999) in got and not [d for d, _ in got if d == 8]
    want = brute(docs, [*items, (999, long)])  # its mean length is that of all items
    close({k: v for k, v in got.items() if k[1] != 999}, {k: v for k, v in want.items() if k[1] != 999})


def test_block_max_wand_against_all_scores():
    """Ranges of many blocks: every item at or above the threshold, and no other, whatever is skipped."""
    draw = np.random.default_rng(3)
    items = [(i, " ".join(f"w{int(x)}" for x in draw.zipf(1.3, size=draw.integers(5, 40)) % 300)) for i in range(3000)]
    words, mass = masses(items)
    df = Counter(t for w in words.values() for t in set(w))
    index = dc.Index(items, {t.encode(): n for t, n in df.items()}, len(words), sum(map(len, words.values())) / len(words))
    assert index.span > index.block >= dc.BLOCK_ITEMS and index.n_ranges <= dc.RANGES
    for k in range(25):
        terms = set(words[int(draw.integers(3000))]) | {f"w{x}" for x in draw.integers(0, 300, size=10)}
        present = np.zeros(len(index.vocabulary), dtype=bool)
        present[[index.vocabulary[t.encode()] for t in terms if t.encode() in index.vocabulary]] = True
        for threshold in (0.3, 0.5, 0.9):
            got = {index.ids[d]: s for part in range(index.n_ranges) for d, s in index.search(part, present, threshold)}
            want = {i: s for i, of in mass.items() if (s := sum(m for t, m in of.items() if t in terms)) >= threshold - 1e-9}
            assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-9 for i in want)
    # the bounds of passages miss none of them either
    texts = [" ".join(words[i] + words[i + 1]) for i in range(0, 40, 2)]
    found = dc.leaks_of(index, texts, 0.5, 0.0, 0.0)
    want = brute(list(enumerate(texts)), items)
    assert {(d, i) for d, i in want} <= {(d, x[0]) for d, f in enumerate(found) for x in f}


def test_every_whole_item_is_found_and_clean_stays(spark):
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    items = bench.collect()
    draw = random.Random(2)
    filler = lambda n: " ".join(f"{draw.choice('bcdfg')}{draw.randrange(10**6)}" for _ in range(n))
    data = [(r.item_id, f"{filler(draw.randrange(400))} {r.text.upper()}, {filler(draw.randrange(300))}", None, None) for r in items]
    data += [(1000 + r.item_id, filler(50) + " " + " ".join(r.text.split()[: len(r.text.split()) // 2]), None, None) for r in items]
    frame = spark.createDataFrame(data, SCHEMA)
    found = {(r.doc_id, r.item_id) for r in dc.benchmark_leaks(frame, bench).collect()}
    assert {(r.item_id, r.item_id) for r in items} <= found
    assert not [d for d, _ in found if d >= 1000]
    assert {r.doc_id for r in dc.drop_leaked(frame, bench).collect()} == {d for d, *_ in data if d >= 1000}


def test_edges(spark):
    bench = spark.createDataFrame([(1, "alpha beta\ngamma delta epsilon zeta"), (2, None), (3, ""), (4, "one"), (None, "nobody knows the id of this item")], "item_id long, text string")
    data = [(1, None, "x", 1), (2, "", None, None), (3, "x ALPHA beta gamma; delta epsilon zeta y", None, None), (3, "x ALPHA beta gamma; delta epsilon zeta y", None, None), (None, "nobody knows the id of this item", None, None), (5, "w " * 40000 + "alpha beta gamma delta epsilon zeta", None, None)]
    got = sorted(str((r.doc_id, r.item_id)) for r in dc.benchmark_leaks(spark.createDataFrame(data, SCHEMA), bench).collect())
    assert got == ["(3, 1)", "(3, 1)", "(5, 1)", "(None, None)"]
    assert dc.benchmark_leaks(spark.createDataFrame([], SCHEMA), bench).count() == 0
    assert dc.benchmark_leaks(spark.createDataFrame(data, SCHEMA), bench.limit(0)).count() == 0
