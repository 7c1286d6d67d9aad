import itertools
import random
import re

import xxhash

from strandwise.llm import simhash

SCHEMA = "doc_id long, text string, fp string, root long"


def brute_fp(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(pairs, radius=4):
    root = list(range(len(pairs)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(pairs)), 2):
        if (pairs[i][1] ^ pairs[j][1]).bit_count() <= radius:
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(pairs):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: least[find(i)] for i, (d, _) in enumerate(pairs)}


def test_masks_cover_every_pair_of_positions():
    for stride in (1, 7):
        found = [m % 2**64 for m in simhash.masks(4, stride)]
        draw = random.Random(1)
        for _ in range(20000):
            diff = sum(1 << b for b in draw.sample(range(64), 4))
            assert any(not diff & m for m in found)
        assert all(28 <= m.bit_count() <= 36 for m in found)


def test_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pairs = [(r.doc_id, brute_fp(r.text)) for r in docs.collect()]
    want = brute_components(pairs)
    got = simhash.near_duplicates(docs).collect()
    assert {r.doc_id: r.fingerprint for r in got} == {d: f"{fp:016x}" for d, fp in pairs}
    assert {r.doc_id: r.component_id for r in got} == want


def test_large_buckets_split_and_lose_no_link(spark):
    draw = random.Random(3)
    seeds = [draw.getrandbits(64) for _ in range(6)]
    fps = sorted({s ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, 7))) for s in seeds for _ in range(60)})
    signed = [(i, f - 2**64 if f >= 2**63 else f) for i, f in enumerate(fps)]
    frame = spark.createDataFrame(signed, "doc_id long, fp long")
    want = brute_components(list(enumerate(fps)))
    for large in (4, 2048):
        roots = {r.node: r.root for r in simhash.components(simhash.near_links(frame.select("fp"), large=large)).collect()}
        groups = {}
        for i, f in signed:
            groups.setdefault(roots.get(f, f), []).append(i)
        got = {i: min(g) for g in groups.values() for i in g}
        assert got == want


def test_edges(spark):
    data = [(5, None, "x", 1), (3, "", None, None), (9, " \n", None, None), (7, "One two", None, None), (8, "one TWO", None, None), (8, "one two", None, None), (None, "alone here is some text", None, None)]
    got = sorted(((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(data, SCHEMA)).collect()), key=str)
    two = f"{brute_fp('one two'):016x}"
    assert [g for g in got if g[0] in "3579"] == [("3", "0" * 16, 3), ("5", "0" * 16, 3), ("7", two, 7), ("9", "0" * 16, 3)]
    assert got.count(("8", two, 7)) == 2 and len(got) == 7
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_row_of_each_component_stays_whatever_the_ids(spark):
    alone = "no row with an id says what stands here"
    one, two, three, four = ("the first text has words of its own", "another text speaks of quite other things", "nobody has ever said a third like this", "last come the words that only five has")
    data = [(None, one), (None, alone), (None, alone), (None, two), (None, three), (3, three), (5, three), (5, four), (7, four.upper()), (8, None), (None, ""), (9, two + " "), (9, two)]
    out = simhash.keep_one(spark.createDataFrame(data, "doc_id long, text string")).collect()
    got = {(r.doc_id, (r.text or "").strip()) for r in out}
    assert got == {(None, one), (None, alone), (9, two), (3, three), (5, four), (8, "")} and len(out) == 6
