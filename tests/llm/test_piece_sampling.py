from collections import Counter

import numpy as np
import pytest
from strandwise.llm import piece_sampling as ps

SCHEMA = "doc_id long, text string, ids int, n_pieces string"


@pytest.fixture(scope="module")
def vocabulary():
    return ps.pieces()


def paths(vocabulary, text):
    """All segmentations of a text with their weights, by recursion."""
    of = {r.decode(): i for i, r in enumerate(vocabulary.raw) if i > vocabulary.bytes_at + 255}

    def go(at):
        if at == len(text):
            yield (), 1.0
        for k in range(1, 17):
            i = of.get(text[at : at + k]) if at + k <= len(text) else None
            if i is not None:
                for tail, w in go(at + k):
                    yield (i, *tail), vocabulary.weight[i] * w

    found = dict(go(0))
    total = sum(found.values())
    return {p: w / total for p, w in found.items()}


@pytest.mark.parametrize("word", ["the", "nation", "other is"])
def test_samples_follow_the_exact_distribution(vocabulary, word):
    want = paths(vocabulary, " " + word)
    n = 30000
    got = Counter(tuple(i.tolist()) for i in vocabulary.encode([ps.seed_of(k) for k in range(n)], [word] * n))
    assert set(got) <= set(want)
    for p, share in want.items():
        assert abs(got[p] / n - share) < 5 * (share * (1 - share) / n) ** 0.5 + 1e-3


def test_long_segments_follow_it_too(vocabulary, monkeypatch):
    n = 20000
    seeds = [ps.seed_of(k) for k in range(n)]
    monkeypatch.setattr(ps, "LONG", 3)
    got = Counter(tuple(i.tolist()) for i in vocabulary.encode(seeds, ["nation"] * n))
    for p, share in paths(vocabulary, " nation").items():
        assert abs(got[p] / n - share) < 5 * (share * (1 - share) / n) ** 0.5 + 1e-3


ODD = ["", " ", "  a", "a  b   c ", "▁literal▁mark", "é漢字😀\n\t\x00", "x" * 20000, "the" * 3000, "　nbsp\xa0", "<0x41><s>", "\n\n", " " * 300]


def test_lossless_and_independent_of_the_batch(vocabulary):
    seeds = [ps.seed_of(k) for k in range(len(ODD))]
    together = vocabulary.encode(seeds, ODD)
    for k, t in enumerate(ODD):
        assert vocabulary.decode(together[k].tolist()) == t
        assert np.array_equal(vocabulary.encode([seeds[k]], [t])[0], together[k])
    other = vocabulary.encode([s + 1 for s in seeds], ODD)
    assert any(not np.array_equal(a, b) for a, b in zip(other, together))


def test_documents_round_trip_in_any_partitioning(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one = ps.encode_texts(docs.coalesce(1))
    rows = {r.doc_id: r.ids for r in one.collect()}
    assert rows == {r.doc_id: r.ids for r in ps.encode_texts(docs.repartition(7)).collect()}
    assert one.where("not lossless").count() == 0
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id: r.text for r in ps.decode_texts(one).collect()} == texts


def test_edges(spark):
    data = [(k, t, 1, "clash") for k, t in enumerate(ODD)] + [(1, None, None, None), (None, "no key", None, None), (0, "again", None, None), (0, "again", None, None)]
    out = ps.encode_texts(spark.createDataFrame(data, SCHEMA)).collect()
    assert len(out) == len(data) and all(r.lossless for r in out)
    assert len({tuple(r.ids) for r in out if r.doc_id == 0 and r.n_pieces}) == 1
    assert ps.encode_texts(spark.createDataFrame([], SCHEMA)).count() == 0
