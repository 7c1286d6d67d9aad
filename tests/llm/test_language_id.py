import zlib

import numpy as np

from strandwise.llm import language_id as L

SCHEMA = "doc_id long, text string, lang string, score int, held_out string"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in L.language_ids(docs).collect()}
    rows = docs.select("doc_id", "lang").collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    held = [r for r in rows if got[r.doc_id].held_out]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in got.values()) and sum(r.rejected for r in got.values()) / len(got) < 0.05


def test_any_partitioning_gives_the_same_and_held_out_rows_teach_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    once = sorted(map(tuple, L.language_ids(docs).collect()))
    assert once == sorted(map(tuple, L.language_ids(docs.repartition(5, "source")).collect()))
    lies = docs.selectExpr("doc_id", "text", "if(crc32(cast(cast(doc_id as string) as binary)) % 4 = 2, 'xx', lang) as lang")
    assert once == sorted(map(tuple, L.language_ids(lies).collect()))


def test_frequencies_centroids_and_limits_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("lang", "text")
    rows = docs.collect()
    held = L.document_frequencies(docs)
    want = np.zeros(len(held), np.int64)
    for r in rows:
        want[sorted(set(L.counts(r.text)[0].tolist()))] += 1
        want[-1] += any(c.isalpha() for c in r.text or "")
    assert (held == want).all()
    model = L.Model(np.log1p(held[-1] / (1.0 + held[:-1])))
    model.languages = ["en", "en", "fr"]
    first = [model.vector(next(r.text for r in rows[k:] if r.lang == x and len(r.text) > 200)) for k, x in ((0, "en"), (50, "en"), (0, "fr"))]
    model.by_bucket = np.zeros((len(model.weights), 3), np.float32)
    for c, (b, v, _) in enumerate(first):
        model.by_bucket[b, c] = v
    sums = np.zeros_like(model.by_bucket, dtype=float)
    far = {"en": [], "fr": []}
    for r in rows:
        b, v, letters = model.vector(r.text)
        mine = [c for c, x in enumerate(model.languages) if x == r.lang]
        if letters and mine:
            near = model.cosines(b, v)
            best = max(mine, key=lambda c: (near[c], -c))
            sums[b, best] += v
            far[r.lang].append(1 - float(near[best]))
    moved = L.moved(docs, model)
    for c in range(3):
        assert np.abs(moved[:, c] - sums[:, c] / np.linalg.norm(sums[:, c])).max() < 1e-4
    limits = L.limits(docs, model, share=0.9)
    for lang, found in far.items():
        steps = sorted(min(1000, int(np.ceil(x * 1000))) for x in found)
        assert limits[lang, -1] == steps[int(np.ceil(0.9 * len(steps) - 1e-9)) - 1] / 1000


def test_grams():
    buckets, often, letters = L.counts("Ab, aB!")
    assert letters == 4 and often.sum() == 4 + 6 + 5  # 4 letters; pairs and triples of " ab ab "
    assert L.counts("ab ab")[0].tolist() == buckets.tolist()
    assert L.counts("12 ²³ --")[2] == L.counts(None)[2] == L.counts("")[2] == 0
    assert L.counts("é世")[2] == 2


def test_kmeans_finds_separate_clusters():
    rows = np.repeat(np.eye(3), 5, axis=0)
    assert sorted(map(tuple, L.kmeans(rows, 4).round(6))) == sorted(map(tuple, np.eye(3)))


def test_far_texts_are_rejected_and_edges(spark):
    en, fr = "the quick brown fox and the lazy dog ", "le renard brun et le chien paresseux "
    data = [(k, (en if k % 2 else fr) * (1 + k % 7), "en" if k % 2 else "fr", 1, "x") for k in range(60)]
    data += [(100, None, "en", 1, None), (101, "", None, 1, None), (102, "12 34 !?", "fr", None, None), (103, "жщъ ыюя жщъ", None, 1, ""), (None, en * 3000, None, 1, "")]
    data += [(1, en * 2, "en", 1, "x")] * 2
    got = L.language_ids(spark.createDataFrame(data, SCHEMA)).collect()
    assert len(got) == len(data)
    by = {r.doc_id: r for r in got}
    for k in (100, 101, 102):
        assert (by[k].lang_pred, by[k].score, by[k].rejected) == ("und", 0.0, True)
    assert by[103].rejected and by[103].lang_pred in ("en", "fr")
    assert by[None].lang_pred == "en" and not by[None].rejected and not by[None].held_out
    assert all(by[k].lang_pred == ("en" if k % 2 else "fr") for k in range(60))
    assert L.language_ids(spark.createDataFrame([], SCHEMA)).count() == 0
    unlabelled = spark.createDataFrame([(1, "some text", None, 1, "x")], SCHEMA)
    assert [(r.lang_pred, r.score) for r in L.language_ids(unlabelled).collect()] == [("und", 0.0)]
