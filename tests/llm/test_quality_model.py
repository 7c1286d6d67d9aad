from collections import Counter

import numpy as np
from strandwise.llm import quality_model as qm

SCHEMA = "doc_id long, text string, score string, votes int"


def test_em_recovers_accuracies_without_labels():
    draw = np.random.default_rng(0)
    k = len(qm.LABELLERS)
    truth = np.linspace(0.65, 0.95, k)
    good = draw.random(40000) < 0.7
    cast = draw.random((40000, k)) < 0.8
    right = draw.random((40000, k)) < truth
    said = np.where(cast, np.where(right == good[:, None], 1, 2), 0)
    patterns = [qm.pattern(v) for v in said]
    posterior, prior, accuracy = qm.em(Counter(patterns))
    assert np.abs(accuracy - truth).max() < 0.03 and abs(prior - 0.7) < 0.03
    assert ((posterior[patterns] > 0.5) == good).mean() > 0.9


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").limit(4000)
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = qm.quality_scores(docs, sample=1500).join(labels, "doc_id").collect()
    assert sum(r.kept for r in out if r.quality == 1) >= 0.99 * sum(r.quality == 1 for r in out)
    assert sum(not r.kept for r in out if r.quality == 0) >= 0.9 * sum(r.quality == 0 for r in out)


def test_edges(spark):
    prose = "The words of it stand here, and so they do for all to see. They are in it. "
    data = [(1, None, "c", 1), (2, "", None, None), (3, " \n", None, None), (4, prose * 9, None, None), (4, prose * 9, None, None)]
    data += [(None, prose, None, None), (5, "x", None, None), (6, prose * 4000, None, None)] + [(10 + i, "BUY!! NOW!! " * (20 + i), None, None) for i in range(9)]
    frame = spark.createDataFrame(data, SCHEMA)
    out = qm.quality_scores(frame).collect()
    kept = {r.doc_id: r.kept for r in out}
    assert len(out) == len(data) and not kept[1] and not kept[2] and not kept[3] and kept[4] and not kept[12]
    assert len({(r.score, r.votes) for r in out if r.doc_id == 4}) == 1
    assert sorted(map(str, qm.keep_good(frame).select("doc_id").collect())) == sorted(str(r) for r in qm.quality_scores(frame).where("kept").select("doc_id").collect())
    empty = spark.createDataFrame([], SCHEMA)
    assert qm.quality_scores(empty).count() == 0 and qm.keep_good(empty).columns == empty.columns
