from hashlib import sha256

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from strandwise.llm import fill_middle as M

SCHEMA = "doc_id long, text string, form string, n int"


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=30), st.integers(1, 90))
def test_rank_and_select(text, times):
    text = text * times
    raw = text.encode("utf-8", "replace")
    bits = M.Boundaries(raw)
    starts = [k for k, b in enumerate(raw) if b & 0xC0 != 0x80]
    assert bits.total == len(starts)
    for r in {0, 1, len(starts) // 2, len(starts) - 1} & set(range(len(starts))):
        assert bits.select(r) == starts[r] and bits.rank(starts[r]) == r
    assert bits.select(len(starts)) == len(raw) and bits.rank(len(raw)) == len(starts)
    for at in np.linspace(0, len(raw), 9).astype(int):
        assert bits.rank(int(at)) == sum(s < at for s in starts)


def plain(key, text):
    text = text or ""
    name = "" if key is None else str(key)
    digest = sha256(f"1:{name}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or h[2] % 100 >= 90 or any(s in text for s in ("<P>", "<S>", "<M>")):
        return key, n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    return (key, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (key, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_query_by_brute_force_and_sql(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    docs = spark.read.parquet(path)
    cut = M.fill_in_middle(docs)
    want = {r.doc_id: plain(r.doc_id, r.text) for r in docs.collect()}
    got = cut.collect()
    assert len(got) == len(want) and all(tuple(r) == want[r.doc_id] for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{path}'")
    assert sorted(map(tuple, M.digests(cut).collect())) == sorted(con.execute(M.ORACLE).fetchall())


def test_round_trip_and_edges(spark):
    texts = [None, "", "x", "<", "<<S", "a<P", "S>M>P>", "has <M> inside", "has <P>", "<S>", "é世🙂" * 50_000, "a\x00b\n" * 3]
    data = [(10 * k + j, t, "x", 1) for k, t in enumerate(texts) for j in range(8)] + [(None, "abc def", None, None), (None, None, "x", 1), (3, "twice", "x", 1), (3, "twice", "x", 1)]
    cut = M.fill_in_middle(spark.createDataFrame(data, SCHEMA))
    got = sorted(map(tuple, cut.collect()), key=str)
    assert got == sorted((plain(k, t) for k, t, _, _ in data), key=str)
    back = cut.select("doc_id", M.restored(cut.output, cut.form).alias("text")).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=str) == sorted(((k, t or "") for k, t, _, _ in data), key=str)
    assert M.digests(M.fill_in_middle(spark.createDataFrame([], SCHEMA))).count() == 0
    assert M.fill_in_middle(spark.createDataFrame([("k", "text")], "doc_id string, text string")).first().doc_id == "k"
