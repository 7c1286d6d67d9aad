import zlib
from hashlib import sha256

from hypothesis import given, settings
from hypothesis import strategies as st

from strandwise.llm import word_runs as W

SCHEMA = "doc_id long, text string, runs string, collapsed int"


def brute(words, least=W.LEAST, repeats=W.REPEATS):
    """Every period, every maximal stretch of words that agree a period away; the smallest period of an interval."""
    found = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, repeats * p):
                found.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((a, b - a, p) for (a, b), p in found.items())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.integers(0, 40), st.integers(1, 20), st.integers(1, 6), st.integers(1, 14))
def test_all_runs(words, at, period, times, least):
    tail = (words[at:] or [7])[:period]
    words = [str(w).encode() for w in words[:at] + tail * times + words[at:]]
    assert W.find_runs(words, least) == brute(words, least)


def test_z_function():
    for s in ([], [1], [1, 1, 1], [1, 2, 1, 2, 1], [0, 0, 1, 0, 0, 1, 0, 2]):
        want = [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]
        assert W.z_function(s) == want


def planted(key, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(key).encode())
    g, n = h // 10, len(words)
    if key is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def expected(key, text):
    words = planted(key, text)
    runs = brute(words)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    return (
        key, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
        sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest(),
        sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest(),
    )


def test_query_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = W.digests(W.word_runs(W.with_periodic_tails(docs))).collect()
    want = {r.doc_id: expected(r.doc_id, r.text) for r in docs.collect()}
    assert len(got) == len(want) and any(r.n_runs for r in got)
    assert all(tuple(r) == want[r.doc_id] for r in got)


def test_edges(spark):
    long = "one two three four five six seven eight " * 20_000 + "end"
    data = [(None, "a b " * 9, "x", 1), (1, None, None, None), (2, "", "x", 1), (3, " \n\t", "x", 1), (4, "é b " * 12, "x", 1), (4, "é b " * 12, "x", 1), (5, long, "x", 1)]
    got = W.digests(W.word_runs(W.with_periodic_tails(spark.createDataFrame(data, SCHEMA)))).collect()
    assert len(got) == 7
    by = {r.doc_id: r for r in got}
    assert (by[None].n_runs, by[None].start, by[None].length, by[None].period, by[None].exponent_milli) == (1, 0, 18, 2, 9000)
    empty = sha256(b"").hexdigest()
    for k in (1, 2, 3):
        assert tuple(by[k])[1:] == (0, None, None, None, None, empty, empty)
    assert [tuple(r) for r in got if r.doc_id == 4] == [expected(4, "é b " * 12)] * 2
    assert by[5].length >= 80_000 and by[5].n_runs >= 1
    assert W.digests(W.word_runs(W.with_periodic_tails(spark.createDataFrame([], SCHEMA)))).count() == 0


def test_any_key_type(spark):
    docs = spark.createDataFrame([("k", "a b c " * 5)], "doc_id string, text string")
    row = W.word_runs(docs).first()
    assert row.doc_id == "k" and [tuple(r) for r in row.runs] == [(0, 15, 3)] and row.collapsed == "a b c"
