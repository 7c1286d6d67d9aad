import re
from collections import Counter

from strandwise.llm import quality_rules as qr

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_words string"


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {p for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), n < 50 or 100 * len(hit) > 50 * n


def rows(df):
    return sorted(
        (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in df.collect()
    )


def test_counts_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = sorted((r.doc_id, *brute(r.text)) for r in docs.collect())
    assert rows(qr.quality_rules(docs)) == want


def test_edges(spark):
    texts = [None, "", " \n\t", "a b c a b c", "a b c", "x\nx\n\nx ", "é 漢字 a\x0bb\x0cc", "a a a a a", ("the same line of it\n" * 200), "w " * 30000]
    data = [(i, t, None if i % 2 else "en", None, "clash") for i, t in enumerate(texts)] + [(0, None, "en", None, "c"), (None, "q r s", None, "s", None)]
    got = rows_any(qr.quality_rules(spark.createDataFrame(data, SCHEMA)))
    assert got == sorted(((str(i), *brute(t)) for i, t, *_ in data), key=str)


def rows_any(df):
    return sorted(
        ((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in df.collect()),
        key=str,
    )


def test_empty_table(spark):
    assert qr.quality_rules(spark.createDataFrame([], SCHEMA)).count() == 0


def test_adapts_and_keeps_clean(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = qr.quality_rules(docs).join(labels, "doc_id").where("not base_failed").collect()
    good = [r.kept for r in out if r.quality == 1]
    bad = [r.kept for r in out if r.quality == 0]
    assert sum(good) >= 0.98 * len(good)
    assert sum(bad) <= 0.6 * len(bad)


def test_sketches_merge_exactly(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    signals = qr.base_signals(docs).select("*", *qr._rates())
    one = {tuple(r) for r in qr.sketches(signals.coalesce(1)).collect()}
    many = {tuple(r) for r in qr.sketches(signals.repartition(7)).collect()}
    assert one == many
