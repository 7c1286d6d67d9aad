"""Quality rules whose cutoffs adapt to each language and source, in DataFrame operations only.

The quantile sketch is a histogram of integers in buckets of at most 1/16
relative width (the leading five bits of a value). Sketches merge by adding
counts, so the result doesn't depend on the partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WHITE, let, settle, words_of

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_GROUP = 200
FENCE = 6
#: Groups whose fences, a hundred bytes each, may be broadcast; more are joined by group.
BROADCAST_GROUPS = 100_000
#: Signal: (least slack around the quartiles, cut above, cut below). Rates are
#: per thousand words or lines; word_len is hundredths of a code point.
SIGNALS = {
    "symbol_rate": (100, True, False),
    "dup_line_rate": (300, True, False),
    "repeat_rate": (300, True, False),
    "word_len": (250, True, True),
}


def _repeated_words(words: Column) -> Column:
    """Words in 3-word windows that the text has at least twice, each word counted once.

    A text whose window hashes are all distinct has none. Else (window hash,
    place) are sorted within the row: linear memory and n log n time for a text
    of any length, with no shuffle.
    """
    n = F.size(words)
    hashes = F.when(
        n >= 4, F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.xxhash64(F.get(words, i - 1), F.get(words, i), F.get(words, i + 1)))
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(ordered: Column) -> Column:
        twice = F.filter(
            ordered,
            lambda e, k: (e["h"] == F.get(ordered, k - 1)["h"]) | (e["h"] == F.get(ordered, k + 1)["h"]),
        )
        places = F.sort_array(F.transform(twice, lambda e: e["i"]))
        step = F.aggregate(
            places,
            F.struct(F.lit(-2).alias("last"), F.lit(0).cast("long").alias("n")),
            lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).cast("long").alias("n")),
            lambda acc: acc["n"],
        )
        return step

    placed = lambda h: F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), (i + 1).alias("i"))))
    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(placed(h), covered)))


def base_signals(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Counts of each whole text and the fixed rules on them."""
    blob = F.coalesce(F.col(text), F.lit(""))
    one = docs.select(
        F.col(key).alias("doc_id"),
        F.coalesce(F.col(lang), F.lit("")).alias("lang"),
        F.coalesce(F.col(source), F.lit("")).alias("source"),
        let(
            words_of(F.col(text)),
            lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeated_words(w).alias("n_repeat_words")),
        ).alias("of_words"),
        let(
            F.filter(F.split(blob, "\n"), lambda s: F.translate(s, " " + WHITE, "") != ""),
            lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")),
        ).alias("of_lines"),
        F.length(F.translate(blob, " " + WHITE, "")).cast("long").alias("word_chars"),
        (F.length(blob) - F.length(F.translate(blob, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    flat = one.select("doc_id", "lang", "source", "word_chars", "n_symbols", "of_words.*", "of_lines.*")
    return flat.withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
    )


def _rates() -> list[Column]:
    return [
        F.expr("1000 * n_symbols div greatest(n_words, 1)").alias("symbol_rate"),
        F.expr("1000 * n_dup_lines div greatest(n_lines, 1)").alias("dup_line_rate"),
        F.expr("1000 * n_repeat_words div greatest(n_words, 1)").alias("repeat_rate"),
        F.expr("100 * word_chars div greatest(n_words, 1)").alias("word_len"),
    ]


def bucket(value: Column) -> Column:
    """The least integer with the same leading five bits: an exact merge key of relative width 1/16."""
    shift = F.greatest(F.length(F.bin(value)) - 5, F.lit(0))
    width = F.pow(F.lit(2.0), shift).cast("long")
    return value - value % width


def sketches(signals: DataFrame) -> DataFrame:
    """(lang, source, signal, bucket, n): one mergeable histogram for each group and signal."""
    pairs = F.array(*[F.struct(F.lit(s).alias("signal"), bucket(F.col(s)).alias("bucket")) for s in SIGNALS])
    return (
        signals.where(F.col("n_words") > 0)
        .select("lang", "source", F.inline(pairs))
        .groupBy("lang", "source", "signal", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _quartiles(merged: DataFrame, keys: list[str]) -> DataFrame:
    by = W.partitionBy(*keys, "signal")
    running = merged.select(
        *keys,
        "signal",
        "bucket",
        F.sum("n").over(by).alias("total"),
        F.sum("n").over(by.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)).alias("upto"),
    )
    return running.groupBy(*keys, "signal").agg(
        F.max("total").alias("total"),
        F.min(F.when(4 * F.col("upto") >= F.col("total"), F.col("bucket"))).alias("q1"),
        F.min(F.when(4 * F.col("upto") >= 3 * F.col("total"), F.col("bucket"))).alias("q3"),
    )


def thresholds(histograms: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """(lang, source, <signal>_low, <signal>_high): quartile fences of the group.

    A group of fewer than min_group texts takes the sketch merged over its
    language, and a language of fewer that of the whole table.
    """
    histograms = settle(histograms)
    group = _quartiles(histograms, ["lang", "source"])
    language = _quartiles(histograms.groupBy("lang", "signal", "bucket").agg(F.sum("n").alias("n")), ["lang"])
    whole = _quartiles(histograms.groupBy("signal", "bucket").agg(F.sum("n").alias("n")), [])
    named = lambda df, p, keys: df.select(*keys, "signal", *[F.col(c).alias(f"{p}_{c}") for c in ("total", "q1", "q3")])
    # language: a few rows for each language; whole: one row for each signal
    joined = (
        group.join(F.broadcast(named(whole, "w", [])), "signal")
        .join(named(language, "l", ["lang"]), ["lang", "signal"])
    )
    pick = lambda c: (
        F.when(F.col("total") >= min_group, F.col(c)).when(F.col("l_total") >= min_group, F.col(f"l_{c}")).otherwise(F.col(f"w_{c}"))
    )
    slack = F.greatest(FENCE * (F.col("q3") - F.col("q1")), F.element_at(F.create_map(*[F.lit(x) for s, (least, _, _) in SIGNALS.items() for x in (s, least)]), F.col("signal")))
    fenced = joined.select("lang", "source", "signal", pick("q1").alias("q1"), pick("q3").alias("q3")).select(
        "lang", "source", "signal", (F.col("q1") - slack).alias("low"), (F.col("q3") + slack).alias("high")
    )
    at = lambda s, c: F.max(F.when(F.col("signal") == s, F.col(c))).alias(f"{s}_{c}")
    return fenced.groupBy("lang", "source").agg(*[at(s, c) for s in SIGNALS for c in ("low", "high")])


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per row of docs, with its counts, the fixed rules and the adaptive verdict.

    Null and empty texts have no words: all counts 0, base_failed, not kept.
    A null language or source is a group of its own. Repeated rows stay
    repeated rows. Other columns, whatever their names, are not carried.
    Texts are read once and never shuffled; the counts are settled in the
    shared folder. The fences are broadcast up to BROADCAST_GROUPS groups, as
    counted; beyond, counts meet them by group.
    """
    signals = settle(base_signals(docs, key, text, lang, source).select("*", *_rates()))
    fences = settle(thresholds(sketches(signals)))
    if fences.count() <= BROADCAST_GROUPS:
        fences = F.broadcast(fences)
    fine = F.lit(True)
    for s, (_, above, below) in SIGNALS.items():
        if above:
            fine = fine & (F.col(s) <= F.col(f"{s}_high"))
        if below:
            fine = fine & (F.col(s) >= F.col(f"{s}_low"))
    return (
        signals.join(fences, ["lang", "source"], "left")
        .withColumn("kept", ~F.col("base_failed") & F.coalesce(fine, F.lit(False)))
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
            *SIGNALS,
        )
    )


def _oracle() -> str:
    """DuckDB SQL for the verdicts over `documents`, for tables whose ids are unique."""
    gone = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    rate = {
        "symbol_rate": "1000 * n_symbols // greatest(n_words, 1)", "dup_line_rate": "1000 * n_dup_lines // greatest(n_lines, 1)",
        "repeat_rate": "1000 * n_repeat_words // greatest(n_words, 1)", "word_len": "100 * word_chars // greatest(n_words, 1)",
    }
    long = " UNION ALL ".join(
        f"SELECT lang, source, '{s}' AS signal, {least} AS least, {s} - {s} % (1::BIGINT << greatest(length(bin({s})) - 5, 0)) AS bucket FROM rated WHERE n_words > 0"
        for s, (least, _, _) in SIGNALS.items()
    )
    fine = " AND ".join(
        f"(SELECT bool_and({test}) FROM fences f WHERE f.lang = r.lang AND f.source = r.source AND signal = '{s}')"
        for s, (_, above, below) in SIGNALS.items()
        for test in ([f"r.{s} <= high"] if above else []) + ([f"r.{s} >= low"] if below else [])
    )
    quartiles = (
        "SELECT {0} signal, max(total) AS total, min(bucket) FILTER (4 * upto >= total) AS q1, min(bucket) FILTER (4 * upto >= 3 * total) AS q3 FROM "
        "(SELECT *, sum(n) OVER (PARTITION BY {0} signal ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {0} signal) AS total FROM (SELECT {0} signal, bucket, count(*) AS n FROM long GROUP BY ALL)) GROUP BY {0} signal"
    )
    return f"""
WITH docs AS MATERIALIZED (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text,
    list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: translate(x, {gone}, '') <> '') AS lines FROM documents),
placed AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM docs),
windows AS (SELECT doc_id, i, w || ' ' || lead(w) OVER p || ' ' || lead(w, 2) OVER p AS tri FROM placed WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, tri) AS k FROM windows WHERE tri IS NOT NULL) WHERE k > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
counted AS (
  SELECT d.doc_id, lang, source, len(words)::BIGINT AS n_words, length(translate(text, {gone}, ''))::BIGINT AS word_chars,
    (length(text) - length(translate(text, '{SYMBOLS}', '')))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM docs d LEFT JOIN covered USING (doc_id)),
rated AS MATERIALIZED (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed, {", ".join(f"{e} AS {s}" for s, e in rate.items())} FROM counted),
long AS MATERIALIZED ({long}),
own AS ({quartiles.format("lang, source,")}), lang_wide AS ({quartiles.format("lang,")}), whole AS ({quartiles.format("")}),
picked AS (
  SELECT own.lang, own.source, own.signal, least,
    CASE WHEN own.total >= {MIN_GROUP} THEN own.q1 WHEN l.total >= {MIN_GROUP} THEN l.q1 ELSE w.q1 END AS q1,
    CASE WHEN own.total >= {MIN_GROUP} THEN own.q3 WHEN l.total >= {MIN_GROUP} THEN l.q3 ELSE w.q3 END AS q3
  FROM own JOIN lang_wide l ON l.lang = own.lang AND l.signal = own.signal JOIN whole w ON w.signal = own.signal JOIN (SELECT DISTINCT signal, least FROM long) x ON x.signal = own.signal),
fences AS MATERIALIZED (SELECT lang, source, signal, q1 - greatest({FENCE} * (q3 - q1), least) AS low, q3 + greatest({FENCE} * (q3 - q1), least) AS high FROM picked)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce({fine}, false) AS kept,
  symbol_rate, dup_line_rate, repeat_rate, word_len FROM rated r
"""


ORACLE = _oracle()
