"""Periodic runs of words by Main-Lorentz divide and conquer.

Words are interned to small numbers. At each midpoint four Z-functions tell, for
every period, how far the repetition that crosses it reaches to both sides.
Crossing repetitions are extended to maximal ones, intervals found twice are
merged, and each keeps its smallest period.

A run of at least LEAST words repeats each of its six-word windows a period
away, so only stretches of words that a repeated window covers are divided; the
windows' hashes may only add to them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, words_of

#: Least words of a run, and least number of its periods.
LEAST, REPEATS = 12, 2


def z_function(s: list[int]) -> list[int]:
    """For each place, the words from there that agree with the beginning; the whole length at 0."""
    n = len(s)
    z = [0] * n
    if not n:
        return z
    z[0] = n
    head, left, right = s[0], 0, 0
    for i in range(1, n):
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        else:
            if s[i] != head:
                continue
            k = 1
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        left, right = i, i + k
    return z


def crossing(s: list[int], low: int, mid: int, high: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of each repetition of at least two periods in s[low:high] that holds the words before and after mid.

    With a period p, a repetition has p of its words to the right of mid or p
    of them to the left. To the right, the words from mid + p on agree with
    those from mid on, and those before mid + p with those before mid; to the
    left alike. One with p words on both sides is extended by both.
    """
    left, right = s[low:mid], s[mid:high]
    back = left[::-1]
    n, m = len(left), len(right)
    # how far s[mid + p:] agrees with s[mid:], and the words before mid - p, backwards, with those before mid
    ahead, behind = z_function(right) + [0], z_function(back) + [0]
    # the words before mid + p, backwards, against those before mid; the words from mid - p against those from mid
    before, after = z_function(back + [-1] + right[::-1]), z_function(right + [-2] + left)
    for p in range(1, m + 1):
        reach = before[n + 1 + m - p]
        if reach and reach + ahead[p] >= p:
            yield mid - reach - (behind[p] if reach == p else 0), mid + p + ahead[p], p
    for p in range(1, n + 1):
        reach = after[m + 1 + n - p]
        if reach and reach + behind[p] >= p:
            yield mid - p - behind[p], mid + reach + (ahead[p] if reach == p else 0), p


def divide(s: list[int], least: int = LEAST, repeats: int = REPEATS) -> list[tuple[int, int, int]]:
    """(start, length, period) of each maximal run of s, by start, then period.

    A repetition that goes on beyond its part crosses the midpoint that cut it
    there, and is kept where it is whole. An interval found with several
    periods keeps the smallest.
    """
    found: dict[tuple[int, int], int] = {}
    parts = [(0, len(s))]
    while parts:
        low, high = parts.pop()
        if high - low < max(2, least):
            continue
        mid = (low + high) // 2
        for start, end, p in crossing(s, low, mid, high):
            if (start == low and low and s[low - 1] == s[low - 1 + p]) or (end == high and high < len(s) and s[high] == s[high - p]):
                continue
            if end - start >= max(least, repeats * p) and found.get((start, end), p + 1) > p:
                found[start, end] = p
        parts += [(low, mid), (mid, high)]
    return sorted((a, b - a, p) for (a, b), p in found.items())


def repeated_stretches(codes: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Stretches of words that windows with an equal hash cover; all words that a run can hold are in one, whole."""
    n = len(codes)
    if n < 2 * window:
        return []
    hashed = np.zeros(n - window + 1, dtype=np.uint64)
    for k in range(window):
        hashed = hashed * np.uint64(0x9E3779B97F4A7C15) + codes[k : n - window + 1 + k].astype(np.uint64) + np.uint64(1)
    order = np.argsort(hashed, kind="stable")
    same = hashed[order][1:] == hashed[order][:-1]
    if not same.any():
        return []
    marked = np.zeros(len(hashed), dtype=bool)
    marked[order[1:][same]] = marked[order[:-1][same]] = True
    places = np.flatnonzero(marked)
    cut = np.flatnonzero(np.diff(places) > window)
    return [(int(a), int(b) + window) for a, b in zip(places[np.concatenate(([0], cut + 1))], places[np.concatenate((cut, [len(places) - 1]))])]


def find_runs(words: list[bytes], least: int = LEAST, repeats: int = REPEATS) -> list[tuple[int, int, int]]:
    """(start, length, period) of each maximal run of words, by start, then period."""
    interned: dict[bytes, int] = {}
    codes = [interned.setdefault(w, len(interned)) for w in words]
    window = max(1, least // 2)
    if len(interned) > len(words) - window:
        return []
    found = []
    for a, b in repeated_stretches(np.array(codes, dtype=np.int64), window):
        found += [(a + start, length, p) for start, length, p in divide(codes[a:b], least, repeats)]
    return found


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), dtype=bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep)])


def word_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, repeats: int = REPEATS) -> DataFrame:
    """(doc_id, runs, collapsed): one row per row of docs; a map over rows, nothing is shuffled.

    runs are all maximal runs (start and length in words, smallest period),
    sorted by start, then period; collapsed is the text without the words that
    a run repeats. Null, empty and wordless texts have no runs and an empty
    collapsed text. Texts of any length are read whole; repeated rows stay;
    other columns, whatever their names, are not carried.
    """
    given = docs.schema[key].dataType.simpleString()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            runs, texts = [], []
            for raw in batch["raw"]:
                words = raw.split()
                found = find_runs(words, least, repeats)
                runs.append(found)
                texts.append(collapse(words, found))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "runs": runs, "collapsed": texts})

    rows = docs.select(F.col(key).cast("string").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("raw"))
    out = rows.mapInPandas(scan, "doc_id string, runs array<struct<start:long,length:long,period:long>>, collapsed binary")
    return out.select(F.col("doc_id").cast(given).alias("doc_id"), "runs", F.col("collapsed").cast("string").alias("collapsed"))


def with_periodic_tails(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text): a tenth of the texts, by the checksum of their ids, with a tail of words made periodic.

    With h the checksum, g = h div 10 and n words, words from a = g mod n on
    become word a + (i - a) mod p of the text, p = 1 + (n - a) div (3 + g mod
    8). A null id, a null text and a text of no words stay as they are.
    """

    def rewritten(words: Column, g: Column) -> Column:
        n = F.size(words).cast("long")
        cut = let(
            F.struct(words.alias("words"), (g % n).alias("a"), g.alias("g"), n.alias("n")),
            lambda x: let(
                F.struct(x["words"].alias("words"), x["a"].alias("a"), (1 + F.floor((x["n"] - x["a"]) / (3 + x["g"] % 8))).alias("p")),
                lambda y: F.transform(y["words"], lambda w, i: F.when(i < y["a"], w).otherwise(F.get(y["words"], (y["a"] + (i - y["a"]) % y["p"]).cast("int")))),
            ),
        )
        return F.array_join(cut, " ")

    h = F.crc32(F.col(key).cast("string").cast("binary"))
    tail = let(words_of(F.col(text)), lambda w: F.when(F.size(w) > 0, rewritten(w, F.floor(h / 10))).otherwise(F.col(text)))
    return docs.select(F.col(key).alias("doc_id"), F.when(h % 10 == 0, tail).otherwise(F.col(text)).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """One row per text: its number of runs, the longest of them, and digests of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    ended = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("")
    return found.select("doc_id", "collapsed", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), ended.alias("listed")).select(
        "doc_id",
        "n_runs",
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.col("listed").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
