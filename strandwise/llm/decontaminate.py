"""Benchmark decontamination by a BM25 inverted index of test items with block-max WAND.

Every training text is cut into passages that overlap by half, so that each
test item fits whole into one. A passage is a query: an item's score is the
share of its own BM25 mass that the passage's terms carry, with document
frequencies and the mean length of all items, however many indexes they make.
A passage first sums the maxima of its posting lists, over all items and then
over ranges of items; where that reaches the threshold, its cursors go through
the range by block-max WAND, and every item at or above the threshold is
checked for overlap of its question and its answer.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import settle, written
from .license_scan import words_of as ascii_words_of

K1, B = 1.2, 0.75
#: Least share of an item's BM25 mass, of its 5-word shingles, and of those of its question and its answer alone.
THRESHOLD, MIN_OVERLAP, MIN_PART = 0.5, 0.8, 0.5
SHINGLE = 5
#: Ranges of items that bounds are summed over, whatever the number of items; blocks in a range; least items in a block.
RANGES, RANGE_BLOCKS, BLOCK_ITEMS = 128, 16, 2
#: UTF-8 bytes of items in one index; more items make more indexes, each of which sees every passage.
INDEX_BYTES = 32_000_000
#: Words of half a passage, the least of them; longer items have indexes of their own with half passages of 4, 16, ... times as many.
STRIDE = 64
#: Half passages bounded at once.
CHUNK = 2048


def words_of(text: str | None) -> list[bytes]:
    """Words without case or punctuation."""
    return ascii_words_of((text or "").casefold())


def split_item(text: str) -> tuple[list[bytes], int]:
    """The item's words and how many of them are its question: what stands before its last line, else its first half."""
    head, _, _ = (text or "").rstrip().rpartition("\n")
    words, question = words_of(text), words_of(head)
    return words, len(question) if question else (len(words) + 1) // 2


class Index:
    """Postings of normalised BM25 impacts over some of the items, with maxima by term, range and block.

    df, n_items and mean_words are those of all items. An item's number is its
    place in the index; a range is `span` of them, a block `block`.
    """

    def __init__(self, items: list[tuple[int, str]], df: dict[bytes, int], n_items: int, mean_words: float, stride: int = STRIDE):
        kept = [(i, *split_item(t)) for i, t in sorted(items, key=lambda x: (x[0] is None, x[0], x[1])) if words_of(t)]
        # items that share their commonest words stand together, which tightens the bounds
        common = Counter(w for _, words, _ in kept for w in set(words))
        kept.sort(key=lambda x: sorted(((-common[w], w) for w in set(x[1])))[:4])
        self.ids = [i for i, _, _ in kept]
        self.words = [w for _, w, _ in kept]
        self.question = [q for _, _, q in kept]
        self.vocabulary: dict[bytes, int] = {}
        for words in self.words:
            for w in words:
                self.vocabulary.setdefault(w, len(self.vocabulary))
        self.stride = stride
        n, size = len(kept), len(self.vocabulary)
        self.span = max(BLOCK_ITEMS, -(-n // RANGES))
        self.block = max(BLOCK_ITEMS, -(-self.span // RANGE_BLOCKS))
        self.n_ranges = -(-n // self.span)
        known = np.array([df[w] for w in self.vocabulary], dtype=float)
        idf = np.log1p((n_items - known + 0.5) / (known + 0.5))
        term, item, impact = [], [], []
        for d, words in enumerate(self.words):
            terms, tf = np.unique([self.vocabulary[w] for w in words], return_counts=True)
            mass = idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean_words))
            term.append(terms)
            item.append(np.full(len(terms), d))
            impact.append(mass / mass.sum())
        whole = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
        term, item, impact = whole(term, np.int64), whole(item, np.int64), whole(impact, np.float64)
        self.list_max = np.zeros(size)
        np.maximum.at(self.list_max, term, impact)
        # range maxima, in rows by term
        within = max(self.n_ranges, 1)
        cell, at = np.unique(term * within + item // self.span, return_inverse=True)
        self.range_max = np.zeros(len(cell))
        np.maximum.at(self.range_max, at, impact)
        self.range_of = cell % within
        self.row = np.searchsorted(cell // within, np.arange(size + 1))
        # posting lists of each range, by term and item; a posting knows its block's maximum
        _, at = np.unique(term * (n + 1) + item // self.block, return_inverse=True)
        top = np.zeros(at.max(initial=-1) + 1)
        np.maximum.at(top, at, impact)
        order = np.lexsort((item, term, item // self.span))
        cuts = np.searchsorted((item // self.span)[order], np.arange(self.n_ranges + 1))
        self.lists = [(term[o], item[o], impact[o], top[at[o]]) for o in (order[a:b] for a, b in zip(cuts, cuts[1:]))]

    def codes(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocabulary.get, words, repeat(-1)), dtype=np.int64, count=len(words))

    def candidates(self, segment: np.ndarray, code: np.ndarray, joined: np.ndarray, threshold: float) -> Iterator[tuple[int, int]]:
        """(segment, range) where the passage of that segment and the next may reach the threshold.

        segment, code: distinct pairs by segment. joined: whether a segment's
        next one is of the same text. Bounds of two segments are added, which
        counts terms of both twice and so only loosens them.
        """
        n = len(joined)
        lists = np.bincount(segment, weights=self.list_max[code], minlength=n)
        able = lists + np.where(joined, np.append(lists[1:], 0), 0) >= threshold
        for low in range(0, n, CHUNK):
            high = min(low + CHUNK, n)
            if not able[low:high].any():
                continue
            a, b = np.searchsorted(segment, (low, high + 1))
            first, counts = self.row[code[a:b]], self.row[code[a:b] + 1] - self.row[code[a:b]]
            within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            cell = np.repeat(first, counts) + within
            place = np.repeat(segment[a:b] - low, counts) * self.n_ranges + self.range_of[cell]
            rows = high + 1 - low
            bound = np.bincount(place, weights=self.range_max[cell], minlength=rows * self.n_ranges).reshape(rows, self.n_ranges)
            bound = bound[:-1] + np.where(joined[low:high, None], bound[1:], 0)
            for s, k in zip(*np.nonzero(bound >= threshold - 1e-9)):
                yield low + int(s), int(k)

    def search(self, part: int, present: np.ndarray, threshold: float) -> Iterator[tuple[int, float]]:
        """(item, score) of the range's items at or above the threshold, by block-max WAND over the lists of the present terms."""
        own = present[self.lists[part][0]]
        term, item, impact, top = (x[own] for x in self.lists[part])
        if not len(term):
            return
        heads = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1])))
        most = np.maximum.reduceat(impact, heads)
        if most.sum() < threshold - 1e-9:
            return  # no pivot
        most = most.tolist()
        at, ends = heads.tolist(), [*heads[1:].tolist(), len(term)]
        item, impact, top = item.tolist(), impact.tolist(), top.tolist()
        live = list(range(len(at)))  # cursors that aren't at their list's end
        threshold -= 1e-9

        def advance(c: int, to: int) -> None:
            while at[c] < ends[c] and item[at[c]] < to:
                at[c] += 1

        while live:
            live.sort(key=lambda c: item[at[c]])
            bound = 0.0
            for k, c in enumerate(live):
                bound += most[c]
                if bound >= threshold:
                    break
            else:
                return  # no item left can reach it
            pivot = item[at[c]]
            while k + 1 < len(live) and item[at[live[k + 1]]] == pivot:
                k += 1
            block, bound = pivot // self.block, 0.0
            for c in live[: k + 1]:
                e = at[c]
                while e < ends[c] and item[e] < pivot:
                    e += 1
                if e < ends[c] and item[e] // self.block == block:
                    bound += top[e]
            if bound >= threshold:
                for c in live[: k + 1]:
                    advance(c, pivot)
                score = sum(impact[at[c]] for c in live[: k + 1] if at[c] < ends[c] and item[at[c]] == pivot)
                if score >= threshold:
                    yield pivot, score
                to = pivot + 1
            else:  # no item up to the block's end, nor before the next list sets in, can reach it
                to = (block + 1) * self.block
                if k + 1 < len(live):
                    to = min(to, item[at[live[k + 1]]])
            for c in live[: k + 1]:
                advance(c, to)
            live = [c for c in live if at[c] < ends[c]]

    def verify(self, item: int, passage: set[bytes]) -> tuple[float, float, float]:
        """Shares of the item's shingles, of its question's and of its answer's, that the passage has."""
        words, question = self.words[item], self.question[item]
        hits = [s in passage for s in shingles(words)]
        cut = max(1, min(question - SHINGLE // 2, len(hits) - 1)) if len(hits) > 1 else 1
        part = lambda x: sum(x) / len(x) if x else 1.0
        return part(hits), part(hits[:cut]), part(hits[cut:])


def shingles(words: list[bytes]) -> list[bytes]:
    """5-word shingles; of fewer words the whole sequence."""
    return [b" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))]


def leaks_of(index: Index, texts: list[str | None], threshold: float, overlap: float, part: float) -> list[list[tuple]]:
    """For each text its leaked items: (item, score, overlap, question's, answer's) of the best passage."""
    found: list[dict] = [{} for _ in texts]
    if not index.ids:
        return [[] for _ in texts]
    step = index.stride
    segments, codes, owner, joined = [], [], [], []
    for k, t in enumerate(texts):
        code = index.codes(words_of(t))
        n = max(1, -(-len(code) // step))
        known = np.flatnonzero(code >= 0)
        segments.append(len(owner) + known // step)
        codes.append(code[known])
        owner += [k] * n
        joined += [True] * (n - 1) + [False]
    size = len(index.vocabulary)
    pairs = np.unique(np.concatenate(segments) * size + np.concatenate(codes)) if segments else np.zeros(0, np.int64)
    segment, code = pairs // size, pairs % size
    at_owner = np.array(owner)
    firsts = np.searchsorted(at_owner, np.arange(len(texts)))
    held: tuple[int, list[bytes]] = (-1, [])
    seen: tuple[int, np.ndarray, set[bytes]] = (-1, np.zeros(0, dtype=bool), set())
    for s, part_of in index.candidates(segment, code, np.array(joined, dtype=bool), threshold):
        k = owner[s]
        if seen[0] != s:
            if held[0] != k:
                held = (k, words_of(texts[k]))
            words = held[1][(s - firsts[k]) * step : (s - firsts[k] + 2) * step]
            present = np.zeros(size, dtype=bool)
            own = index.codes(words)
            present[own[own >= 0]] = True
            seen = (s, present, set())
            passage = words
        for item, score in index.search(part_of, seen[1], threshold):
            if not seen[2]:
                seen[2].update(shingles(passage))
            whole, question, answer = index.verify(item, seen[2])
            if whole >= overlap and question >= part and answer >= part:
                best = (round(score, 6), round(whole, 6), round(question, 6), round(answer, 6))
                found[k][item] = max(found[k].get(item, best), best)
    return [[(index.ids[i], *x) for i, x in sorted(f.items())] for f in found]


class Benchmark:
    """The test items, dealt into indexes of about index_bytes each, with statistics of all of them.

    Items are written once with their words counted; document frequencies are
    a table. An index is made when it is asked for: its items and the
    frequencies of its terms, which are no more than its items' words, are all
    that the driver holds.
    """

    def __init__(self, benchmark: DataFrame, item: str = "item_id", text: str = "text", index_bytes: int = INDEX_BYTES):
        @F.pandas_udf(T.ArrayType(T.BinaryType()))
        def terms(texts: pd.Series) -> pd.Series:
            return pd.Series([words_of(t) for t in texts], dtype=object)

        read = benchmark.select(F.col(item).cast("long").alias("item"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        counted = settle(read.withColumn("words", terms("text")).withColumn("n", F.size("words")).where("n > 0"))
        # 64, 256, 1024, ... words: the least half passage that an item fits into
        step = F.greatest(F.ceil(F.log(4.0, F.col("n") / STRIDE) - 1e-9), F.lit(0)).cast("int")
        self.items = counted.withColumn("step", step)
        total = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("n").alias("mean")).first()
        self.n_items, self.mean_words = total.n, total.mean
        self.df = settle(counted.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")))
        sizes = self.items.groupBy("step").agg(F.sum(F.octet_length("text")).alias("bytes")).orderBy("step").collect()
        self.parts = [(r.step, shard, shards) for r in sizes for shards in [-(-r.bytes // index_bytes)] for shard in range(shards)]

    def __len__(self) -> int:
        return len(self.parts)

    def index(self, k: int) -> Index:
        step, shard, shards = self.parts[k]
        own = self.items.where((F.col("step") == step) & (F.pmod(F.xxhash64("item", "text"), F.lit(shards)) == shard))
        used = own.select(F.explode("words").alias("term")).distinct()
        df = {bytes(r.term): r.df for r in self.df.join(used, "term").collect()}
        return Index([(r.item, r.text) for r in own.select("item", "text").collect()], df, self.n_items, self.mean_words, STRIDE * 4**step)


LEAKS = T.ArrayType(
    T.StructType([T.StructField("item_id", T.LongType())] + [T.StructField(c, T.DoubleType()) for c in ("score", "overlap", "question_overlap", "answer_overlap")])
)


def leak_column(docs: DataFrame, index: Index, text: Column, threshold: float = THRESHOLD, overlap: float = MIN_OVERLAP, part: float = MIN_PART):
    """A column with the leaked items of each text; the index goes to each executor once, as a broadcast of known size."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    @F.pandas_udf(LEAKS)
    def leaks(texts: pd.Series) -> pd.Series:
        out, step = [], 512  # texts bounded at once
        values = list(texts)
        for a in range(0, len(values), step):
            out += leaks_of(shared.value, values[a : a + step], threshold, overlap, part)
        return pd.Series(out)

    return leaks(text), shared


def benchmark_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", index_bytes: int = INDEX_BYTES, **limits) -> DataFrame:
    """(doc_id, item_id, score, overlap, question_overlap, answer_overlap): one row for each leaked item of each row of docs.

    Null and empty texts and items have no words and leak nothing. Repeated
    rows give repeated rows, items that tie are all given. Texts of any length
    are read whole; nothing is shuffled. Other columns are not carried. Where
    the items make several indexes, each one's rows are written before the
    next is made.
    """
    items = Benchmark(benchmark, index_bytes=index_bytes)
    found = []
    for k in range(len(items)):
        column, shared = leak_column(docs, items.index(k), F.col(text), **limits)
        rows = docs.select(F.col(key).alias("doc_id"), F.inline(column))
        if len(items) > 1:
            rows = written(rows, "leaks")
            shared.destroy()
        found.append(rows)
    if not found:
        none = F.lit(None).cast(LEAKS)
        return docs.select(F.col(key).alias("doc_id"), F.inline(none))
    out = found[0]
    for rows in found[1:]:
        out = out.unionByName(rows)
    return out


def drop_leaked(docs: DataFrame, benchmark: DataFrame, text: str = "text", index_bytes: int = INDEX_BYTES, **limits) -> DataFrame:
    """The rows of docs, all columns, in which no test item is found; with several indexes, written after each."""
    items = Benchmark(benchmark, index_bytes=index_bytes)
    for k in range(len(items)):
        column, shared = leak_column(docs, items.index(k), F.col(text), **limits)
        docs = docs.where(F.size(column) == 0)
        if len(items) > 1:
            docs = written(docs, "unleaked")
            shared.destroy()
    return docs
