"""Components of texts with like shingles, by an exact prefix filter.

A text is the set of its shingles of WIDTH words. With all shingles in one order,
two sets of a Jaccard similarity of LEAST or more share one among the first
n - ceil(LEAST * n) + 1 of each, n being a set's size. Any order will do; here
shingles that a sample of the texts has often come last, so that few texts meet
by one that many have.

Two rounds look for links. In the first, each bucket's texts are compared with
one of them alone, which joins most of a large group of near copies at the cost
of its size. In the second, all texts that meet and are of different components
by then are compared, large buckets in blocks. A pair is compared whole only if
its sketches allow it: each shingle turns one bit of a sketch over, so two
sketches differ in no more bits than their sets do in shingles. A sketch has
SKETCH bits, doubled until they are twice the shingles, GROWN times at most; the
longer of two is folded in half, which is the sketch of half the bits. Sets that
may be alike are at most one doubling apart. No pair is missed, none guessed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import settle

WIDTH = 5
#: The least similarity, in tenths.
LEAST = 8
SEED = 42
#: Least bits of a sketch, and how often they may be doubled; texts of one bucket that are compared in one block.
SKETCH, GROWN, BLOCK = 1024, 1, 2048
#: Texts sampled for the order of shingles, and how often a common shingle is in them. They decide the cost, not the result.
SAMPLE, OFTEN = 8000, 3
#: Hashes of common shingles that the order may name, and of texts to be compared that may be broadcast.
COMMON, BROADCAST_TEXTS = 200_000, 1_000_000
_LATE = np.int64(1) << np.int64(62)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles_of(words: list[bytes], width: int = WIDTH) -> np.ndarray:
    """The distinct shingles' hashes of 62 bits, in order; none for no words. A shingle's hash mixes those of its words, in their order."""
    if not words:
        return np.empty(0, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    codes = {w: digest(w, SEED) for w in set(words)}
    own = np.fromiter(map(codes.__getitem__, words), dtype=np.uint64, count=len(words))
    n = max(1, len(words) - width + 1)
    with np.errstate(over="ignore"):
        mixed = np.zeros(n, dtype=np.uint64)
        for k in range(min(width, len(words))):
            mixed = (mixed ^ own[k : k + n]) * _MIX
            mixed ^= mixed >> np.uint64(29)
    return np.unique((mixed >> np.uint64(2)).astype(np.int64))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def sketch_of(shingles: np.ndarray) -> np.ndarray:
    size = SKETCH
    while size < 2 * len(shingles) and size < SKETCH << GROWN:
        size *= 2
    odd = (np.bincount(shingles & (size - 1), minlength=size) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


class Sketches:
    """The sketches of a block by their length; differences of one from many."""

    def __init__(self, sketches: list[np.ndarray]):
        self.length = np.fromiter(map(len, sketches), np.int64, count=len(sketches))
        self.at = np.zeros(len(sketches), np.int64)
        self.whole, self.half = {}, {}
        for n in np.unique(self.length):
            of = np.flatnonzero(self.length == n)
            self.at[of] = np.arange(len(of))
            rows = np.stack([sketches[k] for k in of]).view(np.uint64)  # of signed numbers, bits of the absolute value would count
            self.whole[n], self.half[n] = rows, rows[:, : n // 2] ^ rows[:, n // 2 :]

    def differ(self, i: int, j: np.ndarray) -> np.ndarray:
        """Bits that differ between the i-th and each of the j-th sketches; those of lengths too far apart differ in all."""
        n, out = int(self.length[i]), np.full(len(j), np.iinfo(np.int64).max // 100)
        for m, mine, theirs in ((n, self.whole, self.whole), (2 * n, self.whole, self.half), (n // 2, self.half, self.whole)):
            of = np.flatnonzero(self.length[j] == m)
            if len(of):
                out[of] = np.bitwise_count(theirs[m][self.at[j[of]]] ^ mine[n][self.at[i]]).sum(axis=1, dtype=np.int64)
        return out


@F.pandas_udf(T.ArrayType(T.LongType()))
def shingles(texts: pd.Series) -> pd.Series:
    return pd.Series([shingles_of(words_of(t)) for t in texts], dtype=object)


def prefix_size(n: int) -> int:
    return n - -(-LEAST * n // 10) + 1


def common_shingles(texts: DataFrame, n: int) -> np.ndarray:
    """The hashes of the shingles that OFTEN or more of about SAMPLE texts (h, text) have, the most frequent COMMON at most."""
    sample = texts.where(F.pmod(F.xxhash64("h"), F.lit(max(1, n // SAMPLE))) == 0)
    counted = sample.select(F.explode(shingles("text")).alias("s")).groupBy("s").count().where(F.col("count") >= OFTEN)
    found = counted.orderBy(F.desc("count"), "s").limit(COMMON).select("s").toPandas()["s"]
    return np.sort(found.to_numpy(dtype=np.int64))


def first_shingles(s: np.ndarray, common: np.ndarray) -> np.ndarray:
    """A set's first shingles in the order."""
    late = np.zeros(len(s), dtype=bool) if not len(common) else common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s
    return np.concatenate((s[~late], s[late] + _LATE))[: prefix_size(len(s))]


#: What is known of a text: the set's size, its sketch and its first shingles.
MARK = [T.StructField("n", T.LongType()), T.StructField("sketch", T.ArrayType(T.LongType())), T.StructField("firsts", T.ArrayType(T.LongType()))]


def mark_of(words: list[bytes], common: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    s = shingles_of(words)
    return len(s), sketch_of(s), first_shingles(s, common)


def meetings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs (a, b) of different components in each block, whose sketches allow them to be alike, and how many first shingles they then share at least.

    A block has the members of one or two parts of a bucket. Where `across`, it
    is two, and only pairs between them are compared.
    """
    columns = ["a", "b", "least"]
    for batch in batches:
        found, held = [], 0
        for across, sketch, *rows in zip(*(batch[c] for c in ("across", "sketch", "h", "n", "last", "root", "part"))):
            order = np.argsort(rows[0])
            h, n, last, root, part = (x[order] for x in rows)
            bits = Sketches([np.asarray(sketch[k], dtype=np.int64) for k in order])
            rest = n - (n - -(-LEAST * n // 10) + 1)
            for i in range(len(h) - 1):
                fit = (root[i + 1 :] != root[i]) & (10 * np.minimum(n[i], n[i + 1 :]) >= LEAST * np.maximum(n[i], n[i + 1 :]))
                if across:
                    fit &= part[i + 1 :] != part[i]
                j = np.flatnonzero(fit) + i + 1
                if not len(j):
                    continue
                differ = bits.differ(i, j)
                j = j[(10 + LEAST) * differ <= (10 - LEAST) * (n[i] + n[j])]
                if not len(j):
                    continue
                needed = -(-LEAST * (n[i] + n[j]) // (10 + LEAST))
                # the prefix that ends first is seen whole in the other; what lies beyond it may all be shared
                unseen = np.where(last[i] <= last[j], rest[i], rest[j])
                found.append((np.full(len(j), h[i]), h[j], np.maximum(1, needed - unseen)))
                held += len(j)
                if held > 500_000:
                    yield pd.DataFrame(dict(zip(columns, map(np.concatenate, zip(*found)))))
                    found, held = [], 0
        if found:
            yield pd.DataFrame(dict(zip(columns, map(np.concatenate, zip(*found)))))


def _only(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts of the wanted hashes, one row of each hash or more; the hashes are broadcast up to a measured number."""
    return texts.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_TEXTS else wanted, "h", "left_semi")


def _allowed(a: str, b: str) -> Column:
    """Whether two sketches and sizes allow the similarity."""
    n, m = F.col(f"{a}_n"), F.col(f"{b}_n")
    half = lambda x: (F.size(x) / 2).cast("int")
    fold = lambda x: F.zip_with(F.slice(x, 1, half(x)), F.slice(x, half(x) + 1, half(x)), lambda p, q: p.bitwiseXOR(q))
    level = lambda x, y: F.when(F.size(x) > F.size(y), fold(x)).otherwise(F.col(x))
    one, two = f"{a}_sketch", f"{b}_sketch"
    odd = F.zip_with(level(one, two), level(two, one), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    differ = F.aggregate(odd, F.lit(0), lambda acc, x: acc + F.coalesce(x, F.lit(64)))
    return (10 * F.least(n, m) >= LEAST * F.greatest(n, m)) & ((10 + LEAST) * differ <= (10 - LEAST) * (n + m))


def _verified(pairs: DataFrame, texts: DataFrame, info: DataFrame) -> DataFrame:
    """Links (a, b) between the fingerprints of those pairs (a, b) of text hashes whose sets are alike."""
    pairs = settle(pairs)
    compared = _only(texts, settle(pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct())).dropDuplicates(["h"])
    whole = settle(compared.select("h", shingles("text").alias("set")).join(info.select("h", "fp"), "h"))
    side = lambda x: whole.select(F.col("h").alias(x), F.col("set").alias(f"{x}_set"), F.col("fp").alias(f"{x}_fp"))
    both = F.size(F.array_intersect("a_set", "b_set"))
    like = (10 + LEAST) * both >= LEAST * (F.size("a_set") + F.size("b_set"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(like).select(F.col("a_fp").alias("a"), F.col("b_fp").alias("b")).distinct()


def alike_roots(texts: DataFrame, marked: DataFrame, links: DataFrame, components: Callable[[DataFrame], DataFrame], block: int = BLOCK) -> DataFrame:
    """The components (node, root) of fingerprints by the links (a, b) given and those of all texts that are alike.

    texts: (h, text). marked: (h, fp, n, sketch, firsts), a row for each row
    of the corpus. Hashes are shuffled, sketches of texts that meet, and the
    sets of those that are compared whole.
    """
    # one shuffle of sixteen bytes a first shingle; what passes a task of a common one is those, and may spill
    by = W.partitionBy("s")
    placed = marked.select("h", F.explode("firsts").alias("s")).select("s", "h", F.min("h").over(by).alias("hub"), F.max("h").over(by).alias("top"))
    met = settle(placed.where("hub != top").select("s", "h", "hub").distinct())
    known = marked.select("h", "fp", "n", "sketch", F.try_element_at("firsts", F.lit(-1)).alias("last")).join(met.select("h").distinct(), "h", "left_semi")
    info = settle(known.groupBy("h").agg(*[F.min(c).alias(c) for c in ("fp", "n", "sketch", "last")]))
    side = lambda x: info.select(F.col("h").alias(x), F.col("fp").alias(f"{x}_fp"), F.col("n").alias(f"{x}_n"), F.col("sketch").alias(f"{x}_sketch"))
    # a hint only: what this round leaves out the next one finds. Sketches of sets much larger than they are say little
    stars = met.where("h != hub").select(F.col("hub").alias("a"), F.col("h").alias("b")).distinct()
    near = stars.join(side("a"), "a").join(side("b"), "b").where(f"a_fp != b_fp and a_n + b_n <= {4 * (SKETCH << GROWN)}").where(_allowed("a", "b"))
    roots = settle(components(links.unionByName(_verified(near.select("a", "b"), texts, info))))
    named = info.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    inside = met.select("s", "h").join(named.select("h", "root"), "h")
    mixed = inside.groupBy("s").agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("low"), F.max("root").alias("high")).where("low != high")
    members = met.select("s", "h").join(mixed.select("s", "size"), "s").join(named.select("h", "n", "last", "root", "sketch"), "h")
    # a bucket's members are dealt into parts, and each pair of parts is a block
    parts = F.ceil(F.col("size") / block).cast("int")
    dealt = members.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("h"), parts.cast("long")).cast("int"))
    pair = lambda other: F.struct(F.least("part", other).alias("x"), F.greatest("part", other).alias("y"))
    blocks = (
        dealt.select("s", "h", "n", "last", "root", "sketch", "part", F.inline(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), pair)))
        .groupBy("s", "x", "y")
        .agg(F.collect_list(F.struct("h", "n", "last", "root", "sketch", "part")).alias("m"))
        .select((F.col("x") != F.col("y")).alias("across"), *[F.col("m")[c].alias(c) for c in ("h", "n", "last", "root", "sketch", "part")])
    )
    counted = blocks.mapInPandas(meetings, "a long, b long, least long").groupBy("a", "b").agg(F.count(F.lit(1)).alias("k"), F.max("least").alias("least"))
    more = _verified(counted.where("k >= least").select("a", "b"), texts, info)
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
