"""SimHash near-duplicates by covering locality-sensitive hashing.

A bit position gets a vector of radius + 1 bits, no zero vector; a mask for each
nonzero v of as many bits keeps the positions whose vector has an odd product
with v. The vectors of `radius` differing positions span at most `radius`
dimensions, so some v is orthogonal to all of them, its mask keeps none of
them, and the pair has equal keys in that table: no pair within the radius is
missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import resemblance
from .common import settle

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Distinct fingerprints above which a bucket is split by a second family of masks.
LARGE_BUCKET = 2048
#: Rows that go, or that are alike in id and text, whose keys may be broadcast to where the texts are.
BROADCAST_KEYS = 1_000_000


def fingerprint_of(text: str | None, width: int = SHINGLE) -> int:
    return fingerprint_of_words(resemblance.words_of(text), width)


def fingerprint_of_words(words: list[bytes], width: int = SHINGLE) -> int:
    if not words:
        return 0
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(width))))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):  # bounds the unpacked bits of a very long text
        part = hashes[at : at + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


@F.pandas_udf(T.LongType())
def fingerprint(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint_of(t) for t in texts], dtype=np.uint64).view(np.int64))


def masks(radius: int = RADIUS, stride: int = 1, bits: int = 64) -> list[int]:
    """The covering masks as signed 64-bit numbers; another stride deals the vectors otherwise."""
    n = 2 ** (radius + 1) - 1
    vectors = [(i * stride + i // n) % n + 1 for i in range(bits)]
    found = [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, n + 1)]
    return [m - 2**64 if m >= 2**63 else m for m in found]


def _keyed(fps: DataFrame, keys: list[str], table: str, stride: int, radius: int) -> DataFrame:
    tables = F.array(*[F.struct(F.lit(t).alias(table), F.col("fp").bitwiseAND(F.lit(m)).alias(f"{table}_key")) for t, m in enumerate(masks(radius, stride))])
    return fps.select(*keys, "fp", F.inline(tables))


def _forest(radius: int):
    """Links that connect what a bucket's links within the radius connect: at most one for each member."""

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            left, right = [], []
            for members in batch["members"]:
                rest = np.unique(np.asarray(members, dtype=np.int64)).view(np.uint64)
                while len(rest) > 1:
                    reached, rest = [rest[0]], rest[1:]
                    while reached and len(rest):
                        at = reached.pop()
                        near = np.bitwise_count(rest ^ at) <= radius
                        found = rest[near]
                        left += [at] * len(found)
                        right += found.tolist()
                        reached += list(found)
                        rest = rest[~near]
            yield pd.DataFrame({"a": np.array(left, dtype=np.uint64).view(np.int64), "b": np.array(right, dtype=np.uint64).view(np.int64)})

    return links


def near_links(fps: DataFrame, radius: int = RADIUS, large: int = LARGE_BUCKET) -> DataFrame:
    """Links (a, b) over distinct fingerprints `fp` whose components are those of all pairs within the radius.

    Buckets are counted before anything is gathered. A bucket of two gives its
    pair at once. Larger ones are gathered as distinct fingerprints, and those
    over `large` are first split by a second covering family over the same
    bits, which no pair within the radius escapes either; after both masks at
    most 2**18 values are left to a bucket, whatever the size of the corpus.
    """
    keyed = _keyed(fps, [], "t", 1, radius)
    sized = settle(
        keyed.groupBy("t", "t_key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    )
    two = sized.where("n = 2").select("a", "b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    members = keyed.join(sized.where("n > 2").select("t", "t_key", "n"), ["t", "t_key"])
    small = members.where(F.col("n") <= large).groupBy("t", "t_key").agg(F.collect_list("fp").alias("members")).select("members")
    split = (
        _keyed(members.where(F.col("n") > large), ["t", "t_key"], "s", 7, radius)
        .groupBy("t", "t_key", "s", "s_key")
        .agg(F.collect_list("fp").alias("members"))
        .where(F.size("members") > 1)
        .select("members")
    )
    forest = small.unionByName(split).mapInPandas(_forest(radius), "a long, b long")
    return two.unionByName(forest).distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node each node of the links is connected to; roots other than themselves only.

    Alternates large-star and small-star steps, each a shuffle of the links,
    until a round changes nothing; each round is settled in the shared folder.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    edges = settle(edges)
    last = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(small_least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small_least.select("u", F.col("m").alias("v")))
            .where("u != v")
            .distinct()
        )
        edges = settle(small)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per row of docs.

    Null, empty and blank texts have fingerprint zero and are linked like any
    other. A null id gets a row and names no component unless its component
    has no other id. Rows that repeat an id stay. Other columns, whatever
    their names, are not carried. Texts are read once; only fingerprints and
    ids are shuffled, and equal fingerprints are one node before any link is
    sought, so a third of all rows with one text is one node.
    """
    marked = settle(docs.select(F.col(key).alias("doc_id"), fingerprint(F.col(text)).alias("fp")))
    nodes = settle(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = settle(components(near_links(nodes.select("fp"), radius)))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.select("fp", "root").join(named, "root").select("fp", "component_id")
    return marked.join(classes, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of docs, all columns, that stay: exactly one of each component, whatever the ids are.

    Components are those of fingerprints within the radius and of texts with a
    similarity of 0.8 or more over shingles of five words, all of both.

    It is the one with the smallest id, and of equal ids the one with the
    smallest text hash. A row without an id stays only where no row of its
    component has one. A row is found again by its id and text hash, so rows
    that share an id, or have none, don't stand for each other. Texts are not
    shuffled, but for those alike in id and text, as long as the keys of what
    goes are few enough to be broadcast.
    """
    at = F.struct(docs[key].isNull().alias("none"), docs[key].alias("id"), F.xxhash64(docs[text]).alias("text"))
    texts = docs.select(F.xxhash64(docs[text]).alias("h"), docs[text].alias("text"))
    common = resemblance.common_shingles(texts, docs.count())

    @F.pandas_udf(T.StructType([T.StructField("fp", T.LongType()), *resemblance.MARK]))
    def mark(said: pd.Series) -> pd.DataFrame:
        rows = []
        for t in said:
            words = resemblance.words_of(t)
            fp = fingerprint_of_words(words)
            rows.append((fp - (fp >> 63 << 64), *resemblance.mark_of(words, common)))
        return pd.DataFrame(rows, columns=["fp", "n", "sketch", "firsts"])

    marked = settle(docs.select(at.alias("at"), mark(docs[text]).alias("mark")).select("at", "mark.*"))
    nodes = settle(marked.groupBy("fp").agg(F.min("at").alias("at")))
    links = near_links(nodes.select("fp"), radius)
    roots = resemblance.alike_roots(texts, marked.select(F.col("at.text").alias("h"), "fp", "n", "sketch", "firsts"), links, components)
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("at", F.coalesce("root", "fp").alias("root"))
    kept = rooted.groupBy("root").agg(F.min("at").alias("at")).select("at")
    counted = marked.groupBy("at").agg(F.count(F.lit(1)).alias("n"))
    gone = settle(counted.select("at").join(kept, "at", "left_anti"))
    again = settle(counted.where("n > 1").select("at").join(kept, "at", "left_semi"))  # rows alike in id and text
    # the row is packed, so that no column of docs can clash
    packed = docs.select(at.alias("at"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    left = packed.join(_small(gone), "at", "left_anti")
    if again.isEmpty():
        return left.select("row.*")
    once = left.join(_small(again), "at", "left_anti").unionByName(left.join(_small(again), "at", "left_semi").dropDuplicates(["at"]))
    return once.select("row.*")


def _small(keys: DataFrame) -> DataFrame:
    """Keys to be broadcast up to a measured number, of forty bytes each; beyond, rows meet them by key."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
