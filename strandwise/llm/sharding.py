"""Weighted rendezvous sharding of stable record keys, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandwise.operators.iterate import ranked


def _uniform(key: Column, shard: int) -> Column:
    """A number in (0, 1) that key and shard decide: 52 bits of an MD5."""
    head = F.substring(F.md5(F.concat(key, F.lit(f":{shard}")).cast("binary")), 1, 13)
    return (F.conv(head, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**52))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard with the largest -weight / ln(u(key, shard)); the smaller shard wins a tie.

    A shard with weight 0 gets nothing. Adding a shard leaves every other
    score as it was, so records move only into the new one.
    """
    scores = [F.struct((F.lit(-float(w)) / F.log(_uniform(key, s))).alias("score"), F.lit(-s).alias("shard")) for s, w in enumerate(weights) if w > 0]
    best = scores[0] if len(scores) == 1 else F.greatest(*scores)
    return (-best["shard"]).cast("int")


def shard_records(
    records: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    weights: Sequence[float] = (1.0,) * 8,
    grown_weights: Sequence[float] = (1.0,) * 9,
    slot_buckets: int = 4096,
) -> DataFrame:
    """Assign each record a shard, a gapless slot in it, and its shard after growth.

    A null key counts as the empty key; a null text as the empty text. Rows
    that repeat a key get the same shard and slots of their own, dealt in the
    order of key, checksum and size (full ties are interchangeable). Other
    columns, whatever their names, are not carried. No text is shuffled: only
    key, size and checksum are. Rows are sorted by range in the order of shard,
    bucket of the key's hash, key, checksum and size, and numbered by their
    range's part and place in it, so neither a shard nor a key, nor rows that
    are alike in all, are numbered in one task; a shard's first number comes
    from its count, a row a shard.
    """
    blob = F.coalesce(F.col(text), F.lit(""))
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    dealt = records.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(blob).cast("long") + 1).alias("size"),
        F.crc32(blob.cast("binary")).alias("text_crc32"),
        rendezvous(name, weights).alias("shard"),
        rendezvous(name, grown_weights).alias("grown_shard"),
        (F.conv(F.substring(F.md5(name.cast("binary")), 1, 6), 16, 10).cast("long") % slot_buckets).alias("bucket"),
        # rows alike in all are parted by where they stand
        F.xxhash64(F.monotonically_increasing_id()).alias("tie"),
    )
    placed = ranked(dealt, "shard", "bucket", "doc_id", "text_crc32", "size", "tie", name="place")
    counts = placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return placed.join(F.broadcast(starts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("place") - F.col("start") - 1).cast("long").alias("slot"), "grown_shard"
    )


ORACLE = """
WITH crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i::UBIGINT, [x::UBIGINT FOR x IN range(8)]),
      lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END) AS c
    FROM range(256) r(i))),
bytes AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
sized AS (
  SELECT doc_id, length(h) // 2 + 1 AS size,
    xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT,
      [('0x' || substr(h, 2 * i + 1, 2))::UBIGINT FOR i IN range(length(h) // 2)]),
      lambda c, b: xor(c // 256, t[(xor(c, b) % 256)::BIGINT + 1]))) AS crc
  FROM bytes, crc_table),
scored AS (
  SELECT s.doc_id, s.size, s.crc, g.shard,
    -1.0 / ln((('0x' || substr(md5(coalesce(s.doc_id::VARCHAR, '') || ':' || g.shard), 1, 13))::BIGINT + 0.5) / 4503599627370496.0) AS score
  FROM sized s, (SELECT unnest(range(9)) AS shard) g),
dealt AS (
  SELECT doc_id, size, crc,
    arg_max(shard, score) FILTER (WHERE shard < 8) AS shard, arg_max(shard, score) AS grown_shard,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 6))::BIGINT % 4096 AS bucket
  FROM scored GROUP BY doc_id, size, crc)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'key' AS law, shard::INTEGER AS shard,
  (row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id, crc, size) - 1)::BIGINT AS slot,
  grown_shard::INTEGER AS grown_shard
FROM dealt
"""
