"""Fill-in-the-middle transformation over succinct boundary bitvectors.

Each text is UTF-8 bytes; a bit a byte marks where a code point begins, packed
eight to a byte, with a directory of the ones before each block. The total
popcount is the number of code points, and select on two ranks gives the bytes
at which the text is cut, so no text is decoded or walked character by
character. Output and form rebuild the text exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts, how many are transformed; of 100 transformed ones, how many put the suffix first.
RATE, SUFFIX_FIRST = 90, 20
#: Bytes of packed bits that one entry of the directory covers.
BLOCK = 64
_ONES = np.array([bin(b).count("1") for b in range(256)], dtype=np.uint8)


class Boundaries:
    """Rank and select over the code point starts of UTF-8 bytes."""

    def __init__(self, raw: bytes):
        self.size = len(raw)
        starts = (np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80
        packed = np.packbits(starts)
        self.packed = np.pad(packed, (0, -len(packed) % BLOCK))
        ones = _ONES[self.packed].reshape(-1, BLOCK).sum(1, dtype=np.int64)
        self.before = np.concatenate(([0], np.cumsum(ones)))

    @property
    def total(self) -> int:
        return int(self.before[-1])

    def rank(self, at: int) -> int:
        """Code points that begin before byte `at`."""
        at = max(0, min(at, self.size))
        block = at // (8 * BLOCK)
        if block == len(self.before) - 1:
            return self.total
        inside = np.unpackbits(self.packed[block * BLOCK : (block + 1) * BLOCK], count=at - block * 8 * BLOCK)
        return int(self.before[block]) + int(inside.sum())

    def select(self, rank: int) -> int:
        """The byte at which code point `rank`, from 0, begins; the size for the total."""
        if rank >= self.total:
            return self.size
        block = int(np.searchsorted(self.before, rank, side="right")) - 1
        inside = np.flatnonzero(np.unpackbits(self.packed[block * BLOCK : (block + 1) * BLOCK]))
        return block * 8 * BLOCK + int(inside[rank - int(self.before[block])])


def draws(seed: int, key: str) -> tuple[int, int, int, int]:
    """Four 32-bit numbers that seed and key decide."""
    digest = sha256(f"{seed}:{key}".encode()).hexdigest()
    return tuple(int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))


def transform(raw: bytes, key: str, seed: int, rate: int, suffix_first: int) -> tuple[int, str, int | None, int | None, bytes]:
    """(code points, form, code points of prefix and of middle, output) of one text."""
    bits = Boundaries(raw)
    n = bits.total
    h1, h2, h3, h4 = draws(seed, key)
    if not raw or h3 % 100 >= rate or any(s.encode() in raw for s in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, raw
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = bits.select(first), bits.select(last)
    prefix, middle, suffix = PREFIX.encode() + raw[:a], MIDDLE.encode() + raw[a:b], SUFFIX.encode() + raw[b:]
    if h4 % 100 < suffix_first:
        return n, "spm", first, last - first, suffix + prefix + middle
    return n, "psm", first, last - first, prefix + suffix + middle


def fill_in_middle(
    docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1, rate: int = RATE, suffix_first: int = SUFFIX_FIRST
) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): one row per row of docs; nothing is shuffled.

    The draws depend on seed and key alone: repeated rows get the same output,
    any partitioning the same rows. A null key counts as the empty key, a null
    text as the empty text. Empty texts, texts that hold a sentinel and those
    beyond `rate` stay as they are, with null prefix_chars and middle_chars;
    prefix, middle or suffix may be empty. Texts of any length are cut whole.
    Other columns, whatever their names, are not carried.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [transform(raw, name, seed, rate, suffix_first) for raw, name in zip(batch["raw"], batch["name"])]
            out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
            out["prefix_chars"], out["middle_chars"] = out["prefix_chars"].astype("Int64"), out["middle_chars"].astype("Int64")
            out.insert(0, "name", batch["name"].to_numpy())
            out.insert(0, "null_key", batch["null_key"].to_numpy())
            yield out

    given = docs.schema[key].dataType.simpleString()
    rows = docs.select(
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("name"),
        F.col(key).isNull().alias("null_key"),
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("raw"),
    )
    done = rows.mapInPandas(cut, "null_key boolean, name string, n long, form string, prefix_chars long, middle_chars long, output binary")
    return done.select(
        F.when(~F.col("null_key"), F.col("name")).cast(given).alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", F.col("output").cast("string").alias("output")
    )


def restored(output: Column, form: Column) -> Column:
    """The text that output and form rebuild: no part holds a sentinel, so the first place of each is its own."""
    first, second = F.when(form == "spm", PREFIX).otherwise(SUFFIX), F.lit(MIDDLE)
    parts = let(
        F.split_part(F.substr(output, F.lit(4)), second, F.lit(1)),
        lambda head: F.struct(
            F.split_part(head, first, F.lit(1)).alias("opening"),
            F.split_part(head, first, F.lit(2)).alias("closing"),
            F.split_part(output, second, F.lit(2)).alias("middle"),
        ),
    )
    whole = let(
        parts,
        lambda p: F.when(form == "spm", F.concat(p["closing"], p["middle"], p["opening"])).otherwise(F.concat(p["opening"], p["middle"], p["closing"])),
    )
    return F.when(form == "plain", output).otherwise(whole)


def digests(cut: DataFrame) -> DataFrame:
    """The operator's rows with digests of the output and of the text rebuilt from it."""
    return cut.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )


ORACLE = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d
  FROM documents),
numbers AS (
  SELECT doc_id, t, n, ('0x' || substr(d, 1, 8))::BIGINT AS h1, ('0x' || substr(d, 9, 8))::BIGINT AS h2,
    ('0x' || substr(d, 17, 8))::BIGINT AS h3, ('0x' || substr(d, 25, 8))::BIGINT AS h4
  FROM drawn),
formed AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers),
parts AS (
  SELECT doc_id, t, n, form, a, b, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM formed)
SELECT doc_id, n::BIGINT AS n, form,
  CASE WHEN form <> 'plain' THEN a::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN (b - a)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
"""
