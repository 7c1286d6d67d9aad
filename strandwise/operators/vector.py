"""Exact vector search: cosine of a stated query set against all rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


#: Cosines that are held at once.
SCORES = 1_000_000


def _best(k: int, key: str):
    """The k best of each query of a pack of queries among a pack of rows, by matrix products of SCORES cosines at most."""

    def search(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query": rows["k"][:0], key: rows["k"][:0], "score": np.zeros(0)})]
        if len(rows) and len(queries):
            ids, asked = rows["k"].to_numpy(), queries["k"].to_numpy()
            a, b = np.stack(list(rows["v"])).astype(float), np.stack(list(queries["v"])).astype(float)
            length = np.linalg.norm(a, axis=1)[None]
            step = max(1, SCORES // len(a))
            for at in range(0, len(b), step):
                some, q = asked[at : at + step], b[at : at + step]
                norms = np.linalg.norm(q, axis=1)[:, None] * length
                score = np.round(np.divide(q @ a.T, norms, out=np.zeros_like(norms), where=norms > 0), 6)
                score[some[:, None] == ids[None]] = -np.inf
                order = np.lexsort((np.broadcast_to(ids, score.shape), -score), axis=1)[:, :k]
                line, place = np.repeat(np.arange(len(some)), order.shape[1]), order.ravel()
                found = pd.DataFrame({"query": some[line], key: ids[place], "score": score[line, place]})
                out.append(found[np.isfinite(found["score"])])
        return pd.concat(out, ignore_index=True)

    return search


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", size: int = 4096) -> DataFrame:
    """(query, key, score, rank): the k nearest rows of each query, without itself; smaller keys win ties.

    The stated query set meets all rows in packs of about `size`, dealt by
    hash: a task holds two of them at a time and SCORES of their cosines, and
    gives the k best of each of its queries, so a query's last ranking sees k
    rows of each pack. The plan is the same for any number. A vector of norm 0
    scores 0.
    """
    kind = dict(rows.dtypes)[key]
    packs = lambda df: max(1, -(-df.count() // size))
    of_rows, of_queries = packs(rows), packs(queries)
    dealt = lambda n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = rows.select(F.col(key).alias("k"), F.col(vector).alias("v"), dealt(of_rows).alias("pack"), every(of_queries).alias("asked"))
    asked = queries.select(F.col(key).alias("k"), F.col(vector).alias("v"), every(of_rows).alias("pack"), dealt(of_queries).alias("asked"))
    local = held.groupBy("pack", "asked").cogroup(asked.groupBy("pack", "asked")).applyInPandas(_best(k, key), f"query {kind}, {key} {kind}, score double")
    ranked = local.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), F.col(key))))
    return ranked.where(F.col("rank") <= k).select("query", key, "score", "rank")
