"""Language identification by nearest centroid of letter n-grams.

A text is a normalised TF-IDF vector of hashed n-grams of its letters. Each
language has several centroids: spherical k-means of a bounded sample seeds
them, then rounds over all labelled rows move them. A text gets the language of
the centroid with the largest cosine, and is rejected where it is further from
it than nearly all labelled texts of its length are from theirs. Counts and
sums are of integers, so the model doesn't depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

#: Buckets of n-grams of 1 to GRAMS letters; centroids of a language; rounds over all labelled rows.
BITS, GRAMS, CENTROIDS, ROUNDS = 13, 3, 4, 2
#: Texts of a language that k-means is seeded with at most.
SAMPLE = 256
#: Share of labelled texts that their own language's thresholds let pass, and labelled texts a length class has for a threshold of its own.
PASS, LEAST_CLASS = 0.999, 100
#: How much further than these a text may be before it is rejected.
SLACK = 0.02
UNDETERMINED = "und"
#: One in fixed-point sums.
UNIT = 1 << 20
_SPACE = 32
_letters: list[np.ndarray] = []


def is_letter() -> np.ndarray:
    """For each code point, whether it is a letter; made once a process."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


def counts(text: str | None, bits: int = BITS, grams: int = GRAMS) -> tuple[np.ndarray, np.ndarray, int]:
    """(buckets, how often each occurs, letters): n-grams of lower-case letters, other characters being one space; n-grams of a space alone don't count."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = is_letter()[points]
    n = int(letter.sum())
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), 0
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    points = np.concatenate(([_SPACE], np.where(letter, points, _SPACE)[keep], [_SPACE] * int(letter[-1]))).astype(np.uint32)
    hashed, spread, found = np.zeros(len(points), np.uint32), np.uint32(0x9E3779B1), []
    for k in range(grams):
        hashed = (hashed[: len(points) - k] + points[k:]) * spread
        here = (hashed ^ (hashed >> np.uint32(15))) * np.uint32(0x85EBCA77 + 2 * k) >> np.uint32(32 - bits)
        found.append(here[points != _SPACE] if k == 0 else here)
    tally = np.bincount(np.concatenate(found), minlength=1 << bits)
    buckets = np.flatnonzero(tally)
    return buckets, tally[buckets], n


def size_class(letters: int) -> int:
    return int(letters).bit_length()


@dataclass
class Model:
    """Weights of buckets, centroids (columns) with their languages, distances beyond which a text is rejected; its size is that of the centroids."""

    weights: np.ndarray
    by_bucket: np.ndarray = field(default_factory=lambda: np.empty((0, 0), np.float32))
    languages: list[str] = field(default_factory=list)
    limits: dict[tuple[str, int], float] = field(default_factory=dict)

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
        """(buckets, normalised weights, letters) of a text."""
        buckets, often, letters = counts(text, int(len(self.weights)).bit_length() - 1)
        values = np.log1p(often) * self.weights[buckets]
        return buckets, values / max(np.sqrt((values * values).sum()), 1e-12), letters

    def cosines(self, buckets: np.ndarray, values: np.ndarray) -> np.ndarray:
        return values.astype(np.float32) @ self.by_bucket[buckets]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, cosine of its nearest centroid, whether that is too far)."""
        buckets, values, letters = self.vector(text)
        if not letters or not self.languages:
            return UNDETERMINED, 0.0, True
        near = self.cosines(buckets, values)
        best = int(near.argmax())
        language, score = self.languages[best], min(1.0, max(0.0, float(near[best])))
        limit = self.limits.get((language, size_class(letters)), self.limits.get((language, -1), 2.0))
        return language, round(score, 6), 1 - score > limit + SLACK


def _summed(parts: DataFrame, *keys: str) -> DataFrame:
    """Rows of arrays (buckets, totals), summed by keys and bucket."""
    flat = parts.select(*keys, F.explode(F.arrays_zip("buckets", "totals")).alias("x")).select(*keys, F.col("x.buckets").alias("bucket"), F.col("x.totals").alias("total"))
    return flat.groupBy(*keys, "bucket").agg(F.sum("total").alias("total"))


def document_frequencies(texts: DataFrame, bits: int = BITS) -> np.ndarray:
    """For each bucket the texts that hold it, and last the texts with a letter, over all rows; a row of counts a partition is shuffled."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((1 << bits) + 1, np.int64)
        for batch in batches:
            for t in batch["text"]:
                buckets, _, letters = counts(t, bits)
                total[buckets] += 1
                total[-1] += letters > 0
        some = np.flatnonzero(total)
        yield pd.DataFrame({"buckets": [some.astype(np.int32)], "totals": [total[some]]})

    out = np.zeros((1 << bits) + 1, np.int64)
    got = _summed(texts.select("text").mapInPandas(count, "buckets array<int>, totals array<long>")).toArrow()
    out[got["bucket"].to_numpy()] = got["total"].to_numpy()
    return out


def kmeans(rows: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """At most k centroids of unit rows by cosine: farthest-first seeds from the row nearest to the mean, then Lloyd's rounds."""
    chosen = [int((rows @ rows.mean(0)).argmax())]
    near = rows @ rows[chosen[0]]
    while len(chosen) < k and near.min() < 1 - 1e-9:
        chosen.append(int(near.argmin()))
        near = np.maximum(near, rows @ rows[chosen[-1]])
    centroids = rows[chosen]
    for _ in range(rounds):
        of = (rows @ centroids.T).argmax(1)
        sums = np.stack([rows[of == c].sum(0) if (of == c).any() else centroids[c] for c in range(len(centroids))])
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centroids


def seeds(train: DataFrame, model: Model, k: int, sample: int) -> list[tuple[str, np.ndarray]]:
    """(language, centroid): k-means of at most `sample` distinct texts of each language.

    Texts' hashes are dealt into `sample` cells; each cell's least hash is
    drawn. What meets in one task is the sparse vectors of one language's draw.
    """
    hashed = train.select("lang", "text", F.xxhash64("text").alias("h"))
    drawn = hashed.groupBy("lang", F.pmod("h", F.lit(sample)).alias("cell")).agg(F.min("h").alias("h")).select("lang", "h")
    texts = hashed.join(F.broadcast(drawn), ["lang", "h"]).groupBy("lang", "h").agg(F.first("text").alias("text"))
    shared = train.sparkSession.sparkContext.broadcast(model)
    dims = len(model.weights)

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [shared.value.vector(t) for t in batch["text"]]
            yield pd.DataFrame({"lang": batch["lang"], "h": batch["h"], "buckets": [b.astype(np.int32) for b, _, _ in got], "shares": [v for _, v, _ in got]})

    def cluster(group: pd.DataFrame) -> pd.DataFrame:
        group = group[group["buckets"].map(len) > 0].sort_values("h")
        rows = np.zeros((len(group), dims))
        for i, (b, v) in enumerate(zip(group["buckets"], group["shares"])):
            rows[i, b] = v
        found = kmeans(rows, k) if len(rows) else rows
        return pd.DataFrame({"lang": [group["lang"].iloc[0]] * len(found), "centroid": [c.astype("<f4").tobytes() for c in found]})

    sparse = texts.mapInPandas(vectors, "lang string, h long, buckets array<int>, shares array<double>")
    found = sparse.groupBy("lang").applyInPandas(cluster, "lang string, centroid binary").collect()
    return sorted(((r.lang, np.frombuffer(r.centroid, "<f4")) for r in found), key=lambda x: (x[0], x[1].tobytes()))


def moved(train: DataFrame, model: Model) -> np.ndarray:
    """The centroids after one of Lloyd's rounds over all rows of train, each row among those of its language; an empty one stays."""
    shared = train.sparkSession.sparkContext.broadcast(model)
    dims, k = model.by_bucket.shape

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        mine = {x: np.array([i for i, y in enumerate(model.languages) if y == x]) for x in set(model.languages)}
        total = np.zeros((k, dims), np.int64)
        for batch in batches:
            for lang, t in zip(batch["lang"], batch["text"]):
                buckets, values, letters = model.vector(t)
                if letters and lang in mine:
                    c = mine[lang][model.cosines(buckets, values)[mine[lang]].argmax()]
                    total[c, buckets] += np.rint(values * UNIT).astype(np.int64)
        some = [np.flatnonzero(t) for t in total]
        yield pd.DataFrame({"centroid": np.arange(k), "buckets": [s.astype(np.int32) for s in some], "totals": [t[s] for t, s in zip(total, some)]})

    got = _summed(train.select("lang", "text").mapInPandas(add, "centroid int, buckets array<int>, totals array<long>"), "centroid").toArrow()
    sums = np.zeros((k, dims))
    sums[got["centroid"].to_numpy(), got["bucket"].to_numpy()] = got["total"].to_numpy()
    norms = np.linalg.norm(sums, axis=1, keepdims=True)
    return np.ascontiguousarray(np.where(norms > 0, sums / np.maximum(norms, 1), model.by_bucket.T).T, dtype=np.float32)


def limits(train: DataFrame, model: Model, share: float = PASS, least_class: int = LEAST_CLASS) -> dict[tuple[str, int], float]:
    """Distances that `share` of the labelled texts of a language and length class don't exceed, in thousandths; class -1 is all lengths.

    Distances are to the nearest centroid of the text's own language. The
    table of counts has at most languages x 32 x 1001 rows.
    """
    shared = train.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.IntegerType())
    def placed(langs: pd.Series, texts: pd.Series) -> pd.Series:
        model, out = shared.value, []
        mine = {x: np.array([y == x for y in model.languages]) for x in set(model.languages)}
        for lang, t in zip(langs, texts):
            buckets, values, letters = model.vector(t)
            if not letters or lang not in mine:
                out.append(-1)
                continue
            far = 1 - float(model.cosines(buckets, values)[mine[lang]].max())
            out.append(size_class(letters) * 1024 + min(1000, max(0, int(np.ceil(far * 1000)))))
        return pd.Series(out, dtype="int32")

    cells = train.select("lang", placed("lang", "text").alias("at")).where("at >= 0").groupBy("lang", "at").count()
    cells = cells.select("lang", F.explode(F.array(F.lit(-1), (F.col("at") / 1024).cast("int"))).alias("class"), (F.col("at") % 1024).alias("far"), "count")
    cells = cells.groupBy("lang", "class", "far").agg(F.sum("count").alias("n"))
    group = W.partitionBy("lang", "class")
    ranked = cells.select("*", F.sum("n").over(group.orderBy("far")).alias("upto"), F.sum("n").over(group).alias("all"))
    ranked = ranked.where((F.col("upto") >= F.col("all") * share) & ((F.col("all") >= least_class) | (F.col("class") == -1)))
    found = ranked.groupBy("lang", "class").agg(F.min("far").alias("far")).collect()
    return {(r.lang, r["class"]): r.far / 1000 for r in found}


def fit(
    train: DataFrame, lang: str = "lang", text: str = "text", bits: int = BITS, centroids: int = CENTROIDS, rounds: int = ROUNDS, sample: int = SAMPLE
) -> Model:
    """A model of the rows of train with a language and a text. Frequencies, centroids and limits are of all rows, only seeds of a sample."""
    train = train.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    held = document_frequencies(train, bits)
    model = Model(np.log1p(held[-1] / (1.0 + held[:-1])))
    if not held[-1]:
        return model
    found = seeds(train, model, centroids, sample)
    model.languages, model.by_bucket = [x for x, _ in found], np.stack([c for _, c in found], axis=1)
    for _ in range(rounds):
        model.by_bucket = moved(train, model)
    model.limits = limits(train, model)
    return model


PREDICTED = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])


def predicted(docs: DataFrame, model: Model, text: Column) -> Column:
    """A struct column (lang_pred, score, rejected); the model is broadcast: centroids x buckets numbers of four bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(PREDICTED)
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang_pred", "score", "rejected"])

    return predict(text)


def language_ids(
    docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", parts: int = 4, held: int = 2, **options
) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected): one row per row of docs.

    Learns from rows with a text and a language whose crc32 of the key, as
    text, modulo `parts` isn't `held`; those are held_out. Predictions see the
    text alone. lang_pred is the language of the nearest centroid, `und` for a
    null text, one without a letter, or where nothing was learned; those score
    0 and are rejected. Of centroids that tie, the first language in order
    wins. A null key counts as the empty key. Repeated rows stay and get the
    same prediction; texts of any length are read whole and never shuffled but
    for the seeds; other columns, whatever their names, are not carried.
    """
    held_out = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % parts == held
    model = fit(docs.where(~held_out), lang, text, **options)
    return docs.select(F.col(key).alias("doc_id"), held_out.alias("held_out"), predicted(docs, model, F.col(text)).alias("p")).select("doc_id", "held_out", "p.*")
