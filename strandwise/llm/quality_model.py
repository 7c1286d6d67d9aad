"""Quality classifier: a weak-label model over heuristic labellers trains a hashed linear scorer.

Labellers vote good, bad or nothing on each text. Expectation-maximisation over
the counts of vote patterns (at most 3 ** labellers of them, whatever the
corpus) estimates each labeller's accuracies without any gold label. The
posterior of a pattern is the soft label that trains a logistic scorer on
hashed words, word shapes and binned counts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LABELLERS = ("symbols", "capitals", "clean_words", "short_words", "sentences", "runs", "distinct", "lines")
BITS = 18
#: Texts the scorer is fitted on at most: the expected size of the sample; twice that is a hard bound.
SAMPLE = 6000
#: Code points of a text that the scorer may be fitted on; longer ones are judged, but not drawn.
SAMPLE_CHARS = 50_000
#: Least score to be kept.
LEAST = 0.5
_SHAPE = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256))
#: Letters to one letter, sentence marks left out: what a clean word leaves is that letter alone.
_PLAIN = bytes(97 if 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else b for b in range(256))
_SYMBOLS = b"#*$%&|<>"
_ENDS = b".?!"


def measures(raw: bytes, words: list[bytes]) -> tuple[float, ...]:
    """What the labellers see, in their order; lines and words are counted too."""
    n = max(len(words), 1)
    letters = max(sum(map(len, words)), 1)
    upper = len(raw) - len(raw.translate(None, bytes(range(65, 91))))
    lower = len(raw) - len(raw.translate(None, bytes(range(97, 123))))
    plain = Counter(raw.translate(_PLAIN, b".,;:?'\"()").split())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (
        (len(raw) - len(raw.translate(None, _SYMBOLS))) / letters,
        upper / max(upper + lower, 1),
        sum(k for w, k in plain.items() if not w.strip(b"a")) / n,
        sum(k for w, k in plain.items() if len(w) <= 3 and not w.strip(b"a")) / n,
        n / max(sum(w[-1] in _ENDS for w in words), 1),
        sum(map(eq, words, words[1:])) / n,
        len(set(words)) / n,
        1 - len(set(lines)) / max(len(lines), 1),
        len(lines),
    )


def votes(m: tuple[float, ...], n: int) -> tuple[int, ...]:
    """1 good, 2 bad, 0 nothing, of each labeller; a text of under five words gets no vote."""
    if n < 5:
        return (0,) * len(LABELLERS)
    symbols, capitals, clean, short, sentence, runs, distinct, repeats, lines = m
    say = lambda bad, good=False: 2 if bad else 1 if good else 0
    return (
        say(symbols > 0.08),
        say(capitals > 0.5),
        say(clean < 0.65, clean > 0.9 and runs < 0.05),
        say(short < 0.1 and n >= 30, 0.2 < short < 0.7 and runs < 0.05),
        say(sentence < 1.7 or sentence > 80, 2.5 < sentence < 45 and runs < 0.05),
        say(runs > 0.15),
        say(distinct < 0.25 and 30 <= n < 3000),
        say(repeats > 0.35 and lines >= 5),
    )


def pattern(v: tuple[int, ...]) -> int:
    return sum(x * 3**k for k, x in enumerate(v))


def em(counts: dict[int, int], rounds: int = 200, tolerance: float = 1e-9) -> tuple[np.ndarray, float, np.ndarray]:
    """(P(good | pattern) for each pattern, P(good), accuracy of each labeller's votes).

    Labellers err independently given the class; whether one votes at all
    tells nothing. Starts from the majority of votes. Accuracies stay between
    0.55 and 0.99: a labeller is better than chance and never beyond doubt.
    """
    k = len(LABELLERS)
    seen = np.array(sorted(counts), dtype=np.int64)
    n = np.array([counts[p] for p in seen], dtype=float)
    said = seen[:, None] // 3 ** np.arange(k) % 3
    side = (said == 1) * 1.0 - (said == 2)
    q = 1 / (1 + np.exp(-side.sum(1)))
    prior, accuracy = 0.5, np.full(k, 0.7)
    for _ in range(rounds):
        prior = ((q * n).sum() + 1) / (n.sum() + 2)
        right = (((said == 1) * q[:, None] + (said == 2) * (1 - q)[:, None]) * n[:, None]).sum(0)
        cast = ((said > 0) * n[:, None]).sum(0)
        accuracy = np.clip((right + 1) / (cast + 2), 0.55, 0.99)
        new = 1 / (1 + np.exp(-(side @ np.log(accuracy / (1 - accuracy)) + np.log(prior / (1 - prior)))))
        done = np.abs(new - q).max(initial=0) < tolerance
        q = new
        if done:
            break
    posterior = np.full(3**k, np.nan)
    posterior[seen] = q
    return posterior, float(prior), accuracy


def features(raw: bytes, words: list[bytes], m: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed indices and values: words and shapes weigh one in all each, each binned count one."""
    mask = (1 << BITS) - 1
    shapes = raw.translate(_SHAPE).split()
    n = len(words)
    bins = [b"%d=%d" % (k, min(9, int(x * s))) for k, (x, s) in enumerate(zip(m, (25, 10, 10, 10, 0.2, 10, 10, 10)))]
    index = np.fromiter(
        (crc32(x, salt) & mask for salt, group in ((1, words), (2, shapes), (3, bins)) for x in group), dtype=np.int64, count=2 * n + len(bins)
    )
    value = np.concatenate((np.full(2 * n, 1 / max(n, 1)), np.ones(len(bins))))
    return index, value


def _read(text: str | None) -> tuple[bytes, list[bytes], tuple[float, ...]]:
    raw = (text or "").encode()
    words = raw.split()
    return raw, words, measures(raw, words)


def train(texts: list[str], labels: np.ndarray, epochs: int = 6, rate: float = 0.3, decay: float = 1e-4) -> np.ndarray:
    """Weights of the logistic scorer, bias last, by adaptive gradient steps in the order given."""
    size = 1 << BITS
    weights, squares = np.zeros(size + 1), np.full(size + 1, 1e-2)
    rows = [features(*_read(t)) for t in texts]
    rows = [(np.append(i, size), np.append(v, 1.0)) for i, v in rows]
    for _ in range(epochs):
        for (i, v), y in zip(rows, labels):
            p = 1 / (1 + np.exp(-np.clip((weights[i] * v).sum(), -30, 30)))
            at, back = np.unique(i, return_inverse=True)
            g = np.bincount(back, weights=v) * (p - y) + decay * weights[at]
            squares[at] += g * g
            weights[at] -= rate * g / np.sqrt(squares[at])
    return weights


def vote_patterns(docs: DataFrame, text: str = "text") -> DataFrame:
    """(pattern, n): counts of vote patterns over all rows; partial sums before the shuffle."""

    @F.pandas_udf(T.IntegerType())
    def voted(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            _, words, m = _read(t)
            out.append(pattern(votes(m, len(words))))
        return pd.Series(out, dtype="int32")

    return docs.select(voted(F.col(text)).alias("pattern")).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))


class Model:
    """A fitted classifier: what EM found and the scorer's weights; of a fixed size."""

    def __init__(self, posterior: np.ndarray, prior: float, accuracy: np.ndarray, weights: np.ndarray):
        self.posterior, self.prior, self.accuracy, self.weights = posterior, prior, accuracy, weights.astype(np.float32)

    def judge(self, text: str | None) -> tuple[str, float, float]:
        """(votes, posterior of the votes, score); a text of no words scores 0."""
        raw, words, m = _read(text)
        v = votes(m, len(words))
        p = self.posterior[pattern(v)]
        p = self.prior if np.isnan(p) else float(p)
        if not words:
            return "".join("-+!"[x] for x in v), round(p, 6), 0.0
        index, value = features(raw, words, m)
        odds = float((self.weights[index] * value).sum() + self.weights[-1])
        return "".join("-+!"[x] for x in v), round(p, 6), round(1 / (1 + np.exp(-max(-30.0, min(30.0, odds)))), 6)


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Model:
    """Fit on docs: EM over all rows, the scorer on a sample of rows by the hash of their id.

    The driver gets the pattern counts and, from one task, the weights. The
    sample is at most the 2 * `sample` rows of least hash, of SAMPLE_CHARS
    each, at any size of the corpus and however often an id repeats.
    """
    counts = {r.pattern: r.n for r in vote_patterns(docs, text).collect()}
    posterior, prior, accuracy = em(counts)
    total = sum(counts.values())
    if not total:
        return Model(posterior, prior, accuracy, np.zeros((1 << BITS) + 1))
    share = min(2**32, int(2**32 * sample / total))
    drawn = (
        docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        .where((F.pmod(F.xxhash64("id"), F.lit(2**32)) < share) & (F.length("text") <= SAMPLE_CHARS))
        .orderBy(F.pmod(F.xxhash64("id"), F.lit(2**32)), F.xxhash64("id", "text"))
        .limit(2 * sample)
    )

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({"id": [], "text": []}), *batches]).sort_values(["id", "text"])
        order = np.random.default_rng(7).permutation(len(rows))
        texts = [rows["text"].iloc[i] for i in order]
        labels = []
        for t in texts:
            _, words, m = _read(t)
            labels.append(posterior[pattern(votes(m, len(words)))] if words else 0.0)
        yield pd.DataFrame({"weights": [train(texts, np.array(labels)).astype("<f4").tobytes()]})

    weights = drawn.repartition(1).mapInPandas(fitted, "weights binary").first().weights
    return Model(posterior, prior, accuracy, np.frombuffer(weights, "<f4"))


JUDGED = T.StructType([T.StructField("votes", T.StringType()), T.StructField("posterior", T.DoubleType()), T.StructField("score", T.DoubleType())])


def judged(docs: DataFrame, model: Model, text: Column) -> Column:
    """A struct column (votes, posterior, score); the model, a megabyte, is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(JUDGED)
    def judge(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.judge(t) for t in texts], columns=["votes", "posterior", "score"])

    return judge(text)


def quality_scores(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, votes, posterior, score, kept): one row per row of docs.

    Null, empty and wordless texts get no votes, score 0 and aren't kept.
    Repeated rows stay and score alike. Other columns, whatever their names,
    are not carried. Texts are read whole and never shuffled, but for the
    bounded sample.
    """
    model = fit(docs, key, text, sample)
    return docs.select(F.col(key).alias("doc_id"), judged(docs, model, F.col(text)).alias("j")).select(
        "doc_id", "j.votes", "j.posterior", "j.score", (F.col("j.score") >= least).alias("kept")
    )


def keep_good(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs, all columns, that score at least `least`."""
    model = fit(docs, key, text, sample)
    return docs.where(judged(docs, model, F.col(text))["score"] >= least)
