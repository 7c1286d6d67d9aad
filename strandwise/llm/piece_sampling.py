"""Sampled SentencePiece segmentations by forward filtering and backward sampling, and their decoding.

A text is a path through the lattice of vocabulary pieces; a path's weight is
the product of its pieces' weights. Forward filtering sums the weights of all
paths to each place; backward sampling then draws a path from the end, each
piece with its exact share. The draw at a place is a hash of the row's key and
the place, so a row is cut the same way in any partitioning, batch or run.

The vocabulary has a merge order and no probabilities, so a piece of rank r
weighs (1 / (r + 10)) ** alpha. A space is the piece's word mark; a character
without a piece becomes its UTF-8 bytes, and so does a literal word mark. One
space is put before a text that isn't empty and taken off again, and nothing
is normalised, so decoding gives every text back.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ALPHA = 0.5
#: Characters cut at once, of however many texts; longer texts are a group of their own.
GROUP = 250_000
#: Segments beyond this many characters are filtered one by one, with rescaling.
LONG = 64
_ONE = 1 << 31
_FRESH = 1 << 24  # codes from here on are characters that become bytes


class Pieces:
    """The vocabulary as a trie, and the sampler over it."""

    def __init__(self, model: str = MODEL, alpha: float = ALPHA):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        self.bytes_at = next(i for i in range(n) if sp.is_byte(i))
        self.raw: list[bytes] = [b""] * n
        pieces = {}
        for i in range(n):
            if sp.is_byte(i):
                self.raw[i] = bytes([i - self.bytes_at])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                text = sp.id_to_piece(i).replace("▁", " ")
                self.raw[i] = text.encode()
                pieces[text] = i
        self.flat = np.frombuffer(b"".join(self.raw), dtype=np.uint8)
        self.raw_len = np.fromiter(map(len, self.raw), dtype=np.int64, count=n)
        self.raw_at = np.cumsum(self.raw_len) - self.raw_len
        self.longest = max(map(len, pieces))
        self._find_cuts(pieces)
        # weights are scaled by a constant for each character, which all paths share
        weight = lambda i, text: (1 / (i + 10)) ** alpha * 16.0 ** (alpha * len(text))
        trie: dict[tuple[int, int], int] = {}
        self.state_piece, size = [-1], 1
        for text, i in pieces.items():
            at = 0
            for c in map(ord, text):
                if (at, c) not in trie:
                    trie[at, c] = size
                    self.state_piece.append(-1)
                    size += 1
                at = trie[at, c]
            self.state_piece[at] = i
        self.state_piece = np.array(self.state_piece, dtype=np.int32)
        self.weight = np.zeros(n + 1)
        for text, i in pieces.items():
            self.weight[i] = weight(i, text)
        self.weight[n] = weight(n, "x")
        self.weight[self.weight == 0] = self.weight[n]  # bytes have no piece of their own
        # transitions: a dense table for code points below 256, sorted keys for the rest
        self.low = np.zeros((size, 256), dtype=np.uint16 if size < 1 << 16 else np.int32)
        rest = []
        for (at, c), to in trie.items():
            if c < 256:
                self.low[at, c] = to
            else:
                rest.append(((at << 21) | c, to))
        rest.sort()
        self.keys = np.array([k for k, _ in rest], dtype=np.int64)
        self.tos = np.array([t for _, t in rest], dtype=np.int32)
        self.size = n

    def _find_cuts(self, pieces: dict[str, int]) -> None:
        """Which characters may follow one another inside a piece: a text can be cut between all others."""
        pairs = {(p[k], p[k + 1]) for p in pieces for k in range(len(p) - 1)}
        kinds = {c: k for k, c in enumerate(sorted({c for pair in pairs for c in pair}), 1)}
        self.kind = np.zeros(0x110000, dtype=np.uint16)  # 0: in no piece of two and more characters
        self.kind[[ord(c) for c in kinds]] = list(kinds.values())
        self.meets = np.zeros((len(kinds) + 1, len(kinds) + 1), dtype=bool)
        for a, b in pairs:
            self.meets[kinds[a], kinds[b]] = True

    def _step(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        to = self.low[state, np.minimum(char, 255)].astype(np.int32)
        high = np.flatnonzero(char > 254)
        if len(high):
            key = (state[high].astype(np.int64) << 21) | char[high]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            exact = np.where(self.keys[at] == key, self.tos[at], 0)
            to[high] = np.where(char[high] > 255, exact, to[high])
        return to

    def segments(self, chars: np.ndarray, row_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first character, length) of the segments: no piece reaches over the end of one, nor of a text."""
        kind = self.kind[chars]
        begins = np.append(True, ~self.meets[kind[:-1], kind[1:]])
        begins[row_start] = True
        first = np.flatnonzero(begins)
        return first, np.diff(np.append(first, len(chars)))

    def edges(self, chars: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, stop, code) of all pieces in the segments that chars holds one after another, and the first edge to each stop.

        ends: for each character the end of its segment. Edges are in order of
        their stops, then of their lengths. A character that no piece of its
        own covers gets an edge of its bytes.
        """
        n = len(chars)
        starts = np.arange(n, dtype=np.int32)
        state = np.zeros(n, dtype=np.int32)
        found = []
        room = np.zeros(n + 2, dtype=np.int64)
        for k in range(self.longest):
            char = chars[starts + k] if k else chars
            state = self._step(state, char)
            piece = self.state_piece[state]
            if k == 0:
                bare = np.flatnonzero(piece < 0)
                piece[bare] = np.where(chars[bare] < 128, self.bytes_at + chars[bare], _FRESH + chars[bare])
                found.append((starts, piece))
                room[1:-1] += 1
            else:
                hit = np.flatnonzero(piece >= 0)
                found.append((starts[hit], piece[hit]))
                room[found[-1][0] + (k + 1)] += 1
            go = np.flatnonzero((state > 0) & (starts + (k + 1) < ends[starts]))
            starts, state = starts[go], state[go]
            if not len(starts):
                break
        # a length has one edge to a stop at most, so the lengths in order fill each stop's room in order
        head = np.cumsum(room) - room
        free = head.copy()
        start, stop, code = (np.empty(head[-1], dtype=np.int32) for _ in range(3))
        for k, (s, piece) in enumerate(found, 1):
            to = free[s + k]
            start[to], stop[to], code[to] = s, s + k, piece
            free[s + k] += 1
        return start, stop, code, head

    def lattice(self, chars: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Forward filtering of segments of these lengths: (key, start, code) of edges, and where each segment ends.

        Nodes are places between the characters of all segments together. An
        edge's key is (its stop << 31) plus the cumulated share, in 1 / 2**31,
        of the paths to that stop which end with it or an edge before it.
        """
        stops = np.cumsum(lengths)
        start, stop, code, head = self.edges(chars, np.repeat(stops, lengths))
        weight = self.weight[np.minimum(code, self.size)]
        number = np.repeat(np.arange(len(lengths)), lengths)  # of the segment, by character
        first_char = stops - lengths
        # nodes by their depth in the segment; one depth's nodes only need lesser ones
        depth = np.arange(1, len(chars) + 1) - first_char[number]
        short = np.flatnonzero(lengths[number] <= LONG)
        nodes = short[np.argsort(depth[short].astype(np.uint8), kind="stable")] + 1
        cuts = np.searchsorted(depth[nodes - 1], np.arange(1, LONG + 2))
        # a segment has a node more than characters: its first one has all the mass
        alpha = np.zeros(len(chars) + len(lengths))
        alpha[first_char + np.arange(len(lengths))] = 1.0
        share = np.ones(len(start))
        for i, j in zip(cuts, cuts[1:]):
            to = nodes[i:j]
            sizes = head[to + 1] - head[to]
            base = np.cumsum(sizes) - sizes
            edge = np.repeat(head[to] - base, sizes) + np.arange(base[-1] + sizes[-1] if len(to) else 0)
            if not len(edge):
                continue
            mass = weight[edge] * alpha[start[edge] + np.repeat(number[to - 1], sizes)]
            total = np.add.reduceat(mass, base)
            alpha[to + number[to - 1]] = total
            share[edge] = mass / np.repeat(total, sizes)
        for s in np.flatnonzero(lengths > LONG).tolist():
            self._filter_long(int(first_char[s]), int(stops[s]), start, weight, head, share)
        part = np.rint(share * _ONE).astype(np.int64)
        run = np.cumsum(part)
        sizes = np.diff(head)[1:]  # of the stops 1, 2, ...
        cum = run - np.repeat(run[head[1:-1]] - part[head[1:-1]], sizes)
        np.minimum(cum, _ONE, out=cum)
        cum[head[2:] - 1] = _ONE
        return (stop.astype(np.int64) << 31) + cum, start, code, stops

    @staticmethod
    def _filter_long(first: int, end: int, start, weight, head, share) -> None:
        """The same for a long segment, place by place, rescaled before it can underflow."""
        alpha = {first: 1.0}
        for to in range(first + 1, end + 1):
            own = range(int(head[to]), int(head[to + 1]))
            mass = [float(weight[e]) * alpha[int(start[e])] for e in own]
            total = sum(mass)
            share[own.start : own.stop] = np.array(mass) / total
            alpha[to] = total
            if len(alpha) > 256 or total < 1e-100 or total > 1e100:
                alpha = {k: v / total for k, v in alpha.items() if k >= to - 64}

    def encode_flat(self, keys: list[int], texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(piece ids of all texts one after another, where each text's ids begin and the last one's end)."""
        sizes = np.fromiter((len(t) + 1 if t else 0 for t in texts), dtype=np.int64, count=len(texts))
        row_end = np.cumsum(sizes)
        chars = np.frombuffer("".join([" " + t for t in texts if t]).encode("utf-32-le", "surrogatepass"), dtype="<i4")
        if not len(chars):
            return np.zeros(0, dtype=np.int32), np.zeros(len(texts) + 1, dtype=np.int64)
        row_start = row_end - sizes
        first, lengths = self.segments(chars, row_start[sizes > 0])
        which, index = _distinct(chars, first, lengths)
        key, start, code, stops = self.lattice(chars[_spread(first[index], lengths[index])], lengths[index])
        # segments that are alike are walked together: their edges lie together
        order = np.argsort(which, kind="stable")
        which, place = which[order], (first + lengths)[order]
        owner = np.searchsorted(row_end, place, side="left")
        seed, begin = np.array(keys, dtype=np.uint64)[owner], row_start[owner]
        node, bound = stops[which], (stops - lengths[index])[which]
        out = np.full(len(chars), -1, dtype=np.int32)
        while len(node):
            edge = np.searchsorted(key, (node << 31) + _draw(seed, place - begin), side="right")
            to = start[edge].astype(np.int64)
            place = place - (node - to)
            out[place] = code[edge]
            live = np.flatnonzero(to > bound)
            node, place, seed, begin, bound = (x[live] for x in (to, place, seed, begin, bound))
        return self._bytes(out, np.append(row_start, len(out)))

    def encode(self, keys: list[int], texts: list[str]) -> list[np.ndarray]:
        """Piece ids of each text; keys are the rows' 64-bit seeds."""
        ids, bounds = self.encode_flat(keys, texts)
        return [ids[a:b] for a, b in zip(bounds, bounds[1:])]

    def _bytes(self, out: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids that are drawn, each character without a piece as its bytes; and the texts' bounds among them."""
        size = (out >= 0).astype(np.int64)
        fresh = np.flatnonzero(out >= _FRESH)
        if not len(fresh):
            return out[out >= 0], np.append(0, np.cumsum(size))[bounds]
        told = [chr(c).encode("utf-8", "surrogatepass") for c in (out[fresh] - _FRESH).tolist()]
        size[fresh] = list(map(len, told))
        upto = np.append(0, np.cumsum(size))
        ids = np.repeat(out, size)
        ids[_spread(upto[fresh], size[fresh])] = self.bytes_at + np.frombuffer(b"".join(told), dtype=np.uint8).astype(np.int32)
        return ids, upto[bounds]

    def decode_flat(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The texts of piece ids that stand one after another, of however they were drawn."""
        sizes = self.raw_len[ids]
        told = self.flat[_spread(self.raw_at[ids], sizes)].tobytes()
        upto = np.append(0, np.cumsum(sizes))[bounds].tolist()
        return [told[a:b].decode("utf-8", "replace")[1:] for a, b in zip(upto, upto[1:])]

    def decode(self, ids) -> str:
        """The text of piece ids."""
        return self.decode_flat(np.asarray(ids, dtype=np.int64), np.array([0, len(ids)]))[0]


def _spread(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places first, first + 1, ... of each run, one run after another."""
    upto = np.cumsum(lengths)
    return np.repeat(first - (upto - lengths), lengths) + np.arange(upto[-1] if len(upto) else 0)


def _distinct(chars: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number among the distinct segments of each segment, one segment of each number).

    By hash, then compared character by character: if two segments share a
    hash by chance, all are taken as distinct, which costs time only.
    """
    with np.errstate(over="ignore"):
        power = np.multiply.accumulate(np.full(int(lengths.max()), 0xD6E8FEB86659FD93, dtype=np.uint64))
        mixed = (chars.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed *= power[_spread(np.zeros_like(first), lengths)]
        _, index, which = np.unique(np.add.reduceat(mixed, first), return_index=True, return_inverse=True)
    like = index[which]
    if (lengths[like] == lengths).all() and (chars[_spread(first[like], lengths)] == chars).all():
        return which, index
    return np.arange(len(first)), np.arange(len(first))


def _draw(seed: np.ndarray, place: np.ndarray) -> np.ndarray:
    """31 bits that the row and the place decide: a mixed counter."""
    with np.errstate(over="ignore"):
        x = seed + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(31))) >> np.uint64(33)).astype(np.int64)


@lru_cache(maxsize=2)
def pieces(model: str = MODEL, alpha: float = ALPHA) -> Pieces:
    """One vocabulary for each worker and parameters."""
    return Pieces(model, alpha)


def seed_of(key) -> int:
    """A row's seed: a hash of its key as text; a null key is a key."""
    return xxhash.xxh64_intdigest("\0" if key is None else str(key), 42)


def _grouped(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about GROUP characters together."""
    low = size = 0
    for k, t in enumerate(texts):
        if k > low and size + len(t) > GROUP:
            yield low, k
            low, size = k, 0
        size += len(t)
    if len(texts) > low:
        yield low, len(texts)


def encode_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL, alpha: float = ALPHA) -> DataFrame:
    """(doc_id, n_pieces, ids, lossless): one row per row of docs; lossless says that decoding gave the text back.

    Null and empty texts have no pieces. Repeated rows are cut alike. Other
    columns, whatever their names, are not carried. Keys are of any type that
    a cast to string and back keeps. A map over rows: nothing is shuffled. The
    model file is read from `model` in each worker.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(model, alpha)
        for batch in batches:
            keys, texts = batch.column("doc_id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
            for a, b in _grouped(texts):
                ids, bounds = vocabulary.encode_flat([seed_of(k) for k in keys[a:b]], texts[a:b])
                same = [x == y for x, y in zip(vocabulary.decode_flat(ids, bounds), texts[a:b])]
                columns = [
                    pa.array(keys[a:b], pa.string()), pa.array(np.diff(bounds)),
                    pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids)), pa.array(same, pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_pieces", "ids", "lossless"])

    cut = docs.select(F.col(key).cast("string").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        encode, "doc_id string, n_pieces long, ids array<int>, lossless boolean"
    )
    return cut.withColumn("doc_id", F.col("doc_id").cast(docs.schema[key].dataType))


def decode_texts(encoded: DataFrame, ids: str = "ids", model: str = MODEL) -> DataFrame:
    """The rows of encoded and the column `text`, decoded; null ids give an empty text."""

    @F.pandas_udf(T.StringType())
    def decode(rows: pd.Series) -> pd.Series:
        vocabulary = pieces(model)
        return pd.Series([vocabulary.decode([] if r is None else r) for r in rows], dtype=object)

    return encoded.withColumn("text", decode(F.col(ids)))
