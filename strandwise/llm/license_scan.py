"""Licence scans by the generalised suffix automaton of licence tokens.

The automaton holds every substring of all templates and phrases. Streaming a
file through it gives, at each word, the longest match that ends there (the
matching statistics). Phrases are read off the matches directly. Long maximal
matches are chained, in the order of file and template both, into spans that
cover a share of a template, one for each copy of it that the file has. Part of
a short notice says nothing without the licence's name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_texts import NAMES, PHRASES, TEMPLATES

#: Words of a match that may enter a chain; words of the file between two of one chain; least share of a template.
MIN_MATCH, MAX_GAP, MIN_COVER = 4, 12, 0.6
#: Least words of a template that a span covers, unless it covers it whole or its licence's name stands in it or NAME_GAP words on.
MIN_COVERED, NAME_GAP = 14, 2
#: UTF-8 bytes to words: A-Z to lower case, other ASCII but digits and letters to a space, all else as it is.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


class Automaton:
    """Suffix automaton of several token sequences; states are numbers, 0 is the root."""

    def __init__(self, sequences: list[list[bytes]], phrases: list[list[bytes]]):
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in s] for s in sequences + phrases]
        for s in coded:
            last = 0
            for c in s:
                last = self._extend(last, c)
        self.sequences = coded[: len(sequences)]
        # places of each state in each sequence: (sequence, end) of its longest substring
        self.ends: list[list[tuple[int, int]]] = [[] for _ in self.next]
        for k, s in enumerate(self.sequences):
            at = 0
            for end, c in enumerate(s, 1):
                at = self.next[at][c]
                self.ends[at].append((k, end))
        for v in sorted(range(1, len(self.next)), key=lambda v: -self.length[v]):
            self.ends[self.link[v]] += self.ends[v]
        # phrases that end where a state's substrings do: (words, phrase), where the match is as long as the phrase
        tails: dict[int, list[tuple[int, int]]] = {}
        for p, s in enumerate(coded[len(sequences) :]):
            at = 0
            for c in s:
                at = self.next[at][c]
            tails.setdefault(at, []).append((len(s), p))
        self.phrases: list[tuple[tuple[int, int], ...]] = [()] * len(self.next)
        for v in sorted(range(1, len(self.next)), key=lambda v: self.length[v]):
            self.phrases[v] = self.phrases[self.link[v]] + tuple(tails.get(v, ()))

    def _extend(self, last: int, c: int) -> int:
        """The state of the substring `last` followed by c, made if the automaton hasn't it."""
        have = self.next[last].get(c)
        if have is not None:
            if self.length[have] == self.length[last] + 1:
                return have
            return self._copy(have, last, c)
        new = self._state({}, self.length[last] + 1, 0)
        at = last
        while at != -1 and c not in self.next[at]:
            self.next[at][c] = new
            at = self.link[at]
        if at != -1:
            to = self.next[at][c]
            self.link[new] = to if self.length[to] == self.length[at] + 1 else self._copy(to, at, c)
        return new

    def _state(self, following: dict[int, int], length: int, link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _copy(self, of: int, at: int, c: int) -> int:
        copy = self._state(dict(self.next[of]), self.length[at] + 1, self.link[of])
        self.link[of] = copy
        while at != -1 and self.next[at].get(c) == of:
            self.next[at][c] = copy
            at = self.link[at]
        return copy

    def runs(self, words: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """(first word, codes) of each run of two or more words that any template has; no longer match leaves a run."""
        get = self.vocabulary.get
        codes = np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=len(words))
        known = np.flatnonzero(codes >= 0)
        if len(known) < 2:
            return
        cut = np.flatnonzero(np.diff(known) > 1) + 1
        starts, stops = np.concatenate(([0], cut)), np.concatenate((cut, [len(known)]))
        for a, b in zip(starts[stops - starts > 1], stops[stops - starts > 1]):
            first = int(known[a])
            yield first, codes[first : first + int(b - a)].tolist()

    def scan(self, words: list[bytes], min_match: int):
        """(places, matches): phrase places (start, phrase), and maximal matches (start, words, state)."""
        following, link, length, phrases = self.next, self.link, self.length, self.phrases
        places, matches = [], []
        for first, codes in self.runs(words):
            at = n = 0
            for i, c in enumerate(codes, first):
                to = following[at].get(c)
                if to is None:
                    if n >= min_match:
                        matches.append((i - n, n, at))
                    while at and to is None:
                        at = link[at]
                        n = length[at]
                        to = following[at].get(c)
                if to is None:
                    n = 0
                    continue
                at = to
                n += 1
                if phrases[at]:
                    places += [(i + 1 - k, p) for k, p in phrases[at] if n >= k]
            if n >= min_match:
                matches.append((first + len(codes) - n, n, at))
        return sorted(places), matches


def chains(
    automaton: Automaton, matches, max_gap: int, min_cover: float, named: Callable[[int, int, int], bool] = lambda template, first, last: False
) -> list[tuple[int, float, int, int]]:
    """(template, share of it covered, first and last word of the file, the latter exclusive) of each span, by template and place.

    A chain joins matches that follow one another in the file, with at most
    max_gap words between, and in the template; overlaps count once. Of chains
    of one template that overlap in the file the one that covers most is a
    span, the first and then the shortest of those that tie. named tells
    whether the template's licence is named there. Work is at most the square
    of the places within a gap, which the templates bound.
    """
    found: dict[int, list[tuple[int, int, int]]] = {}  # template: (covered, first, last)
    open_: dict[int, list[tuple[int, int, int, int]]] = {}  # template: (end in file, end in template, covered, start in file)
    for start, n, state in matches:
        for k, end in automaton.ends[state]:
            here = [x for x in open_.get(k, ()) if start - x[0] <= max_gap]
            covered, begun = n, start
            for file_end, template_end, had, began in here:
                if file_end < start + n and template_end < end:
                    new = min(n, start + n - file_end, end - template_end)
                    if had + new > covered:
                        covered, begun = had + new, began
            # of chains that end alike in the template the best one is enough
            here = [x for x in here if x[1] != end or x[2] > covered] + [(start + n, end, covered, begun)]
            open_[k] = here
            words = len(automaton.sequences[k])
            if covered >= min_cover * words and (covered >= min(words, MIN_COVERED) or named(k, begun, start + n)):
                found.setdefault(k, []).append((covered, begun, start + n))
    spans = []
    for k, of in sorted(found.items()):
        taken: list[tuple[int, int, int]] = []
        for covered, first, last in sorted(of, key=lambda x: (-x[0], x[1], x[2])):
            if all(last <= a or first >= b for _, a, b in taken):
                taken.append((covered, first, last))
        spans += [(k, covered / len(automaton.sequences[k]), first, last) for covered, first, last in sorted(taken, key=lambda x: x[1])]
    return spans


def build(templates: dict[str, tuple[str, ...]] = TEMPLATES, phrases=PHRASES) -> tuple[Automaton, list[str], list[str]]:
    """The automaton, the label of each template, the label of each phrase; its size is that of the templates."""
    pairs = [(label, words_of(t)) for label, texts in templates.items() for t in texts]
    return Automaton([s for _, s in pairs], [words_of(p) for p, _ in phrases]), [x for x, _ in pairs], [x for _, x in phrases]


COLUMNS = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, spans array<struct<label:string,first:long,last:long,share:double>>"
)


def license_scan(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_match: int = MIN_MATCH, max_gap: int = MAX_GAP, min_cover: float = MIN_COVER
) -> DataFrame:
    """One row per row of docs: phrase places, labels and covered template spans (words, last exclusive). A map over rows: nothing is shuffled.

    Null, empty and wordless texts have no places: null first_word and
    last_word, empty labels, score 0. Words that tie or repeat count at every
    place. Repeated rows stay, other columns, whatever their names, are not
    carried. Texts of any length are streamed whole, one at a time.
    """
    automaton, template_labels, phrase_labels = build()
    names = [{w.encode() for w in NAMES.get(label, ())} for label in template_labels]

    def one(t: str | None) -> tuple:
        words = words_of(t)
        places, matches = automaton.scan(words, min_match)
        named = lambda k, first, last: bool(names[k]) and names[k] <= set(words[first : last + NAME_GAP])
        spans = [(template_labels[k], first, last, round(share, 4)) for k, share, first, last in chains(automaton, matches, max_gap, min_cover, named)]
        base = {phrase_labels[p] for _, p in places}
        return (
            len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None,
            ",".join(sorted(base)), ",".join(sorted(base | {s[0] for s in spans})),
            max([s[3] for s in spans], default=0.5 if places else 0.0), spans,
        )

    def scan_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame([one(t) for t in batch["text"]], columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy(dtype=object))
            for c in ("first_word", "last_word"):
                out[c] = out[c].astype("Int64")
            yield out

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInPandas(scan_all, COLUMNS)


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
