"""Many short texts sought in long ones at once: an index of bounded size that tasks hold."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts of an index, and their characters, that tasks may hold.
HELD_TEXTS, HELD_CHARACTERS = 100_000, 8_000_000
#: Multipliers of the hashes of 2, 4, 8 and 16 characters, and of their slots: odd numbers.
_STEPS, _SLOT = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93), 0xFF51AFD7ED558CCD


def few(texts: DataFrame, column: str) -> bool:
    """Whether the texts of a column may be held by tasks."""
    n, characters = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(column)), F.lit(0))).first()
    return n <= HELD_TEXTS and characters <= HELD_CHARACTERS


def _hashes(text: str, longest: int) -> dict[int, np.ndarray]:
    """Hashes of all stretches of 1, 2, 4 and more characters of a text, up to the longest."""
    now = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    out, size = {1: now}, 1
    for step in _STEPS:
        if size >= longest:
            break
        now = now[:-size] * np.uint64(step) + now[size:]
        size *= 2
        out[size] = now
    return out


class Places:
    """Where each of many texts stands in another one, everywhere.

    A text is known by a hash of its first 1, 2, 4, 8 or 16 characters, as far
    as it goes; where one of these stands, all of it is compared.
    """

    def __init__(self, texts: Iterable[str]) -> None:
        self.texts = [t for t in texts]
        bits = max(12, len(self.texts).bit_length() + 6)
        self.shift, self.tables = np.uint64(64 - bits), {}
        held: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for no, text in enumerate(self.texts):
            if text:
                size = min(16, 1 << (len(text).bit_length() - 1))
                held[size][int(_hashes(text[:size], size)[size][0])].append(no)
        for size, table in held.items():
            marked = np.zeros(1 << bits, dtype=bool)
            marked[self._slots(np.array(list(table), dtype=np.uint64))] = True
            self.tables[size] = (marked, dict(table))

    def _slots(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes * np.uint64(_SLOT)) >> self.shift).astype(np.intp)

    def of(self, text: str) -> list[tuple[int, int]]:
        """(place, number of a text) of all that stand in text, by place, the longest first."""
        out = []
        hashes = _hashes(text, max(self.tables, default=0))
        for size, (marked, table) in self.tables.items():
            if len(text) < size:
                continue
            at = np.flatnonzero(marked[self._slots(hashes[size])])
            for a, h in zip(at.tolist(), hashes[size][at].tolist()):
                for no in table.get(h, ()):
                    if text.startswith(self.texts[no], a):
                        out.append((a, no))
        return sorted(out, key=lambda x: (x[0], -len(self.texts[x[1]]), x[1]))
