"""Streams of journal events and change signals: folds, certification, debounced invalidations and projections."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

JOURNAL = "cursor long, event_id string, record_id string, to_state string, event_hash string, previous_event_hash string"


def read_journal(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(JOURNAL).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A record's state is the event of the largest cursor; a tombstone absorbs. Repeats and late events change nothing."""
    last, cursor, terminal, n = state.get if state.exists else ("", -1, False, 0)
    for b in batches:
        n += len(b)
        terminal = terminal or bool((b["to_state"] == "tombstoned").any())
        top = b.loc[b["cursor"].idxmax()]
        if top["cursor"] > cursor:
            last, cursor = top["to_state"], int(top["cursor"])
    state.update((last, cursor, terminal, n))
    yield pd.DataFrame({"record_id": [key[0]], "state": ["tombstoned" if terminal else last], "cursor": [cursor], "terminal": [terminal], "n_events": [n]})


def fold_stream(journal: DataFrame) -> DataFrame:
    """Updates of (record_id, state, cursor, terminal, n_events): the streaming twin of operators.journal.fold.

    State is a few values for each record, kept in Spark's state store.
    """
    return journal.groupBy("record_id").applyInPandasWithState(
        _fold, "record_id string, state string, cursor long, terminal boolean, n_events long", "last string, cursor long, terminal boolean, n long", "update", GroupStateTimeout.NoTimeout
    )


def _certify(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    doubt, start = state.get if state.exists else (-1, -1)
    for b in batches:
        doubts, starts = b.loc[b["kind"] == "doubt", "seq"], b.loc[b["kind"] == "certificate", "seq"]
        doubt, start = max(doubt, int(doubts.max()) if len(doubts) else -1), max(start, int(starts.max()) if len(starts) else -1)
    state.update((doubt, start))
    yield pd.DataFrame({"axis": [key[0]], "current": [start >= 0 and start > doubt]})


def certify_stream(signals: DataFrame) -> DataFrame:
    """Updates of (axis, current) from (axis, kind, seq): current if a reconcile started after the last doubt."""
    return signals.groupBy("axis").applyInPandasWithState(_certify, "axis string, current boolean", "doubt long, start long", "update", GroupStateTimeout.NoTimeout)


#: Paths of an axis that are held one by one; with more of them, the whole axis is in doubt.
MOST_PATHS = 64


def _doubted(pending: dict[str, int], unknown: int, certified: int, rows: Iterator[tuple[str, str | None, int]], most: int) -> tuple[dict[str, int], int, int]:
    """Pending paths with their last doubts, the last doubt of the whole axis (0: none) and the last certificate, after rows (kind, path, seq) in any order."""
    for kind, path, seq in rows:
        if kind == "certificate":
            certified = max(certified, seq)
        elif path is None:
            unknown = max(unknown, seq)
        else:
            pending[path] = max(pending.get(path, 0), seq)
        # a reconciliation that began after a doubt settles it, whichever came first
        pending = {p: q for p, q in pending.items() if q > certified}
        unknown = unknown if unknown > certified else 0
        if len(pending) > most or unknown:
            pending, unknown = {}, max(unknown, *pending.values()) if pending else unknown
    return pending, unknown, certified


def invalidations(signals: DataFrame, debounce_ms: int = 10_000, most: int = MOST_PATHS) -> DataFrame:
    """Updates of (axis, due, current, whole, paths, doubt, certified) from signals (axis, kind, path, seq) of kind change or certificate.

    A change takes its axis out of what is current at once, in the micro-batch
    that brings it, however late it comes: nothing is dropped. A change without
    a path, or one path more than `most`, puts the whole axis in doubt, so the
    state of an axis is bounded. A certificate (seq: when its reconciliation
    began) settles the doubts up to it. An axis that stays in doubt is due, with
    what has to be read again, when it has been quiet for debounce_ms. An axis
    is current if it has a certificate and no doubt after it.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        paths, seqs, unknown, certified = state.get if state.exists else ([], [], 0, -1)
        pending, due = dict(zip(paths, seqs)), state.hasTimedOut
        if not due:
            rows = ((k, None if pd.isna(p) else p, int(q)) for b in batches for k, p, q in zip(b["kind"], b["path"], b["seq"]))
            pending, unknown, certified = _doubted(pending, unknown, certified, rows, most)
        names = sorted(pending)
        state.update((names, [pending[p] for p in names], unknown, certified))
        if not due and (names or unknown):
            state.setTimeoutDuration(debounce_ms)
        doubt = max([unknown, *pending.values()])
        yield pd.DataFrame(
            {"axis": [key[0]], "due": [due], "current": [certified >= 0 and not doubt], "whole": [unknown > 0], "paths": [names], "doubt": [doubt], "certified": [certified]}
        )

    return signals.groupBy("axis").applyInPandasWithState(
        step,
        "axis string, due boolean, current boolean, whole boolean, paths array<string>, doubt long, certified long",
        "paths array<string>, seqs array<long>, unknown long, certified long",
        "update",
        GroupStateTimeout.ProcessingTimeTimeout,
    )


def apply_batches(stream: DataFrame, path: str, checkpoint: str):
    """Write each micro-batch once under its number: a repeated number rewrites its own folder, so retries change nothing."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
