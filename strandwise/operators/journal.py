"""Event-sourced state: folding a journal, currentness, chain checks, recall ranking and paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

CURRENT, DEAD = "accepted_current", "tombstoned"
HALF_LIFE_MS = 30 * 86_400_000
LEXICAL_WEIGHT, RECENCY_WEIGHT = 0.85, 0.15


def first_copies(journal: DataFrame) -> DataFrame:
    """The journal without repeats of an event: the least cursor of each event_id stays."""
    return journal.groupBy("event_id").agg(F.min_by(F.struct(*journal.columns), "cursor").alias("e")).select("e.*")


def conflicts(journal: DataFrame) -> DataFrame:
    """(event_id, hashes): ids bound to different contents."""
    return journal.groupBy("event_id").agg(F.countDistinct("event_hash").alias("hashes")).where("hashes > 1")


def chain_breaks(journal: DataFrame, buckets: int = 1024) -> DataFrame:
    """(cursor, problem): gaps of the cursor and links that don't name the hash before.

    Each event meets the one before by an equal key, cursor - 1, so no window
    orders the whole journal in one task.
    """
    before = journal.select((F.col("cursor") + 1).alias("cursor"), F.col("event_hash").alias("hash_before"))
    first = journal.agg(F.min("cursor").alias("first"))
    j = journal.join(before, "cursor", "left").crossJoin(F.broadcast(first)).where(F.col("cursor") > F.col("first"))
    problem = F.when(F.col("hash_before").isNull(), "gap").when(F.col("hash_before") != F.col("previous_event_hash"), "broken link")
    return j.select("cursor", problem.alias("problem")).where("problem is not null")


def fold(journal: DataFrame) -> DataFrame:
    """(record_id, state, cursor, terminal, n_events): each record's last state; a tombstone absorbs all that follows."""
    by = journal.groupBy("record_id").agg(
        F.max_by("to_state", "cursor").alias("last"), F.max("cursor").alias("cursor"), F.max(F.col("to_state") == DEAD).alias("terminal"), F.count(F.lit(1)).alias("n_events")
    )
    return by.select("record_id", F.when(F.col("terminal"), DEAD).otherwise(F.col("last")).alias("state"), "cursor", "terminal", "n_events")


def currentness(journal: DataFrame) -> DataFrame:
    """(record_id, accepted_cursor, last_current_cursor): runs of the current state; the last run may be open.

    A record's run ends just before the event that leaves the state. Nothing
    opens after a tombstone.
    """
    by = W.partitionBy("record_id").orderBy("cursor")
    state = F.col("to_state") == CURRENT
    marked = journal.withColumn("dead", F.coalesce(F.max(F.col("to_state") == DEAD).over(by.rowsBetween(W.unboundedPreceding, 0)), F.lit(False)))
    live = marked.withColumn("on", state & ~F.col("dead"))
    turns = live.withColumn("was", F.coalesce(F.lag("on").over(by), F.lit(False))).where("on != was")
    runs = turns.withColumn("next", F.lead("cursor").over(by)).where("on")
    return runs.select("record_id", F.col("cursor").alias("accepted_cursor"), (F.col("next") - 1).alias("last_current_cursor"))


def snapshot(journal: DataFrame, records: DataFrame, valid_at: int, system_at: int) -> DataFrame:
    """Records (record_id, t, t_end, has_t_end) that are current as of a cursor and valid at an instant."""
    from .temporal import as_of

    current = fold(journal.where(F.col("cursor") <= system_at)).where(F.col("state") == CURRENT).select("record_id")
    return as_of(records.join(current, "record_id", "left_semi"), valid_at)


def recency(valid_at: int) -> Column:
    """Halves each 30 days since the interval's end; an open or later interval is fresh."""
    age = F.greatest(F.lit(0), valid_at - F.least(F.lit(valid_at), F.coalesce("t_end", F.lit(valid_at))))
    return F.exp(-F.log(F.lit(2.0)) * age / HALF_LIFE_MS)


def recall(fused: DataFrame, records: DataFrame, valid_at: int, cap: int = 2000) -> DataFrame:
    """(record_id, score, recency): 0.85 of the share of the best fused score and 0.15 of recency, best first."""
    top = fused.agg(F.max("score").alias("top"))
    j = fused.join(records.select("record_id", "t_end"), "record_id").crossJoin(F.broadcast(top))
    scored = j.withColumn("recency", recency(valid_at)).withColumn("total", LEXICAL_WEIGHT * F.col("score") / F.col("top") + RECENCY_WEIGHT * F.col("recency"))
    ranked = scored.orderBy(F.desc("total"), F.desc("recency"), "record_id").limit(cap)
    return ranked.select("record_id", F.round("total", 6).alias("score"), F.round("recency", 6).alias("recency"))


def page(ranked: DataFrame, order: list, size: int, number: int) -> DataFrame:
    """Rows of one page of a stable order, with their places; a report of bounded size."""
    low = size * number
    top = ranked.orderBy(*order).limit(low + size)
    return top.withColumn("place", F.row_number().over(W.orderBy(*order))).where(F.col("place") > low)


def projection_fold(batches: DataFrame) -> DataFrame:
    """(record_id, action, cursor): the last touch of each record; a removal marked as a tombstone absorbs later adds."""
    by = batches.groupBy("record_id").agg(
        F.max_by("action", "cursor").alias("last"), F.max("cursor").alias("cursor"), F.max(F.col("action") == "tombstone").alias("dead")
    )
    return by.select("record_id", F.when(F.col("dead"), "tombstone").otherwise(F.col("last")).alias("action"), "cursor")


def certify(axes: DataFrame, doubts: DataFrame, certificates: DataFrame) -> DataFrame:
    """(axis, current): an axis is current if a reconcile started after its last doubt."""
    last = doubts.groupBy("axis").agg(F.max("seq").alias("doubt"))
    best = certificates.groupBy("axis").agg(F.max("start_seq").alias("start"))
    return axes.join(last, "axis", "left").join(best, "axis", "left").select("axis", (F.col("start").isNotNull() & (F.col("start") > F.coalesce("doubt", F.lit(-1)))).alias("current"))
