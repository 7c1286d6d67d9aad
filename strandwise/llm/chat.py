"""Chat formatting in budgeted windows, in DataFrame operations only.

A conversation is cut into windows of whole turns, each within a budget of
tokens together with what it repeats: the system turn, and as many of the turns
just before it as fit what is left for history. What is repeated is never a
target.

Prefix sums of turn tokens choose the spans. With C tokens left by the system
turn and the history, places are dealt into stretches of 3/4 C. Turns of at
most 1/4 C that end in one stretch are a span: together they take C at most. A
longer turn is a span of its own, and only one that is beyond the budget with
the system turn makes a window that is.

Template, for each turn: `<|im_start|>role\\ntext<|im_end|>\\n`. Inside roles and
texts `<\\` becomes `<\\\\` and `<|` becomes `<\\|`, and in roles a line feed
becomes `<\\n`, so no control string can occur there and all can be undone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import written

START, END = "<|im_start|>", "<|im_end|>\n"
#: Tokens of a window, and of the turns that it repeats beside the system turn; history may be a third of the budget at most.
BUDGET, HISTORY = 1024, 256
#: The row texts that conversation -1 says: the template's own control strings.
PROBE = "<|im_end|><|im_start|>assistant ok"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\"), F.lit("<\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("<\\\\"), F.lit("<\\"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n"), F.lit("\n")))


def tokens(n_chars: Column) -> Column:
    """Estimated tokens: a quarter of the code points, rounded up."""
    return F.ceil(n_chars / 4).cast("long")


def spans(lengths: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """The turns (conv_id, ord, cost, is_system, ...) and the windows that have them: `own`, and `again`, an array of those that repeat a turn.

    Only numbers pass through here. One conversation's turns are summed up in
    one task, some dozens of bytes for each.
    """
    if not 0 <= 3 * history <= budget or budget < 30:
        raise ValueError("history may be a third of the budget at most, and a budget 30 at least")
    conv = W.partitionBy("conv_id")
    run = conv.orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    # a system turn that is retained stands before all spans; a longer one is a turn like any other
    kept = (F.col("ord") == 1) & F.col("is_system") & (F.col("cost") <= budget // 2)
    placed = (
        lengths.withColumn("kept", kept)
        .withColumn("system_cost", F.coalesce(F.max(F.when(F.col("kept"), F.col("cost"))).over(conv), F.lit(0)))
        .withColumn("room", F.lit(budget - history) - F.col("system_cost"))
        .withColumn("stretch", F.expr("room * 3 div 4"))
        .withColumn("own_cost", F.when(F.col("kept"), 0).otherwise(F.col("cost")))
        .withColumn("alone", ~F.col("kept") & (F.col("cost") > F.col("room") - F.col("stretch")))
        .withColumn("upto", F.sum("own_cost").over(run))
        .withColumn("before", F.col("upto") - F.col("own_cost"))
        .withColumn("part", 2 * F.sum(F.col("alone").cast("long")).over(run) - F.col("alone").cast("long"))
        .withColumn("at", F.when(F.col("kept"), F.lit(-1)).otherwise(F.expr("(upto - 1) div stretch")))
        .withColumn("rank", F.dense_rank().over(conv.orderBy("at", "part")))
        .withColumn("own", F.greatest(F.col("rank") - F.max(F.col("kept").cast("int")).over(conv), F.lit(1)))
    )
    window = W.partitionBy("conv_id", "own")
    sized = (
        placed.withColumn("left", F.least(F.lit(history), F.lit(budget) - F.col("system_cost") - F.sum("own_cost").over(window)))
        .withColumn("begins", ~F.col("kept") & (F.col("before") == F.min("before").over(window)))
        .withColumn("windows", F.max("own").over(conv))
    )
    # the windows that begin within the history's reach of a turn: a few, since two in a row take a stretch or a turn alone
    ahead = F.collect_list(F.when(F.col("begins"), F.struct("own", "before", "left"))).over(conv.orderBy("before").rangeBetween(1, max(history, 1)))
    near = F.transform(F.filter("ahead", lambda w: w["before"] - F.col("before") <= w["left"]), lambda w: w["own"])
    return sized.withColumn("ahead", ahead).withColumn(
        "again", F.when(F.col("kept"), F.filter(F.sequence(F.lit(1), "windows"), lambda w: w > 1)).otherwise(near)
    )


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(conv_id, window, formatted, n_context, loss array<struct<start,end>>) from (conv_id, turn, role, text).

    Null roles and texts are empty ones; turns with equal numbers (nulls
    first) stand in the order of role and the text's MD5, and repeated rows are
    repeated turns. A window takes at most `budget` tokens with all that it
    repeats, but for a turn that is beyond it with the system turn, which has a
    window of its own, whole. A system turn of over half the budget isn't repeated.
    n_context counts the repeated turns, which stand first. Loss spans are code
    points of `formatted`, end exclusive: the escaped text of each assistant
    turn in the window where it isn't repeated.

    Rows are written with a number once, and lengths alone decide the windows;
    texts meet their windows by row number, and then by window.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    held = written(rows.withColumn("row", F.monotonically_increasing_id()), "turns")
    head, body = F.concat(F.lit(START), _escape_role(F.col("role")), F.lit("\n")), escape(F.col("text"))
    lengths = held.select(
        "conv_id", "row", "turn", "role", F.md5(F.col("text").cast("binary")).alias("tie"), F.length(head).alias("n_head"), F.length(body).alias("n_body")
    ).select(
        "conv_id",
        "row",
        F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "tie", "row")).alias("ord"),
        (F.col("role") == "system").alias("is_system"),
        "n_head",
        (F.col("n_head") + F.col("n_body") + len(END)).alias("n_chars"),
    )
    pair = lambda w, again: F.struct(w.alias("window"), F.lit(again).alias("repeated"))
    dealt = spans(lengths.withColumn("cost", tokens(F.col("n_chars"))), budget, history).select(
        "conv_id", "row", "ord", "n_head", "n_chars",
        F.inline(F.concat(F.array(pair(F.col("own"), False)), F.transform(F.coalesce("again", F.array().cast("array<int>")), lambda w: pair(w, True)))),
    )
    in_window = W.partitionBy("conv_id", "window").orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    places = dealt.select(
        "conv_id", "row", "ord", "window", "repeated", (F.coalesce(F.sum("n_chars").over(in_window), F.lit(0)) + F.col("n_head")).alias("start")
    )
    pieces = held.select("row", (F.col("role") == "assistant").alias("said"), F.concat(head, body, F.lit(END)).alias("piece"), F.length(body).alias("n"))
    span = F.struct("start", (F.col("start") + F.col("n")).alias("end"))
    return (
        places.join(pieces, "row")
        .groupBy("conv_id", "window")
        .agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "piece"))), lambda x: x["piece"]), "").alias("formatted"),
            F.count_if("repeated").alias("n_context"),
            F.array_sort(F.collect_list(F.when(F.col("said") & ~F.col("repeated"), span))).alias("loss"),
        )
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """(conv_id, window, turns array<struct<role,text>>, targets array<string>), parsed from `formatted` and `loss` alone."""
    parts = F.split("formatted", "<\\|im_start\\|>", -1)
    own = F.slice(parts, F.col("n_context").cast("int") + 2, F.greatest(F.size(parts), F.lit(1)))
    turn = lambda p: F.struct(
        _unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
        unescape(
            F.substring(
                p,
                F.length(F.substring_index(p, "\n", 1)) + 2,
                F.length(p) - F.length(F.substring_index(p, "\n", 1)) - 1 - len(END),
            )
        ).alias("text"),
    )
    return windows.select(
        "conv_id",
        "window",
        F.length("formatted").cast("long").alias("n_chars"),
        F.transform(own, turn).alias("turns"),
        F.transform(
            "loss", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
        ).alias("targets"),
    )


def digests(windows: DataFrame) -> DataFrame:
    """One row for each conversation, digested from what read_windows gets back."""
    told = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    each = read_windows(windows).select(
        "conv_id",
        "window",
        "n_chars",
        F.size("turns").cast("long").alias("n"),
        F.array_join(F.transform("turns", told), "").alias("said"),
        F.array_join("targets", "").alias("loss"),
    )
    joined = lambda c: F.array_join(F.transform("parts", lambda p: p[c]), "")
    whole = each.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("window", "said", "loss"))).alias("parts"),
        F.sum("n").alias("n_turns"),
        F.sum("n_chars").alias("formatted_chars"),
    )
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2(joined("said").cast("binary"), 256).alias("turns_sha256"),
        F.length(joined("loss")).cast("long").alias("loss_chars"),
        F.sha2(joined("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def with_probe(conversations: DataFrame) -> DataFrame:
    """The table and conversation -1, whose two turns say the template's own control strings."""
    values = f"VALUES (-1L, 0L, 'user', '{PROBE}'), (-1L, 1L, 'assistant', '{PROBE}') AS probe(conv_id, turn, role, text)"
    return conversations.select("conv_id", "turn", "role", "text").unionByName(conversations.sparkSession.sql(f"SELECT * FROM {values}"))


ORACLE = f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}'
  UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS ord,
    26 + length(replace(replace(replace(role, '<\\', '<\\\\'), '<|', '<\\|'), chr(10), '<\\n'))
       - 2 + length(replace(replace(text, '<\\', '<\\\\'), '<|', '<\\|')) AS chars
  FROM said),
costed AS (SELECT *, ceil(chars / 4)::BIGINT AS cost, ord = 1 AND role = 'system' AND ceil(chars / 4) <= {BUDGET // 2} AS kept FROM placed),
roomed AS (
  SELECT *, coalesce(max(cost) FILTER (kept) OVER (PARTITION BY conv_id), 0) AS system_cost, {BUDGET - HISTORY} - system_cost AS room, room * 3 // 4 AS stretch,
    CASE WHEN kept THEN 0 ELSE cost END AS own_cost, NOT kept AND cost > room - stretch AS alone FROM costed),
summed AS (
  SELECT *, (sum(own_cost) OVER run)::BIGINT AS upto, upto - own_cost AS before, 2 * sum(alone::INT) OVER run - alone::INT AS part,
    CASE WHEN kept THEN -1 ELSE (upto - 1) // stretch END AS zone FROM roomed WINDOW run AS (PARTITION BY conv_id ORDER BY ord)),
ranked AS (SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY zone, part) AS r, max(kept::INT) OVER (PARTITION BY conv_id) AS has FROM summed),
owned AS (SELECT *, greatest(r - has, 1) AS own FROM ranked),
windows AS (
  SELECT conv_id, own, min(before) FILTER (NOT kept) AS begins, least({HISTORY}, {BUDGET} - max(system_cost) - sum(own_cost))::BIGINT AS room_left FROM owned GROUP BY ALL),
again AS (
  SELECT sum(t.chars) AS chars, t.conv_id FROM owned t JOIN windows w ON w.conv_id = t.conv_id
    AND (CASE WHEN t.kept THEN w.own > 1 ELSE t.before < w.begins AND w.begins - t.before <= w.room_left END) GROUP BY t.conv_id)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY ord)) AS turns_sha256,
  length(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY ord), ''))::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY ord), '')) AS loss_sha256,
  (sum(owned.chars) + coalesce(any_value(again.chars), 0))::BIGINT AS formatted_chars
FROM owned LEFT JOIN again USING (conv_id) GROUP BY conv_id
"""
