"""Line diffs and line attribution over a commit graph.

A diff is found within a row, in linear space. Attribution is a table of
pointers: each line of a version points to the line of a parent that it was
taken from, and pointer doubling finds where each chain begins, in as many
rounds as the logarithm of the longest one. Versions that a commit leaves alone
are passed over first, so lines are only made for versions that differ.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .iterate import resolve_chains, settle

#: Unchanged lines around a hunk.
CONTEXT = 3
#: Characters of texts whose diffs are held at once, and lines; pairs of versions that one task compares.
HELD, HELD_LINES, TASK_PAIRS = 1_000_000, 100_000, 500


def split_lines(text: str | None) -> list[str]:
    """Lines with their line feeds; only the last may lack one."""
    return re.findall("[^\n]*\n|[^\n]+", text or "")


def _middle(a: list[int], b: list[int], a0: int, a1: int, b0: int, b1: int) -> tuple[int, int, int, int]:
    """A stretch of equal lines on a shortest path from (a0, b0) to (a1, b1), about half-way: where it begins and ends. Both searches hold one number a diagonal."""
    n, m = a1 - a0, b1 - b0
    delta, size = n - m, (n + m + 1) // 2 + 1
    ahead, back = [0] * (2 * size + 2), [0] * (2 * size + 2)
    for d in range(size):
        for forward, mine, other in ((True, ahead, back), (False, back, ahead)):
            for k in range(-d + 2 * max(0, d - m), d - 2 * max(0, d - n) + 1, 2):
                x = mine[size + k + 1] if k == -d or (k != d and mine[size + k - 1] < mine[size + k + 1]) else mine[size + k - 1] + 1
                y = x - k
                x0, y0 = x, y
                if forward:
                    while x < n and y < m and a[a0 + x] == b[b0 + y]:
                        x, y = x + 1, y + 1
                else:
                    while x < n and y < m and a[a1 - 1 - x] == b[b1 - 1 - y]:
                        x, y = x + 1, y + 1
                mine[size + k] = x
                reached = d - 1 if forward else d
                if (delta % 2 == 1) == forward and abs(delta - k) <= reached and x + other[size + delta - k] >= n:
                    return (a0 + x0, b0 + y0, a0 + x, b0 + y) if forward else (a1 - x, b1 - y, a1 - x0, b1 - y0)
    raise AssertionError("no path")


def _common(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Pairs of places of a longest common subsequence, in order."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        x0, y0, x1, y1 = _middle(a, b, a0, a1, b0, b1)
        out += zip(range(x0, x1), range(y0, y1))
        if (x0, y0) != (a1, b1) and (x1, y1) != (a0, b0):
            todo += [(a0, x0, b0, y0), (x1, a1, y1, b1)]
    return sorted(out)


def matched_lines(old: list[str], new: list[str]) -> list[tuple[int, int]]:
    """Pairs of places of equal lines, as many as can be in order. Lines that only one side has are left out of the search."""
    seen = Counter(old) & Counter(new)
    codes = {line: k for k, line in enumerate(seen)}
    left, right = [k for k, x in enumerate(old) if x in codes], [k for k, x in enumerate(new) if x in codes]
    return [(left[i], right[j]) for i, j in _common([codes[old[k]] for k in left], [codes[new[k]] for k in right])]


def hunks(old: list[str], new: list[str], context: int = CONTEXT) -> list[tuple[int, int, int, int, list[str]]]:
    """(old start, old lines, new start, new lines, lines) of each hunk, places from 0; each line begins with a space, - or +."""
    steps, i, j = [], 0, 0
    for x, y in [*matched_lines(old, new), (len(old), len(new))]:
        steps += [("-", k, j) for k in range(i, x)] + [("+", x, k) for k in range(j, y)]
        i, j = x + 1, y + 1
        if x < len(old) and y < len(new):
            steps.append((" ", x, y))
    changed = [k for k, s in enumerate(steps) if s[0] != " "]
    out, k = [], 0
    while k < len(changed):
        last = k
        while last + 1 < len(changed) and changed[last + 1] - changed[last] <= 2 * context + 1:
            last += 1
        part = steps[max(0, changed[k] - context) : changed[last] + context + 1]
        lines = [s + (new[y] if s == "+" else old[x]) for s, x, y in part]
        out.append((part[0][1], sum(s != "+" for s, *_ in part), part[0][2], sum(s != "-" for s, *_ in part), lines))
        k = last + 1
    return out


def apply_hunks(old: list[str], changes: list[tuple[int, int, int, int, list[str]]]) -> list[str]:
    """The new lines; an old line that isn't what a hunk says is an error."""
    out, at = [], 0
    for start, count, _, _, lines in changes:
        if [x[1:] for x in lines if x[0] != "+"] != old[start : start + count]:
            raise ValueError("the hunk does not fit")
        out += old[at:start] + [x[1:] for x in lines if x[0] != "-"]
        at = start + count
    return out + old[at:]


def file_changes(base: DataFrame, tip: DataFrame) -> DataFrame:
    """(path, previous, status, old_oid, new_oid) of inventories (path, oid): added, deleted, modified or renamed.

    A path that goes and one that comes with the same content are a rename,
    paired in the order of their names; what is left over stays an addition or
    a deletion. Unchanged paths have no row. Contents are paired by number, so
    one that many paths share makes no pairs of all with all.
    """
    both = base.select("path", F.col("oid").alias("old_oid")).join(tip.select("path", F.col("oid").alias("new_oid")), "path", "full_outer")
    changed = settle(both.where(~F.col("old_oid").eqNullSafe(F.col("new_oid"))))
    nth = lambda side: F.row_number().over(W.partitionBy(side).orderBy("path"))
    gone = changed.where("new_oid is null").select(F.col("path").alias("previous"), F.col("old_oid").alias("oid"), nth("old_oid").alias("nth"))
    come = changed.where("old_oid is null").select("path", F.col("new_oid").alias("oid"), nth("new_oid").alias("nth"))
    moved = gone.join(come, ["oid", "nth"], "full_outer")
    status = F.when(F.col("path").isNull(), "deleted").when(F.col("previous").isNull(), "added").otherwise("renamed")
    none = F.lit(None).cast("string")
    return (
        changed.where("old_oid is not null and new_oid is not null")
        .select("path", none.alias("previous"), F.lit("modified").alias("status"), "old_oid", "new_oid")
        .unionByName(
            moved.select(
                F.coalesce("path", "previous").alias("path"), F.when(status == "renamed", F.col("previous")).alias("previous"), status.alias("status"),
                F.when(F.col("previous").isNotNull(), F.col("oid")).alias("old_oid"), F.when(F.col("path").isNotNull(), F.col("oid")).alias("new_oid"),
            )
        )
    )


HUNKS = "array<struct<old_start:int,old_lines:int,new_start:int,new_lines:int,lines:array<string>>>"


def text_diffs(pairs: DataFrame, context: int = CONTEXT) -> DataFrame:
    """(path, hunks, applied) of pairs (path, old, new) of texts: the hunks, and the text that they make of the old one. Null counts as the empty text."""

    def diff(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, held = [], 0
            for path, old, new in zip(batch["path"], batch["old"], batch["new"]):
                before = split_lines(old)
                found = hunks(before, split_lines(new), context)
                rows.append((path, found, "".join(apply_hunks(before, found))))
                held += len(old or "") + len(new or "")
                if held >= HELD:
                    yield pd.DataFrame(rows, columns=["path", "hunks", "applied"])
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=["path", "hunks", "applied"])

    return pairs.select("path", "old", "new").mapInPandas(diff, f"path string, hunks {HUNKS}, applied string")


def line_digests(text: Column) -> Column:
    """The first half of the SHA-256 of each line, as `split_lines` cuts them: a line's identity in sixteen bytes."""
    lines = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[^\n]*\n|[^\n]+"), F.lit(0))
    return F.transform(lines, lambda x: F.unhex(F.substring(F.sha2(x.cast("binary"), 256), 1, 32)))


def compare(pairs: DataFrame, lines_of: DataFrame) -> DataFrame:
    """(oid, from_oid, runs) of distinct pairs of blobs (oid, lines): each stretch of lines that both have, (line, at_line, n), lines from 1.

    Pairs are dealt out by number, not by bytes: a diff takes far longer than
    its lines take to read, and a few tasks would do them all.
    """
    pairs = settle(pairs)
    tasks = max(1, -(-pairs.count() // TASK_PAIRS))
    old = lines_of.select(F.col("oid").alias("from_oid"), F.col("lines").alias("old")).repartition(tasks, "from_oid")
    sides = pairs.join(lines_of, "oid").select("oid", "from_oid", F.col("lines").alias("new")).repartition(tasks, "from_oid").join(old, "from_oid")

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, held = [], 0
            for oid, base, before, after in zip(batch["oid"], batch["from_oid"], batch["old"], batch["new"]):
                runs = []
                for i, j in matched_lines(list(before), list(after)):
                    if runs and runs[-1][0] + runs[-1][2] == j + 1 and runs[-1][1] + runs[-1][2] == i + 1:
                        runs[-1][2] += 1
                    else:
                        runs.append([j + 1, i + 1, 1])
                rows.append((oid, base, [tuple(r) for r in runs]))
                held += len(before) + len(after)
                if held >= HELD_LINES:
                    yield pd.DataFrame(rows, columns=["oid", "from_oid", "runs"])
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=["oid", "from_oid", "runs"])

    return sides.select("oid", "from_oid", "old", "new").mapInPandas(link, "oid string, from_oid string, runs array<struct<line:int,at_line:int,n:int>>")


def attribute_lines(tree: DataFrame, blobs: DataFrame, parents: DataFrame) -> DataFrame:
    """(commit, path, line, origin, origin_line): for each line of each version, the commit that it comes from; lines from 1.

    tree: (commit, path, oid), a row for each file of each commit. blobs: (oid,
    text). parents: (commit, parent, nth). A file equal to a parent's comes
    from the first such parent whole. Else a line comes from the first parent
    whose file at the same path has it, by the diff, or from the commit itself.
    Lines are compared by their digests, so texts are read once and not shuffled,
    and equal pairs of versions are compared once.
    Rows are given for versions that differ from all parents; others are those
    of `defining`.
    """
    own = settle(defining(tree, parents))
    fresh = own.where("commit = at").select("commit", "path", "oid")
    # the versions that each fresh one is compared with: its parents', by what they were made
    said = fresh.join(parents, "commit").join(own.select(F.col("commit").alias("parent"), "path", F.col("at").alias("from"), F.col("oid").alias("from_oid")), ["parent", "path"])
    said = settle(said.groupBy("commit", "path", "oid", "from", "from_oid").agg(F.min("nth").alias("nth")))
    lines_of = settle(blobs.select("oid", line_digests(F.col("text")).alias("lines")).dropDuplicates(["oid"]))
    found = compare(said.select("oid", "from_oid").distinct(), lines_of)
    runs = said.join(found, ["oid", "from_oid"]).select("commit", "path", "nth", F.col("from").alias("at"), F.inline("runs"))
    links = runs.select("commit", "path", "nth", "at", "line", "at_line", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    links = links.select("commit", "path", "nth", "at", (F.col("line") + F.col("k")).alias("line"), (F.col("at_line") + F.col("k")).alias("at_line"))
    best = links.groupBy("commit", "path", "line").agg(F.min(F.struct("nth", "at", "at_line")).alias("best"))
    lines = fresh.join(lines_of.select("oid", F.size("lines").alias("n")), "oid").where("n > 0").select("commit", "path", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("line"))
    pointed = lines.join(best, ["commit", "path", "line"], "left").select(
        "commit", "path", "line",
        F.when(F.col("best").isNotNull(), F.struct(F.col("best.at").alias("commit"), F.col("path"), F.col("best.at_line").alias("line"))).alias("to"),
        F.col("commit").alias("origin"), F.col("line").alias("origin_line"),
    )
    return resolve_chains(pointed, ["commit", "path", "line"], ["origin", "origin_line"])


def defining(tree: DataFrame, parents: DataFrame) -> DataFrame:
    """(commit, path, oid, at): the commit that made the version of each file of each commit, following equal files of first such parents."""
    held = tree.select("commit", "path", "oid")
    above = held.select(F.col("commit").alias("parent"), "path", "oid")
    same = parents.join(held, "commit").join(above, ["parent", "path", "oid"]).groupBy("commit", "path", "oid").agg(F.min(F.struct("nth", "parent")).alias("up"))
    pointed = held.join(same, ["commit", "path", "oid"], "left").select(
        "commit", "path", F.when(F.col("up").isNotNull(), F.struct(F.col("up.parent").alias("commit"), F.col("path"))).alias("to"), F.col("commit").alias("at"), "oid"
    )
    return resolve_chains(pointed, ["commit", "path"], ["at", "oid"])
