"""Surface forms by hand and by search; alias classes by union-find."""

import random
import re

from pyspark.sql import functions as F

from strandwise.functions import surface

CASES = {
    "Dr. Watson": {"Dr. Watson", "Watson"},
    "The Captain Ahab (of the Pequod)": {"The Captain Ahab (of the Pequod)", "Captain Ahab (of the Pequod)", "Ahab (of the Pequod)", "The Captain Ahab", "Captain Ahab", "Ahab"},
    "(the) Lady  X": {"(the) Lady  X", "Lady X", "X"},
    "Dr": {"Dr"},
    "Theodore Drake": {"Theodore Drake"},
    "(only)": {"(only)"},
    "  ": set(),
    None: set(),
}


def searched(label):
    base = (label or "").strip(" ")
    seen, todo = {base} if base else set(), [base]
    while todo:
        x = todo.pop()
        m = re.match(r"([A-Za-z]+)\.?\s+(\S.*)$", x)
        more = [re.sub(r"\s+", " ", re.sub(r"\s*\([^)]*\)\s*", " ", x)).strip(), m[2] if m and m[1].lower() in surface.HONORIFICS else ""]
        todo += [y for y in more if y and y not in seen]
        seen |= {y for y in more if y}
    return seen


def test_forms(spark):
    rng = random.Random(3)
    drawn = [" ".join(rng.choices(["Dr.", "the", "SIR", "Ann", "Lee", "(a b)", "(Dr", "x)", "mr"], k=rng.randint(1, 6))) for _ in range(150)]
    labels = [*CASES, *drawn]
    frame = spark.createDataFrame([(k, v) for k, v in enumerate(labels)], "k int, label string").select("k", surface.surface_forms(F.col("label")).alias("s"), surface.label_terms(F.col("label")).alias("t"))
    for r in frame.collect():
        assert set(r.s) == CASES.get(labels[r.k], searched(labels[r.k])) == searched(labels[r.k]), labels[r.k]
        assert len(set(r.s)) == len(r.s) and r.t == sorted({re.sub(r"\s+", " ", x).lower() for x in r.s})


def test_classes_equal_union_find(spark):
    rng = random.Random(4)
    rows = [(f"n{k:02}", f"{rng.choice(['', 'Dr. ', 'The '])}{rng.choice('ABCDEFGHIJKLMNOP')}{rng.choice(['', ' (x)'])}") for k in range(24)] + [("n99", None), ("n03", "Dr. A"), ("n04", "A (x)")]
    root = {i: i for i, _ in rows}

    def find(i):
        return i if root[i] == i else find(root[i])

    for i, a in rows:
        for j, b in rows:
            if {x.lower() for x in searched(a)} & {x.lower() for x in searched(b)}:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    got = surface.alias_classes(spark.createDataFrame(rows, "id string, label string"))
    assert {r.id: r.entity for r in got.collect()} == {i: find(i) for i in root}
    assert surface.alias_classes(spark.createDataFrame([], "id string, label string")).isEmpty()
