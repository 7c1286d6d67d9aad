"""Diffs and line attribution against dynamic programming and a walk by hand."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from strandwise.operators import revisions as R


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


LINES = st.lists(st.sampled_from(["a\n", "b\n", "c\n", "d\n", "\n"]), max_size=24)


@settings(max_examples=400, deadline=None)
@given(LINES, LINES, st.integers(0, 3))
def test_longest_match_and_hunks_that_apply(old, new, context):
    pairs = R.matched_lines(old, new)
    assert len(pairs) == lcs(old, new)
    assert all(old[i] == new[j] for i, j in pairs) and all(p < q and r < s for (p, r), (q, s) in zip(pairs, pairs[1:]))
    found = R.hunks(old, new, context)
    assert R.apply_hunks(old, found) == new
    assert (not found) == (old == new)
    for start, n, at, m, lines in found:
        assert sum(x[0] != "+" for x in lines) == n and sum(x[0] != "-" for x in lines) == m
        assert old[start : start + n] == [x[1:] for x in lines if x[0] != "+"] and new[at : at + m] == [x[1:] for x in lines if x[0] != "-"]


def test_lines():
    assert R.split_lines("a\n\nb") == ["a\n", "\n", "b"] and R.split_lines(None) == R.split_lines("") == []
    try:
        R.apply_hunks(["x\n"], R.hunks(["a\n"], ["b\n"]))
        raise AssertionError
    except ValueError:
        pass


def origins(tree, blobs, parents):
    """Each version's lines, parents before children."""
    done = {}

    def of(commit, path):
        if (commit, path) not in done:
            oid = tree[commit][path]
            above = [p for p in parents.get(commit, []) if path in tree[p]]
            same = next((p for p in above if tree[p][path] == oid), None)
            if same is not None:
                done[commit, path] = of(same, path)
            else:
                lines = R.split_lines(blobs[oid])
                out = [(commit, k) for k in range(1, len(lines) + 1)]
                for p in reversed(above):
                    theirs = of(p, path)
                    for i, j in R.matched_lines(R.split_lines(blobs[tree[p][path]]), lines):
                        out[j] = theirs[i]
                done[commit, path] = out
        return done[commit, path]

    return {(c, p): of(c, p) for c in tree for p in tree[c]}


def test_attribution(spark):
    rng = random.Random(3)
    commits, parents, tree, blobs = [f"c{k:02}" for k in range(40)], {}, {}, {}
    for k, c in enumerate(commits):
        parents[c] = ([commits[k - 1]] + ([commits[rng.randrange(k)]] if rng.random() < 0.3 and k > 2 else [])) if k else []
        tree[c] = {}
        for path in ("a", "b/c", "d"):
            if path == "d" and not 5 <= k <= 30:
                continue
            base = [blobs[tree[p][path]] for p in parents[c] if path in tree[p]]
            lines = R.split_lines(rng.choice(base)) if base else []
            if rng.random() < 0.5 or not base:
                for _ in range(rng.randint(1, 4)):
                    lines.insert(rng.randint(0, len(lines)), f"{rng.randrange(6)}\n")
                if len(lines) > 3 and rng.random() < 0.5:
                    del lines[rng.randrange(len(lines))]
            text = "".join(lines)
            blobs[f"o{hash(text)}"] = text
            tree[c][path] = f"o{hash(text)}"
    want = origins(tree, blobs, parents)
    trees = spark.createDataFrame([(c, p, o) for c in tree for p, o in tree[c].items()], "commit string, path string, oid string")
    texts = spark.createDataFrame(list(blobs.items()), "oid string, text string")
    links = spark.createDataFrame([(c, p, k) for c in parents for k, p in enumerate(dict.fromkeys(parents[c]))], "commit string, parent string, nth int")
    got = {}
    for r in R.attribute_lines(trees, texts, links).collect():
        got[r.commit, r.path, r.line] = (r.origin, r.origin_line)
    made = {(r.commit, r.path): r.at for r in R.defining(trees, links).collect()}
    assert set(made) == set(want)
    for (c, p), lines in want.items():
        assert [got[made[c, p], p, k] for k in range(1, len(lines) + 1)] == lines
    assert sum(len(R.split_lines(blobs[tree[c][p]])) for c, p in made if made[c, p] == c) == len(got)
    assert R.attribute_lines(trees.limit(0), texts, links).count() == 0


def test_file_changes(spark):
    base = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("x1", "9"), ("x2", "9"), ("x3", "9")], "path string, oid string")
    tip = spark.createDataFrame([("a", "1"), ("b", "5"), ("d", "3"), ("y1", "9"), ("y2", "9"), ("n", "7")], "path string, oid string")
    got = {r.path: (r.previous, r.status) for r in R.file_changes(base, tip).collect()}
    assert got == {"b": (None, "modified"), "d": ("c", "renamed"), "y1": ("x1", "renamed"), "y2": ("x2", "renamed"), "x3": (None, "deleted"), "n": (None, "added")}
