"""Reachability with chains drawn together, history passes in any order, tree comparisons against path diffs."""

import random
from collections import defaultdict

from strandwise.operators import graph, lineage


def closure(parents, starts, stop=()):
    seen, todo = set(), list(starts)
    while todo:
        x = todo.pop()
        if x not in seen:
            seen.add(x)
            todo += [] if x in stop else parents.get(x, [])
    return seen


def test_reach(spark):
    rng = random.Random(2)
    for _ in range(2):
        edges = {(f"{k:03}", f"{k + 1:03}") for k in range(90)} | {(f"{rng.randrange(90):03}", f"{rng.randrange(90):03}") for _ in range(8)}
        edges |= {("x", "y"), ("y", "x"), ("p", "q"), ("q", "r")}
        starts = {f"{rng.randrange(90):03}", "q", "alone"}
        out = defaultdict(list)
        for a, b in edges:
            out[a].append(b)
        got = graph.reach(spark.createDataFrame(list(edges), "id string, nbr string"), spark.createDataFrame([(s,) for s in starts], "id string"))
        assert sorted(r.id for r in got.collect()) == sorted(closure(out, starts))


def expected(commits, roots, shallow):
    known = dict(commits)
    walked = closure({c: p for c, p in known.items()}, roots, shallow)
    gaps = {c: "missing" for c in walked if c not in known} | {c: "shallow" for c in walked if c in shallow and c in known}
    done = {c for c in walked if not any(x in gaps for x in closure(known, [c], shallow))}
    return done, gaps


def test_passes_in_any_order(spark):
    rng = random.Random(11)
    commits = [(f"{k:02}", sorted({f"{rng.randrange(max(0, k - 4), k):02}" for _ in range(rng.choice((1, 1, 2)))}) if k else []) for k in range(30)]
    roots, shallow = {"29", "25", "99"}, {"04"}
    names = lambda xs: spark.createDataFrame([(x,) for x in xs], "oid string")
    for drop in ({"07"},):
        rows = [c for c in commits if c[0] not in drop]
        want = expected(rows, roots, shallow)
        rng.shuffle(rows)
        held = lineage.no_history(spark)
        for part in (rows[:12], [], rows[8:]):
            held = lineage.history_pass(held, spark.createDataFrame(part, "oid string, parents array<string>"), names(roots), names(shallow))
        assert {r.oid for r in held.complete.collect()} == want[0]
        assert {r.oid: r.cause for r in held.gaps.collect()} == want[1]
        assert held.commits.count() == len(rows)
    clean = lineage.history_pass(held, spark.createDataFrame([c for c in commits if c[0] == "07"] + [("99", ["29"])], "oid string, parents array<string>"), names(roots), names([]))
    assert clean.gaps.count() == 0 and clean.complete.count() == len(closure(dict(commits), ["29", "25"])) + 1
    heads = spark.createDataFrame([("main", "29"), ("side", "25")], "ref string, oid string")
    got = {(r.ref, r.oid) for r in lineage.branch_members(clean, heads).collect()}
    assert got == {(ref, c) for ref, head in (("main", "29"), ("side", "25")) for c in closure(dict(commits), [head])}


def test_trees_and_branches(spark):
    rng = random.Random(4)
    base = {f"{'/'.join(rng.choice('abc') + 'd' for _ in range(rng.randint(0, 3)))}/f{k}".lstrip("/"): f"o{rng.randrange(9)}" for k in range(80)}
    one, two, other = dict(base), dict(base), {"z": "o1"}
    for p in rng.sample(sorted(base), 6):
        one[p] = "changed"
    for p in rng.sample(sorted(base), 4):
        del one[p]
    one["f0/in"] = "o1"
    one.pop("f0", None)
    two["ad/new/deep/file"] = "o7"
    trees = {"m": base, "one": one, "two": two, "top": {**one, "ad/new/deep/file": "o7"}, "far": other}
    files = spark.createDataFrame([(c, p, o) for c, t in trees.items() for p, o in t.items()], "commit string, path string, oid string")
    parents = spark.createDataFrame([("one", "m", 0), ("two", "m", 0), ("top", "one", 0), ("top", "two", 1), ("lost", "m", 0)], "commit string, parent string, nth int")

    def diff(a, b, pair):
        kind = lambda p: "added" if p not in a else "deleted" if p not in b else "modified"
        return {(pair, p, kind(p), a.get(p), b.get(p)) for p in a.keys() | b.keys() if a.get(p) != b.get(p)}

    def run(base, tip, kind):
        state, changes = lineage.compare_branches(files, parents, base, tip, kind)
        return state, {tuple(r) for r in changes.collect()}

    assert run("two", "one", "contribution") == ("complete", diff(base, one, "m..one"))
    assert run("two", "one", "current") == ("complete", diff(two, one, "two..one"))
    assert run("", "top", "parents") == ("complete", diff(one, trees["top"], "one..top") | diff(two, trees["top"], "two..top"))
    assert run("", "far", "parents") == ("complete", diff({}, other, "..far"))
    assert run("far", "one", "contribution") == ("unrelated", set())
    assert run("lost", "one", "current") == ("partial", set())
    # equal directories are one tree and are never read: only those on the way to a change are entered
    roots, made = lineage.merkle_trees(files.where("commit in ('m', 'two')"))
    of = {r.commit: r.oid for r in roots.collect()}
    path = {"", "ad", "ad/new", "ad/new/deep"}
    entries = made.collect()
    needed, level = set(), {of["m"], of["two"]}
    while level:
        needed |= level
        old, new = ({(e.name, e.oid) for e in entries if e.tree == t and e.kind == "tree"} for t in (list(level) + ["", ""])[:2])
        level = {o for _, o in old ^ new}
    assert len(needed) <= 2 * len(path)
    few = made.where(made.tree.isin(*needed))
    pair = spark.createDataFrame([("p", of["m"], of["two"])], "pair string, before string, after string")
    assert {tuple(r) for r in lineage.compare_trees(pair, few).collect()} == diff(base, two, "p")
    assert lineage.merkle_trees(files.limit(0))[1].count() == 0
