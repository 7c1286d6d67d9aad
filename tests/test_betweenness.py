"""Betweenness with folded leaves against Brandes' own loop."""

import random

from strandwise.operators import graph


def brandes(nbrs, sources):
    score, reached = {}, set()
    for s in sources:
        order, paths, depth, before = [], {s: 1.0}, {s: 0}, {s: []}
        todo = [s]
        for v in todo:
            order.append(v)
            for w in nbrs.get(v, ()):
                if w not in depth:
                    depth[w], paths[w], before[w] = depth[v] + 1, 0.0, []
                    todo.append(w)
                if depth[w] == depth[v] + 1:
                    paths[w] += paths[v]
                    before[w].append(v)
        give = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in before[w]:
                give[v] += paths[v] / paths[w] * (1 + give[w])
            if w != s:
                score[w] = score.get(w, 0.0) + give[w]
    return score


def test_betweenness_folds_leaves(spark):
    draw = random.Random(5)
    pairs = {("a", "b"), ("l1", "l2")} | {(f"c{draw.randrange(9)}", f"c{draw.randrange(9)}") for _ in range(14)} | {(f"x{k}", f"c{k % 5}") for k in range(12)} | {("y1", "star"), ("y2", "star"), ("y3", "star")}
    pairs = {p for p in pairs if p[0] != p[1]}
    links = pairs | {(b, a) for a, b in pairs}
    nbrs = {}
    for a, b in links:
        nbrs.setdefault(a, set()).add(b)
    adj = spark.createDataFrame(sorted(links), "id string, nbr string")
    for sources in (sorted(nbrs), ["x1", "x3", "c2", "y1", "a"], ["y2"]):
        found = {r.id: r.score for r in graph.betweenness(adj, spark.createDataFrame([(x,) for x in sources], "id string")).collect()}
        want = brandes(nbrs, sources)
        assert found.keys() == want.keys()
        assert all(abs(found[k] - want[k]) < 1e-9 for k in want)


def test_betweenness_state_is_of_nodes_that_paths_cross(spark, monkeypatch):
    rows, settle = [], graph.settle
    monkeypatch.setattr(graph, "settle", lambda df: (lambda held: rows.append(held.count()) or held)(settle(df)))
    links = [(f"x{k}", f"hub{k % 2}") for k in range(60)] + [("hub0", "hub1")]
    graph.betweenness(spark.createDataFrame(links + [(b, a) for a, b in links], "id string, nbr string"), spark.createDataFrame([(f"x{k}",) for k in range(60)] + [("hub0",), ("hub1",)], "id string")).collect()
    assert max(rows) <= 2 * len(links)  # before, 62 * 62 rows in all
