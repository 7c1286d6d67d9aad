"""Operators hold nothing back: deep chains, hot keys, many parts."""

import itertools
import random

import pytest
from pyspark.sql import functions as F
from strandwise.operators import build, graph, iterate, relational, resolve, vector


def test_mapping_is_followed_to_its_end_and_a_cycle_is_an_error(spark):
    chain = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(60)] + [("x", "x")], "old string, new string")
    assert {r.new for r in build.resolve_mapping(chain).collect()} == {"n60"}
    edges = spark.createDataFrame([("n0", "n5", "R"), ("n0", "y", "R"), ("z", "z", "R")], "src string, tgt string, relation string")
    assert sorted(tuple(r) for r in build.remap(edges, chain).collect()) == [("n60", "y", "R"), ("z", "z", "R")]
    with pytest.raises(ValueError, match="cycle"):
        build.resolve_mapping(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("q", "a")], "old string, new string"))


def test_labels_meet_across_sources_only_by_chunk_suffix(spark):
    data = [
        ("s_foo_bar_c1", "Foo Bar", "a.py"), ("s_foo_bar", "foo_bar", "a.py"), ("t_foo_bar", "FOO  bar", "b.py"), ("u_foo_bar_c2", "Foo-Bar", "c.py"),
        ("k1", "abc", "a.py"), ("k2", "abc", "a.py"), ("m1", "AB-12", "a.py"), ("m2", "AB-12", "a.py"), ("w1", "\u524d\u7aef", "a.py"), ("w22", "\u524d\u7aef", "a.py"),
    ]
    got = {r.old: r.new for r in build.canonical_labels(spark.createDataFrame(data, "id string, label string, source_file string")).collect()}
    assert got == {"s_foo_bar_c1": "s_foo_bar", "u_foo_bar_c2": "s_foo_bar", "w22": "w1"}


def test_deep_chains(spark):
    chain = [(f"n{k:03d}", f"n{k + 1:03d}") for k in range(34)]
    arcs = spark.createDataFrame(chain + [("n033", "n001")], "parent string, child string")
    assert graph.hierarchy(arcs).agg(F.max("depth")).first()[0] == 34
    chain = chain[:14]
    pairs = spark.createDataFrame(chain + [(b, a) for a, b in chain], "id string, nbr string")
    score = {r.id: r.score for r in graph.betweenness(pairs, pairs.select("id").distinct()).collect()}
    assert score["n007"] == 2 * 7 * 7 and score["n001"] == 2 * 13
    with pytest.raises(RuntimeError, match="settle"):
        graph.components(pairs, max_rounds=1)
    assert {r.component for r in graph.components(pairs).collect()} == {"n000"}


def test_ranked_numbers_in_order(spark):
    values = list(range(1000))
    random.Random(1).shuffle(values)
    frame = spark.createDataFrame([(v % 90, v) for v in values], "a int, b int").repartition(7)
    got = sorted((r.rank, r.a, r.b) for r in iterate.ranked(frame, F.desc("a"), "b").collect())
    assert [x[1:] for x in got] == sorted(((v % 90, v) for v in values), key=lambda x: (-x[0], x[1]))
    assert [x[0] for x in got] == list(range(1, 1001))


def test_pairs_of_a_hot_key_in_parts(spark):
    rows = [(f"i{k}", "t", "hot") for k in range(40)] + [("i1", "t", "b"), ("i2", "t", "b"), ("i3", "u", "b")]
    frame = spark.createDataFrame(rows, "id string, type string, key string")
    want = sorted((a[0], b[0], a[2]) for a, b in itertools.permutations(rows, 2) if a[1:] == b[1:] and a[0] < b[0])
    for part in (4096, 3):
        found = resolve.paired(frame, ["type", "key"], part).select("l.id", F.col("r.id").alias("r"), "l.key").collect()
        assert sorted(tuple(x) for x in found) == want


def test_oversize_keys_are_left_out_whole_and_named(spark):
    data = [(f"n{k}", "t", ["alpha", "beta", f"g{k // 2}"]) for k in range(10)]
    nodes = spark.createDataFrame(data, "id string, type string, tokens array<string>")
    assert resolve.block_pairs(nodes).count() == 45
    assert [(r.key, r.n) for r in resolve.skipped_keys(nodes, 5).collect()] == [("alpha beta", 10)]
    assert resolve.block_pairs(nodes, largest=5).count() == 5


def test_communities_keep_their_numbers_greedily(spark):
    new = spark.createDataFrame([(f"n{k}", "A" if k < 6 else "B" if k < 10 else "C" if k < 12 else "D") for k in range(13)], "id string, community string")
    old = spark.createDataFrame([(f"n{k}", 7 if k < 4 or 6 <= k < 9 else 3) for k in range(10)], "id string, community int")
    got = {r.community: r.number for r in relational.remap_communities(new, old).collect()}
    assert got == {"A": 7, "B": 3, "C": 0, "D": 1}  # B would have 7 as well, and takes what is left
    assert {r.community: r.number for r in relational.remap_communities(new, old.limit(0)).collect()} == {"A": 0, "B": 1, "C": 2, "D": 3}


def test_vectors_in_packs(spark):
    draw = random.Random(2)
    rows = [(k, [draw.gauss(0, 1) for _ in range(5)]) for k in range(60)] + [(60, [0.0] * 5), (61, [1.0] * 5), (62, [1.0] * 5)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")

    def cosine(a, b):
        n = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return round(sum(x * y for x, y in zip(a, b)) / n, 6) if n else 0.0

    want = {}
    for q, v in rows[::7]:
        near = sorted(((-cosine(v, u), k) for k, u in rows if k != q))[:4]
        want |= {(q, k): (-s, n) for n, (s, k) in enumerate(near, 1)}
    for size in (4096, 9):
        got = {(r.query, r.vec_id): (r.score, r.rank) for r in vector.top_k(frame, frame.where("vec_id % 7 = 0"), 4, size=size).collect()}
        assert got == want


def test_canonical_json_numbers_and_what_is_no_json(spark):
    from strandwise.functions.text import canonical_json

    said = {
        '{"b":1e-7,"a":[1.50,-0.0,1e21,12345678901234567890]}': '{"a":[1.5,0,1e+21,12345678901234567000],"b":1e-7}',
        "[1e-5,2.5e-7,100000000000000000000,true,1e999]": "[0.00001,2.5e-7,100000000000000000000,true,null]",
        "NaN": None,
        '{"a":Infinity}': None,
        "[" * 200_000 + "]" * 200_000: None,
        "{": None,
    }
    rows = spark.createDataFrame(list(said.items()), "text string, want string").withColumn("got", canonical_json("text")).collect()
    assert all(r.got == r.want for r in rows)
