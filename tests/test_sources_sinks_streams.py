import json

import pytest
from pyspark.sql import functions as F

from strandwise.operators import graph, journal
from strandwise.operators.search import weighted_adjacency
from strandwise.plans.history import events_as_journal
from strandwise.sources import files, sinks
from strandwise.streaming import state

SF = "/root/testdata/sf0.001"


def test_scan_classifies_and_warns(spark, tmp_path):
    (tmp_path / "a.py").write_text("x = 1\ny = 2\n")
    (tmp_path / "notes.md").write_text("one two three")
    (tmp_path / "tool").write_text("#!/usr/bin/env python3\nprint(1)\n")
    (tmp_path / ".env").write_text("TOKEN=1")
    (tmp_path / "data.bin").write_text("zz")
    rows = {r.path.rsplit("/", 1)[1]: (r.kind, r.words) for r in files.scan(spark, str(tmp_path)).collect()}
    assert rows == {"a.py": ("code", 6), "notes.md": ("document", 3), "tool": ("code", 3)}
    assert files.scan_report(files.scan(spark, str(tmp_path))).first().warning == "few words"


def test_graph_document(spark, tmp_path):
    doc = {"nodes": [{"id": "a", "label": "A"}, {"id": "b", "label": "B"}], "links": [{"source": "a", "target": "b"}, {"source": "a", "target": "gone", "relation": "calls"}]}
    (tmp_path / "g.json").write_text(json.dumps(doc))
    nodes, edges = files.read_graph(spark, str(tmp_path / "g.json"))
    assert nodes.count() == 2
    assert [(r.src, r.tgt, r.relation, r.confidence) for r in edges.collect()] == [("a", "b", "related_to", "EXTRACTED")]
    lines = [json.loads(r.value) for r in sinks.graph_lines(nodes.select("id", "label"), edges).collect()]
    assert [x.get("id") for x in lines] == ["a", "b", None]
    named = nodes.withColumn("node_type", F.lit("thing"))
    assert any("MERGE (a)-[:RELATED_TO]->(b)" in r.value for r in sinks.cypher(named, edges).collect())
    assert any('source="a"' in r.value for r in sinks.graphml(nodes, edges).collect())


def test_registry(spark, tmp_path):
    (tmp_path / "r.csv").write_text("id,name,alias\n1,One,Uno\n2,Two,\n")
    rows = {r.record_id: (r.label, r.aliases) for r in files.read_registry(spark, str(tmp_path / "r.csv"), "id", "name", ["alias"]).collect()}
    assert rows == {"1": ("One", ["Uno"]), "2": ("Two", [])}
    (tmp_path / "d.csv").write_text("id,name\n1,One\n1,Other\n")
    with pytest.raises(ValueError):
        files.read_registry(spark, str(tmp_path / "d.csv"), "id", "name")


def test_commits(spark, tmp_path):
    (tmp_path / "log.txt").write_text("commit\tc2\tc1\t20\n3\t1\tsrc/a.py\n-\t-\timg.png\ncommit\tc1\t\t10\n5\t0\tsrc/a.py\n")
    commits, changes = files.read_commits(spark, str(tmp_path / "log.txt"))
    assert {(r.sha, tuple(r.parents), r.at) for r in commits.collect()} == {("c2", ("c1",), 20), ("c1", (), 10)}
    assert {(r.sha, r.file, r.added) for r in changes.collect()} == {("c2", "src/a.py", 3), ("c2", "img.png", None), ("c1", "src/a.py", 5)}


def test_upsert_keeps_the_newest(spark):
    old = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "id string, v int, batch int")
    new = spark.createDataFrame([("a", 2, 2)], "id string, v int, batch int")
    assert {(r.id, r.v) for r in sinks.upsert(old, new, ["id"]).collect()} == {("a", 2), ("b", 1)}


def run_stream(query_name, stream):
    q = stream.writeStream.format("memory").queryName(query_name).outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None


def test_streamed_fold_equals_the_batch_fold(spark, tmp_path):
    rows = events_as_journal(spark, SF)
    for k in range(3):
        rows.where(F.col("cursor") % 3 == k).coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
    files_in = [str(p) for p in (tmp_path / "in").glob("*/*.parquet")]
    flat = tmp_path / "flat"
    flat.mkdir()
    for k, f in enumerate(files_in):
        (flat / f"{k}.parquet").write_bytes(open(f, "rb").read())
    run_stream("folded", state.fold_stream(state.read_journal(spark, str(flat), files_per_trigger=1)))
    last = spark.table("folded").groupBy("record_id").agg(F.max_by(F.struct("state", "cursor", "terminal", "n_events"), "n_events").alias("s")).select("record_id", "s.*")
    want = journal.fold(rows)
    assert {tuple(r) for r in last.collect()} == {tuple(r) for r in want.collect()}


def test_certification_stream(spark, tmp_path):
    data = [("x", "doubt", 3), ("x", "certificate", 5), ("y", "certificate", 2), ("y", "doubt", 4), ("z", "doubt", 1)]
    spark.createDataFrame(data, "axis string, kind string, seq long").coalesce(1).write.parquet(str(tmp_path / "s"))
    run_stream("certified", state.certify_stream(spark.readStream.schema("axis string, kind string, seq long").parquet(str(tmp_path / "s"))))
    assert {(r.axis, r.current) for r in spark.table("certified").collect()} == {("x", True), ("y", False), ("z", False)}


def test_interval_boundaries(spark):
    from strandwise.operators import temporal

    c = 1000
    rows = [("open", c - 2, None, False), ("touches", c - 1, c, True), ("point", c, c, True), ("start", c, c + 2, True), ("ended", c - 2, c - 1, True), ("later", c + 1, c + 2, True), ("untimed", None, None, False), ("null end", c - 2, None, True), ("backwards", c, c - 1, True)]
    frame = spark.createDataFrame(rows, "id string, t long, t_end long, has_t_end boolean")
    assert {r.id for r in temporal.as_of(frame, c).collect()} == {"open", "touches", "point", "start"}


def test_rank_sums_to_one_and_communities_split_cliques(spark):
    pairs = [(f"{g}{i}", f"{g}{j}") for g in "ab" for i in range(5) for j in range(i)] + [("a0", "b0")]
    edges = spark.createDataFrame([(a, b, "r", "EXTRACTED", 1.0) for a, b in pairs], "src string, tgt string, relation string, confidence string, weight double")
    adj = weighted_adjacency(edges)
    rank = graph.personalized_rank(adj, adj.select("id"), spark.createDataFrame([("a1", 1.0)], "id string, mass double"))
    got = {r.id: r["rank"] for r in rank.collect()}
    assert abs(sum(got.values()) - 1) < 1e-6 and max(got, key=got.get) == "a1"
    found = graph.communities(adj)
    by = {r.id: r.community for r in found.collect()}
    assert len({by[f"a{i}"] for i in range(5)}) == 1 and len({by[f"b{i}"] for i in range(5)}) == 1 and by["a1"] != by["b1"]
    assert graph.modularity(adj, found).first().modularity > 0.4


def test_evidence_merge_is_order_free_and_idempotent(spark):
    from strandwise.operators import build

    row = ("a", "b", "r", "INFERRED", 2.0, "f")
    emissions = spark.createDataFrame([row] * 5000 + [("a", "b", "r", "AMBIGUOUS", 3.0, "e")], "src string, tgt string, relation string, confidence string, weight double, source_file string")
    one = build.merge_evidence(emissions).first()
    assert (one.weight, one.confidence, one.confidence_score, one.n_observations, one.source_file) == (3.0, "INFERRED", 0.5, 2, "e")
    assert build.merge_evidence(emissions.repartition(7)).first() == one


SIGNALS = "axis string, kind string, path string, seq long"


def settled_by_hand(rows, most):
    """What an axis holds after all signals, whatever their order: doubts after the last certificate, the whole axis once too many paths were in doubt at a time."""
    certified = max([q for _, k, _, q in rows if k == "certificate"], default=-1)
    open_ = {}
    for _, k, p, q in rows:
        if k == "change" and q > certified:
            open_[p] = max(open_.get(p, 0), q)
    whole = None in open_ or len(open_) > most
    return (not open_ and certified >= 0, whole, [] if whole else sorted(open_), max(open_.values(), default=0), certified)


def until(done, query, seconds=60):
    """Timers keep such a stream going for ever, so it is stopped when it has done what is asked."""
    import time

    for _ in range(4 * seconds):
        if done() or query.exception():
            return
        time.sleep(0.25)


def test_invalidations_over_a_restart(spark, tmp_path):
    rows = [("dag", "change", f"p{k % 5}", k + 1) for k in range(12)] + [("dag", "certificate", None, 9), ("dag", "change", "late", 3)]
    rows += [("tree", "change", f"q{k}", k + 1) for k in range(90)] + [("refs", "change", None, 4), ("refs", "certificate", None, 6), ("new", "change", "x", 1)]
    parts = [rows[k::3] for k in range(3)]
    source, checkpoint = tmp_path / "signals", str(tmp_path / "checkpoint")
    got = {}

    def keep(batch, _):
        for r in batch.collect():
            got[r.axis] = (r.current, r.whole, r.paths, r.doubt, r.certified)

    for k, part in enumerate(parts):
        spark.createDataFrame(part, SIGNALS).coalesce(1).write.mode("append").parquet(str(source))
        said = [r for p in parts[: k + 1] for r in p]
        want = {axis: settled_by_hand([r for r in said if r[0] == axis], state.MOST_PATHS) for axis in {r[0] for r in said}}
        stream = state.invalidations(spark.readStream.schema(SIGNALS).parquet(str(source)), debounce_ms=3_600_000)
        q = stream.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", checkpoint).trigger(processingTime="200 milliseconds").start()
        until(lambda: got == want, q)
        q.stop()
        assert got == want
    assert got["tree"][1] and got["dag"][2] == ["p0", "p1", "p4"] and got["refs"][0]


def test_a_quiet_axis_is_due(spark, tmp_path):
    spark.createDataFrame([("dag", "change", "a", 1), ("dag", "change", "b", 2)], SIGNALS).coalesce(1).write.parquet(str(tmp_path / "s"))
    seen = []
    stream = state.invalidations(spark.readStream.schema(SIGNALS).parquet(str(tmp_path / "s")), debounce_ms=500)
    q = stream.writeStream.foreachBatch(lambda b, _: seen.extend(b.collect())).outputMode("update").trigger(processingTime="300 milliseconds").start()
    until(lambda: any(r.due for r in seen), q)
    q.stop()
    assert not seen[0].due and not seen[0].current and next(r for r in seen if r.due).paths == ["a", "b"]
