"""The commit stream against git's own answers: rows, order, pace, restarts and moved refs."""

import os
import subprocess

import pytest
from pyspark.sql import functions as F

from strandwise.sources.commit_stream import CommitReader, commit_rows, history_edges, stream_commits

WHEN = {"GIT_AUTHOR_DATE": "1700000000 +0530", "GIT_COMMITTER_DATE": "1700000100 -0230"}
WHO = {f"GIT_{r}_{k}": v for r in ("AUTHOR", "COMMITTER") for k, v in (("NAME", "Zoë Q"), ("EMAIL", "z@example.org"))}


def git(repo, *args):
    return subprocess.run(["git", "-C", str(repo), *args], check=True, capture_output=True, text=True, env=os.environ | WHEN | WHO).stdout.strip()


def commit(repo, name, text, message="change"):
    (repo / name).parent.mkdir(exist_ok=True)
    (repo / name).write_bytes(text)
    git(repo, "add", "-A")
    git(repo, "commit", "-q", "-m", message)
    return git(repo, "rev-parse", "HEAD")


@pytest.fixture
def repo(tmp_path):
    r = tmp_path / "r"
    r.mkdir()
    git(r, "init", "-q", "-b", "main")
    commit(r, "a.txt", b"1\n2\n3\n4\n", "first\n\nbody of it")
    for k in range(5):
        commit(r, f"d/{k} ü\t.txt", b"x\n" * (k + 1))
    git(r, "checkout", "-q", "-b", "side", "HEAD~2")
    commit(r, "side.bin", b"\0\1\2")
    git(r, "mv", "a.txt", "b.txt")
    git(r, "commit", "-q", "-m", "renamed")
    git(r, "checkout", "-q", "main")
    commit(r, "a.txt.more", b"")
    git(r, "merge", "-q", "--no-ff", "-m", "joined", "side")
    git(r, "commit", "-q", "--allow-empty", "-m", "nothing changes")
    return r


def drain(spark, repo, out, mark, **options):
    """Run to the end of what is there now; rows of each micro-batch."""
    stream = stream_commits(spark, str(repo), **options)
    q = stream.writeStream.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}")).option("checkpointLocation", str(mark)).start()
    try:
        q.processAllAvailable()
        return [p["numInputRows"] for p in q.recentProgress if p["numInputRows"]]
    finally:
        q.stop()


def oids(spark, out):
    return [r.oid for r in spark.read.parquet(str(out)).select("oid").collect()]


def test_rows_equal_gits_own_answers(repo):
    every = git(repo, "rev-list", "--all").split()
    rows = {r[0]: r for r in commit_rows(str(repo), every)}
    assert sorted(rows) == sorted(every)
    for oid in every:
        _, tree, parents, author, committer, subject, message, diffs = rows[oid]
        assert [tree, " ".join(parents), subject] == git(repo, "show", "-s", "--format=%T%n%P%n%s", oid).split("\n")
        assert author == ("Zoë Q", "z@example.org", 1700000000, 330) and committer[2:] == (1700000100, -150)
        assert message.strip() == git(repo, "show", "-s", "--format=%B", oid)
        assert [k for k, _ in diffs] == list(range(max(1, len(parents))))
        for k, files in diffs:
            against = parents[k] if parents else git(repo, "hash-object", "-t", "tree", "/dev/null")
            wanted = git(repo, "diff", "--no-renames", "--name-only", "-z", against, oid).split("\0")
            got = {f[0] for f in files} | {f[1] for f in files if f[1]}
            assert got == {w for w in wanted if w}
    renamed = next(r for r in rows.values() if r[5] == "renamed")
    assert renamed[7] == [(0, [("b.txt", "a.txt", "R", 100, "100644", "100644", *[git(repo, "rev-parse", "HEAD:b.txt")] * 2, 0, 0)])]
    binary = next(f for r in rows.values() for _, fs in r[7] for f in fs if f[0] == "side.bin")
    assert binary[8:] == (None, None)
    first = next(r for r in rows.values() if r[5] == "first")
    assert first[6] == "first\n\nbody of it\n" and first[7][0][1][0][8:] == (4, 0)


def test_paced_and_exactly_once_over_restarts_and_moved_refs(spark, repo, tmp_path):
    out, mark = tmp_path / "out", tmp_path / "mark"
    sizes = drain(spark, repo, out, mark, batch=4, per_task=2)
    every = git(repo, "rev-list", "--all").split()
    assert max(sizes) <= 4 and sum(sizes) == len(every)
    assert sorted(oids(spark, out)) == sorted(every)
    assert drain(spark, repo, out, mark, batch=4) == []  # a restart repeats nothing
    commit(repo, "later.txt", b"l\n")
    git(repo, "checkout", "-q", "-b", "fork", "HEAD~3")
    commit(repo, "fork.txt", b"f\n")
    assert sum(drain(spark, repo, out, mark, batch=1)) == 2
    git(repo, "branch", "-D", "side")  # a ref that goes brings nothing
    assert drain(spark, repo, out, mark) == []
    assert sorted(oids(spark, out)) == sorted(git(repo, "rev-list", "--all").split())
    batches = spark.read.parquet(str(out)).select("oid", "batch", F.explode("parents").alias("parent"))
    early = spark.read.parquet(str(out)).select(F.col("oid").alias("parent"), F.col("batch").alias("parent_batch"))
    assert batches.join(early, "parent", "left").where("parent_batch is null or parent_batch > batch").isEmpty()


def test_a_batch_that_was_not_committed_is_read_again_as_it_was(spark, repo, tmp_path):
    out, mark = tmp_path / "out", tmp_path / "mark"
    drain(spark, repo, out, mark, batch=4)
    last = max(int(p.name) for p in (mark / "commits").iterdir() if p.name.isdigit())
    before = sorted(r.oid for r in spark.read.parquet(f"{out}/batch={last}").collect())
    for name in (str(last), f".{last}.crc"):
        (mark / "commits" / name).unlink()
    new = commit(repo, "later.txt", b"l\n")
    sizes = drain(spark, repo, out, mark, batch=100)
    assert sorted(r.oid for r in spark.read.parquet(f"{out}/batch={last}").collect()) == before
    assert sizes == [len(before), 1] and oids(spark, f"{out}/batch={last + 1}") == [new]


def test_offsets_mean_the_same_to_another_reader(repo):
    one = CommitReader(str(repo), ["main"], 3, 2)
    start, seen = one.initialOffset(), []
    while (end := one.latestOffset()) != start:
        mine = [o for p in one.partitions(start, end) for o in p.oids]
        theirs = CommitReader(str(repo), [], 50, 7).partitions(start, end)
        assert [o for p in theirs for o in p.oids] == mine
        seen, start = seen + mine, end
    assert seen == git(repo, "rev-list", "--topo-order", "--reverse", "main").split()
    one.stop()


def test_errors_and_an_empty_repository(tmp_path, repo):
    empty = tmp_path / "empty"
    empty.mkdir()
    git(empty, "init", "-q")
    reader = CommitReader(str(empty), [], 4, 2)
    assert reader.latestOffset() == reader.initialOffset()
    with pytest.raises(RuntimeError, match="git"):
        CommitReader(str(repo), ["no-such-ref"], 4, 2).latestOffset()
    with pytest.raises(RuntimeError, match="no commit"):
        list(commit_rows(str(repo), ["0" * 40]))


def test_edges(spark, repo, tmp_path):
    drain(spark, repo, tmp_path / "out", tmp_path / "mark")
    edges = history_edges(spark.read.parquet(str(tmp_path / "out")))
    parents = {(e.source, e.target) for e in edges.where("relation = 'PARENT_OF'").collect()}
    assert parents == {(p, line[0]) for line in map(str.split, git(repo, "rev-list", "--parents", "--all").split("\n")) for p in line[1:]}
    head = git(repo, "rev-parse", "main^")
    assert {e.target for e in edges.where((F.col("source") == head) & (F.col("relation") == "MODIFIES")).collect()} >= {"b.txt", "side.bin", "a.txt.more"}
