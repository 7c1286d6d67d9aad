"""A stream of the commits of a git repository, paced, and exactly once over restarts."""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator
from threading import Thread

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

_WHO = "struct<name:string, email:string, at:long, offset_minutes:int>"
_FILE = "struct<path:string, previous_path:string, status:string, score:int, old_mode:string, new_mode:string, old_oid:string, new_oid:string, added:long, deleted:long>"
SCHEMA = (
    f"oid string, tree string, parents array<string>, author {_WHO}, committer {_WHO}, subject string, message string, "
    f"diffs array<struct<parent_index:int, files:array<{_FILE}>>>"
)
#: Commits of a micro-batch and of a task, unless options say otherwise.
BATCH, PER_TASK = 1024, 64
_COUNTS = re.compile(rb"(\d+|-)\t(\d+|-)\t(.*)", re.S)
_PERSON = re.compile(r"(.*?) ?<([^>]*)> (-?\d+) ([+-])(\d\d)(\d\d)$", re.S)


def _git(path: str, *args: str, lines: Iterator[str] = iter(())) -> Iterator[bytes]:
    """The output of a git command in blocks, its input fed beside it. A command that fails is an error, so that a cut history is never taken for a whole one."""
    with subprocess.Popen(["git", "-C", path, *args], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.PIPE) as p:
        errors: list[bytes] = []

        def feed() -> None:
            try:
                with p.stdin:
                    for line in lines:
                        p.stdin.write(f"{line}\n".encode())
            except BrokenPipeError:
                pass  # the exit code tells

        workers = [Thread(target=feed, daemon=True), Thread(target=lambda: errors.append(p.stderr.read()), daemon=True)]
        for w in workers:
            w.start()
        try:
            while block := p.stdout.read1(1 << 16):
                yield block
        except GeneratorExit:
            p.kill()
            raise
        for w in workers:
            w.join()
        if p.wait():
            raise RuntimeError(f"git {args[0]} failed: {b''.join(errors).decode(errors='replace').strip()}")


def _parts(blocks: Iterator[bytes], end: bytes) -> Iterator[bytes]:
    rest = b""
    for block in blocks:
        *whole, rest = (rest + block).split(end)
        yield from whole
    if rest:
        yield rest


def _text(raw: bytes) -> str:
    return raw.decode(errors="replace")


def _person(line: str) -> tuple:
    m = _PERSON.match(line)
    if not m:
        return (line, None, None, None)
    minutes = 60 * int(m[5]) + int(m[6])
    return (m[1], m[2], int(m[3]), -minutes if m[4] == "-" else minutes)


def _bodies(path: str, oids: list[str]) -> Iterator[tuple[str, bytes]]:
    """(oid, raw commit) of the oids in their order."""
    blocks, held = _git(path, "cat-file", "--batch", lines=iter(oids)), b""
    for oid in oids:
        while b"\n" not in held:
            held += next(blocks)
        head, held = held.split(b"\n", 1)
        if head.split()[1:2] != [b"commit"]:
            raise RuntimeError(f"no commit: {_text(head)}")
        size, got, chunks = int(head.split()[2]) + 1, len(held), [held]
        while got < size:
            chunks.append(next(blocks))
            got += len(chunks[-1])
        held = b"".join(chunks)
        yield oid, held[: size - 1]
        held = held[size:]
    for _ in blocks:  # its end tells how the command ended
        pass


def _header(raw: bytes) -> tuple[str, list[str], tuple, tuple, str, str]:
    head, _, message = raw.partition(b"\n\n")
    fields = [line.split(b" ", 1) for line in head.split(b"\n") if b" " in line]
    of = {_text(k): _text(v) for k, v in reversed(fields)}
    parents = [_text(v) for k, v in fields if k == b"parent"]
    body = _text(message)
    return of["tree"], parents, _person(of["author"]), _person(of["committer"]), body.split("\n", 1)[0], body


def _diffs(path: str, requests: list[tuple[str, str | None]]) -> Iterator[list[tuple]]:
    """The changed files of each request (commit, parent or none), in the requests' order."""
    lines = (f"{oid} {parent}" if parent else oid for oid, parent in requests)
    parts = _parts(_git(path, "diff-tree", "--stdin", "--always", "--root", "-r", "-z", "-M", "--raw", "--numstat", lines=lines), b"\0")
    files: list[list] | None = None
    counted = 0
    for part in parts:
        part = part.lstrip(b"\n")
        if part.startswith(b":"):
            old_mode, new_mode, old, new, status = _text(part[1:]).split(" ")
            name = _text(next(parts))
            previous, name = (name, _text(next(parts))) if status[0] in "RC" else (None, name)
            files.append([name, previous, status[0], int(status[1:]) if status[1:] else None, old_mode, new_mode, old, new, None, None])
        elif m := _COUNTS.match(part):  # in the order of the raw lines
            if not m[3]:
                next(parts), next(parts)
            files[counted][8:] = [None if x == b"-" else int(x) for x in (m[1], m[2])]
            counted += 1
        elif part:
            if files is not None:
                yield [tuple(f) for f in files]
            files, counted = [], 0
    if files is not None:
        yield [tuple(f) for f in files]


def commit_rows(path: str, oids: list[str]) -> Iterator[tuple]:
    """Rows of SCHEMA for the oids: a diff against each parent, or against nothing for a root."""
    heads = [(oid, _header(raw)) for oid, raw in _bodies(path, oids)]
    diffs = _diffs(path, [(oid, p) for oid, h in heads for p in h[1] or [None]])
    for oid, h in heads:
        yield (oid, *h, [(k, next(diffs)) for k in range(len(h[1]) or 1)])
    if next(diffs, None) is not None:
        raise RuntimeError("more diffs than were asked for")


class _Commits(InputPartition):
    def __init__(self, oids: list[str]):
        self.oids = oids


class CommitReader(DataSourceStreamReader):
    """An offset is a range of history and a place in it: {done, goal, at}.

    The range is what the commits of `goal` reach and those of `done` don't,
    oldest first. As commits never change, an offset means the same commits
    whenever it is read again, so a batch that is retried after a crash has the
    rows it had. A new range begins when the last is read whole and the refs have moved.
    """

    def __init__(self, path: str, roots: list[str], batch: int, per_task: int):
        self.path, self.roots, self.batch, self.per_task = path, roots, batch, per_task
        self.now: dict | None = None
        self.walk: tuple[tuple, int, Iterator[bytes]] | None = None
        self.listed: dict[tuple, list[str]] = {}

    def initialOffset(self) -> dict:
        return {"done": [], "goal": [], "at": 0}

    def _lines(self, *args: str, lines: Iterator[str] = iter(())) -> list[str]:
        return [_text(x) for x in _parts(_git(self.path, *args, lines=lines), b"\n")]

    def _tips(self) -> list[str]:
        named = self._lines("rev-parse", *[f"{r}^{{commit}}" for r in self.roots]) if self.roots else self._lines("rev-list", "--no-walk", "--all")
        return sorted(set(named))

    def _slice(self, o: dict, low: int, size: int) -> list[str]:
        """The oids of a range from `low` on; the walk goes on where it was, so a range is walked once unless a batch is read again."""
        key = (*o["done"], "..", *o["goal"])
        if not self.walk or self.walk[:2] != (key, low):
            wanted = [*o["goal"], *[f"^{d}" for d in o["done"]]]
            oids = _parts(_git(self.path, "rev-list", "--topo-order", "--reverse", "--stdin", lines=iter(wanted)), b"\n") if o["goal"] else iter(())
            for _ in range(low):
                next(oids)
            self.walk = (key, low, oids)
        found = [_text(x) for _, x in zip(range(size), self.walk[2])]
        self.walk = (key, low + len(found), self.walk[2])
        return found

    def latestOffset(self) -> dict:
        now = self.now or self.initialOffset()
        found, end = self._slice(now, now["at"], self.batch), now
        if not found and (tips := self._tips()) and tips != now["goal"]:
            past = sorted({*now["done"], *now["goal"]})
            done = sorted(self._lines("merge-base", "--independent", *past)) if past else []
            end = {"done": done, "goal": tips, "at": 0}
            found = self._slice(end, 0, self.batch)
        self.now = end | {"at": end["at"] + len(found)}
        self.listed = {_key(self.now): found}
        return self.now

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.now = self.now or end  # after a restart the engine plans its last batch first
        low = start["at"] if (start["done"], start["goal"]) == (end["done"], end["goal"]) else 0
        oids = self.listed.get(_key(end))
        if oids is None or len(oids) != end["at"] - low:
            oids = self._slice(end, low, end["at"] - low)
            if len(oids) != end["at"] - low:
                raise RuntimeError("the history is shorter than it was")
        return [_Commits(oids[k : k + self.per_task]) for k in range(0, len(oids), self.per_task)]

    def read(self, partition: _Commits) -> Iterator[tuple]:
        return commit_rows(self.path, partition.oids)

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        if self.walk:
            self.walk[2].close()

    def __getstate__(self) -> dict:
        return self.__dict__ | {"walk": None, "listed": {}}


def _key(o: dict) -> tuple:
    return (*o["done"], "..", *o["goal"], o["at"])


class CommitHistory(DataSource):
    """Options: path (a repository that all machines see), roots (revisions by comma; all refs without), batch and perTask (commits)."""

    @classmethod
    def name(cls) -> str:
        return "commit_history"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> CommitReader:
        o = self.options
        batch, per_task = int(o.get("batch", BATCH)), int(o.get("perTask", PER_TASK))
        if not o.get("path") or batch < 1 or per_task < 1:
            raise ValueError("path is needed, and batch and perTask of at least 1")
        return CommitReader(o["path"], [r for r in o.get("roots", "").split(",") if r], batch, per_task)


def stream_commits(spark: SparkSession, path: str, roots: list[str] | None = None, batch: int = BATCH, per_task: int = PER_TASK) -> DataFrame:
    """Each commit that the roots reach, once, before the commits made on it; `batch` at a time, read by tasks of `per_task`."""
    spark.dataSource.register(CommitHistory)
    return spark.readStream.format("commit_history").options(path=path, roots=",".join(roots or []), batch=batch, perTask=per_task).load()


def history_edges(commits: DataFrame) -> DataFrame:
    """(source, target, relation) of commits, streamed or stored: PARENT_OF from a parent, MODIFIES to each path changed against any parent."""
    parents = commits.select(F.explode("parents").alias("source"), F.col("oid").alias("target"), F.lit("PARENT_OF").alias("relation"))
    paths = F.array_distinct(F.flatten(F.transform("diffs", lambda d: F.transform(d["files"], lambda f: f["path"]))))
    return parents.unionByName(commits.select(F.col("oid").alias("source"), F.explode(paths).alias("target"), F.lit("MODIFIES").alias("relation")))
