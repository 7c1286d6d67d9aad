"""File sources: corpus scans, graph documents, registries, pull-request checks and event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.operators.analyze import CODE

#: Kinds of files by extension. Fixed values.
KINDS = {
    "code": [*CODE, "cjs", "sh"],
    "document": "md mdx txt rst html".split(),
    "paper": ["pdf"],
    "image": "png jpg jpeg gif webp svg".split(),
    "video": "mp4 mov webm mkv avi m4v mp3 wav m4a ogg".split(),
}
SENSITIVE = r"(^|/)(\.env[^/]*|[^/]*\.pem|[^/]*\.key|id_rsa[^/]*|[^/]*credential[^/]*|[^/]*secret[^/]*)$"
#: Words and files at which a scan warns.
FEW_WORDS, MANY_WORDS, MANY_FILES = 50_000, 500_000, 500


def extension(path: Column) -> Column:
    name = F.substring_index(path, "/", -1)
    return F.lower(F.when(F.contains(name, F.lit(".")), F.substring_index(name, ".", -1)).otherwise(""))


def classify(path: Column, head: Column | None = None) -> Column:
    """The kind of a file by its extension, or by its first line where it has none; null if it is of no kind."""
    ext, out = extension(path), F.lit(None).cast("string")
    if head is not None:
        out = F.when((ext == "") & head.rlike(r"^#!.*\b(python\d?|node|bash|sh|zsh|ruby|perl|deno)\b"), "code")
    for kind, extensions in KINDS.items():
        out = F.when(ext.isin(*extensions), kind).otherwise(out)
    return out


def scan(spark: SparkSession, root: str, ignore: list[str] = ()) -> DataFrame:
    """(path, length, modified, kind, words) of the files below root that are of a kind and not sensitive.

    Binary kinds count no words. Ignore patterns are regular expressions.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    for pattern in (SENSITIVE, *ignore):
        raw = raw.where(~F.col("path").rlike(pattern))
    text = F.col("content").cast("string")
    head = F.substring_index(F.substring(text, 1, 200), "\n", 1)
    kind = classify(F.col("path"), head)
    words = F.when(kind.isin("code", "document"), F.regexp_count(text, F.lit(r"\S+"))).otherwise(0)
    return raw.select("path", "length", F.col("modificationTime").alias("modified"), kind.alias("kind"), words.cast("long").alias("words")).where("kind is not null")


def scan_report(files: DataFrame) -> DataFrame:
    """(files, words, warning): one row."""
    s = files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("words"), F.lit(0)).alias("words"))
    return s.withColumn("warning", F.when(F.col("words") < FEW_WORDS, "few words").when((F.col("words") > MANY_WORDS) | (F.col("files") > MANY_FILES), "large corpus"))


NODE = "id string, label string, file_type string, source_file string, node_type string, community int"
EDGE = "source string, target string, relation string, confidence string, weight double, source_file string"


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of graph documents in JSON, whose edges are under `links` or `edges`; dangling ones are dropped."""
    from strandwise.operators.build import keep_live_endpoints

    doc = spark.read.schema(f"nodes array<struct<{_fields(NODE)}>>, links array<struct<{_fields(EDGE)}>>, edges array<struct<{_fields(EDGE)}>>").json(path, multiLine=True)
    nodes = doc.select(F.inline("nodes"))
    links = doc.select(F.inline(F.coalesce("links", "edges")))
    edges = links.select(F.col("source").alias("src"), F.col("target").alias("tgt"), F.coalesce("relation", F.lit("related_to")).alias("relation"), F.coalesce("confidence", F.lit("EXTRACTED")).alias("confidence"), "weight", F.coalesce("source_file", F.lit("")).alias("source_file"))
    return nodes, keep_live_endpoints(edges, nodes)


def _fields(ddl: str) -> str:
    return ", ".join(f"{n}: {k}" for n, k in (x.split(" ") for x in ddl.split(", ")))


def read_registry(spark: SparkSession, path: str, id_column: str, label_column: str, alias_columns: list[str] = (), partition_column: str | None = None) -> DataFrame:
    """(record_id, label, aliases, partition) of a CSV or JSON registry; an id that repeats is an error."""
    raw = spark.read.json(path) if path.endswith((".json", ".jsonl")) else spark.read.csv(path, header=True)
    aliases = F.array(*[F.col(c).cast("string") for c in alias_columns]).cast("array<string>")
    out = raw.select(
        F.col(id_column).cast("string").alias("record_id"), F.col(label_column).cast("string").alias("label"), F.array_compact(aliases).alias("aliases"),
        (F.col(partition_column).cast("string") if partition_column else F.lit(None).cast("string")).alias("partition"),
    )
    twice = out.groupBy("record_id").count().where("count > 1").first()
    if twice:
        raise ValueError(f"registry id repeats: {twice.record_id}")
    return out


def read_checks(spark: SparkSession, path: str) -> DataFrame:
    """(pr, name, conclusion) of pull requests in JSON lines with an array of checks."""
    raw = spark.read.schema("number long, checks array<struct<name: string, conclusion: string>>").json(path)
    return raw.select(F.col("number").alias("pr"), F.inline("checks"))


def read_commits(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(commits (sha, parents, at), changes (sha, file, added, deleted)) from exported `git log --numstat` text.

    Each commit starts with a line `commit<TAB>sha<TAB>parents<TAB>epoch seconds`; `file<TAB>…` lines follow.
    Files are read whole, one record a commit.
    """
    raw = spark.read.option("lineSep", "commit\t").text(path).where("trim(value) != ''")
    lines = F.split("value", "\n")
    head = F.split(F.get(lines, F.lit(0)), "\t")
    commits = raw.select(F.get(head, F.lit(0)).alias("sha"), F.filter(F.split(F.get(head, F.lit(1)), " "), lambda p: p != "").alias("parents"), F.get(head, F.lit(2)).cast("long").alias("at"), lines.alias("lines"))
    changed = commits.select("sha", F.explode(F.slice("lines", 2, F.size("lines"))).alias("line")).where("line like '%\t%\t%'")
    part = F.split("line", "\t")
    number = lambda k: F.get(part, F.lit(k)).try_cast("long")
    return commits.drop("lines"), changed.select("sha", F.get(part, F.lit(2)).alias("file"), number(0).alias("added"), number(1).alias("deleted"))
