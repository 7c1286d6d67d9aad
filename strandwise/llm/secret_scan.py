"""Secret scans over an incremental ledger of content-addressed blobs.

A version of a file is a row (path, text); its blob is the SHA-256 of the text.
The ledger holds, for each blob and rule version that was scanned, the spans
found; it is a Parquet folder that scans append to. A scan reads each unseen
blob once, however many paths and versions hold it, and the findings are joined
back to all of them. The rule version is a digest of the rules, so a changed
rule makes every blob unseen.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_folder


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


#: The base rules in the order of their kinds.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    "(" + "|".join([_either("password"), _either("passwd"), _either("secret"), _either("token"), _either("api") + "_?" + _either("key")]) + ")"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # the runs of [0-9a-f]+ that are long enough
#: Least characters of an assigned value and of an access key.
MIN_VALUE, MIN_ACCESS = 8, 16
#: Rules beyond the base ones: kind, strings of which any match holds one, pattern.
EXTRA = (
    ("pem", ("-----BEGIN ",), re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]+-----END (?:[A-Z]+ )*PRIVATE KEY-----)?")),
    ("jwt", ("eyJ",), re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
    ("hosted", ("gh", "glpat", "xox", "_live"), re.compile(r"(?:gh[pousr]|glpat|xox[abpr]|sk_live|rk_live)[_-][A-Za-z0-9-]{16,}")),
    ("google", ("AIza",), re.compile(r"AIza[A-Za-z0-9_-]{35}")),
    ("mail", ("SG.",), re.compile(r"SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}")),
    ("package", ("npm_", "pypi-"), re.compile(r"npm_[A-Za-z0-9]{36}|pypi-[A-Za-z0-9_-]{40,}")),
    ("header", ("Bearer ", "Basic "), re.compile(r"\b(?:Bearer|Basic) [A-Za-z0-9+/_.~-]{20,}=*")),
    ("url", ("://",), re.compile(r"[a-z][a-z0-9+.-]{1,15}://[^\s/:@]{1,64}:[^\s/@]{4,64}@[A-Za-z0-9.-]+")),
)
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("order", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("end", T.IntegerType())]))
_WORDS = ("passw", "secret", "token", "api")
#: Digest of all that decides the spans.
RULE_VERSION = hashlib.sha256(repr([ASSIGN.pattern, MIN_VALUE, ACCESS.pattern, MIN_ACCESS, HEX.pattern, [(k, m, p.pattern) for k, m, p in EXTRA]]).encode()).hexdigest()[:16]
LEDGER = T.StructType([T.StructField("blob", T.StringType()), T.StructField("spans", SPANS), T.StructField("rule_version", T.StringType())])


def scan(text: str) -> list[tuple[int, int, str, int]]:
    """(start, order of the kind, kind, end) of each span, sorted; places are code points."""
    found = []
    low = text.lower()  # a screen only: what lower() changes beyond ASCII adds or moves, but never hides, these words
    if any(w in low for w in _WORDS):
        found += [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), 2, "hex", m.end()) for m in HEX.finditer(text)]
    for order, (kind, marks, pattern) in enumerate(EXTRA, 3):
        if any(m in text for m in marks):
            found += [(m.start(), order, kind, m.end()) for m in pattern.finditer(text)]
    return sorted(found)


def _scan_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"blob": batch["blob"], "spans": [scan(t) for t in batch["text"]]})


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, rules: str = RULE_VERSION, path: str = "doc_id", text: str = "text") -> DataFrame:
    """New ledger rows (blob, rule_version, spans) for blobs that the ledger hasn't under these rules.

    One path stands for each blob, so a text that a third of all rows hold is
    scanned once. Only the texts that stand for a blob are read for scanning.
    """
    named = versions.select(F.col(path).alias("path"), blob_of(F.col(text)).alias("blob"))
    todo = named.groupBy("blob").agg(F.min("path").alias("path"))
    if ledger is not None:
        todo = todo.join(ledger.where(F.col("rule_version") == rules).select("blob"), "blob", "left_anti")
    texts = versions.select(F.col(path).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    unseen = texts.join(todo, texts["path"].eqNullSafe(todo["path"])).select("blob", "text").where(blob_of(F.col("text")) == F.col("blob"))
    found = unseen.mapInPandas(_scan_all, T.StructType([T.StructField("blob", T.StringType()), T.StructField("spans", SPANS)]))
    # rows that repeat a path with one text would be scanned alike
    return found.dropDuplicates(["blob"]).select("blob", F.lit(rules).alias("rule_version"), "spans")


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger in a folder; empty where nothing was scanned yet. A blob that two scans added at once counts once."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(folder).dropDuplicates(["blob", "rule_version"])


def update_ledger(versions: DataFrame, folder: str, rules: str = RULE_VERSION, path: str = "doc_id", text: str = "text") -> DataFrame:
    """Scan the blobs that the ledger in the folder hasn't under these rules, add them to it, and return it.

    Rows are appended, and a write that fails adds none: a scan that is run
    again after one scans what is still unseen.
    """
    spark = versions.sparkSession
    scan_unseen(versions, read_ledger(spark, folder), rules, path, text).select("blob", "spans", "rule_version").write.mode("append").partitionBy("rule_version").parquet(folder)
    return read_ledger(spark, folder)


def findings(versions: DataFrame, ledger: DataFrame, rules: str = RULE_VERSION, path: str = "doc_id", text: str = "text") -> DataFrame:
    """(path, blob, spans): the ledger's spans at every path and version; empty if there are none.

    Rows of ids and hashes meet the blobs that have findings; a blob that many
    rows hold is split by the adaptive skew join, whose other side is one row.
    """
    named = versions.select(F.col(path).alias("path"), blob_of(F.col(text)).alias("blob"))
    known = ledger.where((F.col("rule_version") == rules) & (F.size("spans") > 0)).select("blob", "spans")
    return named.join(known, "blob", "left").select("path", "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def digests(found: DataFrame) -> DataFrame:
    """One row for each finding row: counts of the base kinds, digest of the base spans, all spans as text."""
    told = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        F.col("path").alias("doc_id"), *map(count, KINDS), F.sha2(told(base).cast("binary"), 256).alias("base_sha256"), told(F.col("spans")).alias("spans")
    )


def _ledger_folder(docs: DataFrame, folder: str | None) -> str:
    return folder or f"{shared_folder(docs.sparkSession)}/ledger-{uuid.uuid4().hex}"


def secret_scan(docs: DataFrame, ledger: str | None = None, path: str = "doc_id", text: str = "text") -> DataFrame:
    """Digest of the secrets of each row of docs.

    ledger is the folder of the ledger that is read and added to; without one,
    a new one is begun in the shared folder. A null text is empty and has
    none. Rows that repeat a path, and versions of one path, are rows of their
    own; a null path is a path. Other columns, whatever their names, are not
    carried. A lost executor costs no rescan of blobs that the ledger has.
    """
    return digests(findings(docs, update_ledger(docs, _ledger_folder(docs, ledger), path=path, text=text), path=path, text=text))


def redact(docs: DataFrame, ledger: str | None = None, key: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """The rows of docs, all columns, each span of the text replaced by its kind in brackets.

    Overlapping spans are one, of the first one's kind. n_chars, where docs has
    it, becomes the length of the new text. Null texts stay null. Rows meet
    their findings by the content's hash, so all copies are redacted.
    """
    known = update_ledger(docs, _ledger_folder(docs, ledger), path=key, text=text).where((F.col("rule_version") == RULE_VERSION) & (F.size("spans") > 0))
    found = known.select("blob", "spans")

    @F.pandas_udf(T.StringType())
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, found in zip(texts, spans):
            if t is None or found is None or not len(found):
                out.append(t)
                continue
            parts, at = [], 0
            for s in found:
                if s["start"] >= at:
                    parts += [t[at : s["start"]], f"[{s['kind']}]"]
                at = max(at, s["end"])
            out.append("".join([*parts, t[at:]]))
        return pd.Series(out, dtype=object)

    # the row is packed, so that no column of docs can clash
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), blob_of(docs[text]).alias("blob"), docs[text].alias("said"))
    cleaned = packed.join(found, "blob", "left").select("row", cut("said", "spans").alias("said"))
    new = {text: F.col("said")}
    if n_chars and n_chars in docs.columns:
        new[n_chars] = F.length("said").cast(docs.schema[n_chars].dataType)
    return cleaned.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
