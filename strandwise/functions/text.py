"""Text functions: tokens, folding, ids, paths, diffs and small parsers, built in where Spark can."""

from __future__ import annotations

import json
import unicodedata
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

#: Words of a question that name nothing. Fixed values.
STOPWORDS = (
    "how what why when where which who whom whose does did is are was were be been being can could should would will shall may might must "
    "has have had the and but not for from with without into onto off that this these those there here its their them they about any all some "
    "work works working"
).split()


@F.pandas_udf(T.StringType())
def fold_accents(values: pd.Series) -> pd.Series:
    """NFKD without its combining marks, in lower case; apply to distinct values."""
    fold = lambda v: "".join(c for c in unicodedata.normalize("NFKD", v) if not unicodedata.combining(c)).lower()
    return values.map(lambda v: None if v is None else fold(v))


@F.pandas_udf(T.StringType())
def nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def query_terms(text: Column) -> Column:
    """Lower-case words of letters, digits and underscores, without ASCII words of one or two letters."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.filter(words, lambda w: ~w.rlike("^[a-z]{1,2}$"))


def term_counts(terms: Column) -> Column:
    """(term, tf) of each distinct term of an array, within the row: sorted terms are cut where they change, in linear space."""
    bound = lambda value, f: F.transform(F.array(value), f)[0]  # noqa: E731  a value that several places read is made once
    starts = lambda s: F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (x != F.get(s, i - 1)), i)), lambda i: i.isNotNull())
    runs = lambda s, at: F.transform(at, lambda i, k: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(s)) - i).alias("tf")))
    return bound(F.sort_array(terms), lambda s: bound(starts(s), lambda at: runs(s, at)))


def drop_stopwords(terms: Column) -> Column:
    """Terms without stopwords, unless all are."""
    kept = F.filter(terms, lambda w: ~w.isin(*STOPWORDS))
    return F.when(F.size(kept) > 0, kept).otherwise(terms)


def matches_all(text: Column, terms: Column) -> Column:
    """Every term is somewhere in the text; both sides folded alike."""
    return F.forall(terms, lambda t: F.contains(text, t))


def search_score(label: Column, source: Column, terms: Column) -> Column:
    """100 for the label as it is, 20 at its edge; 40 for the source, 10 at its end; 1 and 0.5 for each term inside."""
    q = F.array_join(terms, " ")
    score = F.when(label == q, 100).when(F.startswith(label, F.concat(q, F.lit(" "))) | F.endswith(label, F.concat(F.lit(" "), q)), 20).otherwise(0)
    where = F.when(source == q, 40).when(F.endswith(source, F.concat(F.lit("/"), q)), 10).otherwise(0)
    inside = F.size(F.filter(terms, lambda t: F.contains(label, t))) + 0.5 * F.size(F.filter(terms, lambda t: F.contains(source, t)))
    return F.when(q != "", score + where).otherwise(0) + inside


def node_id_part(value: Column) -> Column:
    """Lower case, runs of what is no word character to one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")


def parse_instant(value: Column) -> Column:
    """Epoch milliseconds of an integer in JavaScript's range of dates, or of an ISO time with an explicit zone; null for all else."""
    raw = F.trim(value)
    number = raw.try_cast("long")
    whole = raw.rlike(r"^-?(0|[1-9]\d*)$") & (F.abs(number) <= 8_640_000_000_000_000)
    zoned = raw.rlike(r"(?i)^\d{4}-\d{2}-\d{2}T.+(Z|[+-]\d{2}:\d{2})$")
    return F.when(whole, number).when(zoned, F.unix_millis(raw.try_cast("timestamp")))


def commit_id(repo: Column, sha: Column) -> Column:
    return F.concat(F.lit("commit:"), repo, F.lit("@"), sha)


def branch_id(repo: Column, name: Column) -> Column:
    return F.concat(F.lit("branch:"), repo, F.lit("#"), name)


def request_id(repo: Column, number: Column) -> Column:
    return F.concat(F.lit("pr:"), repo, F.lit("#"), number.cast("string"))


def _number(value: int | float) -> str:
    """A JSON number as the double it stands for: the shortest digits, plain from 1e-6 to 1e21, else with an exponent."""
    try:
        value = float(value)
    except OverflowError:
        return "null"
    if value == 0 or value in (float("inf"), float("-inf")):
        return "0" if value == 0 else "null"
    if 1e-6 <= abs(value) < 1e21:
        plain = format(Decimal(repr(value)), "f")
        return plain.rstrip("0").rstrip(".") if "." in plain else plain
    digits, exponent = repr(value).split("e")
    return f"{digits}e{int(exponent):+d}"


def _canonical(value) -> str:
    """JSON with the keys of every object in the order of their UTF-16 units."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{_canonical(k)}:{_canonical(value[k])}" for k in sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_canonical, value)) + "]"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return _number(value)
    return json.dumps(value, ensure_ascii=False)


def _no_constant(name: str):
    raise ValueError(f"{name} is no JSON")


@F.pandas_udf(T.StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """Each JSON text in its canonical form; null for what is no JSON (NaN isn't), or is nested too deeply to be read."""

    def one(t: str | None) -> str | None:
        try:
            return None if t is None else _canonical(json.loads(t, parse_constant=_no_constant))
        except (ValueError, RecursionError):
            return None

    return texts.map(one)


def clean_label(value: Column, size: int = 256) -> Column:
    """Without control characters, and of bounded length: a display label."""
    return F.substring(F.regexp_replace(value, r"[\x00-\x1f\x7f]", ""), 1, size)


def escape_html(value: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        value = F.replace(value, F.lit(a), F.lit(b))
    return value


def token_estimate(value: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(value) / 4)).cast("long")


#: Relations that are one under another name. Fixed values.
RELATIONS = {
    "VALIDATED_BY": "TESTED_BY", "VALIDATES": "TESTED_BY", "TESTS": "TESTED_BY", "IMPORTS": "IMPORTS_FROM", "EXTENDS": "INHERITS",
    "INHERITS_FROM": "INHERITS", "SUBCLASS_OF": "INHERITS", "IMPLEMENTS_INTERFACE": "IMPLEMENTS", "REALIZES": "IMPLEMENTS",
}


def canonical_relation(value: Column) -> Column:
    """Camel case and spaces to upper snake case, synonyms to one name; nothing is RELATED_TO."""
    told = F.when(F.trim(value) != "", F.trim(value)).otherwise("RELATED_TO")
    name = F.upper(F.regexp_replace(F.regexp_replace(told, "([a-z0-9])([A-Z])", "$1_$2"), r"[\s-]+", "_"))
    same = F.create_map(*[F.lit(x) for pair in RELATIONS.items() for x in pair])
    return F.coalesce(F.try_element_at(same, name), name)


def line_range(value: Column) -> Column:
    """`L10-20` or `L10` as (start, stop); null if it is neither."""
    start = F.regexp_extract(value, r"^L?(\d+)", 1).try_cast("int")
    stop = F.regexp_extract(value, r"^L?\d+-L?(\d+)", 1).try_cast("int")
    return F.when(start.isNotNull(), F.struct(start.alias("start"), F.coalesce(stop, start).alias("stop")))


def quote_window(text: Column, at: Column, width: int = 120) -> Column:
    """The text around a place, trimmed."""
    low = F.greatest(F.lit(1), at + 1 - width // 2)
    return F.trim(F.substring(text, low, F.lit(width)))


def parse_diff(lines: DataFrame) -> DataFrame:
    """(doc, file, start, stop) of the hunks of unified diffs given as lines (doc, no, line)."""
    by = W.partitionBy("doc").orderBy("no").rowsBetween(W.unboundedPreceding, 0)
    named = F.regexp_extract("line", r"^\+\+\+ (?:b/)?(.+)$", 1)
    marked = lines.withColumn("file", F.last(F.when(F.col("line").startswith("+++ "), named), ignorenulls=True).over(by))
    hunk = marked.where(F.col("line").startswith("@@"))
    start = F.regexp_extract("line", r"\+(\d+)", 1).cast("int")
    size = F.coalesce(F.regexp_extract("line", r"\+\d+,(\d+)", 1).try_cast("int"), F.lit(1))
    return hunk.select("doc", "file", start.alias("start"), (start + F.greatest(size, F.lit(1)) - 1).alias("stop"))


def parse_source(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, no, section, line): non-empty lines, each under the last heading above it."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("no", "line"))
    by = W.partitionBy(key).orderBy("no").rowsBetween(W.unboundedPreceding, 0)
    heading = F.when(F.col("line").rlike("^#+ "), F.regexp_replace("line", "^#+ ", ""))
    return lines.withColumn("section", F.last(heading, ignorenulls=True).over(by)).where("trim(line) != ''").select(key, "no", "section", "line")
