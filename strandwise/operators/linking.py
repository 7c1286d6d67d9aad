"""Entity linking end to end: spans of several detectors, one for each place, resolved against partitioned registries."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .grounding import fold, folded, is_markdown, occurrences, paragraphs, source_units
from .iterate import settle
from .resolve import dedup_occurrences, partition_gate
from .seek import Places, few

LEXICON, PATTERN, PROPOSAL = 0, 1, 2
DETECTORS = ("lexicon", "pattern", "proposal")


class LinkType(NamedTuple):
    """How nodes of a type are linked: its registry, whether that has partitions, the key of the front matter or else the place in the path that names one, and a pattern of spans."""

    node_type: str
    registry: str
    partitioned: bool = False
    front_key: str | None = None
    path_segment: int | None = None
    pattern: str | None = None


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def front_matter(texts: pd.Series) -> pd.Series:
    """The keys and values of a text's leading block between rules; none without one."""

    def one(text: str | None) -> dict[str, str]:
        lines = (text or "").split("\n")
        out: dict[str, str] = {}
        if lines[0].strip() != "---":
            return out
        for line in lines[1:]:
            bare = line.strip()
            found = re.match(r"([a-zA-Z0-9_-]+):\s*(.*)$", bare)
            if bare == "---" or (bare and not found):
                break
            if found:
                value = found.group(2).strip()
                quoted = re.fullmatch("\"(.*)\"|'(.*)'", value, re.S)
                out[found.group(1)] = (quoted.group(1) or quoted.group(2) or "") if quoted else value
        return out

    return texts.map(one)


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("raw_span", T.StringType()), T.StructField("normalized", T.StringType())]))
FOUND = "scope string, source string, page int, start int, end int, raw_span string, normalized string, detector int"
#: Distinct known forms that may be broadcast.
BROADCAST_FORMS = 1_000_000


def _sweep(text: str, form: str, at: np.ndarray, hits: list[tuple[int, int]]) -> list[tuple[int, int, str, str]]:
    """Of hits (place, length) in a unit's folded text, by place, the longest first: the leftmost and of those the longest, none over another, as spans (start, end, raw_span, normalized) of the unit; one that ends within a word is consumed and left out."""
    word = lambda c: c.isalnum() or c == "_"
    spans, free = [], 0
    for a, n in hits:
        if a >= free:
            free = a + n
            if not (a and word(form[a - 1]) or free < len(form) and word(form[free])):
                first, end = int(at[a]), int(at[free - 1]) + 1
                spans.append((first, end, text[first:end], folded(text[first:end])))
    return spans


@F.pandas_udf(SPANS)
def _swept(texts: pd.Series, starts: pd.Series, sizes: pd.Series) -> pd.Series:
    return pd.Series([_sweep(text, *fold(text), sorted(zip(start, size), key=lambda x: (x[0], -x[1]))) for text, start, size in zip(texts, starts, sizes)])


def _matched(pattern: str):
    @F.pandas_udf(SPANS)
    def spans(texts: pd.Series) -> pd.Series:
        run = re.compile(pattern).finditer
        return texts.map(lambda t: [(*m.span(), m.group(), folded(m.group())) for m in run(t) if m.end() > m.start()])

    return spans


@F.pandas_udf(T.StringType())
def _form(texts: pd.Series) -> pd.Series:
    return texts.map(folded)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _words(forms: pd.Series) -> pd.Series:
    return forms.map(lambda t: re.findall(r"\w+", t))


def _partition(kind: LinkType, source: Column, front: Column) -> Column:
    none = F.lit(None).cast("string")
    told = F.trim(F.try_element_at(front, F.lit(kind.front_key))) if kind.front_key else none
    parts = F.filter(F.split(source, "/"), lambda p: p != "")
    place = F.trim(F.get(parts, F.lit(kind.path_segment))) if kind.path_segment is not None else none
    return F.coalesce(F.when(told != "", told), F.when(place != "", place))


def _sought(scoped: DataFrame, kinds: Sequence[LinkType], lexicon: DataFrame) -> DataFrame:
    """(scope, source, page, start, end, raw_span, normalized, detector) of what the lexicon (scope, form) and patterns find in sources (source, text, scopes), one for each place.

    Tasks hold the lexicon, and each text is read once; nothing of it is written or shuffled.
    """
    within = defaultdict(set)
    for r in lexicon.collect():  # at most HELD_TEXTS
        within[r.form].add(r.scope)
    forms = {form: frozenset(of) for form, of in sorted(within.items()) if re.search(r"\w", form)}
    shared = lexicon.sparkSession.sparkContext.broadcast((Places(forms), list(forms.values()), dict(within)))
    patterns = [(k.node_type, k.pattern) for k in kinds if k.pattern]

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, of, within = shared.value
        runs = [(kind, re.compile(pattern).finditer) for kind, pattern in patterns]
        for batch in batches:
            rows = []
            for source, said, scopes, markdown in zip(batch["source"], batch["text"], batch["scopes"], batch["markdown"]):
                for page, _, a, b in paragraphs(said, markdown):
                    text = said[a:b]
                    form, at = fold(text)
                    hits = [(k, len(index.texts[no]), of[no]) for k, no in index.of(form)]
                    for scope in scopes:
                        spans = _sweep(text, form, at, [(k, n) for k, n, known in hits if scope in known])
                        rows += [(scope, source, page, a + x, a + y, raw, normal, LEXICON) for x, y, raw, normal in spans]
                        taken = {span[:2] for span in spans}
                        for run in {run for kind, run in runs if scope.split("\x00", 1)[0] == kind}:
                            for m in run(text):
                                # what a pattern finds counts only if the registry knows it
                                if m.end() > m.start() and m.span() not in taken and scope in within.get(normal := folded(m.group()), ()):
                                    taken.add(m.span())
                                    rows.append((scope, source, page, a + m.start(), a + m.end(), m.group(), normal, PATTERN))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FOUND.split(", ")])

    return scoped.select("source", "text", "scopes", is_markdown(F.col("source")).alias("markdown")).where(F.size("scopes") > 0).mapInPandas(find, FOUND)


def _joined(scoped: DataFrame, kinds: Sequence[LinkType], lexicon: DataFrame) -> DataFrame:
    """What `_sought` gives, for a lexicon beyond what tasks may hold: by joins of words."""
    scopes = settle(scoped.select("source", F.explode("scopes").alias("scope")).distinct())
    units = settle(source_units(scoped.select("source", "text")))
    terms = lexicon.select(F.col("scope").alias("id"), F.xxhash64("form").alias("order"), F.col("form").alias("term"), _words("form").alias("words"))
    terms = settle(terms.withColumn("at", F.coalesce(F.instr(F.col("term"), F.get("words", F.lit(0))) - 1, F.lit(0))))
    wanted = scopes.select(F.col("scope").alias("id"), "source")
    hits = occurrences(terms, units, wanted).join(terms.select("id", "order", F.length("term").alias("size")), ["id", "order"])
    gathered = hits.groupBy("id", "source", "unit").agg(F.collect_list(F.struct("at", "size")).alias("h"))
    whole = units.select("source", "unit", "page", F.col("start").alias("offset"), "text")
    swept = gathered.join(whole, ["source", "unit"]).select(F.col("id").alias("scope"), "source", "page", "offset", _swept("text", "h.at", "h.size").alias("spans"))
    # no text goes beside its spans
    each_span = lambda df, detector: df.select("scope", "source", "page", "offset", F.inline("spans"), F.lit(detector).alias("detector"))
    found = each_span(swept, LEXICON)
    # what a pattern finds counts only if the registry knows it
    member = lexicon.withColumnRenamed("form", "normalized")
    member = F.broadcast(member) if member.count() <= BROADCAST_FORMS else member
    for k in kinds:
        if k.pattern:
            mine = scopes.where(F.substring_index("scope", "\x00", 1) == k.node_type).select("scope", "source")
            spans = whole.join(mine, "source").select("scope", "source", "page", "offset", _matched(k.pattern)("text").alias("spans"))
            found = found.unionByName(each_span(spans, PATTERN).join(member, ["scope", "normalized"], "left_semi").select(*found.columns))
    place = lambda side: (F.col("offset") + F.col(side)).alias(side)
    return found.select("scope", "source", "page", place("start"), place("end"), "raw_span", "normalized", "detector")


def link_entities(sources: DataFrame, kinds: Sequence[LinkType], registry: DataFrame, proposals: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(occurrences, issues) of the kinds in sources (source, text).

    registry: (registry, record_id, surface, is_label, partition). proposals,
    if given, are spans found elsewhere: (source, node_type, start, end).

    A source of a kind whose registry has partitions, but that names none, is
    left out with an issue. In the others the lexicon, all surfaces of the
    registry and partition, is sought in one pass over the texts, leftmost and
    longest first, at whole words (beyond what tasks may hold, by joins of
    words); patterns give spans that the registry knows;
    proposals have to be a place of the source. A place is taken once, by the
    first of these detectors. Its folded text is resolved within the partition:
    a label's one record, else an alias's; several are ambiguous, an issue, and
    none is unlinked.

    occurrences: (id, node_type, source, page, start, end, raw_span,
    normalized, detector, resolution, record_id, partition, candidates). start
    and end are code points of the source. issues: (code, severity, node_type,
    source, start, end).
    """
    each = F.array(*[F.struct(F.lit(k.node_type).alias("node_type"), F.lit(k.registry).alias("registry"), F.lit(k.partitioned).alias("partitioned"), _partition(k, F.col("source"), F.col("front")).alias("named")) for k in kinds])
    # a registry without partitions is one partition, whatever the source names
    open_ = lambda s: s["named"].isNotNull() | partition_gate(s["partitioned"], s["named"], s["named"])
    scope_of = lambda s: F.concat_ws("\x00", s["node_type"], F.when(s["partitioned"], s["named"]).otherwise(""))
    fronted = sources.where("text is not null").select("source", "text", front_matter("text").alias("front")).select("source", "text", each.alias("each"))
    scoped = fronted.select("source", "text", F.array_distinct(F.transform(F.filter("each", open_), scope_of)).alias("scopes"))
    shut = fronted.select("source", F.inline(F.filter("each", lambda s: ~open_(s)))).distinct()
    named = F.array(*[F.struct(F.lit(k.node_type).alias("node_type"), F.lit(k.registry).alias("of"), F.lit(k.partitioned).alias("partitioned")) for k in kinds])
    known = registry.select("registry", "record_id", "is_label", "partition", _form(F.coalesce("surface", F.lit(""))).alias("form"), F.inline(named)).where("registry = of and form != ''")
    # of a partitioned registry, a record without a partition is in none
    known = known.where("not partitioned or partition is not null").withColumn("scope", scope_of({"node_type": F.col("node_type"), "partitioned": F.col("partitioned"), "named": F.col("partition")}))
    known = settle(known.select("scope", "form", "record_id", "is_label").distinct())
    lexicon = known.select("scope", "form").distinct()
    held = few(lexicon, "form")
    spans = _sought(scoped, kinds, lexicon) if held else _joined(scoped, kinds, lexicon)
    bad = None
    if proposals is not None:
        scopes = scoped.select("source", F.explode("scopes").alias("scope")).withColumn("node_type", F.substring_index("scope", "\x00", 1))
        asked = proposals.join(scopes, ["source", "node_type"]).join(sources.select("source", "text"), "source")
        raw = F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))
        stands = (F.col("start") >= 0) & (F.col("end") > F.col("start")) & (F.col("end") <= F.length("text"))
        told = settle(asked.select("scope", "node_type", "source", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.coalesce(stands, F.lit(False)).alias("ok"), raw.alias("raw_span")))
        bad = told.where(~F.col("ok"))
        units = source_units(sources.select("source", "text").join(told.where("ok").select("source").distinct(), "source", "left_semi"))
        paged = told.where("ok").join(units.select("source", "page", F.col("start").alias("a"), F.col("end").alias("b")), "source", "left").where("a is null or a <= start")
        good = paged.groupBy("scope", "source", "start", "end", "raw_span").agg(F.max("page").alias("page"))
        spans = spans.unionByName(good.select("scope", "source", F.coalesce("page", F.lit(1)).alias("page"), "start", "end", "raw_span", F.lit(PROPOSAL).alias("detector"), _form("raw_span").alias("normalized")))
    once = dedup_occurrences(spans, ["scope", "source", "start", "end"], "detector")
    per = known.withColumnRenamed("form", "normalized").groupBy("scope", "normalized").agg(
        *[f.alias(n) for side, flag in (("l", F.col("is_label")), ("a", ~F.col("is_label"))) for n, f in ((f"n_{side}", F.countDistinct(F.when(flag, F.col("record_id")))), (f"r_{side}", F.min(F.when(flag, F.col("record_id")))))]
    )
    n = F.coalesce(F.when(F.col("n_l") > 0, F.col("n_l")).otherwise(F.col("n_a")), F.lit(0))
    partition = F.expr("substring(scope, instr(scope, '\\0') + 1)")
    resolved = once.join(F.broadcast(per) if held else per, ["scope", "normalized"], "left").withColumn("node_type", F.substring_index("scope", "\x00", 1)).withColumn("partition", F.when(partition != "", partition))
    named_by = F.element_at(F.array(*map(F.lit, DETECTORS)), F.col("detector") + 1)
    occurrences_ = settle(
        resolved.select(
            F.substring(F.sha2(F.concat_ws("|", "source", "node_type", "start", "end").cast("binary"), 256), 1, 24).alias("id"), "node_type", "source", "page", "start", "end", "raw_span",
            "normalized", named_by.alias("detector"), F.when(n == 1, "linked").when(n > 1, "ambiguous").otherwise("unlinked").alias("resolution"),
            F.when(n == 1, F.when(F.col("n_l") > 0, F.col("r_l")).otherwise(F.col("r_a"))).alias("record_id"), "partition", n.cast("long").alias("candidates"),
        )
    )
    note = lambda df, code, severity, a, b: df.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), "node_type", "source", a.cast("int").alias("start"), b.cast("int").alias("end"))
    issues = note(shut, "partition_unresolved", "error", F.lit(None), F.lit(None)).unionByName(note(occurrences_.where("resolution = 'ambiguous'"), "ambiguous", "warning", F.col("start"), F.col("end")))
    if bad is not None:
        issues = issues.unionByName(note(bad, "not_in_source", "warning", F.col("start"), F.col("end")))
    return occurrences_, issues
