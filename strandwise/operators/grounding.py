"""Citation grounding: node terms found in source units by a positional index, quoted verbatim.

Sources are cut into paragraphs with pages, sections and offsets. Each paragraph
is folded (accents, ligatures, case, white space, dotted initials). Tasks hold
the terms and read each source once; terms beyond what they may hold are sought
by their rarest words, which are held with their places. Each quote is a slice of its source; what can't be grounded is an issue.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .iterate import settle
from .seek import Places, few

#: Code points of a quote before and after what it shows, and in all; citations of a node in a source. Fixed values.
BEFORE, AFTER, LONGEST, TOP = 110, 210, 320, 6
#: Where a quote may begin and end. Fixed values.
OPENING, CLOSING = ' \n«("“', ' \n.!?»)"”'
#: Kinds of nodes that are sought by their longest content word too. Fixed values.
CONCEPTS = "concept technology use_case regulation project standard tool rationale".split()
#: Words that say too little to be such a word. Fixed values.
GENERAL = (
    "aeronautique aeronautics intelligence artificielle artificial systeme systemes system systems "
    "operationnelle operationnel operational transformation developpement development application "
    "applications technologie technologies technology analyse analysis gestion management donnees "
    "data modele model methode method niveau level processus process secteur sector impact apport "
    "apports enjeux defis perspective perspectives concept concepts general overview document section"
).split()
_WIDE = re.compile("[ᄀ-ᇿ぀-ヿ㐀-䶿一-鿿가-힯豈-﫿\U00020000-\U0002fa1f]")
_INITIALS = re.compile(r"\b[a-z]\s*\.(?:\s*[a-z]\s*\.)+")
_HEADING = re.compile(r"#{1,4}\s+(.*)", re.S)
_IMAGE = re.compile(r"!\[[^\]]*\]\(([^)]+)\)")
_CHAPTER = re.compile(r"(?:chapter|part|book|adventure|story)\b", re.I)
_KEY = re.compile(r"[a-z_]+:\s", re.I)


class _Folded(dict):
    """A character's folded form; white space is one space, a combining mark nothing. Those met that are not one character then are odd."""

    def __init__(self) -> None:
        self.odd: set[str] = set()

    def __missing__(self, c: str) -> str:
        bare = re.sub("[̀-ͯ]", "", unicodedata.normalize("NFKD", c))
        self[c] = " " if c.isspace() else bare.replace("œ", "oe").replace("æ", "ae").replace("Œ", "OE").replace("Æ", "AE").lower()
        if len(self[c]) != 1:
            self.odd.add(c)
        return self[c]


_FOLD = _Folded()


def fold(text: str) -> tuple[str, np.ndarray]:
    """(folded text, for each of its characters the place in text that it comes from)."""
    pieces = [_FOLD[c] for c in text]
    at = np.arange(len(pieces))
    if not _FOLD.odd.isdisjoint(text):
        at = np.repeat(at, np.fromiter(map(len, pieces), np.int64, count=len(pieces)))
    whole = "".join(pieces)
    if not whole:
        return "", at
    space = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype="<u4") == 32
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    kept = np.flatnonzero(keep)
    kept = kept[1:] if len(kept) and space[kept[0]] else kept
    kept = kept[:-1] if len(kept) and space[kept[-1]] else kept
    text, at = " ".join(filter(None, whole.split(" "))) if len(kept) < len(whole) else whole, at[kept]
    gone = [i for m in _INITIALS.finditer(text) for i in range(*m.span()) if text[i] == " "] if "." in text else []
    if gone:
        stay = np.ones(len(text), dtype=bool)
        stay[gone] = False
        text, at = "".join([text[i] for i in np.flatnonzero(stay)]), at[stay]
    return text, at


def folded(text: str | None) -> str:
    if text and text.isascii() and "." not in text:
        return " ".join(text.lower().split())
    form = " ".join(filter(None, "".join([_FOLD[c] for c in text or ""]).split(" ")))
    return _INITIALS.sub(lambda m: m.group().replace(" ", ""), form) if "." in form else form


def _is_heading(line: str) -> bool:
    """A short line that opens a plain paragraph: a chapter's name, or mostly capitals."""
    if len(line) > 80:
        return False
    if _CHAPTER.match(line):
        return True
    letters = re.sub("[^a-zA-ZÀ-ÿ]", "", line)
    return len(line.split()) <= 8 and len(letters) >= 3 and len(re.sub("[^A-ZÀ-Þ]", "", line)) / len(letters) >= 0.7


def paragraphs(text: str, markdown: bool) -> Iterator[tuple[int, str, int, int]]:
    """(page, section, start, end) of each paragraph, in order; ends are exclusive.

    Blank lines, headings and, in markdown, page rules (---) and images end a
    paragraph; a leading block of keys between rules is no content.
    """
    page, section, first, last = 1, "", None, 0
    front = markdown and text.split("\n", 1)[0].strip() == "---"
    skip = front
    at = 0
    for line in text.split("\n"):
        bare = line.strip()
        start, at = at, at + len(line) + 1
        if skip:
            skip = False
            continue
        if front:
            if bare == "---":
                front = False
                continue
            if not bare or _KEY.match(bare):
                continue
            front = False
        heading = _HEADING.match(bare) or (not markdown and first is None and bare and _is_heading(bare) or None)
        rule = markdown and bare == "---"
        if bare and not heading and not rule and not (markdown and _IMAGE.match(bare)):
            if first is None:
                first = start + line.index(bare)
            last = start + line.index(bare) + len(bare)
            continue
        if first is not None and not text.startswith("![", first):
            yield page, section, first, last
        first = None
        page += rule
        if heading:
            section = bare if heading is True else heading.group(1).strip()
    if first is not None and not text.startswith("![", first):
        yield page, section, first, last


def is_markdown(key: Column) -> Column:
    return F.lower(key).rlike(r"\.(md|markdown)$")


UNIT = "source string, unit int, page int, section string, start int, end int, text string, folded string, words array<struct<pos:int,word:string,at:int>>"


def source_units(sources: DataFrame, key: str = "source", text: str = "text", markdown: Column | None = None) -> DataFrame:
    """A row for each paragraph: (source, unit, page, section, start, end, text, folded, words).

    start and end are code points of the source; words holds each run of
    letters, digits and underscores of the folded paragraph, with its number
    and its place there. A source is markdown where `markdown` says so, by
    default where its key ends in .md or .markdown. A null text has no units.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in UNIT.split(", ")]
        for batch in batches:
            rows = []
            for source, said, marked in zip(batch["source"], batch["text"], batch["markdown"]):
                for n, (page, section, a, b) in enumerate(paragraphs(said, bool(marked))):
                    form, _ = fold(said[a:b])
                    words = [(k, m.group(), m.start()) for k, m in enumerate(re.finditer(r"\w+", form))]
                    rows.append((source, n, page, section, a, b, said[a:b], form, words))
                    if len(rows) >= 500:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
            yield pd.DataFrame(rows, columns=columns)

    kind = is_markdown(F.col(key)) if markdown is None else markdown
    given = sources.where(F.col(text).isNotNull()).select(F.col(key).cast("string").alias("source"), F.col(text).alias("text"), F.coalesce(kind, F.lit(False)).alias("markdown"))
    return given.mapInPandas(cut, UNIT)


def terms_of(kind: str, id_: str, label: str, aliases: list[str]) -> list[tuple[int, str, str]]:
    """(order, how, term) of a node, as it is sought: `text` anywhere in a paragraph, `word` a raw whole word, `raw` as it stands, `section` words of a heading."""
    base = re.split("[—–,(]", label)[0].strip()
    width = lambda t: sum(2 if _WIDE.match(c) else 1 for c in t)
    texts = [t for t in map(folded, (base, label, *aliases)) if width(t) >= 4]
    out = []
    if kind == "person":
        names = [w for w in base.split() if len(folded(w)) >= 3 and re.match("[a-zA-ZÀ-ÿ]", w)]
        surname = folded(names[-1]) if names and len(folded(names[-1])) >= 4 else None
        texts += [surname] if surname else []
        out += [("section", s) for s in [surname or folded(base)] if s]
    found = re.search(r"\[(\d+)\]", label) or re.search(r"ref_(\d+)", id_)
    if kind == "reference" and found:
        out.append(("raw", f"[{found.group(1)}]"))
    if kind in CONCEPTS:
        words = [w for w in re.findall("[a-zà-ÿ]{5,}", folded(base)) if w not in GENERAL]
        texts += [max(words, key=len)] if words else []
    out += [("text", t) for t in dict.fromkeys(texts)]
    if re.fullmatch("[A-Z][A-Z0-9]{2,5}", base):
        out.append(("word", base))
    return [(k, how, term) for k, (how, term) in enumerate(out)]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("order", T.IntegerType()), T.StructField("how", T.StringType()), T.StructField("term", T.StringType()), T.StructField("words", T.ArrayType(T.StringType())), T.StructField("at", T.IntegerType())])))
def _terms(kinds: pd.Series, ids: pd.Series, labels: pd.Series, aliases: pd.Series) -> pd.Series:
    out = []
    for kind, id_, label, more in zip(kinds, ids, labels, aliases):
        rows = []
        for order, how, term in terms_of((kind or "").lower(), id_ or "", label or "", [a for a in (more if more is not None else ()) if a]):
            form = folded(term)
            rows.append((order, how, term, re.findall(r"\w+", form), next((m.start() for m in re.finditer(r"\w", form)), 0)))
        out.append(rows)
    return pd.Series(out)


def node_terms(nodes: DataFrame) -> DataFrame:
    """(id, order, how, term, words, at) of nodes (id, node_type, label, aliases): their terms, the folded words and where the first begins."""
    return nodes.select("id", F.explode(_terms("node_type", "id", "label", "aliases")).alias("t")).select("id", "t.*")


#: Words sought that may be broadcast; words of a text that are held together with what stands around them.
BROADCAST_WORDS, HELD_WORDS = 1_000_000, 32
GRAM = 3


def _grams(word: Column) -> Column:
    """All stretches of 1 to GRAM characters of a word."""
    each = lambda k: F.when(F.length(word) >= k, F.transform(F.sequence(F.lit(1), F.length(word) - k + 1), lambda i: F.substr(word, i, F.lit(k)))).otherwise(F.array())
    return F.array_distinct(F.concat(*[each(k) for k in range(1, GRAM + 1)]))


def occurrences(terms: DataFrame, units: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(id, order, source, unit, at): where in a folded unit each of the terms (id, order, term, words, at) stands, everywhere.

    wanted, if given, are the pairs (id, source) to be looked at. The source's
    words that a term's word can be are found over the vocabulary, by stretches
    of three characters; where each term's rarest word stands, the text around
    it is compared with the whole term. A term may begin or end within a word.
    Up to BROADCAST_WORDS words that are sought are broadcast, so that of the
    text nothing is shuffled but the places found; beyond, stretches of it
    meet them by the word. Texts are searched once, however often the places
    are read.
    """
    return settle(_places(terms, units, wanted))


def _places(terms: DataFrame, units: DataFrame, wanted: DataFrame | None) -> DataFrame:
    words = units.select(F.explode("words").alias("w")).select(F.col("w.word").alias("word"))
    vocabulary = settle(words.groupBy("word").agg(F.count(F.lit(1)).alias("df")))
    asked = terms.where(F.size("words") > 0)
    parts = asked.select("id", "order", F.size("words").alias("n"), F.posexplode("words").alias("j", "part"))
    shape = F.when(F.col("n") == 1, "in").when(F.col("j") == 0, "end").when(F.col("j") == F.col("n") - 1, "begin").otherwise("whole")
    parts = settle(parts.withColumn("shape", shape))
    forms = parts.select("part", "shape").distinct()
    edges = forms.where("shape != 'whole'").withColumn("gram", F.substr("part", F.lit(1), F.lit(GRAM)))
    spelled = vocabulary.select("word", "df", F.explode(_grams(F.col("word"))).alias("gram"))
    fits = F.when(F.col("shape") == "in", F.contains("word", "part")).when(F.col("shape") == "end", F.endswith("word", "part")).otherwise(F.startswith("word", "part"))
    wide = edges.join(spelled, "gram").where(fits).select("part", "shape", "word", "df")
    exact = forms.where("shape = 'whole'").join(vocabulary.withColumn("part", F.col("word")), "part").select("part", "shape", "word", "df")
    spread = settle(wide.unionByName(exact))
    cost = spread.groupBy("part", "shape").agg(F.sum("df").alias("cost"))
    rare = parts.join(cost, ["part", "shape"], "left").groupBy("id", "order", "n").agg(F.min(F.struct(F.coalesce("cost", F.lit(0)).alias("cost"), "j", "part", "shape")).alias("rare"))
    anchors = rare.where("rare.cost > 0").select("id", "order", "n", F.col("rare.j").alias("anchor"), F.col("rare.part").alias("part"), F.col("rare.shape").alias("shape"))
    # how far into the term its rarest word begins, after each of the words before it
    step = lambda i, k: F.position(F.get("words", k), F.col("term"), i + F.length(F.get("words", k - 1)) + 1) - 1
    lead = F.when(F.col("anchor") > 0, F.aggregate(F.sequence(F.lit(1), F.col("anchor")), F.col("at").cast("int"), step)).otherwise(F.col("at")).cast("int")
    begins = anchors.join(asked.select("id", "order", "term", "words", "at"), ["id", "order"]).select("id", "order", "n", "anchor", "part", "shape", "term", lead.alias("lead"))
    sought = settle(begins.join(spread.select("part", "shape", "word"), ["part", "shape"]).select("id", "order", "shape", "part", "term", "lead", "word"))
    n, longest = sought.agg(F.count(F.lit(1)), F.max(F.length("term"))).first()
    each = _stretches(units, longest or 0).select("source", "unit", "from", "around", F.explode("held").alias("w"))
    hits = each.select("source", "unit", "from", "around", F.col("w.word").alias("word"), F.col("w.at").alias("place")).join(F.broadcast(sought) if n <= BROADCAST_WORDS else sought, "word")
    # a first word ends its text's word, a single one may stand anywhere in it, others begin it
    within = F.when(F.col("shape") == "end", F.array(F.length("word") - F.length("part"))).when(F.col("shape") == "in", F.sequence(F.lit(0), F.length("word") - F.length("part"))).otherwise(F.array(F.lit(0)))
    placed = hits.select("id", "order", "term", "source", "unit", "from", "around", (F.col("place") - F.col("lead")).alias("begin"), F.explode(within).alias("k")).withColumn("at", F.col("begin") + F.col("k"))
    stands = F.substr("around", F.col("at") - F.col("from") + 1, F.length("term")) == F.col("term")
    found = placed.where((F.col("at") >= 0) & stands).select("id", "order", "source", "unit", "at")
    return found if wanted is None else found.join(wanted, ["id", "source"], "left_semi")


def _stretches(units: DataFrame, longest: int) -> DataFrame:
    """(source, unit, from, around, held): HELD_WORDS words at a time of each unit with the folded text around them, as far as a term of that length from or to one of them can go; from is where that begins."""
    first = F.greatest(F.lit(0), F.col("held")[0]["at"] - longest)
    last = F.element_at("held", -1)
    cut = F.transform(F.sequence(F.lit(1), F.size("words"), F.lit(HELD_WORDS)), lambda i: F.slice("words", i, HELD_WORDS))
    held = units.where(F.size("words") > 0).select("source", "unit", "folded", F.explode(cut).alias("held")).withColumn("from", first)
    return held.select("source", "unit", "from", F.substr("folded", F.col("from") + 1, last["at"] + F.length(last["word"]) + longest - F.col("from")).alias("around"), "held")


def _meets(word: Column, term: Column, j: Column, n: Column) -> Column:
    """Whether a source's word can be the term's word j of n: whole inside a term, open to the left at its beginning, to the right at its end."""
    return F.when(n == 1, F.contains(word, term)).when(j == 0, F.endswith(word, term)).when(j == n - 1, F.startswith(word, term)).otherwise(word == term)


def joined_occurrences(terms: DataFrame, units: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """What `occurrences` gives, by joins of positions, for long and single words' terms of grounding: (id, order, source, unit, at), where in a folded unit each of the terms (id, order, term, words, at) stands, everywhere.

    wanted, if given, are the pairs (id, source) to be looked at. The source's
    words that a term's word can be are found over the vocabulary, by stretches
    of three characters; each term's rarest word then fetches its positions,
    and the positions of its other words are joined to those candidates. A term
    may begin or end within a word. What is shuffled by a word are positions
    of terms' rarest words only.
    """
    positions = units.select("source", "unit", F.posexplode("words").alias("n", "w")).select("source", "unit", F.col("w.pos").alias("pos"), F.col("w.word").alias("word"), F.col("w.at").alias("place"))
    vocabulary = settle(positions.groupBy("word").agg(F.count(F.lit(1)).alias("df")))
    asked = terms.where(F.size("words") > 0)
    parts = asked.select("id", "order", F.size("words").alias("n"), F.posexplode("words").alias("j", "part"))
    shape = F.when(F.col("n") == 1, "in").when(F.col("j") == 0, "end").when(F.col("j") == F.col("n") - 1, "begin").otherwise("whole")
    parts = settle(parts.withColumn("shape", shape))
    forms = parts.select("part", "shape").distinct()
    edges = forms.where("shape != 'whole'").withColumn("gram", F.substr("part", F.lit(1), F.lit(GRAM)))
    spelled = vocabulary.select("word", "df", F.explode(_grams(F.col("word"))).alias("gram"))
    fits = F.when(F.col("shape") == "in", F.contains("word", "part")).when(F.col("shape") == "end", F.endswith("word", "part")).otherwise(F.startswith("word", "part"))
    wide = edges.join(spelled, "gram").where(fits).select("part", "shape", "word", "df")
    exact = forms.where("shape = 'whole'").join(vocabulary.withColumn("part", F.col("word")), "part").select("part", "shape", "word", "df")
    spread = settle(wide.unionByName(exact))
    cost = spread.groupBy("part", "shape").agg(F.sum("df").alias("cost"))
    rare = parts.join(cost, ["part", "shape"], "left").groupBy("id", "order", "n").agg(F.min(F.struct(F.coalesce("cost", F.lit(0)).alias("cost"), "j", "part", "shape")).alias("rare"))
    anchors = rare.where("rare.cost > 0").select("id", "order", "n", F.col("rare.j").alias("anchor"), F.col("rare.part").alias("part"), F.col("rare.shape").alias("shape"))
    sought = anchors.join(spread.select("part", "shape", "word"), ["part", "shape"]).select("id", "order", "n", "anchor", "word")
    hits = positions.join(sought, "word")
    if wanted is not None:
        hits = hits.join(wanted, ["id", "source"], "left_semi")
    candidates = settle(hits.select("id", "order", "n", "source", "unit", (F.col("pos") - F.col("anchor")).alias("first")).where("first >= 0"))
    needed = candidates.join(parts.select("id", "order", "j", "part"), ["id", "order"]).withColumn("pos", F.col("first") + F.col("j"))
    held = needed.join(positions, ["source", "unit", "pos"]).where(_meets(F.col("word"), F.col("part"), F.col("j"), F.col("n")))
    # where the term's first word begins: at the end of a longer word, or anywhere in a single one
    begins = F.min(F.when(F.col("j") == 0, F.struct("place", "word"))).alias("head")
    phrases = held.groupBy("id", "order", "n", "source", "unit", "first").agg(F.count(F.lit(1)).alias("k"), begins).where("k = n")
    whole = phrases.join(asked.select("id", "order", "term", "words", F.col("at").alias("lead")), ["id", "order"]).join(units.select("source", "unit", "folded"), ["source", "unit"])
    head = F.when(F.col("n") > 1, F.array(F.length("head.word") - F.length(F.col("words")[0]))).otherwise(
        F.filter(F.sequence(F.lit(0), F.length("head.word") - F.length(F.col("words")[0])), lambda k: F.substr("head.word", k + 1, F.length(F.col("words")[0])) == F.col("words")[0])
    )
    placed = whole.select("id", "order", "term", "source", "unit", "folded", F.explode(head).alias("k"), "head", "lead").withColumn("at", F.col("head.place") + F.col("k") - F.col("lead"))
    stands = F.substr("folded", F.col("at") + 1, F.length("term")) == F.col("term")
    return placed.where((F.col("at") >= 0) & stands).select("id", "order", "source", "unit", "at")


def quote_at(text: str, at: int) -> tuple[int, int, str]:
    """(start, end, quote): a window of text around `at`, grown to where a quote may begin and end; dots tell that more stands there."""
    a, b = max(0, at - BEFORE), min(len(text), at + AFTER)
    while a and text[a] not in OPENING:
        a -= 1
    while b < len(text) and text[b] not in CLOSING:
        b += 1
    quote = ("… " if a else "") + text[a:b].strip() + (" …" if b < len(text) else "")
    quote = " ".join(quote.split())
    return a, b, quote[:LONGEST].strip()


def _core(quote: str) -> str:
    return folded(re.sub(r"\s*…$", "", re.sub(r"^…\s*", "", quote)))


def _quote(text: str, form: str, origin: np.ndarray, at: int, needle: str) -> tuple[int, int, str, str, bool]:
    """(start, end, quote, its first 60 folded characters, whether it is in its unit and shows the needle) at a place of the unit's folded form, or of the raw needle if that is -1."""
    a, b, said = quote_at(text, int(origin[at]) if at >= 0 else max(0, text.find(needle)))
    core, shown = _core(said), folded(said)
    return a, b, said, shown[:60], bool(core) and core in form and folded(needle) in shown


CITED = "id string, source string, stage int, unit int, page int, section string, start int, end int, quote string, brief string, confidence string, verified boolean"


def _quoted(found: DataFrame) -> DataFrame:
    """Citations of found (id, source, stage, unit, page, section, offset, text, folded, at, needle, confidence), each verified against its unit.

    at is a place in the folded text, or -1 for the first one where the raw
    needle stands.
    """

    def quote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                a, b, said, brief, ok = _quote(r.text, r.folded, fold(r.text)[1], r.at, r.needle)
                rows.append((r.id, r.source, r.stage, r.unit, r.page, r.section, r.offset + a, r.offset + b, said, brief, r.confidence, ok))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CITED.split(", ")])

    return found.mapInPandas(quote, CITED)


def ground(nodes: DataFrame, sources: DataFrame, wanted: DataFrame | None = None, key: str = "source", text: str = "text", top: int = TOP) -> tuple[DataFrame, DataFrame]:
    """(citations, issues) of nodes (id, node_type, label, aliases, rationale) in the sources.

    citations: (id, source, rank, page, section, unit, start, end, quote,
    confidence), the first `top` of a node in a source: paragraphs under a
    heading that names a person, then a reference's mark, then terms by
    paragraph, then the rationale's own words, each quote once by its first 60
    folded characters. start and end are code points of the source, the quote
    is what stands there, its white space collapsed, between dots where more
    follows. issues: (id, source, reason): `unverified` for a place whose quote
    isn't in its unit or doesn't show the term, `ungrounded` for a pair without
    a citation. wanted are the pairs (id, source) to be grounded; without it
    every source is searched, and only pairs with an occurrence are reported.
    """
    terms = settle(node_terms(nodes))
    said = settle(_sayings(nodes))
    pairs = None if wanted is None else wanted.select("id", F.col("source").cast("string").alias("source")).distinct()
    given = sources.where(F.col(text).isNotNull()).select(F.col(key).cast("string").alias("source"), F.col(text).alias("text"))
    held = few(terms.select("term").unionByName(said.select("term")), "term")
    quoted = _cited(given, terms, said, top) if held else _joined(given, terms, said, pairs)
    quoted = settle(quoted if pairs is None else quoted.join(pairs, ["id", "source"], "left_semi"))
    # what a task found of a source is in order, unless the source has more rows
    if not held or not given.groupBy("source").count().where("count > 1").isEmpty():
        quoted = quoted.repartition("id", "source").withColumn("nth", F.when(F.col("verified"), F.row_number().over(W.partitionBy("id", "source", "verified", "brief").orderBy("stage", "unit", "start"))))
        quoted = settle(quoted.where("not verified or nth = 1").withColumn("rank", F.row_number().over(W.partitionBy("id", "source", "verified").orderBy("stage", "unit", "start"))).drop("nth"))
    citations = quoted.where(F.col("verified") & (F.col("rank") <= top)).select("id", "source", "rank", "page", "section", "unit", "start", "end", "quote", "confidence")
    issues = quoted.where("not verified and stage < 4").select("id", "source", F.lit("unverified").alias("reason")).distinct()
    sought = quoted.select("id", "source").distinct() if pairs is None else pairs
    bare = sought.join(citations.select("id", "source").distinct(), ["id", "source"], "left_anti").select("id", "source", F.lit("ungrounded").alias("reason"))
    return citations, issues.unionByName(bare)


def _citations(source: str, said: str, markdown: bool, index: Places, entries: list[list[tuple]], heads: dict[str, list[tuple]], top: int) -> list[tuple]:
    """Rows of CITED, with ranks, of a source: of each node the first `top` citations, and one that isn't verified if there is any."""
    offers: dict[str, list[tuple]] = defaultdict(list)
    stretches: dict[tuple[str, int], tuple] = {}
    for unit, (page, section, start, end) in enumerate(paragraphs(said, markdown)):
        text = said[start:end]
        form, origin = fold(text)
        first, words = {}, {}

        def offer(id_: str, stage: int, at: int, needle: str) -> None:
            a, b, quote, brief, ok = _quote(text, form, origin, at, needle)
            offers[id_].append((stage, unit, start + a, page, section, start + b, quote, brief, "EXTRACTED", ok))

        title = re.findall("[a-z0-9]+", section.lower()) if heads and section else []
        for head in dict.fromkeys(title):
            for id_, run in heads.get(head, ()):
                if any(title[k : k + len(run)] == run for k in range(len(title))):
                    offer(id_, 1, 0, "")
        for at, no in index.of(form):
            for how, id_, order, term, *more in entries[no]:
                if how == "text":
                    first[id_] = min(first.get(id_, (order, at, term)), (order, at, term))
                elif how == "said":
                    if (id_, order) not in stretches:
                        a, b = start + int(origin[at]), start + int(origin[at + len(index.texts[no]) - 1]) + 1
                        stretches[id_, order] = (4 + order, unit, a, page, section, b, term, index.texts[no][:60], more[1], True), more[0]
                elif (how, id_, order) not in words:
                    words[how, id_, order] = term if (term in text if how == "raw" else re.search(rf"\b{term}\b", text)) else None
        for id_, (_, at, term) in first.items():
            offer(id_, 3, at, term)
        for (how, id_, _), term in words.items():
            if term and (how == "raw" or id_ not in first):
                offer(id_, 2 if how == "raw" else 3, -1, term)
    # all of a rationale counts only where no quoted stretch of it stands
    marked = {id_ for (id_, _), (_, quoted) in stretches.items() if quoted}
    for (id_, _), (row, quoted) in stretches.items():
        if quoted or id_ not in marked:
            offers[id_].append(row)
    rows = []
    for id_, found in offers.items():
        briefs, rank, doubt = set(), 0, False
        for stage, unit, a, page, section, b, quote, brief, confidence, ok in sorted(found, key=lambda c: c[:3]):
            if ok and brief not in briefs and rank < top:
                briefs.add(brief)
                rank += 1
                rows.append((id_, source, stage, unit, page, section, a, b, quote, brief, confidence, True, rank))
            elif not ok and not doubt:
                doubt = True
                rows.append((id_, source, stage, unit, page, section, a, b, None, None, None, False, None))
    return rows


def _cited(given: DataFrame, terms: DataFrame, said: DataFrame, top: int) -> DataFrame:
    """CITED and rank: what `_citations` finds of terms and rationales' stretches in each of given (source, text).

    Tasks hold the terms, and each source is read once: nothing of it is
    written or shuffled but its citations.
    """
    entries: dict[str, list[tuple]] = defaultdict(list)
    heads: dict[str, list[tuple]] = defaultdict(list)
    for r in terms.where(F.size("words") > 0).orderBy("id", "order").collect():  # at most HELD_TEXTS, as the next
        if r.how == "section":
            heads[r.words[0]].append((r.id, list(r.words)))
        else:
            entries[r.term.lower()].append((r.how, r.id, r.order, r.term))
    for r in said.where(F.size("words") > 0).orderBy("id", "order").collect():
        entries[r.term].append(("said", r.id, r.order, r.quote, r.quoted, "EXTRACTED" if r.kind == "quote" else "INFERRED"))
    shared = given.sparkSession.sparkContext.broadcast((Places(entries), list(entries.values()), dict(heads)))
    columns = [c.split()[0] for c in CITED.split(", ")] + ["rank"]

    def cite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for source, text, markdown in zip(batch["source"], batch["text"], batch["markdown"]):
                rows += _citations(source, text, markdown, *shared.value, top)
                if len(rows) >= 5000:
                    yield _frame(rows, columns)
                    rows = []
            yield _frame(rows, columns)

    return given.withColumn("markdown", is_markdown(F.col("source"))).mapInPandas(cite, f"{CITED}, rank int")


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=columns, dtype=object)


def _joined(given: DataFrame, terms: DataFrame, said: DataFrame, pairs: DataFrame | None) -> DataFrame:
    """CITED of what `_cited` finds, all of it without ranks, for terms beyond what tasks may hold: by joins of words."""
    units = settle(source_units(given))
    plain = joined_occurrences(terms.where("how = 'text'").drop("how"), units, pairs)
    # the first of a node's terms that stands in the paragraph, where it stands first
    first = plain.groupBy("id", "source", "unit").agg(F.min(F.struct("order", "at")).alias("f")).select("id", "source", "unit", F.col("f.order").alias("order"), F.col("f.at").alias("at"))
    exact = joined_occurrences(
        terms.where("how in ('raw', 'word')").select("id", "order", F.lower("term").alias("term"), "words", "at"), units, pairs
    ).select("id", "order", "source", "unit").distinct()
    named = terms.where("how = 'section'").select("id", "order", "words", F.col("words")[0].alias("head"), F.size("words").alias("n"))
    titles = units.select("source", "unit", "section").where("section != ''").withColumn("title", F.expr("regexp_extract_all(lower(section), '[a-z0-9]+', 0)"))
    titles = titles.select("source", "unit", "title", F.explode(F.array_distinct("title")).alias("head"))
    run = F.exists(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("title") - F.col("n") + 1)), lambda i: F.slice("title", i, F.col("n")) == F.col("words"))
    headed = named.join(titles, "head").where(run).select("id", "order", "source", "unit")
    if pairs is not None:
        headed = headed.join(pairs, ["id", "source"], "left_semi")
    how = terms.select("id", "order", "how", "term")
    raw = exact.join(how, ["id", "order"]).join(units.select("source", "unit", "text"), ["source", "unit"])
    stands = F.when(F.col("how") == "raw", F.contains("text", "term")).otherwise(F.regexp_count(F.col("text"), F.concat(F.lit(r"\b"), F.col("term"), F.lit(r"\b"))) > 0)
    raw = raw.where(stands).select("id", "source", "unit", "how", "term")
    acronyms = raw.where("how = 'word'").join(first.select("id", "source", "unit"), ["id", "source", "unit"], "left_anti")
    found = (
        headed.select("id", "source", "unit", F.lit(1).alias("stage"), F.lit(0).alias("at"), F.lit("").alias("needle"))
        .unionByName(raw.where("how = 'raw'").select("id", "source", "unit", F.lit(2).alias("stage"), F.lit(-1).alias("at"), F.col("term").alias("needle")))
        .unionByName(first.join(how, ["id", "order"]).select("id", "source", "unit", F.lit(3).alias("stage"), "at", F.col("term").alias("needle")))
        .unionByName(acronyms.select("id", "source", "unit", F.lit(3).alias("stage"), F.lit(-1).alias("at"), F.col("term").alias("needle")))
        .join(units.select("source", "unit", "page", "section", F.col("start").alias("offset"), "text", "folded"), ["source", "unit"])
    )
    quoted = _quoted(found.select("id", "source", "stage", "unit", "page", "section", "offset", "text", "folded", "at", "needle", F.lit("EXTRACTED").alias("confidence")))
    return quoted.unionByName(_rationales(said, units, pairs))


def _sayings(nodes: DataFrame) -> DataFrame:
    """(id, kind, order, quoted, quote, term, words, at) of the rationale's quoted stretches of eight characters and more, then all of it."""

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("order", T.IntegerType()), T.StructField("quoted", T.BooleanType()), T.StructField("quote", T.StringType()), T.StructField("term", T.StringType()), T.StructField("words", T.ArrayType(T.StringType())), T.StructField("at", T.IntegerType())])))
    def spans(said: pd.Series) -> pd.Series:
        out = []
        for whole in said:
            whole = (whole or "").strip()
            marked = [m.strip() for m in re.findall("[«\"“]([^«»\"“”]{8,})[»\"”]", whole)]
            rows = []
            for k, (quoted, x) in enumerate([(True, m) for m in marked if m] + ([(False, whole)] if whole else [])):
                x = " ".join(x.split())[:LONGEST]
                form = folded(x)
                rows.append((k, quoted, x, form, re.findall(r"\w+", form), next((m.start() for m in re.finditer(r"\w", form)), 0)))
            out.append(rows)
        return pd.Series(out)

    return nodes.where("rationale is not null").select("id", F.lower("node_type").alias("kind"), F.explode(spans("rationale")).alias("s")).select("id", "kind", "s.*")


def _rationales(each: DataFrame, units: DataFrame, pairs: DataFrame | None) -> DataFrame:
    """Citations by the rationale's quoted stretches, or else by all of it, where they stand verbatim in a unit."""
    found = joined_occurrences(each.select("id", "order", "term", "words", "at"), units, pairs)
    first = found.groupBy("id", "order", "source").agg(F.min(F.struct("unit", "at")).alias("f"))
    joined = first.join(each.select("id", "order", "kind", "quoted", "quote", "term"), ["id", "order"])
    # all of it counts only where no quoted stretch of it stands
    best = W.partitionBy("id", "source")
    joined = joined.withColumn("any", F.max("quoted").over(best)).where("quoted or not any")
    placed = joined.select("id", "source", "order", F.col("f.unit").alias("unit"), F.col("f.at").alias("at"), "kind", "quote", "term").join(units.select("source", "unit", "page", "section", "start", "text"), ["source", "unit"])

    @F.pandas_udf(T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())]))
    def origin(texts: pd.Series, at: pd.Series, terms: pd.Series) -> pd.DataFrame:
        rows = []
        for t, k, term in zip(texts, at, terms):
            _, places = fold(t)
            rows.append((int(places[k]), int(places[k + len(term) - 1]) + 1))
        return pd.DataFrame(rows, columns=["a", "b"])

    placed = placed.withColumn("o", origin("text", "at", "term"))
    return placed.select(
        "id", "source", (F.lit(4) + F.col("order")).alias("stage"), "unit", "page", "section", (F.col("start") + F.col("o.a")).cast("int").alias("start"),
        (F.col("start") + F.col("o.b")).cast("int").alias("end"), "quote", F.substring("term", 1, 60).alias("brief"),
        F.when(F.col("kind") == "quote", "EXTRACTED").otherwise("INFERRED").alias("confidence"), F.lit(True).alias("verified"),
    )
