"""Main text of web pages by site style trees.

The pages of a host are merged into one tree: an element's place in it is the
path of tags, classes and, for containers, positions from the root. Over the
host's distinct pages, a presentation node's importance is the entropy of its
children's styles, and a content node's is one less the entropy of its text
over the pages that have the place; a branch takes the mean of what it holds.

Markup gives a branch a prior importance that counts as PRIOR_PAGES pages: what
it names the article has most of it, text beside a named article as much as
the article leaves of the page. The more pages the tree has seen a place on,
the less the prior says. Branches of low importance go. Navigation, adverts,
comments and the like, which the result must never have, go by their names
even where their text is another one on each page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle, written

#: Branches and texts below this importance go; places on fewer pages than MIN_PAGES have no say.
LOW, MIN_PAGES = 0.3, 4
CONTENT_SHARE = 0.8
#: Pages that the prior importance of the markup counts as.
PRIOR_PAGES = 8
#: A named article under this share of the page's largest is a card, of this prior importance.
CARD_SHARE, CARD = 0.1, 0.25
#: Prior importance of what a class or id names as content, and of text that markup says nothing of; beside named articles with MAIN_SHARE of the text it is BESIDE.
NEUTRAL, BESIDE, MAIN_SHARE = 0.5, 0.1, 0.2
#: Hosts with over this share of all pages are split for the join; there can't be more than its inverse.
HOT_SHARE = 0.001
#: Bytes of low-importance keys that may be broadcast.
BROADCAST_BYTES = 32_000_000

_TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|</([a-zA-Z][a-zA-Z0-9:-]*)[^>]*>|<[!?/][^>]*>", re.DOTALL)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style|itemprop)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.IGNORECASE)
_RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "noembed", "xmp", "template")
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>", re.IGNORECASE) for t in _RAW}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option optgroup p pre section select summary table tbody td "
    "tfoot th thead tr ul".split()
)
_PLACED = frozenset("article aside div dl fieldset figure footer form header main nav ol section table td tr ul".split())
_DROP = frozenset("nav footer aside form button select option datalist dialog menu head object applet audio video canvas svg math map frameset label".split())
_MAIN = frozenset(("article", "main"))
#: A start tag closes an open one of the same list.
_CLOSES = {
    "li": ("li",), "p": ("p",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd"),
    "option": ("option",),
}
_SCOPE = frozenset("article main section div table ul ol dl td body nav aside footer header form".split())
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Words of classes, ids and roles that name no part of an article.
_NO_ARTICLE = frozenset(
    "ad ads adsense advert adverts advertisement alert aside banner breadcrumb breadcrumbs comment comments commentlist complementary "
    "consent contentinfo cookie cookies dialog discussion disqus footer gdpr login menu modal nav navbar navigation newsletter notice "
    "notices notification paywall popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup "
    "skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
#: Words that say where or how such a part stands; any other word beside it (alert-fatigue, with-sidebar) names something else.
_WHERE = frozenset(
    "area article articles bar block blog bottom box btn button buttons center col column container content desktop entry fixed global group "
    "head header icons in inline inner item items left link links list main mobile module outer overlay page panel post posts primary right row "
    "secondary section site slot small sticky stories story sub text title top unit wrap wrapper".split()
)
_PAGE_HEAD = frozenset(("header", "masthead", "sitehead", "banner"))
_IS_ARTICLE = frozenset(("articlebody", "article", "main"))
_IS_CONTENT = frozenset("content maincontent main-content main_content post-content entry-content article-content article-body post-body story-body page-content".split())


class Block:
    """A run of text between block boundaries, the places it stands in, root first, and what markup says of it.

    region: the number of the named article that it is in, 0 for none; content:
    whether it is in what a class or id names as content; out: ruled out.
    """

    __slots__ = ("text", "path", "region", "content", "out")

    def __init__(self, text: str, path: tuple[int, ...], region: int, content: bool, out: bool):
        self.text, self.path, self.region, self.content, self.out = text, path, region, content, out


def _key(parent: int, style: str) -> int:
    return xxhash.xxh64_intdigest(f"{parent:x}/{style}") >> 1


def parse(html: str | None) -> tuple[list[Block], dict[int, list[str]]]:
    """(blocks in page order, those that markup rules out too; each place's children's styles)."""
    html = html or ""
    blocks: list[Block] = []
    shapes: dict[int, list[str]] = {}
    # open elements: (tag, place, number of the named article, ruled out, positions of children by style, named as content)
    stack: list[tuple[str, int, int, bool, dict, bool]] = [("", 1, 0, False, {}, False)]
    regions = 0
    held: list[str] = []
    shade: list[str] = []  # text of a ruled-out element, which may stand inside a block that isn't
    at = 0

    def flush() -> None:
        for parts, out in ((held, False), (shade, True)):
            if parts:
                text = " ".join(unescape("".join(parts)).split())
                parts.clear()
                if text:
                    blocks.append(Block(text, tuple(x[1] for x in stack), 0 if out else stack[-1][2], stack[-1][5], out))

    def close(tags: tuple[str, ...], within: frozenset | None) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in tags:
                if any(x[0] in _BLOCK for x in stack[k:]):
                    flush()
                del stack[k:]
                return
            if within is not None and stack[k][0] in within:
                return

    while True:
        m = _TAG.search(html, at)
        if m is None:
            if at < len(html):
                (shade if stack[-1][3] else held).append(html[at:])
            break
        if m.start() > at:
            (shade if stack[-1][3] else held).append(html[at : m.start()])
        at = m.end()
        if m[3] is not None:
            tag = m[3].lower()
            if tag == "p" or tag not in _BLOCK:
                close((tag,), _SCOPE)
            else:
                close((tag,), _MAIN if tag not in ("article", "main", "body", "html") else None)
            if tag in _BLOCK:
                flush()
            continue
        if m[1] is None:
            continue
        tag = m[1].lower()
        if tag in _RAW:
            end = None if m[2].endswith("/") and tag not in ("script", "style") else _RAW_END[tag].search(html, at)
            at = end.end() if end else at if m[2].endswith("/") else len(html)
            continue
        if tag in _VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                (shade if stack[-1][3] else held).append(" ")
            continue
        if tag in _BLOCK:
            flush()
            if tag in _CLOSES:
                close(_CLOSES[tag], _SCOPE - {tag})
            elif stack[-1][0] == "p" or any(x[0] == "p" for x in stack[-4:]):
                close(("p",), _SCOPE)
        if m[2] and not m[2].isspace():
            attributes = {a[1].lower(): a[2] or a[3] or a[4] or "" for a in _ATTRIBUTE.finditer(m[2])}
        else:
            attributes = {}
        _, parent, region, out, positions, content = stack[-1]
        style = tag
        if attributes:
            style += "." + ".".join(sorted(attributes.get("class", "").split())) + "#" + re.sub(r"\d+", "0", attributes.get("id", ""))
        if tag in _MAIN and out and not region:
            first = next(x[0] for x in stack if x[3])
            out = re.compile(rf"</{first}\b", re.IGNORECASE).search(html, at) is not None  # an article ends what is never closed
        out = out or _ruled_out(tag, attributes, region > 0)
        if not out and tag in _BLOCK:
            told = _named(attributes)
            content = content or bool(told & _IS_CONTENT)
            if not region and (tag in _MAIN or told & _IS_ARTICLE):
                region = regions = regions + 1
        nth = positions[style] = positions.get(style, -1) + 1
        shapes.setdefault(parent, []).append(style)
        # inline elements are no places of the tree: their text is their block's
        place = _key(parent, f"{style}[{nth}]" if tag in _PLACED else style) if tag in _BLOCK or attributes else parent
        if not m[2].endswith("/"):
            stack.append((tag, place, region, out, {}, content))
    flush()
    return blocks, shapes


def _named(attributes: dict[str, str]) -> set[str]:
    return set((attributes.get("itemprop", "") + " " + attributes.get("role", "") + " " + attributes.get("class", "") + " " + attributes.get("id", "")).lower().split()) if attributes else set()


def _ruled_out(tag: str, attributes: dict[str, str], named: bool) -> bool:
    if tag in _DROP or tag == "header" and not named:
        return True
    if not attributes or tag in ("html", "body"):
        return False
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", ""), re.IGNORECASE):
        return True
    for name in ("class", "id", "role"):
        for token in attributes.get(name, "").split():
            words = {w.lower() for w in _PARTS.findall(token)}
            if words <= _NO_ARTICLE | _WHERE and (words & _NO_ARTICLE or not named and words & _PAGE_HEAD):
                return True
    return False


def _text_key(place: int, text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), place & 0xFFFFFFFF) >> 1


def host_of(url: Column) -> Column:
    """The host in lower case; a url without one, or null, gives an empty host."""
    return F.coalesce(F.regexp_extract(F.lower(url), "^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))


BRANCH, SHAPE, TEXT = 0, 1, 2


def priors(blocks: list[Block]) -> list[float]:
    """Each block's importance by its page's markup alone; below 0 for what is ruled out."""
    sizes: dict[int, int] = {}
    for b in blocks:
        if not b.out:
            sizes[b.region] = sizes.get(b.region, 0) + len(b.text)
    beside = sizes.pop(0, 0)
    largest, named = max(sizes.values(), default=0), sum(sizes.values())
    neutral = BESIDE if named and named >= MAIN_SHARE * (beside + named) else NEUTRAL
    return [
        -1.0 if b.out else (1.0 if sizes[b.region] >= CARD_SHARE * largest else CARD) if b.region else NEUTRAL if b.content else neutral
        for b in blocks
    ]


def style_rows(pages: DataFrame, low: float = LOW) -> DataFrame:
    """(host, place, item, kind, chars, page, asked): what each page has at each place of its host's tree.

    A place gives one row for the text of its branch and one for the style of
    its children, and each text a row at the place it stands in. The tree holds
    all that a page shows, whatever markup says of it. asked: the place has
    text that goes unless the tree finds it important.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for host, html in zip(batch["host"], batch["html"]):
                blocks, shapes = parse(html)
                page = xxhash.xxh64_intdigest((html or "").encode("utf-8", "surrogatepass")) >> 1
                branches: dict[int, list[int]] = {}
                texts: dict[tuple[int, int], int] = {}
                asked: set[int] = set()
                for b, prior in zip(blocks, priors(blocks)):
                    item = _text_key(b.path[-1], b.text)
                    texts[b.path[-1], item] = len(b.text)
                    for place in dict.fromkeys(b.path[1:]):
                        branches.setdefault(place, [0]).append(item)
                        branches[place][0] += len(b.text)
                    if 0 <= prior < low:
                        asked.update(b.path[1:])
                out += [(host, place, item, TEXT, n, page, False) for (place, item), n in texts.items()]
                for place, (n, *items) in branches.items():
                    out.append((host, place, _text_key(place, str(items)), BRANCH, n, page, place in asked))
                    out.append((host, place, _text_key(place, " ".join(shapes.get(place, ()))), SHAPE, 0, page, False))
            yield pd.DataFrame(out, columns=["host", "place", "item", "kind", "chars", "page", "asked"])

    return pages.select(F.xxhash64("host").alias("host"), "html").mapInPandas(
        rows, "host long, place long, item long, kind int, chars long, page long, asked boolean"
    )


def importances(pages: DataFrame, low: float = LOW, min_pages: int = MIN_PAGES) -> tuple[DataFrame, DataFrame]:
    """Places (host, key, m, importance, asked), and texts (host, key, m, importance) below `low`, both on min_pages pages or more.

    A page that the host has twice counts once. An item on n of a place's m
    pages has entropy log n / log m. Counts are made per (host, place, item)
    and sums per (host, place) before anything meets by host, so a host with a
    third of all pages is spread over its places, and only sums reach it.
    """
    counted = style_rows(pages, low).groupBy("host", "place", "item", "kind").agg(
        F.countDistinct("page").alias("n"), F.max("chars").alias("chars"), F.max("asked").alias("asked")
    )
    held = written(counted, "style-tree")  # read twice, parsed once
    of = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x))
    sums = held.groupBy("host", "place").agg(
        of(SHAPE, F.col("n")).alias("m"),
        of(SHAPE, F.col("n") * F.log("n")).alias("shape_log"),
        of(BRANCH, F.col("n") * F.col("chars")).alias("mass"),
        of(BRANCH, F.col("n") * F.col("chars") * F.log("n")).alias("mass_log"),
        F.max("asked").alias("asked"),
    )
    seen = sums.where(F.col("m") >= min_pages).withColumn("log_m", F.log("m"))
    content = 1 - F.col("mass_log") / F.col("mass") / F.col("log_m")
    presentation = 1 - F.col("shape_log") / F.col("m") / F.col("log_m")
    places = seen.select("host", F.col("place").alias("key"), "m", (CONTENT_SHARE * content + (1 - CONTENT_SHARE) * presentation).alias("importance"), "asked")
    often = held.where((F.col("kind") == TEXT) & (F.col("n") > 1)).select("host", "place", "item", "n")
    texts = often.join(seen.select("host", "place", "m", "log_m"), ["host", "place"]).select(
        "host", F.col("item").alias("key"), "m", (1 - F.log("n") / F.col("log_m")).alias("importance")
    )
    return places, texts.where(F.col("importance") < low)


def host_keys(pages: DataFrame, low: float = LOW, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, keys, m, importance), arrays alike in order: what the tree has to say of each host, by the host's hash.

    That is its places and texts of low importance, and the places that pages
    ask for. Texts of low importance stand on over m ** (1 - low) pages each,
    so a host of a million pages with forty texts each has some thousands at
    most; places are those of its templates.
    """
    places, texts = importances(pages, low, min_pages)
    said = places.where((F.col("importance") < low) | F.col("asked")).drop("asked").unionByName(texts)
    packed = said.groupBy("host").agg(F.collect_list(F.struct("key", F.col("m").cast("int").alias("m"), F.col("importance").cast("float").alias("importance"))).alias("said"))
    return packed.select("host", *[F.col("said")[c].alias(c) for c in ("key", "m", "importance")])


def main_text(html: str | None, seen: dict[int, tuple[float, float]] = {}, low: float = LOW) -> str:  # noqa: B006
    """The page's text without what markup rules out and without branches and texts of low importance.

    seen: pages and importance of places and texts of the host. Of a named
    article, low branches go as long as they are the lesser part of it: where
    most of it repeats on other pages, it is the article that repeats. Single
    texts that repeat go outside of named articles only.
    """
    blocks, _ = parse(html)
    kept: list[tuple[Block, bool]] = []
    sizes: dict[int, list[int]] = {}
    for b, prior in zip(blocks, priors(blocks)):
        if prior < 0:
            continue
        weighed = lambda k: (seen[k][0] * seen[k][1] + PRIOR_PAGES * prior) / (seen[k][0] + PRIOR_PAGES) if k in seen else None  # noqa: B023, E731
        told = [weighed(k) for k in (*b.path[1:], *(() if b.region else (_text_key(b.path[-1], b.text),)))]
        stays = (prior if b.path[-1] not in seen else 1.0) >= low and all(x is None or x >= low for x in told)
        kept.append((b, stays))
        if b.region:
            of = sizes.setdefault(b.region, [0, 0])
            of[stays] += len(b.text)
            if prior < low:
                of[1] = -1  # a card stands or falls with what the tree says
    return "\n".join(b.text for b, stays in kept if stays or b.region and 0 <= sizes[b.region][1] <= sizes[b.region][0])


def extract_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", low: float = LOW, min_pages: int = MIN_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars): one row per row of pages.

    Null and empty html give an empty text. A null url is of the empty host.
    Repeated rows stay and read alike. Other columns, whatever their names,
    are not carried. Each page is read whole, twice: for its host's style tree
    and for its text. What the tree says of each host is broadcast if its
    measured size is at most BROADCAST_BYTES. Beyond, pages meet it by host
    and salt: a host is split until no part has over HOT_SHARE of all pages.
    """
    named = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.xxhash64(host_of(F.col(url))).alias("host"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    told = settle(host_keys(pages.select(host_of(F.col(url)).alias("host"), F.coalesce(F.col(html), F.lit("")).alias("html")), low, min_pages))
    size = told.agg(F.coalesce(F.sum(16 * F.size("key") + 64), F.lit(0)).alias("n")).first().n
    joined = named.join(F.broadcast(told), "host", "left") if size <= BROADCAST_BYTES else _by_salted_host(named, told)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = []
            for h, *said in zip(batch["html"], batch["key"], batch["m"], batch["importance"]):
                seen = {k: (m, i) for k, m, i in zip(*(x.tolist() for x in said))} if said[0] is not None else {}
                texts.append(main_text(h, seen, low))
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    kind = dict(pages.dtypes)
    return joined.select("page_id", "url", "html", "key", "m", "importance").mapInPandas(read, f"page_id {kind[key]}, url {kind[url]}, text string, n_chars long")


def _by_salted_host(named: DataFrame, told: DataFrame) -> DataFrame:
    """Pages with what the tree says of their host, hosts with many pages in parts."""
    counts = settle(named.groupBy("host").agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n").alias("n")).first().n or 1
    parts = F.broadcast(counts.where(F.col("n") > HOT_SHARE * total).select("host", F.ceil(F.col("n") / (HOT_SHARE * total)).cast("int").alias("parts")))
    salted = named.join(parts, "host", "left").withColumn("salt", F.pmod(F.xxhash64("page_id", "url", "html"), F.coalesce("parts", F.lit(1))).cast("int"))
    spread = told.join(parts, "host", "left").select(*told.columns, F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("salt"))
    return salted.join(spread, ["host", "salt"], "left")
