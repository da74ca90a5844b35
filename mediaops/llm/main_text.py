"""Main text of web pages by two passes of block rules."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import slices

#: Elements of HTML by the part they play here.
HIDDEN = frozenset("script style noscript template title textarea select option svg math iframe object canvas audio video head button".split())
RAW = frozenset("script style title textarea noscript iframe".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ARTICLES = frozenset(["article", "main"])
OUTSIDE = frozenset("nav footer aside form menu dialog".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Words in class and id attributes that name what is not the article.
OUTSIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement banner breadcrumb breadcrumbs comment comments comentarios kommentare cookie cookies consent disqus "
    "footer gdpr header login masthead menu modal nav navbar navigation newsletter notice pagination pager popup promo related replies reply "
    "respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
#: Names of what consists of small articles itself: an article element within is no reason to leave it.
SMALL_ARTICLES = frozenset("ad ads adv advert adverts advertisement comment comments comentarios kommentare disqus promo related replies reply respond sponsored".split())
#: Parts of a name that say what holds the named thing, and first parts by which a name is about something else.
_HOLDERS = frozenset("area bar block body box container content group inner items links list section slot unit wrap wrapper".split())
#: Parts that say where or of what kind the named thing is, or of what it is a list: they leave an outside first part the main one.
_KINDS = frozenset("articles bottom buttons desktop entries form icons left lower main mobile news nested posts primary right secondary stories sticky topics top upper".split())
_ABOUT = frozenset("has have hide is no not show with without".split())
_OWN_HEADERS = frozenset("article content entry news page post story title".split())
#: Frequent words of the languages at hand.
_LANGUAGES = [frozenset(words.split()) for words in (
    "a an and are as at be by for from had has have he her his i in is it its not of on or she that the their they this to was were which will with you",
    "au aux avec ce dans de des du elle en est et il la le les mais ne nous ou par pas pour qui que se son sur un une vous",
    "als auch auf aus bei das dem den der die durch ein eine er es für ich im ist mit nach nicht sich sie sind so und von war wie zu",
    "al como con del el esta este fue ha las lo los más no para pero por si sin su sus y de en es la que se un")]
STOP_WORDS = frozenset().union(*_LANGUAGES)

NAMED, OUT = 1, 2

_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)/?>|<!--(.*?)-->|<[!?][^>]*>", re.S)
_NAMED = re.compile(r"\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORDS = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Rules:
    """Limits of the first pass: characters of a short and of a long block, and densities of stop words and links."""
    short: int = 70
    long: int = 200
    few_stop_words: float = 0.15
    stop_words: float = 0.25
    links: float = 0.4


@dataclass
class Block:
    """What lies between block boundaries."""
    outside: bool
    region: int
    heading: bool
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def _names(value: str) -> set[str]:
    """The outside names that are the main part of a class or id: its last part that is no holder, or its first if the others only describe it."""
    found = set()
    for name in value.lower().split():
        parts = [x for x in re.split(r"[^a-z0-9]+", name) if x]
        while len(parts) > 1 and parts[-1] in _HOLDERS:
            parts.pop()
        if not parts or parts[0] in _ABOUT or (parts[-1] == "header" and not _OWN_HEADERS.isdisjoint(parts[:-1])):
            continue
        if parts[-1] in OUTSIDE_NAMES:
            found.add(parts[-1])
        elif parts[0] in OUTSIDE_NAMES and all(x in _HOLDERS or x in _KINDS or x in OUTSIDE_NAMES or x.isdigit() for x in parts[1:]):
            found.add(parts[0])
    return found


def blocks_of(html: str) -> list[Block]:
    """The non-empty blocks of a page in order. ``region`` numbers the article a block lies in, 0 outside."""
    out: list[Block] = []
    # Open elements that matter: (name, outside, region, hidden, heading). Outside by a wrapper's name alone is NAMED.
    open_: list[tuple[str, int, int, bool, bool]] = [("", 0, 0, False, False)]
    block = Block(False, 0, False)
    at, links, regions = 0, 0, 0

    def close() -> None:
        nonlocal block
        block.text = " ".join("".join(block.pieces).split())
        if block.text:
            out.append(block)
        _, outside, region, _, heading = open_[-1]
        block = Block(bool(outside), region, heading)

    def add(piece: str) -> None:
        if piece and not open_[-1][3]:
            piece = unescape(piece)
            block.pieces.append(piece)
            if links:
                block.linked += len(piece)

    while at < len(html):
        tag = _TAG.search(html, at)
        if tag is None:
            add(_unfinished(html[at:]))
            break
        add(_unfinished(html[at:tag.start()]))
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue
        if tag[1]:
            if name == "a":
                links = max(0, links - 1)
            for k in range(len(open_) - 1, 0, -1):
                if open_[k][0] == name:
                    del open_[k:]
                    break
            if name in BLOCKS:
                close()
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if name == "br":
            add(" ")
        if name == "a":
            links += 1
        if name in VOID:
            if name == "hr":
                close()
            continue
        if name == "p" or name in ("li", "td", "th", "tr", "dd", "dt"):
            # Such elements end where the next one of their kind begins, unless a list or table lies between.
            for k in range(len(open_) - 1, 0, -1):
                if open_[k][0] == name:
                    del open_[k:]
                    break
                if open_[k][0] in BLOCKS:
                    break
        if name in BLOCKS or name in HIDDEN:
            if name in BLOCKS:
                links = 0
            _, outside, region, hidden, heading = open_[-1]
            if name in ARTICLES and not region:
                regions += 1
                region = regions
                outside = 0 if outside == NAMED else outside
            if name in OUTSIDE or (name == "header" and not region):
                outside = OUT
            if tag[3]:
                said = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _NAMED.finditer(tag[3])}
                if said.get("role", "").lower() in OUTSIDE_ROLES:
                    outside = OUT
                elif name not in ("html", "body", *ARTICLES) and (names := _names(f"{said.get('class', '')} {said.get('id', '')}")):
                    outside = max(outside, NAMED if names.isdisjoint(SMALL_ARTICLES) else OUT)
                hidden = hidden or "hidden" in said or said.get("aria-hidden") == "true"
            open_.append((name, outside, region, hidden or name in HIDDEN, heading or name in ("h1", "h2", "h3", "h4", "h5", "h6")))
            if name in BLOCKS:
                close()
    close()
    return out


def _unfinished(text: str) -> str:
    """Text between tags; a tag that never ends takes what follows with it."""
    broken = re.search(r"<(?:/?[A-Za-z]|!--)", text)
    return text[:broken.start()] if broken else text


def known_language(blocks: list[Block], rules: Rules) -> bool:
    """The longer blocks inside hold stop words of one of the languages as its prose does, or there are none."""
    words = [w for b in blocks if not b.outside and len(b.text) >= rules.short and b.linked <= rules.links * len(b.text) for w in _WORDS.findall(b.text.lower())]
    return not words or max(sum(w in language for w in words) for language in _LANGUAGES) >= rules.few_stop_words * len(words)


def decided(block: Block, rules: Rules, known: bool = True) -> bool | None:
    """First pass: article or not, or None for blocks too short or mixed to tell. Length and links decide where no language is ``known``."""
    if block.outside:
        return False
    size = len(block.text)
    if block.linked > rules.links * size:
        # The article's own elements say where it is: there, links are its author's.
        return None if block.region else False
    if size < rules.short:
        return None
    if not known:
        return True if size >= rules.long else None
    words = _WORDS.findall(block.text.lower())
    stops = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if stops >= rules.stop_words or (stops >= rules.few_stop_words and size >= rules.long):
        return True
    if block.region and size >= rules.long:
        return True
    return None if stops >= rules.few_stop_words or block.region else False


def main_text(html: str | None, rules: Rules = Rules()) -> str:
    """The article of a page, its blocks joined by newlines; empty if there is none."""
    blocks = blocks_of(html or "")
    known = known_language(blocks, rules)
    labels = [decided(b, rules, known) for b in blocks]
    kept = []
    for i, (block, label) in enumerate(zip(blocks, labels, strict=True)):
        if label is None:
            label = _inherited(blocks, labels, i)
        if label:
            kept.append(block.text)
    return "\n".join(kept)


def _inherited(blocks: list[Block], labels: list[bool | None], i: int) -> bool:
    """Second pass: the label of the nearest decided neighbours.

    Within an article only those of the article count, and blocks of menus and the like never do: their elements
    say where they end.
    """
    region = blocks[i].region

    def nearest(step: int) -> tuple[int, bool | None]:
        k = i + step
        while 0 <= k < len(blocks) and not (region and blocks[k].region != region):
            if labels[k] is not None and not blocks[k].outside:
                return abs(k - i), labels[k]
            k += step
        return len(blocks), None

    (before, a), (after, b) = nearest(-1), nearest(1)
    if a is None and b is None:
        return bool(region) or not any(x.region for x in blocks)
    if a is None or b is None or a == b:
        return bool(b if a is None else a)
    if before != after:
        return bool(a if before < after else b)
    return bool(region) or blocks[i].heading and bool(b)


def extract(pages: DataFrame, *, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", rules: Rules = Rules()) -> DataFrame:
    """(id, url, text, n_chars) per page: the main text of its whole html.

    A null or empty page has an empty text; every row is kept, repeated ones each; other columns play no part.
    """
    rows = pages.select(F.col(id_column).alias("id"), F.col(url_column).alias("url"), F.col(html_column).cast("string").alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    names = [id_column, url_column, "text", "n_chars"]

    def run(batches):
        for batch in slices(batches, "html"):
            texts = [main_text(h, rules) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=names)

    return rows.mapInArrow(run, f"`{id_column}` {kinds['id']}, `{url_column}` {kinds['url']}, text string, n_chars long")
