"""Main text of web pages by block rules in two passes.

A page is cut into blocks at block-level tags. The first pass classifies each block by itself:
by link density, length and the share of stop words. Blocks inside elements that never hold the
article (navigation, header, footer, sidebar, form and the like), or whose class or id names
such a part, are boilerplate. The second pass settles the blocks that are too short to judge:
headings that lead to text, and short blocks by their nearest decided neighbours.

Where a page marks its article (``article`` or ``main``), blocks outside the mark and in other
containers are boilerplate and have no vote; those inside go through both passes like any other, and the mark is one more
piece of evidence: a block that is short, or of middle length with few stop words, is kept if one
neighbour is text or none is decided. A marked page without text inside the mark is judged as a
whole. Articles inside another one, and articles whose class or id begins with a word for comments,
are tested like other containers. Short blocks that are mostly words of buttons, by-lines or dates,
and notices, are boilerplate wherever they stand; they are known by short fixed lists in the
languages of the stop words.

Defined results: a null page, an empty page and a page without article text give the empty text.
Repeated rows give one row each. Broken markup is read as browsers do in the common cases:
unclosed paragraphs end at the next block, unknown tags are dropped, a "<" that begins no tag is
text, an unclosed comment or script ends with the page. Time grows with the length of a page, however
its markup is broken: every scan goes on where the last one ended, or is not repeated.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Thresholds, element and word lists.
MAX_LINK_DENSITY = 0.33
SHORT_CHARS = 70
LONG_CHARS = 200
STOP_LOW, STOP_HIGH = 0.10, 0.20
HEADING_REACH = 200  # characters between a heading and the text that it leads to
# elements whose content is never text of the page
OPAQUE = frozenset("script style noscript template svg math canvas iframe object head select textarea button datalist audio video".split())
# elements that hold other things than the article
OUTSIDE = frozenset("nav header footer aside form dialog menu search fieldset".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th "
    "thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# words of class and id names (split at other characters and at capitals) that mark such parts
PARTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners breadcrumb breadcrumbs comment comments commentlist "
    "consent cookie cookies copyright disclaimer disqus feedback footer header login masthead menu menubar modal nav navbar navigation "
    "newsletter notice notices overlay pager pagination paywall popup promo promotion promoted recommend recommended recommendations related "
    "reply replies respond reviews share sharing sidebar signup skip social sponsor sponsored subscribe subscription survey tagcloud tags "
    "teaser toc toolbar trending widget widgets gdpr privacy alert notification".split()
)
# names like "has-sidebar" speak of the page; a header of these is the title of the article
LAYOUT = frozenset("has with without no".split())
CONTENT = frozenset("article entry post content story page title".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
STOP_WORDS = frozenset(
    "a about after all also an and any are as at be because been but by can could did do for from had has have he her his how i if in into is it "
    "its more my no not of on one only or other our out she so some than that the their them then there they this to up was we were what when "
    "which who will with would you your "
    "aber alle als am an auch auf aus bei bin bis da das dass dem den der des die doch du durch ein eine einem einen einer er es für hat ich ihr "
    "im ist ja kann man mehr mit nach nicht noch nur oder sein sich sie sind so um und uns unter vom von vor war was weil wenn wie wir wird zu zum zur über "
    "au aux avec ce ces cette comme dans de des du elle en est et eux il ils je la le les leur lui mais me même ne nous on ou où par pas plus pour "
    "qu que qui sa se ses son sur un une vous été être à "
    "al como con cuando de del desde donde el ella en entre era es esta este fue ha hasta la las le les lo los me mi muy más ni o para pero por porque "
    "que se ser si sin sobre son su sus también te un una y ya".split()
)
# words of article elements that hold what readers wrote
COMMENTS = frozenset("comment comments commentlist reply replies response respond".split())
# words of buttons and of lines about an article
BAR_WORDS = frozenset(
    "share tweet email print pin save follow facebook twitter whatsapp linkedin pinterest reddit instagram telegram copy link comments likes views "
    "shares advertisement sponsored published updated posted filed tagged subscribe login signup bookmark min read "
    "teilen drucken merken folgen anzeige veröffentlicht aktualisiert kommentare lesezeit "
    "partager imprimer suivre publicité publié commentaires compartir imprimir guardar seguir publicidad publicado actualizado comentarios".split()
)
BAR_SHARE = 0.5
# a name, or names, after the word for "by", and perhaps a date; no sentence
BYLINE = re.compile(r"(?:written |posted |published )?(?:by|von|par|por):? (?:[A-ZÀ-Þ][\w.'’-]*+(?: (?:and|und|et|y|de|von|van))?[ ,|·•–—-]*){1,6}(?:(?:on |am |le |el )?\W*\d[\w\s.,:/|-]*)?", re.I)
DATE = re.compile(r"[\W\d]*(?:[^\W\d]+[\W\d]+){0,3}(?:19|20)\d\d(?:[\W\d]|am|pm|utc|gmt|uhr)*", re.I)
NOTICE = re.compile(
    r"all rights reserved|alle rechte vorbehalten|tous droits réservés|todos los derechos reservados|privacy policy|datenschutzerklärung"
    r"|politique de confidentialité|política de privacidad|terms of (?:use|service)|uses? cookies|accept (?:all )?cookies|cookies? (?:policy|settings)"
    r"|ad ?blocker|sign up|subscribe|our newsletter|unseren newsletter|notre newsletter|nuestro boletín|you agree to",
    re.I,
)
TAG_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
# attributes whose quotes, if any, open and close values
CLEAN = re.compile(r"(?:[^\"'=]|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])))*+")
OPEN_QUOTE = re.compile(r"=\s*+([\"'])")
ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
WORD = re.compile(r"[^\W\d_]+")
# closing tags that a block of this name implies for an open one
CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


class Tags:
    """The tags of a page in order, in time proportional to its length.

    A tag ends at the first ">" outside quoted values; a quote opens a value only behind "=", and
    one that is never closed counts as a letter. Where even then no ">" follows outside quotes, quotes
    are letters from there on. A "<" without any later ">" is text.
    """

    def __init__(self, page: str):
        self.page, self.quoted = page, True
        self.last = {c: page.rfind(c) for c in "\"'>"}

    def _end(self, at: int) -> int:
        """Place of the ">" that ends the tag whose name ends at ``at``; there is one behind it."""
        first = stop = self.page.find(">", at)
        if first < 0 or CLEAN.fullmatch(self.page, at, first):
            return first
        while self.quoted:
            if 0 <= stop < at:
                stop = self.page.find(">", at)
            until = stop if stop >= 0 else len(self.page)
            found = OPEN_QUOTE.search(self.page, at, until)
            while found and self.last[found.group(1)] < found.end():
                found = OPEN_QUOTE.search(self.page, found.end(), until)
            if found:
                at = self.page.find(found.group(1), found.end()) + 1
            elif stop >= 0:
                return stop
            else:
                self.quoted = False
        return first

    def __iter__(self):
        """Yields (begin, end, closing, name, attributes, literal): text in place of the tag, for character data."""
        page, position = self.page, 0
        while (begin := page.find("<", position)) >= 0:
            if page.startswith("<!--", begin):
                end = page.find("-->", begin + 4)
                position = end + 3 if end >= 0 else len(page)
                yield begin, position, "", None, "", ""
            elif page.startswith("<![CDATA[", begin):
                end = page.find("]]>", begin + 9)
                position = end + 3 if end >= 0 else len(page)
                yield begin, position, "", None, "", page[begin + 9 : end if end >= 0 else len(page)]
            elif page.startswith(("<!", "<?"), begin):
                end = page.find(">", begin)
                position = end + 1 if end >= 0 else len(page)
                yield begin, position, "", None, "", ""
            elif self.last[">"] < begin:
                return
            else:
                found = TAG_NAME.match(page, begin + 1)
                if not found:
                    position = begin + 1
                    continue
                end = self._end(found.end())
                position = end + 1
                skip = yield begin, position, found.group(1), found.group(2).lower(), page[found.end() : end], ""
                if skip is not None:  # the reader goes on behind it
                    position = skip
                    yield None


class Block:
    __slots__ = ("text", "links", "outside", "inside", "heading", "label", "prior")

    def __init__(self, text, links, outside, inside, heading):
        self.text, self.links, self.outside, self.inside, self.heading = text, links, outside, inside, heading
        self.label, self.prior = None, False


def _marks_part(attributes: str, name: str, nested: bool = False) -> bool:
    """Whether the attributes of a tag say that it holds something else than the article.

    ``nested``: it stands inside an article. Others are named after what they are about, too.
    """
    for key, a, b, c in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), a or b or c
        if key == "hidden" or (key == "aria-hidden" and value.strip().lower() == "true"):
            return True
        if key == "role" and value.strip().lower() in ROLES:
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if key in ("class", "id") and name == "article" and not nested:
            if any(words and words[0].lower() in COMMENTS for words in map(NAME.findall, value.split())):
                return True
        elif key in ("class", "id") and name not in ("html", "body", "main"):
            for one in value.split():
                words = {w.lower() for w in NAME.findall(one)}
                if words & LAYOUT:
                    continue
                found = words & PARTS
                if found - ({"header"} if words & CONTENT else set()):
                    return True
    return False


def blocks_of(page: str) -> list[Block]:
    """Text blocks of a page in order, with the lengths of their links and where they stand."""
    out: list[Block] = []
    open_: list[tuple[str, bool]] = []  # elements that matter, and whether they hold other things
    outside = inside = anchors = 0
    heading = False
    parts: list[str] = []
    linked: list[str] = []

    def end_block():
        nonlocal parts, linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                links = len(" ".join(entities.unescape("".join(linked)).split()))
                out.append(Block(text, links, outside > 0, inside > 0, heading))
            parts, linked = [], []

    def pop():
        """Close the innermost element."""
        nonlocal outside, inside, heading
        name, other = open_.pop()
        held[name] -= 1
        if floor and floor[-1] == len(open_):
            floor.pop()
        outside -= other
        inside -= name in ("article", "main")
        if name in HEADINGS:
            heading = False
        return name

    position, length = 0, len(page)
    tags = iter(Tags(page))
    unclosed: set[str] = set()  # elements whose end is not found any more
    held: Counter = Counter()  # names in ``open_``
    floor: list[int] = []  # places in ``open_`` of blocks that are no headings, and options

    for begin, end, closing, name, attributes, literal in tags:
        text = page[position:begin]
        if text:
            parts.append(text)
            if anchors:
                linked.append(text)
        position = end
        if name is None:
            if literal:
                parts.append(entities.escape(literal))
            continue
        if name in OPAQUE and not closing:
            if not attributes.endswith("/") or name in ("script", "style"):
                found = None if name in unclosed else re.compile(rf"</{name}\s*+>", re.I).search(page, position)
                if found is None and name not in unclosed:
                    unclosed.add(name)
                    if name == "head":
                        found = re.compile(r"(?=<body[\s>])", re.I).search(page, position)
                if found:
                    position = found.end()
                elif name != "head":
                    position = length
                tags.send(position)
            parts.append(" ")
            continue
        if name == "a":
            anchors = 0 if closing else 1
            continue
        if name == "br":
            parts.append(" ")
            if anchors:
                linked.append(" ")
            continue
        other = not closing and name not in VOID and (name in OUTSIDE or _marks_part(attributes, name, inside > 0))
        if name not in BLOCKS and not other and not held[name]:
            continue
        if name in BLOCKS or other or closing:
            end_block()
            anchors = 0 if name in BLOCKS else anchors
        if closing:
            if held[name]:
                while pop() != name:
                    pass
            continue
        # an open paragraph or item ends here
        innermost = open_[floor[-1]][0] if floor else None
        if innermost in CLOSES.get(name, ()) or (innermost == "p" and name in BLOCKS):
            while pop() != innermost:
                pass
        if name in VOID or attributes.endswith("/"):
            continue
        # a header inside the article holds its title
        if name == "header" and inside and not _marks_part(attributes, name):
            other = False
        if (name in BLOCKS and name not in HEADINGS) or name == "option":
            floor.append(len(open_))
        held[name] += 1
        open_.append((name, other))
        outside += other
        inside += name in ("article", "main")
        if name in HEADINGS:
            heading = True
    if position < length:
        parts.append(page[position:])
        if anchors:
            linked.append(page[position:])
    end_block()
    return out


def _is_bar(text: str, words: list[str]) -> bool:
    """Whether a short block is a row of buttons, a by-line or a date."""
    if words and sum(w in BAR_WORDS for w in words) >= BAR_SHARE * len(words) and any(w in BAR_WORDS for w in words):
        return True
    return bool(DATE.fullmatch(text)) or (text[-1] not in "!?" and _is_byline(text))


def _is_byline(text: str) -> bool:
    if not BYLINE.fullmatch(text):
        return False
    names = WORD.findall(text)[1:]
    return len(names) > 1 and sum(w[0].isupper() for w in names) >= 0.6 * len(names)


def _first_pass(b: Block, prior: bool) -> str:
    """The class of a block by itself; ``prior``: it stands inside the article that the page marks.

    "out" is "bad", but says nothing about its neighbours inside a mark.
    """
    n = len(b.text)
    density = b.links / n
    words = WORD.findall(b.text.lower())
    stop = sum(w in STOP_WORDS for w in words) / max(len(words), 1)
    if density > MAX_LINK_DENSITY:
        if prior and b.heading:
            return "short"
        return "near" if prior and n >= LONG_CHARS and stop >= STOP_HIGH else "bad"
    if "©" in b.text[:3] or "©" in b.text[-3:]:
        return "out"
    if not b.heading and n <= LONG_CHARS:
        notices = len({m.lower() for m in NOTICE.findall(b.text)})
        if notices > 1 or (notices and stop < STOP_HIGH) or (n < SHORT_CHARS and _is_bar(b.text, words)):
            return "out"
    if n < SHORT_CHARS:
        return "bad" if b.links and not prior else "short"
    if stop >= STOP_HIGH:
        return "good" if n > LONG_CHARS else "near"
    if stop >= STOP_LOW or n > LONG_CHARS:
        return "near"
    return "short" if prior else "bad"


def classify(blocks: list[Block]) -> list[Block]:
    """Blocks of the article, in page order."""
    marked = any(b.inside and not b.outside for b in blocks)
    for b in blocks:
        b.prior = marked
        b.label = "out" if b.outside or (marked and not b.inside) else _first_pass(b, marked)
    voting = [b for b in blocks if not marked or b.label != "out"]
    for b in voting:
        b.label = "bad" if b.label == "out" else b.label
    _inherit(voting)
    return [b for b in voting if b.label == "good"]


def _inherit(blocks: list[Block]) -> None:
    """Second pass: short and nearly good blocks follow their nearest decided neighbours."""
    n = len(blocks)
    before, after = [None] * n, [None] * n
    last = None
    for i, b in enumerate(blocks):
        before[i] = last
        last = b.label if b.label in ("good", "bad") else last
    near_before, near_after = [None] * n, [None] * n
    for order, into in ((range(n), near_before), (range(n - 1, -1, -1), near_after)):
        last = None
        for i in order:
            into[i] = last
            last = "good" if blocks[i].label in ("good", "near") else "bad" if blocks[i].label == "bad" else last
    last = None
    for i in range(n - 1, -1, -1):
        after[i] = last
        last = blocks[i].label if blocks[i].label in ("good", "bad") else last
    final = []
    for i, b in enumerate(blocks):
        label = b.label
        if label == "short":
            sides = {near_before[i], near_after[i]}
            if b.heading:
                label = "good" if near_after[i] == "good" or (b.prior and near_after[i] is None and not b.links) else "bad"
            elif b.prior:
                label = "good" if "good" in sides or sides == {None} else "bad"
            else:
                label = "good" if sides == {"good"} else "bad"
        elif label == "near":
            sides = {before[i], after[i]}
            label = "bad" if sides == {"bad"} and len(b.text) < LONG_CHARS else "good"
        final.append(label)
    for b, label in zip(blocks, final):
        b.label = label


def main_text(page: str | None) -> str:
    """The article of a page: its blocks joined by line breaks."""
    return "\n".join(b.text for b in classify(blocks_of(page or "")))


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""

    def run(batches):
        for batch in batches:
            texts = [main_text(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    source = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long")
