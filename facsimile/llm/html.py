"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags (and at two line breaks in a
row). Pass one labels each block by itself:

* blocks inside menus, page headers, footers, sidebars, notices, adverts,
  forms or comments (by element, role, class or id), and blocks outside an
  ``article`` or ``main`` element where the page has one, are bad. A class or
  id counts by whole names that say nothing else (``sidebar-left``, but not
  ``has-sidebar`` or ``social-science``), and never against an ``article`` or
  ``main`` inside it, unless the page has another one outside;
* blocks that are mostly links are bad (inside ``article`` or ``main`` they are
  undecided);
* of the others, long blocks with many stop words are good; medium ones are
  nearly good; short ones and those with few stop words (code, tables, names)
  are undecided. Where blocks with stop words are a small part of the page's
  text, as in other languages, length alone tells good from nearly good.

Pass two gives undecided and nearly good blocks the label of their nearest
decided neighbours, before and after: equal labels are taken over, otherwise
the nearer one counts (nearly good blocks become good if either is). Blocks
inside ``article`` or ``main`` look no further than that element, which itself
counts as good.

Script, style, template, text field and comment contents never become text. Character
references are decoded after the tags are gone, white space in a block becomes
one space, and good blocks are joined in page order by an empty line. Nothing
else is dropped or cut.

Null html counts as empty and gives an empty text, like pages without any good
block. Repeated rows keep their rows, null ids and urls are passed on. An empty
table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facsimile.llm.common import ship, text_of
from facsimile.llm.tokens import text_slices

# Elements of HTML by their role here. The contents of RAW are not read.
RAW = "script style textarea title template head".split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
BLOCK = (
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul"
).split()
HEADINGS = "h1 h2 h3 h4 h5 h6".split()
BOILERPLATE = "nav footer aside form menu dialog button fieldset select object canvas audio video".split()
ROLES = "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split()
# Words in class and id names that mark a part as not the article.
MARKS = (
    "ad ads adv advert advertisement advertising adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr login masthead "
    "menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promotion related share sharing sidebar signup social "
    "sponsor sponsored subscribe teaser toolbar widget widgets"
).split()
# Words that may stand beside a mark word in a class or id name without
# changing what it says; any other word (has-sidebar, no-comments, social-science) does.
PLAIN = (
    "area article bar block body bottom box button buttons container content css desktop element en fixed float footer form global group header home icon icons inner item items js large left "
    "link links list main mobile module new nav outer page panel post posts primary right row secondary section simple site small stories story sub text title top ul unit view wrap wrapper"
).split()
# Words that make a marked name that of a layout around the article.
AROUND = "content layout main page wrap wrapper".split()
# Frequent function words of the corpus languages.
STOP_WORDS = frozenset(
    "a about after all also an and are as at be because been but by can could for from had has have he her his how i if in into is it its more no not of on one or our out "
    "she so some than that the their them then there these they this to was we were what when which who will with would you your "
    "aber als am an auch auf aus bei das dass dem den der des die durch ein eine einem einen einer er es für hat ich im in ist mit nach nicht noch nur oder sich sie sind so über um und "
    "uns von vor war was wenn werden wie wir wird zu zum zur "
    "au aux avec ce ces cette comme dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou où par pas plus pour qu que qui sa se ses son sont sur un une vous "
    "al algo como con cuando de del desde donde el ella en entre era es esta este fue ha hay la las lo los más me mi muy no nos o para pero por porque que se si sin sobre su sus también te un una y ya".split()
)
SHORT, LONG = 70, 200  # characters
STOP_LOW, STOP_HIGH = 0.30, 0.32
SPOKEN = 0.2  # share of characters in blocks with stop words, below which stop words tell nothing
LINKS = 0.5  # share of characters in links

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)", re.S)
_NAME = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
_WORD = re.compile(r"[^\W\d_]+")
_RAW, _VOID, _BLOCK, _BOILER, _MARKS, _ROLES, _PLAIN, _AROUND = map(frozenset, (RAW, VOID, BLOCK, BOILERPLATE, MARKS, ROLES, PLAIN, AROUND))
OPEN, MARKED, BAD = range(3)  # how a part stands: unmarked; marked by a class, id or role above the article; not the article


@dataclass
class Block:
    text: str
    linked: int  # characters in links
    main: int  # number of the article or main element, 0: outside
    bad: bool  # inside a part that is not the article
    marked: bool  # the article or main element itself lies in a marked part
    heading: bool
    label: str = ""


def _says(name: str) -> bool:
    """Whether one class or id name marks a part that is not the article."""
    words = [w for w in re.split(r"[_-]+", name) if w]
    marks = [w in _MARKS for w in words]
    if not any(marks):
        return False
    if words[0] in _AROUND and words[-1] in _AROUND:  # content-sidebar-wrap
        return False
    return all(m or w in _PLAIN or len(w) == 1 or w.isdigit() for w, m in zip(words, marks))


def _marked(attributes: str) -> bool:
    for m in _NAME.finditer(attributes):
        value = (m[2] or m[3] or m[4] or "").lower()
        if m[1].lower() == "role":
            if value.strip() in _ROLES:
                return True
        elif any(map(_says, value.split())):
            return True
    return False


def blocks_of(page: str) -> list[Block]:
    """Blocks of a page in order, texts decoded and trimmed."""
    out: list[Block] = []
    pieces: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, int, int, bool]] = []  # tag, how the part stands, main element, whether that is marked
    open_tags: Counter = Counter()
    state = {"link": False, "breaks": 0, "mains": 0}

    def end_block():
        text = " ".join(references.unescape("".join(pieces)).split())
        if text:
            tag, stands, main, marked = stack[-1] if stack else ("", OPEN, 0, False)
            size = len(" ".join(references.unescape("".join(linked)).split()))
            out.append(Block(text, size, main, stands == BAD or (stands == MARKED and not main), marked, tag in HEADINGS))
        pieces.clear()
        linked.clear()
        state["breaks"] = 0

    def add(text):
        if text:
            pieces.append(text)
            if state["link"]:
                linked.append(text)
            if not text.isspace():
                state["breaks"] = 0

    at, size = 0, len(page)
    while at < size:
        m = _MARKUP.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        closing = m[1] == "/"
        if tag == "br":
            state["breaks"] += 1
            if state["breaks"] > 1:
                end_block()
            else:
                pieces.append(" ")
            continue
        if tag in _RAW:
            if not closing and tag != "head":
                end = _RAW_END[tag].search(page, at)
                at = end.start() if end else size
            if tag in ("title", "head"):
                end_block()
            continue
        if tag in _BLOCK:
            end_block()
        elif tag == "a":
            state["link"] = not closing
        if closing:
            if open_tags[tag]:
                while True:
                    name = stack.pop()[0]
                    open_tags[name] -= 1
                    if name == tag:
                        break
                if tag in _BLOCK:
                    state["link"] = False
        elif tag not in _VOID and not m[0].endswith("/>"):
            _, stands, main, marked = stack[-1] if stack else ("", OPEN, 0, False)
            if tag in ("article", "main") and not main and stands != BAD:
                state["mains"] += 1
                main, marked = state["mains"], stands == MARKED
            elif tag in _BOILER or (tag == "header" and not main):
                stands = BAD
            elif m[3] and tag not in ("html", "body", "article", "main") and stands != BAD and _marked(m[3]):
                stands = BAD if main else MARKED
            if tag in ("p", "li", "a") and stack and stack[-1][0] == tag:
                open_tags[stack.pop()[0]] -= 1  # these do not nest
            stack.append((tag, stands, main, marked))
            open_tags[tag] += 1
    end_block()
    return out


def classify(blocks: list[Block]) -> list[Block]:
    """The good blocks. Labels: good, bad; in between near and short."""
    if any(b.main and not b.marked and not b.bad for b in blocks):
        for b in blocks:  # the article is elsewhere: these are teasers or comments
            b.bad = b.bad or b.marked
            b.main = 0 if b.marked else b.main
    has_main = any(b.main for b in blocks)
    dense = []  # stop words' share of each block
    spoken = long = 0  # characters of blocks with stop words, and of all that stop words are to judge
    for b in blocks:
        words = _WORD.findall(b.text.lower())
        dense.append(sum(w in STOP_WORDS for w in words) / max(1, len(words)))
        if not b.bad and (b.main or not has_main) and b.linked / len(b.text) <= LINKS and len(b.text) >= SHORT:
            long += len(b.text)
            spoken += len(b.text) * (dense[-1] >= STOP_LOW)
    by_length = spoken < SPOKEN * long
    for b, stop in zip(blocks, dense):
        link = b.linked / len(b.text)
        if b.bad or (has_main and not b.main):
            b.label = "bad"
        elif link > LINKS:
            b.label = "short" if b.main else "bad"
        elif len(b.text) < SHORT:
            b.label = "short" if b.main or not b.linked else "bad"
        elif by_length or stop >= STOP_HIGH or (b.main and stop >= STOP_LOW):
            b.label = "good" if len(b.text) > LONG else "near"
        elif stop >= STOP_LOW:
            b.label = "near"
        else:
            b.label = "short"
    n = len(blocks)
    before: list[tuple[int, str]] = [(n, "")] * n  # distance and label of the decided neighbour
    after = list(before)
    for order, found in ((range(n), before), (range(n - 1, -1, -1), after)):
        last: tuple[int, str] | None = None
        main = None
        for i in order:
            if blocks[i].main != main:
                main = blocks[i].main
                if main:
                    last = (i, "good")  # the element itself
                elif has_main:
                    last = (i, "bad")
            found[i] = (abs(i - last[0]), last[1]) if last else (n + 1, "bad")
            if blocks[i].label in ("good", "bad") and not (blocks[i].bad and main):  # an advert inside an article says nothing of its neighbours
                last = (i, blocks[i].label)
    good = []
    for b, (d1, l1), (d2, l2) in zip(blocks, before, after):
        label = b.label
        if label == "near":
            label = "good" if "good" in (l1, l2) else "bad"
        elif label == "short":
            label = l1 if l1 == l2 or d1 < d2 else l2 if d2 < d1 or b.heading else "good" if b.main else "bad"
        if label == "good":
            good.append(b)
    return good


def main_text(page: str | None) -> str:
    return "\n\n".join(b.text for b in classify(blocks_of(page or "")))


def _extract(batches):
    for batch in batches:
        for at, pages in text_slices(batch, "html"):
            texts = [main_text(p) for p in pages]
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, len(pages)), batch.column("url").slice(at, len(pages)), pa.array(texts, pa.string())], ["id", "url", "text"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text) of every page."""
    ship(pages.sparkSession)
    slim = pages.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), text_of(html_col).alias("html"))
    return slim.mapInArrow(_extract, "id bigint, url string, text string")
