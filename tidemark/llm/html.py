"""Main text of HTML pages by block rules in two passes.

A page is cut into blocks at block-level tags.  Elements that are never main text (navigation, forms, footers) give none.
Pass one classifies blocks by link density, length and stop-word density; blocks in a container whose class or id names
boilerplate (adverts, comments, sidebars) are boilerplate too, unless no other block of the page reads like text: then
the fullest such container is the text.  Pass two gives the ambiguous blocks the label of their nearest decided neighbours.
In a page with an article, only the article's blocks are candidates, and what stays undecided there is text.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import slices

# Element names of HTML and words of four languages.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section "
    "summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is raw text up to their end tag.
RAW = frozenset("script style textarea title xmp noembed noframes".split())
#: Elements whose text is never part of the page's main text.
DROPPED = frozenset(
    "nav footer aside form head template noscript svg math iframe object canvas audio video select datalist button "
    "dialog menu search map fieldset".split()
)
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
ROLES = frozenset(
    "navigation banner contentinfo complementary search form menu menubar toolbar dialog alertdialog alert "
    "tablist".split()
)
#: Parts of class names and ids that name boilerplate.
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar "
    "submenu breadcrumb breadcrumbs sidebar footer masthead topbar cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social related recommended recommendations widget toolbar pagination pager comment comments "
    "disqus replies responses skip disclaimer paywall tagcloud".split()
)
COMMENT_HINTS = frozenset("comment comments reply replies response responses disqus".split())
STOP_WORDS = frozenset(
    (
        "a about after all also an and any are as at be been but by can for from had has have he her his if in into is it "
        "its more no not of on one or other our she so some than that the their them then there these they this to up "
        "was we were what when which who will with would you your "
        "aber als am an auch auf aus bei das dass dem den der des die durch ein eine einem einen einer er es für hat ich im "
        "in ist mit nach nicht noch nur oder sein sich sie sind so über um und von vor war was wenn wie wird zu zum zur "
        "au aux avec ce ces cette dans de des du elle en est et être il ils je la le les leur mais ne nous on ou par pas "
        "plus pour qu que qui sa se ses son sur un une vous "
        "al como con cuando de del desde donde el ella en entre era es esta este fue ha hasta la las lo los más me mi muy no o "
        "para pero por porque que se ser si sin sobre son su sus también un una y ya"
    ).split()
)

LINK_DENSE = 0.5
SHORT_CHARS = 70
LONG_CHARS = 200
STOP_LOW = 0.2
STOP_HIGH = 0.3
#: Longer blocks with fewer stop words than this and this part of links are lists of links, outside articles.
STOP_NONE = 0.05
LINK_SOME = 0.2
# Parts of names that say nothing of what a container holds, and first parts that turn a name round.
TAILS = frozenset(
    "list item items box wrap wrapper container section block area inner outer bar unit links link panel slot left right top bottom "
    "main body content group row col column holder zone region text form message thread header".split()
)
TURNS = frozenset("no non not with without has hide show".split())
#: A link-dense block of an article is boilerplate up to this length.
LINK_LIST_CHARS = 120

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:=\s*\"[^\"]*\"|=\s*'[^']*'|=|[^>=])*+)>"
    r"|(?P<text>[^<]+|<)",
    re.S,
)
_OPENS = re.compile("</?[a-zA-Z]")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.S)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_LETTERS = re.compile(r"[^\W\d_]+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}


class Block:
    """Text between block tags: its label is True (text), False (boilerplate) or None (ambiguous)."""

    __slots__ = ("heading", "hint", "in_list", "label", "linked", "muted", "scope", "text")

    def __init__(self, text: str, linked: int, heading: bool, in_list: bool, scope: bool, hint: int = 0, muted: int = 0) -> None:
        self.text, self.linked, self.heading, self.in_list, self.scope = text, linked, heading, in_list, scope
        self.muted = muted  # the number of the inline element around it that names itself boilerplate, if any
        self.hint = hint  # the outermost container that names itself boilerplate: its number, negative for reader comments
        self.label: bool | None = None


def _named(value: str, hints: frozenset[str]) -> bool:
    """Whether one of the names in a class or id is, by its last part that says something, one of the hints."""
    for name in value.split():
        parts = [x.lower() for x in _PART.findall(name) if not x.isdigit()]
        if not parts or parts[0] in TURNS:
            continue
        while len(parts) > 1 and parts[-1] in TAILS:
            parts.pop()
        if parts[-1] in hints:
            return True
    return False


def _hidden(attributes: dict[str, str]) -> bool:
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return True
    return "style" in attributes and bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes["style"], re.I))


def _hinted(name: str, attributes: dict[str, str]) -> int:
    """1 if the element names itself boilerplate, -1 if reader comments, else 0."""
    if name in ("html", "body", "main"):
        return 0
    value = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    if _named(value, COMMENT_HINTS):
        return -1
    if name == "article":
        return 0
    return int(attributes.get("role", "").strip().lower() in ROLES or _named(value, HINTS))


class _Muted:
    """An open inline element that names itself boilerplate: its own text goes; blocks inside it go if its end tag comes before its parent's end."""

    __slots__ = ("inner", "level", "name", "nested", "number")

    def __init__(self, name: str, level: int, number: int) -> None:
        self.name, self.level, self.number, self.nested, self.inner = name, level, number, 1, False


def _attributes(rest: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for key, a, b, c in _ATTRIBUTE.findall(rest):
        found.setdefault(key.lower(), html.unescape(a or b or c))
    return found


def blocks_of(page: str) -> list[Block]:
    """The page's blocks in order, without those in boilerplate containers."""
    found: list[Block] = []
    stack: list[tuple[str, bool, bool]] = []  # open block-level elements: name, dropped, outermost hinted
    bad = scope = header = links = 0
    hint = hints = 0
    parts: list[str] = []
    linked = 0
    opens: Counter[str] = Counter()  # names on the stack
    muted: _Muted | None = None
    closed: set[int] = set()  # muted elements whose end tag came

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            heading = any(n in HEADINGS for n, *_ in stack[-2:])
            if text:
                lists = any(n in ("li", "td", "th", "dd", "dt", "ul", "ol") for n, *_ in stack[-3:])
                block = Block(text, min(linked, len(text)), heading, lists, scope > 0, hint, muted.number if muted and muted.inner else 0)
                # In an article's header only headings and what reads like text count.
                if not header or heading or reads_like_text(block):
                    found.append(block)
            parts, linked = [], 0

    def pop() -> None:
        nonlocal bad, scope, header, hint, muted
        name, was, opened = stack.pop()
        opens[name] -= 1
        if muted and len(stack) < muted.level:
            muted = None
        bad -= was
        hint = 0 if opened else hint
        if not was and name in ("article", "main"):
            scope -= 1
        if name == "header":
            header -= 1

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.match(page, at)
        if m["text"] == "<" and _OPENS.match(page, at):  # a tag that never ends holds the rest of the page
            break
        at = m.end()
        text = m["text"] if m["text"] is not None else m["cdata"]
        if text is not None:
            if not bad and not (muted and not muted.inner):
                text = html.unescape(text) if "&" in text and m["cdata"] is None else text
                parts.append(text)
                if links:
                    linked += len(text.strip())
            continue
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if m["close"]:
            if name == "a":
                links = max(0, links - 1)
            elif name in BLOCKS or name in DROPPED:
                flush()
                if muted:
                    muted.inner = True
                if opens[name]:
                    while stack[-1][0] != name:
                        pop()
                    pop()
            elif muted and name == muted.name:
                muted.nested -= 1
                if not muted.nested:
                    if muted.inner:
                        flush()
                    closed.add(muted.number)
                    muted = None
            continue
        if name in RAW:
            end = _RAW_END[name].search(page, at)
            if end is None:
                break
            close = page.find(">", end.end())
            at = size if close < 0 else close + 1
            continue
        if name == "a":
            links = 1  # links don't nest
            continue
        if name == "br":
            parts.append(" ")
            continue
        attributes = _attributes(m["rest"]) if m["rest"] else {}
        if name in BLOCKS or name in DROPPED:
            flush()
            if muted:
                muted.inner = True
            links = 0 if name in BLOCKS and name not in ("div", "p", "li") else links
            if stack and stack[-1][0] == "p":
                pop()
            elif stack and name == stack[-1][0] and name in ("li", "td", "th", "tr", "dd", "dt", "option"):
                pop()
            if name in VOID:
                continue
            if m["rest"].endswith("/") and name in ("svg", "iframe", "object"):
                continue
            was = name in DROPPED or _hidden(attributes)
            kind = 0 if hint or was else _hinted(name, attributes)
            if kind:
                hints += 1
                hint = kind * hints
            # An article's own header keeps its headings; a page's header is boilerplate.
            if name == "header":
                header += 1
                was = was or not scope
            stack.append((name, was, kind != 0))
            opens[name] += 1
            bad += was
            if not was and name in ("article", "main"):
                scope += 1
        elif name == "body":
            links = 0
        elif name in VOID:
            continue
        elif muted:
            muted.nested += name == muted.name
        elif attributes and (_hidden(attributes) or _hinted(name, attributes)):
            hints += 1
            muted = _Muted(name, len(stack), hints)
    flush()
    return [b for b in found if b.muted not in closed]


def _stop_density(text: str) -> float:
    words = _LETTERS.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def reads_like_text(b: Block) -> bool:
    """Long, rich in stop words and poor in links."""
    size = len(b.text)
    if size < SHORT_CHARS or b.heading or b.linked > LINK_DENSE * size:
        return False
    stops = _stop_density(b.text)
    return stops >= STOP_HIGH or (stops >= STOP_LOW and size >= LONG_CHARS)


def trusted(blocks: list[Block]) -> list[Block]:
    """The blocks outside hinted containers; if none of them reads like text, those of the fullest hinted one as well."""
    if not any(b.hint == 0 and reads_like_text(b) for b in blocks):
        sizes: dict[int, int] = {}
        for b in blocks:
            if b.hint > 0 and reads_like_text(b):
                sizes[b.hint] = sizes.get(b.hint, 0) + len(b.text)
        if sizes:
            best = max(sizes, key=lambda h: (sizes[h], -h))
            return [b for b in blocks if b.hint in (0, best)]
    return [b for b in blocks if b.hint == 0]


def pass_one(rows: list[Block], inside: bool) -> list[bool | None]:
    """True for text, False for boilerplate, None for the ambiguous."""
    found: list[bool | None] = []
    for b in rows:
        size, label = len(b.text), None
        if b.linked > LINK_DENSE * size and not b.heading:
            label = False if not inside or (b.in_list and size <= LINK_LIST_CHARS) else None
        elif reads_like_text(b):
            label = True
        elif not inside and size >= SHORT_CHARS and not b.heading and b.linked > LINK_SOME * size and _stop_density(b.text) < STOP_NONE:
            label = False
        found.append(label)
    return found


def pass_two(labels: list[bool | None], headings: list[bool], inside: bool) -> list[bool]:
    """The ambiguous take the label of the nearest decided block, of two at one distance True; a heading that of what follows it.

    Where nothing is decided all is text; in an article, what isn't boilerplate on both sides is.
    """
    before: list[tuple[int, bool | None]] = []
    last: tuple[int, bool | None] = (1 << 30, None)
    for label in labels:
        last = (0, label) if label is not None else (last[0] + 1, last[1])
        before.append(last)
    found: list[bool] = []
    last = (1 << 30, None)
    for i in range(len(labels) - 1, -1, -1):
        label = labels[i]
        last = (0, label) if label is not None else (last[0] + 1, last[1])
        if label is None:
            (d1, l1), (d2, l2) = before[i], last
            near = l1 if d1 < d2 else l2 if d2 < d1 else (l1 or l2)
            if headings[i] and l2 is not None:
                near = l2
            label = True if near is None or (inside and not (l1 is False and l2 is False)) else near
        found.append(label)
    return found[::-1]


def classify(blocks: list[Block]) -> list[Block]:
    """Label the blocks; those of an article alone, if there is one with text."""
    kept = trusted(blocks)
    inside = any(b.scope for b in kept)
    rows = [b for b in kept if b.scope] if inside else kept
    for b, label in zip(rows, pass_two(pass_one(rows, inside), [b.heading for b in rows], inside), strict=True):
        b.label = label
    return rows


def main_text(page: str) -> str:
    """The main text: blocks joined by an empty line."""
    return "\n\n".join(b.text for b in classify(blocks_of(page)) if b.label)


def extract_text(pages: DataFrame, column: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages; n_chars counts code points.

    Null or empty html, and pages without main text, give the empty text.  page_id and url may be
    null or repeat; each row is extracted by itself.  Pages of any length are read whole.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col(column).alias("html")
    )

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [main_text(x) if x else "" for x in batch.column("html").to_pylist()]
            yield pa.record_batch(
                [
                    batch.column("page_id"),
                    batch.column("url"),
                    pa.array(texts, type=pa.string()),
                    pa.array([len(t) for t in texts], type=pa.int64()),
                ],
                names=["page_id", "url", "text", "n_chars"],
            )

    return rows.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
