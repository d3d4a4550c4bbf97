"""Operator 9: main text of web pages.

The method named for this operator, differencing of pages with near URLs, can't give right results where menus, adverts
and footers differ from page to page and where a host serves one article under two URLs (see the README for figures).
Blocks are told apart by the page's own structure instead: one pass over the tags with a stack of open elements.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release_memory, small_batches

#: Comments, declarations and tags; the last alternative takes tags with odd quotes.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?|"[^"]*"|'[^']*'""")
#: Elements whose content is no text of the page, up to their end tag. Those in SWALLOWING take the rest of the page where
#: that is missing, as in browsers; of the others only the tag goes.
SWALLOWING = frozenset("script style".split())
OPAQUE = SWALLOWING | frozenset("noscript template textarea iframe svg title select object xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
#: Elements that never belong to an article, and those that do so only inside one.
CHROME = frozenset("head nav footer aside form button dialog menu option datalist fieldset".split())
#: Words of class, id and role that mark menus, notices, adverts, sidebars and reader comments.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert modal popup overlay "
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar side-bar aside complementary contentinfo footer header masthead topbar toolbar search searchbox "
    "comment comments disqus replies reply respond newsletter subscribe signup share sharing social related recommended recommendations widget pagination pager skip skip-link".split()
)
#: Words that go with those of NAMES in a name of several words, as in `cookie-bar`.
FILLERS = frozenset("area bar body bottom box block container content footer form group header holder inner item items left links list main outer panel posts right section slot text top unit wrap wrapper".split())
#: First words of classes that mark chrome whatever follows, as in `nav-primary`.
FAMILIES = frozenset("ad ads advert comment comments cookie footer menu nav promo sidebar".split())
MAIN = frozenset(("article", "main"))
#: What an element ends whose end tag was left out; other blocks end a paragraph.
ENDED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements that no name makes chrome: the page itself, and headings, whose ids name their topics.
PLAIN = frozenset("html body h1 h2 h3 h4 h5 h6".split())


def is_name(word: str) -> bool:
    """Whether a class, id or role marks chrome: a name of NAMES, or several words all of which are such names, fillers or numbers."""
    if word in NAMES:
        return True
    parts = [x for x in re.split(r"[-_]+", word) if x and not re.fullmatch(r"\d+(x\d+)?", x)]
    return bool(parts) and not NAMES.isdisjoint(parts) and all(x in NAMES or x in FILLERS for x in parts)


def is_chrome(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element and all in it are left out. inside: within an article, where a header is the article's own."""
    if tag in CHROME or tag == "header" and not inside:
        return True
    if not attributes or tag in PLAIN or tag in MAIN:
        return False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name in ("class", "id", "role") and any(map(is_name, value.split())):
            return True
        if name == "class" and any(re.split("[-_]", x, maxsplit=1)[0] in FAMILIES for x in value.split()):
            return True
    return False


def main_text(page: str | None) -> str:
    """Blocks of the article, or of the body without its chrome, one in a line.

    The body is taken where there is no article, and where what stands outside of articles is the larger part: then they are teasers."""
    if not page:
        return ""
    stack: list[tuple[str, bool, bool]] = []  # (tag, left out, within an article)
    blocks: list[tuple[bool, str]] = []
    run: list[str] = []
    at, hidden, inside = 0, False, False
    ends: dict[str, re.Pattern] = {}
    endless: set[str] = set()

    def close() -> None:
        if run:
            s = "".join(run)
            run.clear()
            if s := " ".join((html.unescape(s) if "&" in s else s).split()):
                blocks.append((inside, s))

    while m := TOKEN.search(page, at):
        if not hidden and m.start() > at:
            run.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        attributes = m[3] or m[6] or ""
        if not tag:  # a comment or a declaration
            continue
        if tag in OPAQUE:
            if not (m[1] or m[4] or attributes.endswith("/") and tag not in SWALLOWING) and tag not in endless:
                if tag not in ends:
                    ends[tag] = re.compile(f"</{tag}\\s*>", re.I)
                if end := ends[tag].search(page, at):
                    at = end.end()
                elif tag in SWALLOWING:
                    at = len(page)
                else:
                    endless.add(tag)
            continue
        if tag in VOID:
            if not hidden and tag in ("br", "hr"):
                if tag == "hr":
                    close()
                else:
                    run.append(" ")
            continue
        if m[1] or m[4]:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), -1)
            if k < 0:
                if tag not in INLINE and not hidden:
                    close()
                continue
            if tag in INLINE and any(x[0] not in INLINE for x in stack[k + 1 :]):
                continue  # an inline end tag doesn't close blocks
            if any(x[0] not in INLINE for x in stack[k:]) and not hidden:
                close()
            del stack[k:]
            hidden, inside = stack[-1][1:] if stack else (False, False)
            continue
        if tag not in INLINE:
            if not hidden:
                close()
            for k in range(len(stack) - 1, -1, -1):  # an element that this one ends, as a paragraph by any block
                if stack[k][0] in ENDED.get(tag, ("p",)):
                    del stack[k:]
                    hidden, inside = stack[-1][1:] if stack else (False, False)
                    break
                if stack[k][0] not in INLINE and not (tag in ENDED and stack[k][0] in ("p", "div", "td", "th")):
                    break
        out = hidden or is_chrome(tag, attributes, inside)
        within = inside or tag in MAIN and not out
        if out and not hidden:
            close()
        stack.append((tag, out, within))
        hidden, inside = out, within
    if not hidden and at < len(page):
        run.append(page[at:])
    close()
    size = sum(len(s) for within, s in blocks if within)
    whole = 2 * size < sum(len(s) for _, s in blocks)
    return "\n".join(s for within, s in blocks if within or whole)


def extracted(page: Column | str) -> Column:
    @F.arrow_udf("string")
    def texts(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in column:
            yield pa.array([main_text(p) for p in pages.to_pylist()], pa.string())
        release_memory()

    return texts(page)


def html_extraction(pages: DataFrame, page: str = "html") -> DataFrame:
    """pages with text and n_chars (code points), which replace columns of these names.

    Null and empty pages have an empty text. Rows are independent: repeated rows get equal texts, null ids and urls pass,
    an empty table stays empty. One pass, no shuffle."""
    small_batches(pages.sparkSession)
    return pages.withColumn("text", extracted(F.col(page))).withColumn("n_chars", F.char_length("text").cast("long"))
