"""Main text of web pages by two-pass block rules."""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.common import judged

# Frequent words of the languages the rules know.
STOP_WORDS = frozenset(
    "the of and to in is that it was for on are as with his they be at this have from or had by but not what all were when we "
    "der die das und ist nicht mit von zu den ein eine im für auf dem des sich auch als er sie es an werden aus bei "
    "le la les de et un une des en du que qui est pour dans par sur au avec plus ne pas se ce il "
    "el los las y del que en un una por con para no es al lo su como más se".split()
)

# Elements of HTML by role.
HIDDEN = frozenset("script style noscript template iframe object svg canvas head title textarea select option datalist".split())
FURNITURE = frozenset("nav header footer aside form button menu dialog".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset("article main".split())

# Class, id and role names of furniture.
NAMED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|respond|replies|cookies?|consent|disclaimer|footer|header|masthead|menu|"
    r"modal|nav|navbar|navigation|newsletter|notice|alert|pagination|popup|promo\w*|related|share|sharing|sidebar|social|"
    r"sponsor\w*|subscribe|toolbar|widget|complementary|contentinfo|search)(?:$|[\s_-])",
    re.I,
)
PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^>\"']++|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z)",
    re.S,
)
MARK = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
SPACE = re.compile(r"\s+")

LINKED = 0.33  # share of characters in links from which a block is furniture
LONG, SHORT = 70, 25  # characters
DENSE, SPARSE = 0.30, 0.12  # share of stop words

# Sentences in any language: what ends one, and scripts whose characters each stand for a syllable or a word.
ENDS = re.compile(r"[.!?\u2026\u061f\u06d4\u0589\u0964]+(?=[\"'\u00bb\u201d\u2019)\]]*(?:\s|$))|[\u3002\uff01\uff1f]+")
DENSE_SCRIPT = re.compile(r"[\u0e00-\u0eff\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\uf900-\ufaff]")
WEIGHT = 3  # letters that such a character counts for
SENTENCE = 20  # letters of a sentence on average
LETTERS = 0.75  # share of letters among the characters of prose, white space aside


def _named(name: str, rest: str) -> bool:
    """Does the element's own name or marking say that it is furniture?"""
    if name in FURNITURE:
        return True
    for key, value in MARK.findall(rest):
        key, value = key.lower(), value.strip("\"'").strip()
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key not in ("hidden", "aria-hidden") and NAMED.search(value):
            return True
    return False


def _heading(name: str) -> bool:
    return len(name) == 2 and name[0] == "h" and name[1].isdigit()


def blocks(page: str) -> list[tuple[str, int, int, bool, bool]]:
    """(text, linked characters, article, furniture, heading) of each block in page order.

    `article` numbers the article or main element that holds the block, 0 outside. Elements
    left open are closed by the end of an element around them.
    """
    out: list[tuple[str, int, int, bool, bool]] = []
    stack: list[tuple[str, bool, int, int]] = []  # name, furniture, article, links
    places: defaultdict[str, list[int]] = defaultdict(list)  # of each name, where it stands in the stack
    held: list[int] = []  # where blocks stand in the stack
    headings = 0
    endless: set[str] = set()  # hidden elements that nothing closes any more
    parts: list[str] = []
    linked = articles = at = 0
    furniture, article, links, heading = False, 0, 0, False

    def flush() -> None:
        nonlocal linked
        text = SPACE.sub(" ", unescape("".join(parts))).strip()
        if text:
            out.append((text, linked, article, furniture, heading))
        parts.clear()
        linked = 0

    def close(depth: int) -> None:
        nonlocal headings
        while len(stack) > depth:
            name = stack.pop()[0]
            places[name].pop()
            headings -= _heading(name)
            if name in BLOCKS:
                held.pop()

    n = len(page)
    while at < n:
        m = PIECE.search(page, at)
        piece = page[at : m.start() if m else n]
        if piece:
            parts.append(piece)
            if links:
                linked += len(piece.strip())
        if not m:
            break
        at = m.end()
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if name == "br":
            parts.append(" ")
        if m["close"]:
            if name in BLOCKS:
                flush()
            at_name = places[name]
            if at_name and (name in BLOCKS or not held or held[-1] < at_name[-1]):
                close(at_name[-1])
        else:
            if name in BLOCKS:
                flush()
            if name in EMPTY or m["rest"].endswith("/") and name not in BLOCKS:
                continue
            if name in HIDDEN:
                end = None if name in endless else re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                if end is None:
                    endless.add(name)
                if end is None and name not in ("script", "style"):
                    continue
                at = end.end() if end else n
                if name in BLOCKS:
                    flush()
                continue
            if name == "p" or name == "li":
                while stack and places[name] and stack[-1][0] in (name, "b", "i", "em", "strong", "span"):
                    close(len(stack) - 1)
            was = stack[-1] if stack else ("", False, 0, 0)
            inside = was[2]
            if name in MAIN and not (inside and name == "article"):
                articles += 1
                inside = articles
            places[name].append(len(stack))
            headings += _heading(name)
            if name in BLOCKS:
                held.append(len(stack))
            stack.append((name, was[1] or _named(name, m["rest"]) and name not in ("html", "body", *MAIN) and not (inside and name == "header"), inside, was[3] + (name == "a")))
        top = stack[-1] if stack else ("", False, 0, 0)
        furniture, article, links = top[1], top[2], top[3]
        heading = headings > 0
    flush()
    return out


def foreign(text: str) -> bool:
    """Are most letters of a script that no stop word is written in?"""
    letters = [c for c in text if c.isalpha()]
    return 2 * sum(c > "\u024f" for c in letters) > len(letters)


def prose(text: str) -> bool:
    """Sentences, told without their language: they end as such, are long enough, are made of
    letters, and not every word has a capital, as in a list of names or titles."""
    ends = len(ENDS.findall(text))
    letters = sum(map(str.isalpha, text)) + (WEIGHT - 1) * len(DENSE_SCRIPT.findall(text))
    marks = sum(not c.isspace() and not c.isalpha() and unicodedata.category(c)[0] != "M" for c in text)
    words = [w for w in text.split() if w[0].isalpha()]
    capitals = sum(w[0].isupper() for w in words)
    return ends > 0 and letters >= SENTENCE * ends and letters * (1 - LETTERS) >= marks * LETTERS and 2 * capitals <= len(words) + 1


def decide(text: str, linked: int, furniture: bool, known: bool = True) -> str:
    """First pass: good, bad, near (leaning to good) or short, by a block's own figures.

    Stop words are those of the languages in STOP_WORDS. A block in another script, and with
    `known` false any block, is as dense as prose where it consists of sentences.
    """
    if furniture or linked > LINKED * len(text):
        return "bad"
    words = text.lower().split()
    dense = sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words) / len(words)
    size = len(text)
    if dense < DENSE and (not known or foreign(text)):
        size += (WEIGHT - 1) * len(DENSE_SCRIPT.findall(text))
        if size >= SHORT and prose(text):
            return "good" if size >= LONG else "near"
    if size < SHORT:
        return "short"
    if dense >= DENSE:
        return "good" if len(text) >= LONG else "near"
    if dense >= SPARSE:
        return "near"
    return "short" if len(text) < LONG else "bad"


def main_text(page: str | None) -> str:
    """The page's article: its good blocks in page order, joined by single spaces.

    The second pass lets an undecided block inherit from its nearest decided neighbours: of
    the same article or main element where it stands in one, else of the whole page. Two that agree decide; of two that differ the nearer one does, good winning a
    draw for a near-good block. Where stop words show no good block at all, the page is in a
    language they do not know, and sentences stand in for them. Inside an article a block is bad only by its links or its
    marking, and blocks without a decided neighbour are good. On a page with an article that
    holds a good block, undecided blocks outside of one need good neighbours on both sides.
    """
    found = blocks(page or "")
    first = [decide(text, linked, furniture) for text, linked, _, furniture, _ in found]
    if "good" not in first:
        first = [decide(text, linked, furniture, False) for text, linked, _, furniture, _ in found]
    for i, (text, linked, article, furniture, _) in enumerate(found):
        kind = first[i]
        if article and kind == "bad" and not furniture and linked <= LINKED * len(text):
            first[i] = "near"
    has_main = any(b[2] and kind == "good" for b, kind in zip(found, first))
    n = len(found)
    before, after = [None] * n, [None] * n
    for order, to in ((range(n), before), (range(n - 1, -1, -1), after)):
        last: dict[int, tuple[str, int]] = {}
        for i in order:
            article = found[i][2]
            to[i] = last.get(article)
            if first[i] in ("good", "bad") and not (article and first[i] == "bad"):
                last[article] = last[0] = (first[i], i)
    kept = []
    for i, (text, _, article, _, heading) in enumerate(found):
        kind = first[i]
        if kind in ("near", "short"):
            a, b = before[i], after[i]
            if article and not a and not b:
                kind = "good"
            elif not article and has_main:
                kind = "good" if a and b and a[0] == b[0] == "good" else "bad"
            elif a and b and a[0] != b[0]:
                gap = (i - a[1]) - (b[1] - i)
                kind = a[0] if gap < 0 else b[0] if gap > 0 else "good" if kind == "near" else "bad"
                if heading and b[0] == "good":
                    kind = "good"
            elif a or b:
                kind = (a or b)[0] if not (a and b) else a[0]
            else:
                kind = "good" if kind == "near" else "bad"
        if kind == "good":
            kept.append(text)
    return " ".join(kept)


def extract_text(pages: DataFrame, id: str = "id", url: str = "url", html: str = "html") -> DataFrame:
    """(id, url, text, n_chars), one row per page: the article without the page's furniture.

    The cohort of this library has no web pages, so the operator is general: `pages` holds
    (id, url, html). Markup is cut into blocks; stop-word density, length and link density
    class them, and undecided ones inherit from their neighbours (`main_text`). Pages in any
    language are read: where no stop word is known, sentences count as dense. Menus,
    headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments, told by
    element, class, id or role, are furniture. Character references are decoded, white space
    inside a block becomes one space.

    A null or empty page has an empty text and 0 characters. Null ids and urls are carried,
    repeated pages give a row each. Unclosed elements, unclosed comments and pages of any
    length are read to the end. Other columns are not read.
    """
    rows = pages.select(F.col(id).alias("id"), F.col(url).alias("url"), F.col(html).cast("string").alias("html"))
    texts = judged(rows, "html", lambda pages: [main_text(p) for p in pages], "string", pa.string())
    return texts.select("row.id", "row.url", F.col("value").alias("text"), F.char_length("value").cast("long").alias("n_chars"))
