"""Main text of HTML pages by two passes of block rules.

A page is cut into blocks at block-level tags; markup, scripts, styles and
comments go, character references are decoded, and white space inside a block
becomes one space.  Pass 1 classifies each block by itself:

* blocks in menus, headers, footers, sidebars, notices, adverts, forms and
  reader comments (by element, role, class or id) are bad;
* blocks whose characters stand mostly in links are bad, unless they are one
  short paragraph;
* in the marked article (``article`` or ``main``) a block of some length is good;
* on pages without a marked article, length and stop-word density decide: long
  running text is good, the rest open.  The stop words are English, German, French
  and Spanish.  Long text in another script than Latin, and all long text of a page
  on which the stop words find less than a quarter of it, is good by its length.
  If no block of such a page is good, as in a dialogue of short lines, all open
  blocks are.

Pass 2 gives open (short) blocks the label that their nearest decided neighbours
share.  Where those differ, a heading takes the label of what follows and any
other block that of the nearer one (bad if equally near).  A marked article is
a run of its own: its ends count as good neighbours, and a block between a good
and a bad neighbour is good.  Good blocks are joined in page order.

Defined results: null or empty html, and pages without good blocks, give an empty
text; repeated pages each get a row; very long pages are read whole in one
pass; an empty table gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, table

LONG, SHORT = 200, 70
LINKS, DENSE, SPARSE = 0.5, 0.30, 0.20

# Frequent function words of the languages handled.
STOP_WORDS = frozenset(
    """
    a an and are as at be been but by can could did do does for from had has have he her his i if in into is it its me my no not of on
    one or our out she so some than that the their them then there these they this to up was we were what when which who will with would you your
    aber als am an auch auf aus bei bin bis da das dass dem den der des die doch du durch ein eine einem einen einer er es für hat ich ihr im in
    ist ja kann man mit nach nicht noch nur ob oder sein sich sie sind so über um und uns von vor war was wenn wie wir wird zu zum zur
    au aux avec c ce ces cette d dans de des du elle en est et eu il ils j je l la le les leur lui mais n ne nous on ont ou où par pas plus pour
    qu que qui s sa se ses son sont sur un une vous
    al como con cuando de del desde donde el ella en entre era es esta este ha hay la las le lo los más muy ni no o para pero por que se ser si
    sin sobre son su sus también un una uno y ya
    """.split()
)
_BLOCKS = frozenset(
    """address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset
    h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th
    thead tr ul""".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BAD_TAGS = frozenset("nav footer aside form button select menu dialog fieldset head".split())
_BAD_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tablist note".split())
_BAD_NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner banners cookie cookies
    consent gdpr notice notices notification alert alerts sidebar sidebars rail widget widgets nav navbar navigation navi menu menus breadcrumb
    breadcrumbs topbar toolbar masthead footer foot colophon comment comments commentlist respond reply replies discussion disqus share sharing
    social related recommended recommendations recommend newsletter subscribe subscription signup login popup popups modal overlay pagination
    pager skip hidden search copyright disclaimer form taboola outbrain trending""".split()
)
#: Of those, names that a page may also give to a wrapper of its whole article.
_LOOSE_NAMES = frozenset("notice notices alert alerts banner banners widget widgets hidden search social share form modal overlay header promo".split())
#: Elements whose end tag may be left out, and the elements that a new one of them ends.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("ul ol dl table select menu".split())
_HEADING = re.compile(r"h[1-6]$")

_TOKEN = re.compile(
    r"""(?P<skip><!--(?:-?>|.*?(?:--!?>|\Z))
      |<(?P<raw>script|style|title|textarea|noscript|template|iframe|svg|object|noembed|noframes|xmp)\b[^>]*+>.*?(?:</(?P=raw)\s*>|\Z)
      |<[!?][^>]*+(?:>|\Z))
      |<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*+)(?P<attrs>(?>[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)>
      |(?P<text>[^<]++|<)""",
    re.S | re.I | re.X,
)
_NAME = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_PART = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")
_WORD = re.compile(r"\w+")
_LETTER = re.compile(r"[^\W\d_]")
_LATIN = re.compile(r"[A-Za-z\u00c0-\u024f\u1e00-\u1eff]")
#: Characters of two columns (Chinese, Japanese, Korean), of which fewer make a long text.
_WIDE = re.compile(r"[\u1100-\u115f\u2e80-\ua4cf\uac00-\ud7a3\uf900-\ufaff\ufe30-\ufe6f\uff00-\uff60\uffe0-\uffe6\U00020000-\U0003fffd]")


class _Element:
    __slots__ = ("tag", "bad", "firm", "void", "up", "known")

    def __init__(self, tag: str, bad: bool, firm: bool, up: _Element | None):
        #: void: excluded by a loose name, but found to hold the article; up: the excluded element around it
        self.tag, self.bad, self.firm, self.void, self.up = tag, bad, firm, False, up
        self.known: bool | None = None


def _out(e: _Element | None) -> bool:
    """Whether an excluded element around a block stands, asked once the page is read."""
    seen = []
    while e is not None and e.known is None and e.void:
        seen.append(e)
        e = e.up
    answer = e is not None and (e.known if e.known is not None else True)
    for x in seen:
        x.known = answer
    return answer


def _excluded(attrs: str, in_article: bool) -> tuple[bool, bool]:
    """Whether the attributes exclude an element, and whether that holds even around an article."""
    loose = False
    for key, value in _NAME.findall(attrs):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" and not value.strip("hidden").strip():
            return True, True
        if key == "aria-hidden" and value.lower() == "true":
            return True, True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, True
        if key == "role" and value.lower() in _BAD_ROLES:
            return True, True
        if key in ("class", "id"):
            for name in value.split():
                parts = [p.lower() for p in _PART.findall(name)]
                if any(p in ("has", "with", "no", "without", "is") for p in parts):
                    continue  # says something about the layout, as in has-sidebar
                names = {p for p in parts if p in _BAD_NAMES or (p == "header" and not in_article)}
                if names - _LOOSE_NAMES:
                    return True, True
                loose = loose or bool(names)
    return loose, False


class _Block:
    __slots__ = ("text", "linked", "heading", "item", "article", "owner", "label")

    def __init__(self, text: str, linked: int, heading: bool, item: bool, article: bool, owner: _Element | None):
        self.text, self.linked, self.heading, self.item, self.article, self.owner = text, linked, heading, item, article, owner
        self.label: bool | None = None


def _blocks(page: str) -> list[_Block]:
    out: list[_Block] = []
    stack: list[_Element] = []
    #: open elements by tag, so that no end tag searches the stack in vain
    open_: Counter[str] = Counter()
    bad_now: _Element | None = None
    parts: list[str] = []
    linked, in_link, article = 0, 0, 0
    heading = False

    def flush() -> None:
        nonlocal linked, heading
        text = " ".join("".join(parts).split())
        if text:
            out.append(_Block(text, linked, heading, open_["li"] > 0, article > 0, bad_now))
        parts.clear()
        linked, heading = 0, False

    def pop_to(i: int) -> None:
        nonlocal article, bad_now
        for e in stack[i:]:
            open_[e.tag] -= 1
            article -= e.tag in ("article", "main") and not e.bad
        for e in reversed(stack[i:]):
            bad_now = e.up if e.bad else bad_now
        del stack[i:]

    for m in _TOKEN.finditer(page):
        if m["text"] is not None:
            text = references.unescape(m["text"])
            parts.append(text)
            if in_link:
                linked += len("".join(text.split()))
            continue
        if m["tag"] is None:
            continue
        tag, attrs = m["tag"].lower(), m["attrs"]
        if tag == "a":
            in_link = 0 if m["end"] else 1
        if tag == "br":
            parts.append(" ")
        block = tag in _BLOCKS
        if block:
            flush()
            in_link = 0 if tag != "a" and block and not m["end"] else in_link
        if m["end"]:
            for i in range(len(stack) - 1, -1, -1) if open_[tag] else ():
                if stack[i].tag == tag:
                    pop_to(i)
                    break
                if stack[i].tag in ("article", "main", "nav", "footer", "aside") and tag not in _BLOCKS:
                    break  # a stray end tag of an inline element ends nothing outside
            continue
        if tag in _VOID:
            continue
        if block and stack and stack[-1].tag == "p":
            pop_to(len(stack) - 1)
        for i in range(len(stack) - 1, -1, -1) if any(open_[x] for x in _ENDS.get(tag, ())) else ():
            if stack[i].tag in _ENDS[tag]:
                pop_to(i)
                break
            if stack[i].tag in _SCOPE:
                break
        named, firm = _excluded(attrs, article > 0) if attrs.strip() and tag not in ("html", "body") else (False, False)
        by_tag = tag in _BAD_TAGS or (tag == "header" and not article)
        bad = named or by_tag
        if block or named:
            stack.append(_Element(tag, bad, firm or (by_tag and tag != "form"), bad_now))
            open_[tag] += 1
            bad_now = stack[-1] if bad else bad_now
        if tag in ("article", "main") and not bad:
            article += 1
            e = bad_now if article == 1 else None
            while e is not None:
                e.void = e.void or not e.firm
                e = e.up
        if _HEADING.match(tag):
            heading = True
    flush()
    return out


def _columns(text: str) -> int:
    return len(text) if text.isascii() else len(text) + len(_WIDE.findall(text))


def _first_pass(b: _Block, marked: bool) -> bool | None:
    if _out(b.owner) or (marked and not b.article):
        return False
    size = len(b.text)
    if b.linked > LINKS * len(b.text.replace(" ", "")):
        return False if b.item or not marked or size > LONG else None
    if marked:
        return True if size >= SHORT and not b.heading else None
    if b.heading or _columns(b.text) < SHORT:
        return None
    found = [w.lower() for w in _WORD.findall(b.text)]
    density = sum(w in STOP_WORDS for w in found) / max(1, len(found))
    return True if density >= DENSE or (density >= SPARSE and size >= LONG) else None


def _by_length(blocks: list[_Block]) -> None:
    """On a page without a marked article, label the long open blocks that the stop words cannot judge."""
    long = [b for b in blocks if b.label is not False and not b.heading and _columns(b.text) >= SHORT]
    other = [b for b in long if b.label is None and 2 * len(_LATIN.findall(b.text)) < len(_LETTER.findall(b.text))]
    for b in other:
        b.label = True
    foreign = set(map(id, other))
    judged = [b for b in long if id(b) not in foreign]
    if 4 * sum(len(b.text) for b in judged if b.label) < sum(len(b.text) for b in judged):
        for b in judged:
            b.label = True


def main_text(page: str | None) -> str:
    """The main text of one page, its blocks joined by an empty line."""
    if not page:
        return ""
    blocks = _blocks(page)
    marked = any(b.article and not _out(b.owner) for b in blocks)
    for b in blocks:
        b.label = _first_pass(b, marked)
    if not marked:
        _by_length(blocks)
        if not any(b.label for b in blocks):
            for b in blocks:
                b.label = b.label is None
    scope = [b for b in blocks if not marked or (b.article and not _out(b.owner))]
    decided = [b.label for b in scope]
    n = len(scope)
    before, after = [-1] * n, [n] * n
    for i in range(1, n):
        before[i] = i - 1 if decided[i - 1] is not None else before[i - 1]
    for i in range(n - 2, -1, -1):
        after[i] = i + 1 if decided[i + 1] is not None else after[i + 1]
    for i, b in enumerate(scope):
        if decided[i] is None:
            # the ends of a marked article count as good neighbours
            left = decided[before[i]] if before[i] >= 0 else (True if marked else None)
            right = decided[after[i]] if after[i] < n else (True if marked else None)
            if left is None or right is None or left == right:
                b.label = left if left is not None else bool(right)
            elif b.heading and (after[i] == i + 1 or not marked):
                b.label = right
            elif marked:
                b.label = True
            else:
                b.label = left if i - before[i] < after[i] - i else right if i - before[i] > after[i] - i else False
    return "\n\n".join(b.text for b in scope if b.label)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(p.as_py()) for p in batch.column(2)]
        yield pa.record_batch(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return map_arrow(p, _extract, "page_id bigint, url string, text string, n_chars bigint")


def op2_two_pass_blocks(spark, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
