"""Main text of web pages: the maximum-scoring run of words and tags, with weights learned from labelled pages."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup "
    "time tt u var wbr".split()
)
#: Elements whose words are never part of an article, and words of class, id and role that mark such elements.
NEVER = frozenset(
    "aside button canvas datalist dialog footer form head iframe input math menu nav noscript object script select style svg template "
    "textarea title video audio".split()
)
MARKS = frozenset(
    "ad ads adsbygoogle advert advertisement adverts alert alerts aside banner breadcrumb breadcrumbs byline-share comment commentlist comments complementary contentinfo consent "
    "cookie cookies disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices notification pagination "
    "pager popup promo promoted promotion recommended related replies respond search share sharing sidebar sitenav skip social "
    "sponsor sponsored subscribe subscription subnav toolbar topbar topnav widget".split()
)
#: Marks of parts that may hold more words than the text they follow.
AFTER = frozenset("comment comments commentlist disqus recommended related replies respond".split())
#: Parts of names that tell a layout, or a part of the text, from the marked thing itself.
LAYOUT = frozenset("no has with without layout wrapper wrap container content entry post page article results main body story".split())
#: What a name may hold besides marks to mark a part inside an article; ``related-work`` and ``ad-hoc`` are the article's own.
DETAIL = frozenset("area bar block bottom box button buttons form icons inline inner item items left link links list posts right section signup slot thread top unit".split())
#: Marks that inside an article name its own heading.
HEADS = frozenset(["header", "masthead", "banner"])
ARTICLE = frozenset(["article", "main"])
#: Elements whose content is text up to their end tag; all others have elements inside and go by the stack.
RAW = "script|style|textarea|title"

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)(?=[\s/>])[^>]*>|\Z)|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)[^>]*>|(?P<text>[^<]+|<)",
    re.S | re.I,
)
#: Elements in which a slash before the closing bracket ends the element.
FOREIGN = frozenset(["svg", "math", "iframe"])
#: Elements that hold a page's text, by which a marked element is known to be a layout around it.
_PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li".split())
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_WORD = re.compile(r"\S+")
#: Weight of a word or tag whose surroundings were never seen, least cost of a tag, and greatest weight of anything.
UNSEEN_WORD, TAG_COST, MOST = 0.5, 0.1, 4.0


@dataclass
class Element:
    tag: str
    name: str
    dropped: bool
    article: bool
    near: str
    foreign: bool = False
    paragraph: bool = False
    #: The innermost marked element that this one is or is in.
    mark: int = -1


@dataclass
class Token:
    """A text node or a tag, with what surrounds it."""

    text: str | None
    tag: str
    near: str
    dropped: bool
    inside: bool
    breaks: bool
    opens: str = ""
    mark: int = -1
    paragraph: bool = False


def is_mark(name: str, marks: frozenset[str], inside: bool = False) -> bool:
    """A whole name, or one whose parts are a mark and what numbers or details it, such as ``sidebar-left`` or ``main-nav``.

    Inside an article every part must be a mark, a number or one of ``DETAIL``.
    """
    parts = [part for part in re.split(r"[-_]+", name) if part]
    if name in marks:
        return True
    if inside and not all(part in MARKS or part in DETAIL or part.isdigit() for part in parts):
        return False
    return any(part in marks for part in parts) and not any(part in LAYOUT for part in parts)


def tokens(page: str) -> list[Token]:
    """Text nodes and tags in page order.  Unclosed and stray tags are tolerated; comments and raw elements are skipped.

    A marked element is dropped unless it is a layout around the text: if it holds an article or main element or, on a page without
    one, most of the words in paragraphs.
    """
    # Marked elements in page order: the one around each (-1: none), and whether it is one of ``AFTER``.
    around_of: list[int] = []
    after: list[bool] = []
    items = list(_tokens(page, around_of, after))
    if not around_of:
        return items
    layout = [False] * len(around_of)
    if any(t.opens in ARTICLE for t in items):
        for t in items:
            mark = t.mark if t.opens in ARTICLE else -1
            while mark >= 0 and not layout[mark]:
                layout[mark] = True
                mark = around_of[mark]
    else:
        words, total = [0] * len(around_of), 0
        for t in items:
            if t.paragraph and not t.dropped and t.text is not None:
                n = len(_WORD.findall(t.text))
                total += n
                if t.mark >= 0:
                    words[t.mark] += n
        # Elements come after those around them.
        for mark in range(len(words) - 1, -1, -1):
            layout[mark] = 2 * words[mark] > total
            if around_of[mark] >= 0:
                words[around_of[mark]] += words[mark]
    gone: list[bool] = []
    for mark, outer in enumerate(around_of):
        gone.append(after[mark] or not layout[mark] or (outer >= 0 and gone[outer]))
    for t in items:
        t.dropped = t.dropped or (t.mark >= 0 and gone[t.mark])
    return items


def _closed(m: re.Match) -> bool:
    """Did a comment or raw element end where it should, and not with the page?"""
    if m["raw"]:
        return re.search(rf"</{m['raw']}(?=[\s/>])[^>]*>\Z", m[0], re.I) is not None
    return not m[0].startswith("<!--") or m[0].endswith("-->")


def _tokens(page: str, around_of: list[int], after: list[bool]) -> Iterator[Token]:
    """Tokens, with the marked elements around them, for which none is dropped yet; the two lists get what is known of marked elements.

    Nothing after the last closing bracket can be a tag, so that is not searched for one.
    """
    stack, opened = [Element("", "", False, False, "")], Counter()
    last, end = None, page.rfind(">") + 1
    for last in _TOKEN.finditer(page, 0, end):
        m, top = last, stack[-1]
        if m["text"] is not None:
            yield Token(html.unescape(m["text"]), top.tag, top.near, top.dropped, top.article, False, "", top.mark, top.paragraph)
            continue
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        breaks, opens = tag not in INLINE, ""
        if m["end"] or m["end2"]:
            if opened[tag]:
                depth = next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag)
                for element in stack[depth:]:
                    opened[element.tag] -= 1
                del stack[depth:]
            top = stack[-1]
        elif tag not in VOID and not ((top.foreign or tag in FOREIGN) and m[0].endswith("/>")):
            if breaks and top.tag == "p":
                opened[stack.pop().tag] -= 1
                top = stack[-1]
            if tag in ("li", "tr", "td", "th", "dt", "dd", "option") and top.tag == tag:
                opened[stack.pop().tag] -= 1
                top = stack[-1]
            names, hidden = [], False
            for key, value in _ATTR.findall(m["attrs"] or ""):
                value = value.strip("\"'").lower()
                if key.lower() in ("hidden", "aria-hidden"):
                    hidden |= key.lower() == "hidden" or value == "true"
                else:
                    names += value.split()
            marks = MARKS - HEADS if top.article else MARKS
            found = [n for n in names if is_mark(n, marks, top.article)] if tag not in ("html", "body") and tag not in ARTICLE else []
            mark = top.mark
            if found:
                around_of.append(top.mark)
                after.append(any(part in AFTER for n in found for part in (n, *re.split(r"[-_]", n))))
                mark = len(around_of) - 1
            dropped = top.dropped or tag in NEVER or hidden or (tag == "header" and not top.article)
            near = top.near if tag in INLINE or tag in ("p", "br") else ".".join([tag, *names[:1]])
            stack.append(Element(
                tag, near, dropped, top.article or tag in ARTICLE, near, top.foreign or tag in FOREIGN, top.paragraph or tag in _PARAGRAPH, mark,
            ))
            opened[tag] += 1
            top, opens = stack[-1], tag
        yield Token(None, tag, top.near, top.dropped, top.article, breaks, opens, top.mark)
    if end < len(page) and (last is None or _closed(last)):
        top = stack[-1]
        yield Token(html.unescape(page[end:]), top.tag, top.near, top.dropped, top.article, False, "", top.mark, top.paragraph)


def context(token: Token) -> tuple[str, str]:
    kind = "word" if token.text is not None else "tag"
    return f"{kind} {token.tag} in {token.near}", f"{kind} {token.tag}"


def best_run(values: list[float]) -> tuple[int, int]:
    """Bounds of the contiguous run of greatest sum, empty if no sum is positive; ties: the first that reaches it."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for k, value in enumerate(values):
        if total <= 0:
            total, start = 0.0, k
        total += value
        if total > best:
            best, span = total, (start, k + 1)
    return span


@dataclass(frozen=True)
class PageModel:
    """Log odds of lying in the main text, by surroundings and, where those are unknown, by element."""

    weights: dict[str, float] = field(default_factory=dict)

    def weight(self, token: Token) -> float:
        full, short = context(token)
        known = self.weights.get(full, self.weights.get(short))
        if token.dropped:
            return 0.0
        if token.text is None:
            return min(-TAG_COST, known if known is not None else -TAG_COST)
        return known if known is not None else UNSEEN_WORD

    def extract(self, page: str) -> str:
        """Blocks of the best run of tokens, in page order, joined by newlines."""
        items = tokens(page)
        first, end = best_run([self.weight(t) * (1 if t.text is None else len(_WORD.findall(t.text))) for t in items])
        blocks, now = [], []
        for token in items[first:end]:
            if token.text is None:
                if token.breaks:
                    blocks.append("".join(now))
                    now = []
            elif not token.dropped:
                now.append(token.text)
        blocks.append("".join(now))
        clean = (" ".join(block.split()) for block in blocks)
        return "\n".join(block for block in clean if block)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        inside, outside = Counter(), Counter()
        for page in batch.column("html").to_pylist():
            items = tokens(page)
            if not any(t.inside and t.text is not None and not t.dropped for t in items):
                continue
            for token in items:
                if token.dropped:
                    continue
                counts = inside if token.inside else outside
                n = len(_WORD.findall(token.text)) if token.text is not None else 1
                for key in context(token):
                    counts[key] += n
        keys = list(inside.keys() | outside.keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), pa.array([inside[k] for k in keys], pa.int64()), pa.array([outside[k] for k in keys], pa.int64())],
            names=["key", "inside", "outside"],
        )


def learn_pages(pages: DataFrame, most_contexts: int = 20_000) -> PageModel:
    """Weights from the pages that label their own main text with ``article`` or ``main``, all of them.

    Every word and tag of such a page counts for or against its surroundings; the ``most_contexts`` most frequent ones make the
    model.  Pages without a label, and null pages, teach nothing; with none of them the default weights hold.
    """
    labelled = pages.where(F.col("html").cast("string").rlike("(?i)<(article|main)[\\s>]")).select(F.col("html").cast("string").alias("html"))
    counts = labelled.mapInArrow(_contexts, "key string, inside long, outside long").groupBy("key").agg(
        F.sum("inside").alias("inside"), F.sum("outside").alias("outside")
    ).orderBy(F.desc(F.col("inside") + F.col("outside")), "key").limit(most_contexts).collect()
    return PageModel({
        r["key"]: max(-MOST, min(MOST, log((r["inside"] + 0.5) / (r["outside"] + 0.5)))) for r in counts
    })


def _extract(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: PageModel = shared.value
        for batch in batches:
            texts = [model.extract(page) if page else "" for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"]
            )

    return run


def extract_pages(pages: DataFrame, model: PageModel) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages(page_id, url, html)``, from whole pages.

    Words and tags are scored with the model's weights, and one linear scan finds the contiguous run of greatest total.  Menus, headers, footers,
    sidebars, notices, adverts, forms, scripts, styles and reader comments, by element, class, id or role, score nothing, so that a run may
    pass over them, and are left out of its text.  Character references are
    decoded, white space inside a block becomes one space, blocks are joined by one newline; a line break ends a block.
    Null, empty and wordless pages give an empty text; repeated rows and null ids are answered as they are; of equal runs
    the first is taken; other columns are ignored.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")
    )
    found = rows.mapInArrow(_extract(shared), "page_id long, url string, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))
