"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import html
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daygauge.llm.common import batches, query, table

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
_HINTS = re.compile(r"""(?:^|\s)(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none|visibility\s*:\s*hidden""", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？।]")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup; it ends at their end tag, and without one those in the second set go on to the end of the page.
RAW = frozenset("script style iframe noembed noframes xmp textarea title".split())
ENDLESS = frozenset("script style textarea title".split())
#: Elements of their own kind of content: a tag that starts a block of a page ends them, if their own end tag is missing.
FOREIGN = frozenset("svg select".split())
#: Elements that hold no article text, whatever their paths' ratios are.
OUTSIDE = frozenset("head nav footer aside button menu dialog fieldset datalist audio video canvas map applet noscript template object "
                    "annotation annotation-xml".split()) | RAW | FOREIGN
#: Words of class, id or role that mark an element (as does being a form), which goes unless it holds what the page is about; an
#: article, main, body or html element is never one.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted nav navbar navigation menu "
    "breadcrumb breadcrumbs footer colophon sidebar aside comment comments disqus reply replies respond cookie cookies consent gdpr notice notices "
    "notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "recommendations widget widgets pagination pager toolbar masthead copyright legal banner complementary contentinfo search "
    "skip skyscraper teaser taboola outbrain".split())
TRUSTED = frozenset("html body main article".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup "
    "time tt u var wbr "
    "math mrow mi mn mo ms mtext mspace mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover "
    "mmultiscripts mprescripts mtable mtr mtd semantics annotation annotation-xml".split())
#: These do not end a block of text that stands around them.
UNBROKEN = INLINE | RAW | FOREIGN | VOID - {"hr", "col"} | frozenset("noscript template object audio video canvas map button".split())
#: What a start tag ends if it is open nearer than the tags in the second set.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
        "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Leaves that belong to an article whose paragraphs are their siblings, although short.
COMPANIONS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th figcaption caption".split())
#: What may stand between such a leaf and the parent of a content path.
BETWEEN = frozenset("ul ol dl li table thead tbody tfoot tr blockquote figure header hgroup".split())
#: Start tags that end a foreign element.
STARTERS = COMPANIONS | BETWEEN | TRUSTED | frozenset("div section nav footer aside form".split())


def _marked(attributes: str) -> bool:
    for found in _HINTS.finditer(attributes):
        value = found[1] or found[2] or found[3] or ""
        if any(t.lower() in MARKS for t in _TOKEN.findall(value)):
            return True
    return False


class _Marks:
    """Marked elements by the place of their start tag: those around each block, those within an article or main element, and which
    of these two each of them holds."""

    def __init__(self):
        self.around: list[tuple[int, ...]] = []
        self.within: set[int] = set()
        self.holds: dict[int, set[str]] = {}


def _parsed(page: str, kept: frozenset[int] = frozenset(), marks: _Marks | None = None) -> list[tuple[tuple[str, ...], str]]:
    """The blocks of a page without its marked elements, but for those in ``kept``; with ``marks`` no marked element is left out
    and ``marks`` is filled."""
    found: list[tuple[tuple[str, ...], str]] = []
    stack: list[tuple[str, bool]] = []
    open_: list[tuple[int, int]] = []  # depth and place of marked elements
    outside = foreign = 0
    parts: list[str] = []
    at = 0

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                found.append((tuple(name for name, _ in stack if name not in INLINE), text))
                if marks is not None:
                    marks.around.append(tuple(place for _, place in open_))
            parts.clear()

    def close(depth: int) -> None:
        nonlocal outside, foreign
        while len(stack) > depth:
            name, dropped = stack[-1]
            marked = bool(open_) and open_[-1][0] == len(stack) - 1
            if not outside and (marked or name not in UNBROKEN):
                flush()
            if marked:
                open_.pop()
            stack.pop()
            outside -= dropped
            foreign -= name in FOREIGN

    while True:
        tag = _MARKUP.search(page, at)
        if not outside:
            parts.append(page[at:tag.start() if tag else len(page)])
        if tag is None:
            break
        at = tag.end()
        name = (tag[2] or tag[5] or "").lower()
        if not name:
            continue
        attributes = tag[3] or tag[6] or ""
        inline = name in INLINE
        if name == "br" or name == "wbr":
            if not outside and name == "br":
                parts.append("\n")
            continue
        if foreign and name in STARTERS and not (tag[1] or tag[4]):
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == "foreignobject":
                    break
                if stack[depth][0] in FOREIGN:
                    close(depth)
                    break
        if not outside and name not in UNBROKEN:
            flush()
        if tag[1] or tag[4]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    close(depth)
                    break
                if inline and stack[depth][0] not in INLINE:
                    break
            continue
        if name in VOID:
            continue
        if name not in UNBROKEN:
            ended, within = ENDS.get(name, (frozenset(), frozenset()))
            for depth in range(len(stack) - 1, -1, -1):
                other = stack[depth][0]
                if other in ended:
                    close(depth)
                elif other == "p":
                    close(depth)
                    break
                elif other in within or other not in INLINE and other not in ended and not ended:
                    break
        if name in RAW and not attributes.endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\b[^>]*+(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page) if name in ENDLESS else at
            continue
        if attributes.endswith("/"):
            continue
        drop = name in OUTSIDE or name not in TRUSTED and _HIDDEN.search(attributes) is not None
        if name == "header":
            drop = drop or not any(n in ("article", "main") for n, _ in stack)
        if not drop and not outside and (name == "form" or name not in TRUSTED and _marked(attributes)):
            place = tag.start()
            if marks is None:
                drop = place not in kept
            else:
                flush()
                open_.append((len(stack), place))
                marks.holds[place] = set()
                if any(n in ("article", "main") for n, _ in stack):
                    marks.within.add(place)
        if marks is not None and not outside and not drop and name in ("article", "main"):
            for _, place in open_:
                marks.holds[place].add(name)
        stack.append((name, drop))
        outside += drop
        foreign += name in FOREIGN
    flush()
    return found


def _smooth(x: list[float]) -> list[float]:
    wide = [x[0], *x, x[-1]]
    return [(wide[i] + 2 * wide[i + 1] + wide[i + 2]) / 4 for i in range(len(x))]


def _ratios(found: list[tuple[tuple[str, ...], str]]) -> tuple[dict[tuple[str, ...], list[int]], list[float]]:
    """By path its blocks, characters and punctuation marks; by block the fused ratio."""
    paths = defaultdict(lambda: [0, 0, 0])
    for path, text in found:
        own = paths[path]
        own[0] += 1
        own[1] += len(text)
        own[2] += len(_PUNCTUATION.findall(text))
    length = [paths[p][1] / paths[p][0] for p, _ in found]
    marks = [paths[p][2] / paths[p][0] for p, _ in found]
    return paths, [(a * (1 + b)) ** 0.5 for a, b in zip(_smooth(length), _smooth(marks), strict=True)]


def _recalled(found: list[tuple[tuple[str, ...], str]], marks: _Marks) -> frozenset[int]:
    """The marked elements that hold a main element, most of the page, or an article with more than all unmarked text and than any
    other marked element beside them.

    Where an article or main element is itself in no marked element, only marked elements in it can hold most of it.
    """
    weight = [f * len(t) for f, (_, t) in zip(_ratios(found)[1], found, strict=True)]
    mass, whole, own, free = defaultdict(float), 0.0, 0.0, 0.0
    for w, (path, _), around in zip(weight, found, marks.around, strict=True):
        whole += w
        for place in around:
            mass[place] += w
        if not around:
            free += w
        if ("article" in path or "main" in path) and marks.within.issuperset(around):
            own += w

    heaviest = sorted(mass, key=lambda p: -mass[p])

    def first_beside(place: int) -> float:
        nested = {p for around in marks.around if place in around for p in around}
        return next((mass[p] for p in heaviest if p not in nested), 0.0)

    def recalled(place: int) -> bool:
        if "main" in marks.holds[place]:
            return True
        if own:
            return place in marks.within and mass[place] > own / 2
        return mass[place] > whole / 2 or "article" in marks.holds[place] and mass[place] > free and mass[place] > first_beside(place)

    return frozenset(place for place in mass if recalled(place))


def blocks(page: str) -> list[tuple[tuple[str, ...], str]]:
    """The blocks of text of a page in order: the path of block tags down to each, and its text with single spaces."""
    marks = _Marks()
    found = _parsed(page, marks=marks)
    return _parsed(page, _recalled(found, marks)) if marks.holds and found else found


def main_text(page: str, share: float = 0.5) -> str:
    """The article of a page.

    Per path of block tags the mean length and the mean number of punctuation marks of its blocks are taken; both are smoothed
    over neighbouring blocks in page order and fused to their geometric mean, and a path is content if its mean is at least
    ``share`` of the mean that the characters of the page have, wherever it stands. Headings, items and short paragraphs beside content
    blocks, in the same parent, belong to it. Elements that say what they are (menus, footers, forms, adverts) are left out
    beforehand; a form or an element so named by its class or id stays if it holds what the page is about (``_recalled``).
    """
    found = blocks(page)
    if not found:
        return ""
    paths, fused = _ratios(found)
    by_path = defaultdict(list)
    for (path, _), value in zip(found, fused, strict=True):
        by_path[path].append(value)
    score = {p: sum(v) / len(v) for p, v in by_path.items()}
    least = share * sum(f * len(t) for f, (_, t) in zip(fused, found, strict=True)) / sum(len(t) for _, t in found)
    mass = {p: paths[p][1] * (1 + paths[p][2] / paths[p][0]) for p in paths}
    best = max(score, key=lambda p: (mass[p], score[p]))
    content = {p for p in score if score[p] >= least} | {best}
    holder = best[:best.index("article") + 1] if "article" in best else best[:best.index("main") + 1] if "main" in best else best[:-1]
    parents = {p[:-1] for p in content}

    def belongs(path: tuple[str, ...]) -> bool:
        if path in content:
            return True
        if holder and holder[-1] in ("article", "main"):
            if path[:len(holder)] == holder:
                return True
        elif path and path[-1] in COMPANIONS and path[:len(holder)] == holder:
            return True
        return bool(path) and path[-1] in COMPANIONS and any(path[:k] in parents and BETWEEN.issuperset(path[k:-1]) for k in range(len(path)))

    return "\n".join(text for path, text in found if belongs(path))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` per row; a null page is empty, a page without article text gives the empty text.

    Each page is judged by its own paths, so there is no shuffle. Other columns are ignored; repeated rows give repeated results;
    an empty table gives no rows.
    """
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(p) if p else "" for p in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                                          names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(key).cast("bigint").alias("page_id"), F.col(url).alias("url"), F.col(source).alias("html"))
    return rows.mapInArrow(batches(run), "page_id bigint, url string, text string, n_chars bigint")


@query("op2_main_text")
def op2_main_text(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))
