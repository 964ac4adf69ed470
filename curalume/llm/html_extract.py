"""Main text of web pages by tag-path ratios.

A page is a sequence of text blocks, each at the end of a path of tags from the root. For every path, the
length of its text and its punctuation are summed over its blocks; their means are smoothed over its siblings,
weighted by their characters, so that a short heading or paragraph stands with the paragraphs around it, and fused,
with the share of the text outside links as a factor. Paths above a share of the best one are content. Blocks inside
elements that never hold an article's text are not candidates. The core is the deepest element that, at each step from
the root, holds more than half of the fused mass; a path outside of it weighs the share of the mass that is outside, or
its root where its tag is that of the best path, so that a few paragraphs of the text in an element of their own stay.
Where the page marks an article, what is outside of it weighs little; all paths are scored and thresholded alike.

Siblings have the same parent, where lists, quotes, tables and figures without a label count as their parent's own
children; each list without a label is a path of its own. A heading's siblings are all blocks beneath its parent.
Text directly in a div or the like has none.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|[^<]+|<", re.S)
_LABEL = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[a-z]+")
_WHITE = re.compile(r"\s+")
_MARK = re.compile(r"[.,;:!?。，、]")

# Elements of HTML by how they are read.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe template svg math xmp noembed".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("ul ol dl table article section div main body html aside nav form".split())
_NEVER = _RAW | frozenset("head nav header footer aside form button select option dialog menu audio video canvas object".split())
#: Words of a class, id or role that name what is around an article.
_AROUND = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus dropdown footer gdpr header login masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo promoted recommended related replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget complementary contentinfo search".split()
)


# Elements whose text stands with its siblings, and those that do not set apart what they hold.
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_SIBLING = frozenset("p li dt dd td th blockquote figcaption caption pre summary".split())
_FLOW = frozenset("ul ol dl li dd blockquote table thead tbody tfoot tr figure details".split())
_LIST = frozenset("ul ol dl".split())
_HREF = re.compile(r"\bhref\s*=", re.I)
_FRAME = frozenset("html body main article".split())
_ABOUT = frozenset("with has no without".split())
#: What a path outside the marked article weighs.
_OUTSIDE = 0.01


def _names_surroundings(name: str) -> bool:
    """Whether a class, id or role names what is around an article; has-sidebar and the like only tell of it."""
    parts = _PART.findall(name)
    return not _ABOUT & set(parts) and any(x in _AROUND for x in parts)


def blocks(page: str) -> Iterator[tuple[tuple[str, ...], bool, str, int]]:
    """(path, in an article, text, characters of it in links) of each block of a page that can be content, in page order."""
    stack: list[tuple[str, str, bool, bool]] = []  # tag, label, candidate, in an article
    text: list[str] = []
    links: list[str] = []
    at: list[tuple[str, str, bool, bool]] = []
    skip = ""
    lists = 0

    def flush():
        s = _WHITE.sub(" ", html.unescape("".join(text))).strip()
        linked = len(_WHITE.sub(" ", html.unescape("".join(links))).strip()) if links else 0
        text.clear()
        links.clear()
        if s:
            yield tuple(x[1] for x in at), bool(at) and at[-1][3], s, linked

    def pop(names, stop=frozenset()):
        """Close the innermost element of these names, unless one of `stop` is nearer."""
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                del stack[i:]
                return
            if stack[i][0] in stop:
                return

    for m in _TOKEN.finditer(page):
        tag = m.group(2)
        if tag is None:
            piece = m.group()
            if not skip and (not stack or stack[-1][2]) and (piece[0] != "<" or piece == "<"):
                if not text:
                    at = [x for x in stack if x[0] not in _INLINE]
                text.append(piece)
                if any(x[1] == "a href" for x in stack):
                    links.append(piece)
            continue
        tag = tag.lower()
        if skip:
            if m.group(1) and tag == skip:
                skip = ""
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in _RAW:
            skip = "" if m.group(1) or (m.group(3) or "").rstrip().endswith("/") else tag
            continue
        hidden = False
        if not m.group(1):
            label = " ".join(filter(None, (next(filter(None, x), "") for x in _LABEL.findall(m.group(3) or "")))).lower()
            hidden = tag in _NEVER or ((tag not in _FRAME or tag == "article" and bool(stack) and stack[-1][3]) and any(_names_surroundings(x) for x in label.split()))
        if tag not in _INLINE:
            yield from flush()
        if m.group(1):
            if tag in _INLINE:
                pop({tag}, _CLOSES_P | _SCOPE)
            else:
                pop({tag}, _SCOPE if tag in ("p", "li", "td", "th", "tr", "dt", "dd") else frozenset())
            continue
        if tag in _CLOSES_P:
            pop({"p"}, _SCOPE)
        if tag in _CLOSED_BY:
            pop(_CLOSED_BY[tag], _SCOPE)
        if tag in _VOID:
            continue
        ok = (not stack or stack[-1][2]) and not hidden
        name = f"{tag}.{label}" if label else tag
        if name in _LIST:
            lists += 1
            name = f"{tag}#{lists}"
        if tag == "a":
            pop({"a"}, _CLOSES_P | _SCOPE)
            name = "a href" if _HREF.search(m.group(3) or "") else "a"
        stack.append((tag, name, ok, (bool(stack) and stack[-1][3]) or tag in ("article", "main")))
    yield from flush()


def _tag(part: str) -> str:
    return part.partition(".")[0].partition("#")[0]


def _parent(path: tuple[str, ...]) -> tuple[str, ...]:
    """The element that sets a block apart: its parent, or what holds the lists, quotes and tables without a label around it."""
    n = max(0, len(path) - 1)
    while n and path[n - 1].partition("#")[0] in _FLOW:
        n -= 1
    return path[:n]


def _core(mass: dict[tuple[str, ...], float]) -> tuple[set[tuple[str, ...]], float]:
    """Paths inside the element reached from the root by steps that keep more than half of the mass, and the share outside of it.

    A heading whose parent holds that element counts as inside, for its siblings are all blocks beneath its parent.
    """
    inside, total = set(mass), sum(mass.values())
    holder = {path: _parent(path) if path and _tag(path[-1]) in _SIBLING | _HEADING else path for path in mass}
    held, depth = total, 0
    while held:
        child: dict[str, float] = defaultdict(float)
        for path in inside:
            if len(holder[path]) > depth:
                child[holder[path][depth]] += mass[path]
        name = max(child, key=child.get, default=None)
        if name is None or 2 * child[name] <= held:
            break
        inside = {path for path in inside if len(holder[path]) > depth and holder[path][depth] == name}
        held, depth = child[name], depth + 1
    core = next(iter(holder[path][:depth] for path in inside), ())
    inside |= {path for path in mass if path and _tag(path[-1]) in _HEADING and core[: len(path) - 1] == path[:-1]}
    return inside, 1 - held / total if total else 0.0


def main_text(page: str | None, share: float = 0.1) -> str:
    """The content blocks of a page, joined by empty lines; empty if there are none."""
    found = [*blocks(page or "")]
    outside = {path for path, inside, _, _ in found if not inside} if any(b[1] for b in found) else set()
    count: dict[tuple, list[float]] = defaultdict(lambda: [0.0] * 4)  # blocks, characters, marks, characters in links
    for path, _, s, linked in found:
        for i, x in enumerate((1, len(s), len(_MARK.findall(s)), min(linked, len(s)))):
            count[path][i] += x
    family: dict[tuple, list[float]] = defaultdict(lambda: [0.0] * 4)
    beneath: dict[tuple, list[float]] = defaultdict(lambda: [0.0] * 4)
    heads = {path[:-1] for path in count if path and _tag(path[-1]) in _HEADING}
    for path, (n, size, marks, linked) in count.items():
        to = [beneath[path[:k]] for k in range(len(path)) if path[:k] in heads]
        if path and _tag(path[-1]) in _SIBLING | _HEADING:
            to.append(family[_parent(path)])
        for total in to:
            for i, x in enumerate((size, size * size / n, size * marks / n, linked)):
                total[i] += x
    score = {}
    for path, c in count.items():
        tag = _tag(path[-1]) if path else ""
        size, punct, plain = c[1] / c[0], c[2] / c[0], 1 - c[3] / c[1]
        near = beneath[path[:-1]] if tag in _HEADING else family[_parent(path)] if tag in _SIBLING else None
        if near:
            size, punct = (size + near[1] / near[0]) / 2, (punct + near[2] / near[0]) / 2
            plain = 1 - near[3] / near[0] if tag in _HEADING else plain
        score[path] = size * (1 + punct) * plain * (_OUTSIDE if path in outside else 1)
    top = max(score, key=score.get, default=())
    inside, share_out = _core({path: count[path][0] * score[path] for path in score})
    for path in score.keys() - inside:
        score[path] *= share_out**0.5 if path and _tag(path[-1]) == _tag(top[-1] if top else "") else share_out
    best = max(score.values(), default=0.0)
    return "\n\n".join(s for path, _, s, _ in found if score[path] >= share * best)


def extracted(pages: DataFrame, id: str = "page_id", url: str = "url", source: str = "html", share: float = 0.1) -> DataFrame:
    """(page_id, url, text) per row of `pages`.

    Character references are decoded, white space in a block is one space, blocks are joined in page order by an
    empty line. A null or empty page, and one without content, has the text "". Null or repeated ids and urls each
    keep their row; other columns are ignored; an empty table gives no rows. `share` is the part of the best
    path's fused ratio from which a path is content, whether an element marks the article or not.
    """

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([main_text(x.as_py(), share) for x in batch.column(2)], pa.string())], names=["page_id", "url", "text"])

    return pages.select(F.col(id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(source).cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string")
