"""Main text of web pages by composite text density.

The page becomes a tree of blocks; what cannot be the article by its tag or role is left out, and
by its class or id if it holds a small share of the page's unlinked text.  Each block gets the
density of its subtree: characters per tag, scaled down by the share of links in both.  A
container's density sum adds up its children's densities; the block of largest sum is the article.
Its path to the body gives the threshold: blocks beside the path, and the ancestors that only join
such blocks, count too if their density reaches it and most of their text is no link.  Where the
page marks its article, only blocks marked alike stand beside it.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm.common import col, map_batches, table, whole

# Fixed values of HTML: elements by their kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
#: A start tag that ends an open element of the second set, unless one of the third lies between.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
NEVER = frozenset(
    "head nav aside footer script style noscript template iframe svg math canvas object embed audio video button select textarea input dialog menu title noembed noframes map".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Class tokens or ids, or their first or last words, by which a block is hardly the article.
NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense adbox adslot banner sponsor sponsored promo promoted promotion
    sidebar sidenav menu submenu nav navbar navigation breadcrumb breadcrumbs footer foot masthead topbar
    comment comments commentlist disqus respond reply replies discussion
    share sharing social newsletter subscribe subscription signup signin login cookie cookies consent gdpr
    notice notices notification alert popup modal overlay paywall related recommended recommendations trending widget widgets
    pagination pager toolbar skip""".split()
)
#: Those of them that stand for what readers wrote, which may well be longer than the article.
READERS = frozenset("comment comments commentlist disqus respond reply replies".split())
#: Those that say so in any place.
ASIDES = frozenset("sidebar footer".split())
#: Words that turn a name into a property of the block, as in with-sidebar.
TURNED = frozenset("with has have no not without is show hide open free enabled".split())
#: The largest share of the page's unlinked text at which a name decides, by kind of name; a form
#: that holds more is the page itself.
SMALL, SMALL_READERS, SMALL_FORM = 0.25, 0.5, 0.4
#: Longer ones of readers count so much less, unless they hold nearly all of the text.
LOWERED, NEARLY_ALL = 0.02, 0.95
ARTICLE = frozenset(("article", "main"))
#: A base of 1, as without any link, has no logarithms: it counts as a little more.
LEAST = 0.2

TOKEN = re.compile(
    r"""<!--(?:.*?--!?>|.*\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*>|<[A-Za-z/!?][^>]*\Z""",
    re.S,
)
#: One attribute after the other, so that nothing inside a value counts as a name.
ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+("[^"]*"|'[^']*'|[^\s"'>]++))?""")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Block:
    __slots__ = ("tag", "up", "items", "chars", "tags", "link_chars", "link_tags", "own", "out", "named", "lowered", "holds", "density", "sum")

    def __init__(self, tag: str, up: Block | None, out: bool, named: float = 0.0):
        self.tag, self.up, self.out = tag, up, out
        self.named = named  # the share of text up to which its name decides
        self.lowered = up is not None and up.lowered
        self.holds = False  # whether an article or main is in it, or is it
        self.own = True  # whether most of the text that is in no inner block is unlinked
        self.items: list[Block | str] = []  # text and blocks in page order
        self.chars = self.link_chars = self.link_tags = 0
        self.tags = 1


def left_out(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether an element is not part of an article by what it is called."""
    if tag in NEVER or (tag == "header" and not in_article):
        return True
    if not attributes or tag in ("html", "body"):
        return False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if name == "role" and value.lower() in ROLES:
            return True
    return False


def named(tag: str, attributes: str, in_article: bool) -> float:
    """The share of the page's text up to which the element's class or id decides; 0 without such a name."""
    share = SMALL_FORM if tag == "form" else 0.0
    if not attributes or tag in ("html", "body") or tag in ARTICLE:
        return share
    for name, value in ATTRIBUTE.findall(attributes):
        if name.lower() not in ("class", "id"):
            continue
        for token in value.strip("\"'").split():
            words = [w.lower() for w in PART.findall(token)]
            if not words or TURNED.intersection(words):
                continue
            if READERS.intersection(words):
                share = SMALL_READERS
            elif words[-1] in NAMES or words[0] in NAMES or ASIDES.intersection(words) or (words[-1] == "header" and not in_article and tag in ("div", "section")):
                share = max(share, SMALL)
    return share


def parse(page: str) -> Block:
    """The tree of blocks, with text gathered in the innermost block."""
    root = Block("html", None, False)
    block, stack = root, []  # open elements: (tag, block that it made or None)
    links = articles = 0
    opened: Counter[str] = Counter()  # an end tag without a start costs nothing
    at, end = 0, len(page)

    def text(part: str) -> None:
        if part and not block.out:
            part = entities.unescape(part)
            n = len(part.strip())
            block.chars += n
            if links:
                block.link_chars += n
            block.items.append(part)

    def close(depth: int) -> None:
        nonlocal block, links, articles
        while len(stack) > depth:
            tag, made = stack.pop()
            opened[tag] -= 1
            links -= tag == "a"
            articles -= tag in ARTICLE
            if made is not None:
                block = made.up

    while at < end:
        found = TOKEN.search(page, at)
        if found is None:
            text(page[at:])
            break
        text(page[at : found.start()])
        at = found.end()
        slash, tag, attributes = found.group(1, 2, 3)
        if tag is None:
            slash, tag, attributes = found.group(4, 5, 6)
            if tag is None:
                continue
        tag = tag.lower()
        if slash:
            for depth in range(0) if not opened[tag] else range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    close(depth)
                    break
            continue
        if tag in CLOSES_P:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == "p":
                    close(depth)
                    break
                if stack[depth][0] not in INLINE:
                    break
        elif tag in SIBLINGS:
            ends, within = SIBLINGS[tag]
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] in within:
                    break
                if stack[depth][0] in ends:
                    close(depth)
                    break
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        block.tags += 1
        if tag == "br":
            block.items.append("\n")
        if tag == "a":
            block.link_tags += 1
        if tag in VOID:
            if tag == "hr" and not block.out:
                block.items.append(Block("hr", block, True))
            continue
        out = block.out or left_out(tag, attributes, articles > 0)
        name = 0.0 if out else named(tag, attributes, articles > 0)
        if tag in INLINE and not (out and not block.out) and not name:
            made = None
        else:
            made = Block(tag, block, out, name)
            block.items.append(made)
            block = made
            if tag in ARTICLE and not out:
                up = made
                while up is not None and not up.holds:
                    up.holds = True
                    up = up.up
        if tag != "html" and tag != "body" or made is not None:
            stack.append((tag, made))
            opened[tag] += 1
            links += tag == "a"
            articles += tag in ARTICLE
    close(0)
    return root


def in_order(root: Block) -> list[Block]:
    """Blocks that are not left out, each before those within."""
    found, todo = [], [root]
    while todo:
        b = todo.pop()
        if not b.out:
            found.append(b)
            todo += [x for x in reversed(b.items) if isinstance(x, Block)]
    return found


def by_name(root: Block) -> None:
    """Leaves out the blocks whose name decides: with little of the unlinked text, and no article in them."""
    blocks = in_order(root)
    unlinked = {id(b): b.chars - b.link_chars for b in blocks}
    for b in reversed(blocks):
        if b.up is not None:
            unlinked[id(b.up)] += unlinked[id(b)]
    total = unlinked[id(root)]
    for b in blocks:
        if b.named and not b.holds and unlinked[id(b)] <= b.named * total:
            b.out = True
        elif b.named == SMALL_READERS and not b.holds and unlinked[id(b)] <= NEARLY_ALL * total:
            b.lowered = True
        b.lowered = b.lowered or (b.up is not None and b.up.lowered)


def measure(blocks: list[Block]) -> None:
    """Densities of the subtrees and their sums; ``blocks`` in page order, the root first."""
    for b in blocks:
        b.own = b.link_chars * 2 <= b.chars
    for b in reversed(blocks):
        if b.up is not None:
            up = b.up
            up.chars += b.chars
            up.tags += b.tags
            up.link_chars += b.link_chars
            up.link_tags += b.link_tags
    root = blocks[0]
    share = root.link_chars / max(root.chars, 1)
    for b in blocks:
        c, t, lc, lt = b.chars, b.tags, b.link_chars, b.link_tags
        # The weight is a logarithm whose base grows with the share of links; empty counts are 1.
        base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
        weight = math.log(max(c / max(lc, 1) * t / max(lt, 1), 1.0)) / max(math.log(base), LEAST)
        b.density = c / t * weight * (LOWERED if b.lowered else 1)
    for b in blocks:
        inner = [x.density for x in b.items if isinstance(x, Block) and not x.out]
        b.sum = sum(inner) if inner else b.density


def chosen(blocks: list[Block]) -> tuple[Block, dict[int, Block], float | None]:
    """The block of largest density sum, led up to the article it is in or the blocks it belongs to.

    Also the blocks from there to the root, by identity, and the threshold; None if nothing
    stands beside, as in a page that marks its main part.
    """
    best = max(blocks, key=lambda b: b.sum)
    path = [best]
    while path[-1].up is not None:
        path.append(path[-1].up)
    # The thinnest block on the path, up to the body, is the threshold.
    inside = [b for b in path if b.tag != "html"] or path
    threshold = min(b.density for b in inside)
    by_id = {id(b): b for b in path}
    marked = [b for b in reversed(path) if b.tag in ARTICLE]  # the outermost holds the rest of it
    if marked:
        return marked[0], by_id, None if marked[0].tag == "main" else threshold
    # The article goes on in the container as long as what stands beside is text: headings and
    # paragraphs, or blocks that reach the threshold.
    while best.up is not None and best.up.tag not in ("html", "body"):
        beside = [x for x in best.up.items if isinstance(x, Block) and not x.out and x is not best and x.chars]
        if not all(goes_on(x, best, best.up, threshold) for x in beside):
            break
        best = best.up
    return best, by_id, threshold


def goes_on(x: Block, best: Block, container: Block | None, threshold: float) -> bool:
    """Whether the article goes on in a block: dense enough or a paragraph of its container, and mostly unlinked."""
    if not x.chars or x.link_chars * 2 > x.chars or (x.lowered and not best.lowered):
        return False
    return x.density >= threshold or (x.tag in TEXTS and container is not None and container.tag not in ("html", "body"))


TEXTS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl figure figcaption table header hgroup".split())


def main_text(page: str) -> str:
    """Blocks of the article, white space inside each turned into one space, joined by two line breaks."""
    root = parse(page)
    by_name(root)
    blocks = in_order(root)
    measure(blocks)
    best, path, threshold = chosen(blocks)
    marked = best.tag in ARTICLE
    parts: list[str] = []
    line: list[str] = []

    def flush() -> None:
        words = "".join(line).split()
        if words:
            parts.append(" ".join(words))
        line.clear()

    def taken(x: Block) -> bool:
        if x is best:
            return True
        if threshold is None or id(x) in path or (marked and x.tag != "article"):
            return False
        return goes_on(x, best, path.get(id(x.up)), threshold)

    todo: list[tuple[Block | str | None, bool]] = [(root, False)]
    while todo:
        x, all_of_it = todo.pop()
        if isinstance(x, str):
            if all_of_it:
                line.append(x)
            continue
        flush()
        if x is not None and not x.out:
            all_of_it = all_of_it or taken(x)
            # The text that an ancestor itself holds beside the article is as dense as the ancestor.
            own = all_of_it or (not marked and id(x) in path and x.own)
            todo.append((None, False))  # its end
            todo += [(i, own if isinstance(i, str) else all_of_it) for i in reversed(x.items)]
    flush()
    return "\n\n".join(parts)


def extract(df: DataFrame, html: str = "html", key: str = "page_id", url: str = "url") -> DataFrame:
    """``(key, url, text, n_chars)``, one row per row of ``df``; ``n_chars`` in code points.

    A null or empty page, or one without an article, has an empty text.  Broken markup is read as
    browsers do: unclosed paragraphs, cut-off tags and stray end tags do no harm.  Repeated rows
    give repeated results; other columns are not read.
    """

    def rows(batch):
        for k, u, page in zip(batch["k"], batch["u"], batch["h"]):
            text = main_text(page)
            yield k, u, text, len(text)

    schema = T.StructType(
        [
            T.StructField(key, df.schema[key].dataType),
            T.StructField(url, df.schema[url].dataType),
            T.StructField("text", T.StringType()),
            T.StructField("n_chars", T.LongType()),
        ]
    )
    narrow = df.select(col(key).alias("k"), col(url).alias("u"), whole(col(html)).alias("h"))
    return map_batches(narrow, schema, rows)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
