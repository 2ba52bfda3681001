"""Main text of web pages by tree scoring.

A page becomes a tree of elements (unclosed and misnested tags are repaired, scripts and comments skipped).
Subtrees that are menus, headers, footers, sidebars, notices, adverts, media or reader comments by tag, role
or visibility are left out.  Forms, and names in class or id, are weaker evidence (``settle``): a subtree stays if it
holds most of the page's paragraph points, or a real part of them with the page's h1, main or article (a form also
needs more of them than it has controls).  A name counts in full only if all its words speak of page furniture
("ad-slot"); one that merely holds such a word ("ad-hoc-networks") leaves out what lies outside the best
container, and inside it only link-dense subtrees; common words ("share") count for short or link-dense ones.
Every paragraph then passes points to its ancestors: one, plus its commas, plus its length in hundreds up to three;
all to the parent, half to the grandparent, a ninth to the one above.  An ancestor's points are discounted by the share
of its text inside links.  The best container is kept together with its siblings that score a fifth as much, share
its class, or are headings or real paragraphs; an enclosing ``article`` element, or one worth half the best, takes its
place, and of headings and paragraphs beside it only those directly before an article or other kept sibling
stay.  Lists of links only are left out of siblings and of a whole page, not of the container or an article.  Blocks are
written in page order.

One page is handled at a time; time and memory are linear in its size (open elements are held by name, so no end
tag walks up the tree, and attempts to read tags that never end are bounded) and nesting is not recursive.

Defined cases: a null or empty page has empty text; a page without any scored container gives all its text
outside the left-out subtrees; text behind the page's last ``>`` is text, a ``<`` in it too; repeated rows give the
same text; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinops.llm.common import prepare

TAG = re.compile(r"<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)")
#: The rest of a tag; quotes count behind "=" only, and nothing is read twice.
REST = re.compile(r"(?:[^=>]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+>")
ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
RAW_END = {t: re.compile(rf"</{t}\b[^>]*+(?:>|\Z)|\Z", re.I) for t in RAW}
LEFT_OUT = frozenset(("script style textarea title noscript iframe xmp noembed noframes head template object svg math canvas "
                      "select button label legend nav footer aside dialog menu audio video map applet").split())
BLOCK = frozenset(("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer "
                   "form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody td tfoot "
                   "th thead tr ul caption").split())
FORMS = frozenset(("form", "fieldset"))
CONTROLS = frozenset(("input", "select", "textarea", "button"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
PARAGRAPHS = frozenset(("p", "pre", "blockquote", "td", "li", "dd"))
SAME_CLOSES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"),
               "th": ("tr", "table"), "option": ("select",)}
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar "
                           "toolbar".split())
LEFT_OUT_WORDS = frozenset((
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner nav navbar navigation "
    "menu breadcrumb breadcrumbs sidebar masthead footer header topbar toolbar pagination pager pagenav comment comments "
    "disqus reply replies respond cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup "
    "login signin skip hidden copyright").split())
COMMENT_WORDS = frozenset("comment comments disqus reply replies respond".split())
#: Words that say nothing of their own beside one of LEFT_OUT_WORDS.
PLACE_WORDS = frozenset((
    "area article bar block blog body bottom box btn button buttons center col column container content desktop entry end "
    "fixed form g global google holder icon icons inline inner item items js large left link links main mini mobile module "
    "outer page panel post primary region right row secondary site slot small sticky strip text title top unit web widget "
    "wrap wrapper zone").split())
COMMENT_PLACES = frozenset("list section thread threads".split())
#: Words that name real sections as well; the second set on a section of an article mostly does.
COMMON_WORDS = frozenset("discussion share sharing social related recommended recommendations notice notices alert".split())
SECTION_WORDS = frozenset("discussion related recommended recommendations".split())
#: What tag, class and id say of an element, by growing weight.
COMMON, PARTLY, LEFT, COMMENTS, FORM = 1, 2, 3, 4, 5
SHORT = 200  # characters
ABOUT_LAYOUT = frozenset(("has", "no", "with", "without"))
SAFE = frozenset(("html", "body", "article", "main"))


def folded(text: str) -> str:
    """Every run of white space as one space, none at the ends."""
    return " ".join(text.split())


class Node:
    __slots__ = ("tag", "up", "kids", "out", "name", "kind", "points", "own", "chars", "linked", "depth")

    def __init__(self, tag: str, up: Node | None, out: bool, name: str = "", kind: int = 0):
        self.tag, self.up, self.out, self.name, self.kind = tag, up, out, name, kind
        self.kids: list = []
        self.depth = up.depth + 1 if up is not None else 0
        self.points = 0.0
        self.own = self.chars = self.linked = 0


def left_out(tag: str, attrs: dict[str, str], in_article: bool) -> bool:
    if tag in LEFT_OUT or "hidden" in attrs or attrs.get("aria-hidden") == "true" or tag == "header" and not in_article:
        return True
    if tag in SAFE:
        return False
    role = attrs.get("role", "").lower()
    if role in LEFT_OUT_ROLES and not (tag in FORMS and role == "form"):
        return True
    style = attrs.get("style", "").replace(" ", "").lower()
    return "display:none" in style or "visibility:hidden" in style


def named(tag: str, attrs: dict[str, str], in_article: bool) -> int:
    """What the words of class and id, or a form's tag, say of an element; 0 for nothing."""
    if tag in SAFE or tag in HEADINGS or tag == "header":
        return 0
    kind = FORM if tag in FORMS else 0
    for name in (attrs.get("class", "") + " " + attrs.get("id", "")).split():
        words = {w.lower(): None for w in NAME_WORD.findall(name)}
        # "has-sidebar" names a layout, not a sidebar
        if not words or next(iter(words)) in ABOUT_LAYOUT:
            continue
        words = set(words)
        if in_article:  # a header inside an article is the article's own
            words.discard("header")
        comment, left = words & COMMENT_WORDS, words & LEFT_OUT_WORDS
        rest = words - LEFT_OUT_WORDS - PLACE_WORDS - COMMON_WORDS
        if comment and rest <= COMMENT_PLACES:
            kind = max(kind, COMMENTS)
        elif left and not rest:
            kind = max(kind, LEFT)
        elif left:
            kind = max(kind, PARTLY)
        elif words & COMMON_WORDS:
            kind = max(kind, PARTLY if tag == "section" and in_article and words <= SECTION_WORDS else COMMON)
    return kind


def parse(page: str) -> list[Node]:
    """Elements in page order; the first is the root.  Children are elements and pieces of text."""
    root = Node("html", None, False)
    nodes, top, at, n = [root], root, 0, len(page)
    open_: dict[str, list[Node]] = {}  # open elements by tag, innermost last
    open_blocks: list[Node] = []
    last_end, lost = page.rfind(">"), 0

    def add_text(text: str) -> None:
        if text and not top.out:
            text = entities.unescape(text)
            top.kids.append(text)
            top.own += len(folded(text))

    def shut(node: Node) -> None:
        nonlocal top
        while True:
            x = top
            open_[x.tag].pop()
            if x.tag in BLOCK:
                open_blocks.pop()
            top = x.up
            if x is node:
                return

    def innermost(tags) -> Node | None:
        return max((open_[t][-1] for t in tags if open_.get(t)), key=lambda x: x.depth, default=None)

    def skip_to(mark: str, start: int) -> int:
        end = page.find(mark, start)
        return n if end < 0 else end + len(mark)

    text_from = 0
    while True:
        at = page.find("<", at)
        if at < 0:
            add_text(page[text_from:])
            break
        here = at
        if page.startswith("<!--", at):
            add_text(page[text_from:here])
            text_from = at = skip_to("-->", at + 4)
            continue
        if page.startswith("<![CDATA[", at):
            add_text(page[text_from:here])
            at = skip_to("]]>", at + 9)
            add_text(entities.escape(page[here + 9 : at - 3 if page.endswith("]]>", here + 9, at) else at]))
            text_from = at
            continue
        if page.startswith(("<!", "<?"), at):
            add_text(page[text_from:here])
            text_from = at = skip_to(">", at)
            continue
        m = TAG.match(page, at) if at < last_end else None
        if m is None:
            at += 1
            continue
        # scans that find no end are paid for: once they cost a page's length, quotes no longer count
        rest = REST.match(page, m.end()) if lost <= n else None
        if rest is None:
            lost += n - m.end()
        end = rest.end() if rest else skip_to(">", m.end())
        add_text(page[text_from:here])
        text_from = at = end
        tag, attr_text = m["tag"].lower(), page[m.end() : end - 1]
        if m["close"]:
            if tag == "br":
                add_text(" ")
            elif open_.get(tag):
                shut(open_[tag][-1])
            continue
        if tag in ("html", "body") and any(x.tag == tag for x in nodes[1:3]):
            continue
        if tag in BLOCK and tag not in ("html", "body"):  # a block ends an open paragraph
            if open_blocks and open_blocks[-1].tag == "p":
                shut(open_blocks[-1])
        if tag in SAME_CLOSES:
            inner = innermost((tag, *SAME_CLOSES[tag]))
            if inner is not None and inner.tag == tag:
                shut(inner)
        attrs = {k.lower(): v.strip("\"'") for k, v in ATTR.findall(attr_text)} if attr_text.strip() else {}
        in_article = bool(open_.get("article"))
        node = Node(tag, top, top.out or left_out(tag, attrs, in_article), attrs.get("class", ""),
                    named(tag, attrs, in_article) if attrs or tag in FORMS else 0)
        if tag == "input" and attrs.get("type", "").lower() == "hidden":
            node.tag = "param"  # no control that a reader sees
        top.kids.append(node)
        nodes.append(node)
        if tag in RAW:
            text_from = at = RAW_END[tag].search(page, at).end()
        elif tag not in VOID and not attr_text.endswith("/"):
            top = node
            open_.setdefault(tag, []).append(node)
            if tag in BLOCK:
                open_blocks.append(node)
    return nodes


def inline_text(node: Node) -> str:
    """Text directly in a node, not that of its elements."""
    return " ".join(k for k in node.kids if isinstance(k, str))


def measure(nodes: list[Node]) -> None:
    """Characters, and those inside links, of every subtree without what is left out."""
    for node in nodes:
        node.chars, node.linked = 0 if node.out else node.own, 0
    for node in reversed(nodes[1:]):  # children before parents
        node.up.chars += node.chars
        node.up.linked += node.chars if node.tag == "a" else node.linked


def paragraph_points(node: Node) -> float:
    """Points that a paragraph, or a block with text of its own, passes on; 0 for other nodes."""
    if node.out or not node.chars or node.tag == "a":
        return 0.0
    if node.tag not in PARAGRAPHS and not (
            node.tag in BLOCK and node.tag not in HEADINGS and inline_text(node).strip()):
        return 0.0
    stack, commas = [node], 0
    while stack:
        for k in stack.pop().kids:
            if isinstance(k, str):
                commas += k.count(",") + k.count("，") + k.count("、")
            elif not k.out and k.tag not in BLOCK:
                stack.append(k)
    return (1 + commas + min(node.chars / 100, 3)) * (1 - node.linked / node.chars)


def settle(nodes: list[Node]) -> None:
    """Leave out forms, and subtrees by their class and id words, unless they hold the page's text."""
    if not any(x.kind and not x.out for x in nodes):
        return
    place = {id(x): i for i, x in enumerate(nodes)}
    up = [-1] + [place[id(x.up)] for x in nodes[1:]]
    last = list(range(len(nodes)))  # the last node of each subtree
    controls = [int(x.tag in CONTROLS and not (x.up is not None and x.up.out)) for x in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        last[up[i]] = max(last[up[i]], last[i])
        controls[up[i]] += controls[i]

    def held_by() -> tuple[list[float], list[bool]]:
        """Paragraph points of every subtree, and whether it holds the page's h1, main or article."""
        measure(nodes)
        held = [paragraph_points(x) for x in nodes]
        if not any(held):
            held = [0.0 if x.out else float(x.own) for x in nodes]
        body = [not x.out and x.kind != COMMENTS and x.own + x.chars > 0 and (
            x.tag in ("h1", "main") or x.tag == "article" and COMMENT_WORDS.isdisjoint(
                w.lower() for w in NAME_WORD.findall(x.name))) for x in nodes]
        for i in range(len(nodes) - 1, 0, -1):
            held[up[i]] += held[i]
            body[up[i]] |= body[i]
        return held, body

    # reader comments first: they are no part of what the others are a share of.  Names that only hold a word of
    # page furniture come last, when the best container is known
    for kinds in ((COMMENTS,), (FORM, LEFT, COMMON), (PARTLY,)):
        if not any(x.kind in kinds and not x.out for x in nodes):
            continue
        held, body = held_by()
        inside = range(0)
        if kinds == (PARTLY,):
            score(nodes)
            best, _ = chosen(nodes)
            if best is not None and best.up is not None:
                i = place[id(best)]
                inside = range(i + 1, last[i] + 1)
        whole = held[0]  # points of subtrees dropped in this round leave the whole
        i = 1
        while i < len(nodes):
            node = nodes[i]
            if node.kind in kinds and not node.out:
                dense = 2 * node.linked > node.chars
                if node.kind == FORM and held[i] < (1 if body[i] else 2) * controls[i]:
                    stays = False
                elif whole > 0 and (held[i] >= 0.8 * whole and not (node.kind == COMMENTS and held[i] < whole and not body[i])
                                    or body[i] and held[i] >= whole / 4):
                    stays = True
                elif node.kind == PARTLY:
                    stays = i in inside and not dense
                else:
                    stays = node.kind == COMMON and node.chars >= SHORT and not dense
                if not stays:
                    whole -= held[i]
                    for x in nodes[i : last[i] + 1]:
                        x.out = True
                    i = last[i]
            i += 1


def score(nodes: list[Node]) -> None:
    measure(nodes)
    for node in nodes:
        node.points = 0.0
    for node in nodes:
        points = paragraph_points(node)
        if not points:
            continue
        above = node.up if node.tag in PARAGRAPHS else node
        for share in (1, 1 / 2, 1 / 9):
            if above is None:
                break
            above.points += points * share
            above = above.up


def worth(node: Node) -> float:
    return node.points * (1 - node.linked / node.chars) if node.chars else 0.0


def chosen(nodes: list[Node]) -> tuple[Node | None, list[Node]]:
    """The best container, and it and the siblings kept with it in page order."""
    best = max((x for x in nodes if not x.out and x.points > 0), key=worth, default=None)
    if best is None:
        return nodes[0], [nodes[0]]
    # the article around the best container, or one of comparable worth, takes its place
    article = max((x for x in nodes if x.tag == "article" and not x.out), key=worth, default=None)
    up = best
    while up is not None and up.tag != "article":
        up = up.up
    if up is not None:
        best = up
    elif article is not None and worth(article) >= worth(best) / 2:
        best = article
    if best.up is None or best.tag == "body":  # all of the page, with its menus
        return None, [best]
    least, kept = worth(best) / 5, []
    beside: list[Node] = []  # headings and paragraphs since the last other element
    for k in best.up.kids:
        if isinstance(k, str) or k.out:
            continue
        density = k.linked / k.chars if k.chars else 1.0
        if k is best or worth(k) >= least or (best.name and k.name == best.name and k.tag == best.tag):
            kept += [*beside, k]
            beside = []
        elif k.tag in ("h1", "h2", "h3") or (k.tag == "p" and density < 0.25):
            # an article has its own paragraphs: beside it only those directly before a kept sibling count
            (beside if best.tag == "article" else kept).append(k)
        elif k.chars:
            beside = []
    return best, kept


def menu_like(node: Node) -> bool:
    """A list or block of links only."""
    return node.tag in ("ul", "ol") and node.chars > 0 and node.linked > 0.9 * node.chars


def blocks(node: Node, whole: bool = False) -> list[str]:
    """Texts of the blocks below a node, white space folded; without menus unless it is taken whole."""
    out: list[str] = []
    open_: list[str] = []

    def flush() -> None:
        text = folded("".join(open_))
        if text:
            out.append(text)
        open_.clear()

    stack: list = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            open_.append(x)
        elif x is None:
            flush()
        elif x.tag == "br":
            open_.append(" ")
        elif not x.out and (whole or not menu_like(x)):
            if x.tag in BLOCK:
                flush()
                stack.append(None)
            stack.extend(reversed(x.kids))
    flush()
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    nodes = parse(page)
    settle(nodes)
    score(nodes)
    best, kept = chosen(nodes)
    return "\n\n".join(b for node in kept for b in blocks(node, node is best or node.tag == "article"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: id, url, text, n_chars."""
    prepare(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def run(batches):
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(x) for x in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, url string, text string, n_chars long")
