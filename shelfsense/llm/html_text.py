"""Main text of web pages by composite text density.

Each page becomes a tree of elements. For every element: C characters of text, T tags, LC and LT
those inside links. Its density is C/T, adjusted for links by a logarithm whose base grows with
the share of link text (an element made of links comes out near zero), after Sun, Song and Liao
(2011). The element whose children's densities have the largest sum holds the main text; an
article or main around it is taken whole. Without one the least dense element on its path to the
body gives the threshold: beside the path, blocks with links below it are left out, those on or
above it are treated like the page in turn, and blocks without links and paragraphs stay. Menus,
notices, adverts and the like inside the choice are left out, and its blocks are written in page
order. Everything is linear in the page and free of recursion.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

from pyspark.sql import DataFrame

# Element names of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section "
    "summary table tbody td tfoot th thead tr ul".split()
)
UNSEEN = frozenset(
    "script style noscript template iframe object embed applet svg math canvas audio video map head title "
    "select option optgroup datalist button input textarea".split()
)
ASIDE = frozenset("nav header footer aside form menu dialog search".split())
ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split()
)
#: Words in class or id that mark an element beside the text.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead "
    "notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription signup "
    "comment comments disqus respond replies share sharing social related recommended pagination pager widget".split()
)
#: Of these, marks of other people's texts: they stay out however much of the page they are.
REPLIES = frozenset("comment comments disqus respond replies".split())
#: A class or id with one of these parts tells of the layout or a state, not of what the element is.
_STATES = frozenset("with without no not has have is hide show".split())
#: With one of these parts, header and the like mean the head of the text itself.
_OF_TEXT = frozenset("article post entry story title".split())
_HEADS = frozenset("header masthead".split())
#: What an element is: part of the text, unseen, beside it by name, role, class or id, replies to it.
TEXT, HIDDEN, BESIDE, REPLY = range(4)
#: An opening tag ends open elements of these names (up to a closer ancestor of the second set).
_CELLS = frozenset({"td", "th"})
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": (_CELLS, {"tr", "table"}), "th": (_CELLS, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead"}, {"table"}),
}
ENDS_P = BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary"}
#: Blocks of running text: left out for their links only if they are nothing but links.
TEXTS = frozenset("blockquote dl figcaption h1 h2 h3 h4 h5 h6 hgroup p pre table".split())
KEPT_NAMES = frozenset({"html", "body", "article", "main"})
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


class Tree(HTMLParser):
    """Elements in page order; the element at index 0 stands for the page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.names, self.parents, self.beside = ["html"], [-1], [TEXT]
        #: (element, text) or (element, None) where a block begins or ends.
        self.content: list[tuple[int, str | None]] = []
        self.open = [0]
        #: Where in ``open`` elements of a name are, the innermost last.
        self.places: dict[str, list[int]] = {}

    def _close_to(self, depth: int) -> None:
        for index in self.open[depth:]:
            if self.names[index] in BLOCKS:
                self.content.append((index, None))
                break
        for index in self.open[depth:]:
            self.places[self.names[index]].pop()
        del self.open[depth:]

    def _innermost(self, names) -> int:
        return max((self.places[name][-1] for name in names if self.places.get(name)), default=0)

    def _find(self, names, stops) -> int:
        """Place of the innermost open element of ``names``; 0 if one of ``stops`` is further in."""
        depth = self._innermost(names)
        return depth if depth and depth >= self._innermost(stops) else 0

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body") and self.places.get(tag):
            return
        if tag in ENDS_P and (depth := self._find({"p"}, _CELLS | {"div", "li", "article", "section"})):
            self._close_to(depth)
        if tag in CLOSES and (depth := self._find(*CLOSES[tag])):
            self._close_to(depth)
        index = len(self.names)
        self.names.append(tag)
        self.parents.append(self.open[-1])
        self.beside.append(_is_beside(tag, attrs))
        if tag in BLOCKS:
            self.content.append((index, None))
        elif tag == "br":
            self.content.append((self.open[-1], " "))
        if tag not in VOID:
            self.places.setdefault(tag, []).append(len(self.open))
            self.open.append(index)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "math", "path", "iframe"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if depth := self._find({tag}, frozenset() if tag in BLOCKS else _CELLS):
            self._close_to(depth)

    def handle_data(self, data):
        self.content.append((self.open[-1], data))


def _marks(value: str) -> set[str]:
    """The marks among the words of a class or id attribute."""
    found = set()
    for token in value.split():
        words = {word.lower() for word in _WORD.findall(token)}
        if not words & _STATES:
            found |= (words - _HEADS if words & _OF_TEXT else words) & MARKS
    return found


def _is_beside(tag: str, attrs) -> int:
    if tag in UNSEEN:
        return HIDDEN
    found = BESIDE if tag in ASIDE else TEXT
    if tag in KEPT_NAMES:
        return found
    for name, value in attrs:
        value = value or ""
        if name in ("class", "id"):
            if marks := _marks(value):
                found = max(found, REPLY if marks & REPLIES else BESIDE)
        elif name == "role":
            if value.lower() in ROLES:
                found = max(found, BESIDE)
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            return HIDDEN
        elif name == "style" and "display:none" in value.replace(" ", "").lower():
            return HIDDEN
    return found


def left_out(tree: Tree) -> list[bool]:
    """Whether each element is unseen or beside the text, by itself or with an element around it.

    A wrapper is not beside the text if the page's only article or main with text is in it, or,
    where there is none, most of the page's text.
    """
    n, parents = len(tree.names), tree.parents
    unseen, in_link, marked = [False] * n, [False] * n, [False] * n
    for i in range(1, n):
        p = parents[i]
        unseen[i] = tree.beside[i] == HIDDEN or unseen[p]
        in_link[i] = tree.names[i] == "a" or in_link[p]
        marked[i] = tree.beside[i] != TEXT or marked[p]
    chars = [0] * n
    for i, text in tree.content:
        if text and not unseen[i] and not in_link[i]:
            chars[i] += len("".join(text.split()))
    beside = sum(c for c, m in zip(chars, marked) if m)
    left = sum(chars) - beside
    for i in range(n - 1, 0, -1):
        chars[parents[i]] += chars[i]
    texts = [i for i in range(n) if tree.names[i] in ("article", "main") and chars[i]]
    kept = set()
    if beside and all(marked[i] for i in texts):
        if texts and chars[most := max(texts, key=lambda i: (chars[i], -i))] > left:
            while most > 0:
                kept.add(most)
                most = parents[most]
        else:
            kept = {i for i in range(n) if 2 * chars[i] > chars[0] and tree.beside[i] != REPLY}
    out = [False] * n
    for i in range(1, n):
        out[i] = out[parents[i]] or tree.beside[i] == HIDDEN or (tree.beside[i] != TEXT and i not in kept)
    return out


def densities(tree: Tree, out: list[bool]) -> tuple[list[float], list[float], list[int]]:
    """Density of every element, the sum of its children's, its characters in links; unseen elements have no text."""
    n = len(tree.names)
    chars, links = [0] * n, [0] * n
    tags, link_tags = [0] * n, [0] * n
    in_link = [False] * n
    for i in range(1, n):
        in_link[i] = tree.names[i] == "a" or in_link[tree.parents[i]]
    for i, text in tree.content:
        if text and not out[i]:
            size = len("".join(text.split()))
            chars[i] += size
            links[i] += size if in_link[i] else 0
    for i in range(n - 1, 0, -1):
        p = tree.parents[i]
        chars[p] += chars[i]
        links[p] += links[i]
        tags[p] += tags[i] + 1
        link_tags[p] += link_tags[i] + (tree.names[i] == "a")
    body = next((i for i in range(n) if tree.names[i] == "body"), 0)
    share = links[body] / max(1, chars[body])
    density, sums = [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        c, lc = chars[i], links[i]
        if c:
            t, lt = max(1, tags[i]), max(1, link_tags[i])
            base = math.log(c * lc / max(1, c - lc) + share * c + math.e)
            density[i] = max(0.0, c / t * math.log(max(1.0, c / max(1, lc) * t / lt)) / math.log(max(base, 1.0001)))
            if c == lc:
                density[i] = 0.0
        if i:
            sums[tree.parents[i]] += density[i]
    return density, sums, links


def chosen(tree: Tree, out: list[bool]) -> list[bool]:
    """Whether the text directly in each element belongs to the main text."""
    n, names, parents = len(tree.names), tree.names, tree.parents
    density, sums, links = densities(tree, out)
    score = [sums[i] or density[i] / 2 for i in range(n)]
    best_in, children = list(range(n)), [[] for _ in range(n)]
    for i in range(n - 1, 0, -1):
        p = parents[i]
        children[p].append(i)
        if (score[best_in[i]], -best_in[i]) > (score[best_in[p]], -best_in[p]):
            best_in[p] = best_in[i]
    best = best_in[0]
    body = next((i for i in range(n) if names[i] == "body"), 0)
    path = [best]
    while path[-1] not in (0, body):
        path.append(parents[path[-1]])
    whole, own = [False] * n, [False] * n
    marked = next((i for i in path if names[i] in ("article", "main")), None)
    if marked is not None:
        whole[marked] = True
    else:
        threshold = min(density[i] for i in path)
        top = [path[-1]]
        while top:
            r = top.pop()
            i = best_in[r]
            whole[i] = True
            while i != r:
                below, i = i, parents[i]
                own[i] = True
                for c in children[i]:
                    if c == below or out[c]:
                        continue
                    if names[c] not in BLOCKS or not links[c] or (names[c] in TEXTS and density[c] > 0):
                        whole[c] = True
                    elif density[c] > 0 and density[c] >= threshold:
                        top.append(c)
    for i in range(1, n):
        whole[i] = whole[i] or whole[parents[i]]
    return [(whole[i] or own[i]) and not out[i] for i in range(n)]


def main_text(html: str | None) -> str:
    """Main text of one page; empty for null, empty and textless pages."""
    if not html:
        return ""
    tree = Tree()
    tree.feed(html)
    tree.close()
    inside = chosen(tree, left_out(tree))
    blocks, current = [], []
    for i, text in tree.content:
        if text is None:
            blocks.append("".join(current))
            current = []
        elif inside[i]:
            current.append(text)
    blocks.append("".join(current))
    return "\n".join(line for line in (" ".join(b.split()) for b in blocks) if line)


def extract_pages(pages: DataFrame) -> DataFrame:
    """Main text of every row of ``pages`` (columns ``page_id``, ``url``, ``html``).

    ``page_id``, ``url``, ``text`` (empty if there is none) and ``n_chars``, its code points. Null
    ids and urls pass through, equal rows give equal rows, other columns are ignored.
    """

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [main_text(html) for html in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                ["page_id", "url", "text", "n_chars"],
            )

    kept = pages.select("page_id", "url", "html")
    kinds = dict(kept.dtypes)
    return kept.mapInArrow(
        work, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint"
    )
