"""DOM trees of web pages, tolerant of broken markup, and their alignment by simple tree matching."""

from __future__ import annotations

import html
import json
import re
from hashlib import blake2b

import numpy as np

# Element names of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary "
    "table tbody td tfoot th thead title tr ul".split()
)
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"},
}
SCOPES = frozenset("article body div html main nav ol section table td th ul dl aside footer header form".split())
BOILERPLATE = frozenset("aside button dialog footer form head iframe menu nav noscript script select style svg template textarea".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies discussion "
    "footer form header masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo related "
    "replies respond share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)

#: Deeper elements become children of the element at this depth; below it only the outermost boilerplate element opens.
DEEPEST = 150

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|</?[a-zA-Z](?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>|</?[a-zA-Z][^>]*(?:>|\Z)|[^<]+|<",
    re.DOTALL,
)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_KIND = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.IGNORECASE)
_WORDS = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"\d+")


class Node:
    """An element (``text`` is None) or a piece of text."""

    __slots__ = ("tag", "kind", "kids", "text", "digest", "shape", "size", "closed")

    def __init__(self, tag: str, kind: str = "", text: str | None = None) -> None:
        self.tag, self.kind, self.text = tag, kind, text
        self.kids: list[Node] = []
        self.digest: str = ""
        self.closed: bool | None = None  # whether the page closes it, once asked


def parse(page: str) -> Node:
    """The tree of a page. Comments and declarations are left out; character references stay as they are."""
    root = Node("#page")
    stack = [root]
    flat: dict[str, int] = {}  # open elements that are too deep to stand on the stack
    at, size = 0, len(page)
    while at < size:
        found = _TOKEN.match(page, at)
        token, at = found[0], found.end()
        if token[0] != "<" or token == "<":
            if stack[-1].kids and stack[-1].kids[-1].text is not None:
                stack[-1].kids[-1].text += token
            else:
                stack[-1].kids.append(Node("#text", text=token))
            continue
        if token[1] in "!?":
            continue
        tag = _NAME.match(token)[1].lower()
        if token[1] == "/":
            open_tags = [n.tag for n in stack]
            if flat.get(tag):
                flat[tag] -= 1
            elif tag in open_tags[1:]:
                last = len(open_tags) - 1 - open_tags[::-1].index(tag)
                del stack[last:]
                flat.clear()
            elif tag == "p" or tag == "br":
                stack[-1].kids.append(Node("br"))
            continue
        _close_before(stack, tag, page, at)
        kind = " ".join(next(filter(None, m), "") for m in _KIND.findall(token)).lower() if "=" in token else ""
        node = Node(tag, kind)
        stack[-1].kids.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>|\Z", re.IGNORECASE).search(page, at)
            if tag == "title":
                node.kids.append(Node("#text", text=page[at : end.start()]))
            at = end.end()
        elif tag not in VOID and not token.endswith("/>"):
            if len(stack) < DEEPEST or (len(stack) == DEEPEST and is_boilerplate(node)):
                stack.append(node)
            else:
                flat[tag] = flat.get(tag, 0) + 1
    return root


def _ends(page: str, at: int, tag: str) -> int:
    """How many elements of this name, open at ``at``, the rest of the page closes."""
    depth, least = 0, 0
    for found in re.compile(rf"<(/?){tag}(?=[\s/>])", re.IGNORECASE).finditer(page, at):
        depth += -1 if found[1] else 1
        least = min(least, depth)
    return -least


def _close_before(stack: list[Node], tag: str, page: str, at: int) -> None:
    """Close what a start tag ends implicitly.

    An article that starts inside a menu or notice lies in it if the page closes all open elements of its name later,
    as for readers' comments and teasers. A menu that is never closed does not hold the article.
    """
    if tag in ("article", "main"):
        for i, node in enumerate(stack[1:], 1):
            if is_boilerplate(node):
                if node.closed is None:
                    node.closed = _ends(page, at, node.tag) >= sum(n.tag == node.tag for n in stack)
                if not node.closed:
                    del stack[i:]
                    return
    closes = CLOSES.get(tag) or ({"p"} if tag in BLOCK and tag != "br" else ())
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in closes:
            del stack[i:]
            return
        if stack[i].tag in SCOPES:
            return


def is_boilerplate(node: Node) -> bool:
    """Menus, footers, forms, adverts, comments and the like, by name, class, id or role."""
    if node.tag in BOILERPLATE:
        return True
    if not node.kind or node.tag in ("html", "body", "main"):
        return False
    return not BOILERPLATE_WORDS.isdisjoint(_WORDS.findall(node.kind))


def finish(node: Node, shapes: dict[tuple, int]) -> None:
    """Give every node its shape (a number for its structure), size and text digest (empty for white space alone)."""
    if node.text is not None:
        node.shape, node.size = 0, 1
        if not node.digest and (words := " ".join(html.unescape(node.text).split())):
            node.digest = blake2b(words.encode("utf-8", "replace"), digest_size=8).hexdigest()
        return
    for kid in node.kids:
        finish(kid, shapes)
    node.shape = shapes.setdefault((node.tag, node.kind, *(k.shape for k in node.kids)), len(shapes) + 1)
    node.size = 1 + sum(k.size for k in node.kids)
    node.digest = blake2b("".join(k.digest for k in node.kids).encode(), digest_size=8).hexdigest()


def layout(root: Node) -> str:
    """A digest of the tree's upper levels: the set of elements on the first level of the body with several of them.

    Digits in names do not count, neither do order and number.
    """
    # an html or body that is missing is passed over
    level = [root]
    while True:
        below = [k for n in level for k in n.kids if k.text is None and k.tag not in ("head", "br", *RAW)]
        if not below:
            break
        level = below
        if len(level) > 1 and not any(n.tag in ("html", "body") for n in level):
            break
    names = sorted({_DIGITS.sub("0", f"{n.tag} {n.kind}") for n in level})
    return blake2b("\n".join(names).encode("utf-8", "replace"), digest_size=8).hexdigest()


def content(root: Node) -> list[str]:
    """The digests of the texts that the elements alone leave, in page order, without those of white space alone."""
    out, todo = [], main_parts(root)[::-1]
    while todo:
        node = todo.pop()
        if node.text is not None:
            if node.digest:
                out.append(node.digest)
        elif node.tag != "title" and not is_boilerplate(node):
            todo.extend(reversed(node.kids))
    return out


def skeleton(root: Node) -> str:
    """A tree without its texts: element names, kinds and text digests, as JSON."""

    def lay(node: Node) -> list | str:
        return node.digest if node.text is not None else [node.tag, node.kind, *map(lay, node.kids)]

    return json.dumps(lay(root), separators=(",", ":"))


def from_skeleton(text: str, shapes: dict[tuple, int]) -> tuple[Node, list[Node]]:
    """The tree of a skeleton and its text nodes in order, without those of white space alone."""
    pieces: list[Node] = []

    def build(laid: list | str) -> Node:
        if isinstance(laid, str):
            node = Node("#text", text="")
            node.digest = laid
            if laid:
                pieces.append(node)
            return node
        node = Node(laid[0], laid[1])
        node.kids = [build(k) for k in laid[2:]]
        return node

    root = build(json.loads(text))
    finish(root, shapes)
    return root, pieces


class TreeMatcher:
    """Simple tree matching: the largest order-preserving match of two trees' nodes, level by level.

    Nodes match if element name and kind agree. Among equally large matches, those with equal texts are preferred.
    """

    def __init__(self) -> None:
        self.scores: dict[tuple[int, int], int] = {}

    def score(self, a: Node, b: Node) -> int:
        """The size of the largest match of two nodes."""
        if a.tag != b.tag or a.kind != b.kind:
            return 0
        if a.shape == b.shape:
            return a.size
        known = self.scores.get((a.shape, b.shape))
        if known is None:
            known = 1 + int(self._table(self._weights(a, b, 1, 0))[-1, -1])
            self.scores[a.shape, b.shape] = known
        return known

    def _weights(self, a: Node, b: Node, scale: int, bonus: int) -> np.ndarray:
        out = np.zeros((len(a.kids), len(b.kids)), np.int64)
        columns: dict[tuple[int, str, str], list[int]] = {}
        for j, y in enumerate(b.kids):
            columns.setdefault((y.shape, y.tag, y.kind), []).append(j)
        rows: dict[tuple[int, str, str], list[int]] = {}
        for i, x in enumerate(a.kids):
            rows.setdefault((x.shape, x.tag, x.kind), []).append(i)
        for r in rows.values():
            for c in columns.values():
                if s := self.score(a.kids[r[0]], b.kids[c[0]]):
                    out[np.ix_(r, c)] = scale * s
        if bonus:
            same = np.array([k.digest for k in a.kids], object)[:, None] == np.array([k.digest for k in b.kids], object)
            out += bonus * (same & (out > 0))
        return out

    @staticmethod
    def _table(weights: np.ndarray) -> np.ndarray:
        best = np.zeros((weights.shape[0] + 1, weights.shape[1] + 1), np.int64)
        for i, row in enumerate(weights, 1):
            best[i, 1:] = np.maximum.accumulate(np.maximum(best[i - 1, 1:], best[i - 1, :-1] + row))
        return best

    def texts(self, a: Node, b: Node) -> list[tuple[Node, Node]]:
        """Pairs of matched text nodes of two trees with equal roots."""
        out, todo = [], [(a, b)]
        while todo:
            x, y = todo.pop()
            if x.text is not None:
                out.append((x, y))
                continue
            if not x.kids or not y.kids:
                continue
            if x.shape == y.shape and len(x.kids) == 1:
                todo.append((x.kids[0], y.kids[0]))
                continue
            weights = self._weights(x, y, 4, 1)
            best = self._table(weights)
            i, j = weights.shape
            while i and j:
                if best[i, j] == best[i - 1, j]:
                    i -= 1
                elif best[i, j] == best[i, j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    todo.append((x.kids[i], y.kids[j]))
        return out


def main_parts(root: Node) -> list[Node]:
    """The outermost articles that are no boilerplate, else the main elements, else the whole page."""

    def outermost(tag: str) -> list[Node]:
        out, todo = [], [root]
        while todo:
            node = todo.pop()
            if node.tag == tag and not is_boilerplate(node):
                out.append(node)
            elif not is_boilerplate(node):
                todo.extend(reversed(node.kids))
        return out

    return outermost("article") or outermost("main") or [root]


def blocks(parts: list[Node], template: set[int]) -> list[str]:
    """The texts of the blocks in page order, without boilerplate elements and template texts (by ``id``)."""
    out: list[str] = []
    piece: list[str] = []

    def close() -> None:
        if text := " ".join("".join(piece).split()):
            out.append(text)
        piece.clear()

    def walk(node: Node) -> None:
        if node.text is not None:
            if id(node) not in template:
                piece.append(html.unescape(node.text))
            return
        if node.tag == "title" or is_boilerplate(node):
            return
        if node.tag in BLOCK:
            close()
        for kid in node.kids:
            walk(kid)
        if node.tag in BLOCK:
            close()

    for part in parts:
        walk(part)
        close()
    return out
