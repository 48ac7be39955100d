"""A small HTML reader: block elements as a tree, texts of blocks decoded, everything else as markup."""

from __future__ import annotations

import html
import re

#: Elements that break a text into blocks, those without content, those whose content is not markup, and
#: those that a new block of the same kind ends.
BLOCKS = frozenset(
    "html body main article section div header footer nav aside p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody "
    "tfoot tr td th caption blockquote pre figure figcaption address form fieldset details summary center dialog menu hr "
    "head title noscript template button select option textarea iframe svg canvas object video audio".split()
)
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS_P = BLOCKS - frozenset("button select option textarea iframe svg canvas object video audio noscript template".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table body html div article section main nav aside header footer".split())
#: Elements and name parts (of class, id, role) that hold no main text.
DROPPED = frozenset(
    "head title script style noscript template nav header footer aside form button select option textarea iframe svg canvas "
    "object dialog menu video audio".split()
)
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion menu nav navbar navigation "
    "breadcrumb breadcrumbs header masthead topbar footer sidebar aside widget related recommended share sharing social cookie "
    "cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login comment "
    "comments commentlist respond replies reply discussion disqus pagination pager contentinfo complementary search skip toolbar".split()
)
LAYOUT = frozenset("with has no without layout".split())
CONTAINERS = frozenset("article main section div td body center".split())
#: Names of what readers write, which is no main text however long it is.
READERS = frozenset("comment comments commentlist respond replies reply discussion disqus".split())
LISTS = CONTAINERS | frozenset("ul ol dl table".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_NAMES = re.compile(r"(?:^|\s)(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?", re.I)
_SPACE = re.compile(r"[ \t\n\r\f\v\xa0  -     　\x85\x1c-\x1f]+")
_PARTS = re.compile(r"[^a-z0-9]+")


def _speaks(name: str) -> bool:
    """Whether a class, id or role names something without main text ("with-sidebar" names a layout)."""
    parts = _PARTS.split(name)
    return not HINTS.isdisjoint(parts) and LAYOUT.isdisjoint(parts)


def _by_readers(name: str) -> bool:
    return not READERS.isdisjoint(_PARTS.split(name))


class Node:
    """A block element; ``parts`` holds its texts (str) and child nodes in page order."""

    __slots__ = ("tag", "label", "parts", "children", "dropped", "forced", "hinted", "index", "linked", "size", "shape", "holds")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.label = tag, tag
        self.parts: list = []
        self.children: list[Node] = []
        #: ``forced``: by its kind or because it is not shown; ``hinted``: only by its name.
        self.dropped, self.hinted, self.forced = tag in DROPPED, False, False
        self.linked = 0  # characters of link text directly in here
        self.index = self.size = self.shape = 0
        self.holds = tag in ("article", "main")
        if attributes:
            for name, a, b, c in _NAMES.findall(attributes):
                name, value = name.lower(), (a or b or c).lower()
                if name == "hidden" or name == "aria-hidden" and value == "true":
                    self.dropped = True
                elif name == "style":
                    self.dropped |= "display:none" in value.replace(" ", "")
                elif value:
                    if name == "class":
                        self.label = f"{tag}.{value.split()[0]}" if value.split() else tag
                    self.hinted |= any(_speaks(n) for n in value.split())
                    self.forced |= any(_by_readers(n) for n in value.split())
        self.forced |= self.dropped


def parse(page: str) -> Node:
    """The tree of a page; a missing end tag ends with what encloses it, a stray one is ignored."""
    root = Node("html")
    stack, in_link, at, end = [root], 0, 0, len(page)
    lowered = None

    def text(s: str) -> None:
        if s:
            stack[-1].parts.append(s)
            if in_link:
                stack[-1].linked += len(s)

    def close(k: int) -> None:
        del stack[k:]

    while True:
        m = _TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        tag = m.group(2) or m.group(5)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(1) or m.group(4):
            if tag == "a":
                in_link = 0
            elif tag in BLOCKS:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        close(k)
                        break
            elif tag == "br":
                text(" ")
            continue
        if tag == "a":
            in_link = 1
        elif tag == "br" or tag == "wbr":
            if tag == "br":
                text(" ")
        elif tag in RAW:
            lowered = page.lower() if lowered is None else lowered
            stop = lowered.find(f"</{tag}", at)
            while stop >= 0 and lowered[stop + 2 + len(tag) : stop + 3 + len(tag)] not in ("", ">", "/", " ", "\t", "\n", "\r", "\f"):
                stop = lowered.find(f"</{tag}", stop + 1)
            stop = end if stop < 0 else stop
            at = stop if stop == end else (page.find(">", stop) + 1 or end)
        elif tag in BLOCKS:
            if tag == "html" or tag == "body" and any(n.tag == "body" for n in stack):
                continue
            if tag == "body" or tag != "head" and stack[-1].tag == "head" and tag not in ("title", "noscript", "template"):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == "head":
                        close(k)
                        break
            if tag in ENDS_P and stack[-1].tag == "p":
                close(len(stack) - 1)
            rivals = SAME.get(tag)
            if rivals:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in rivals:
                        close(k)
                        break
                    if stack[k].tag in SCOPES:
                        break
            node = Node(tag, m.group(3) if m.group(2) else m.group(6))
            stack[-1].parts.append(node)
            stack[-1].children.append(node)
            if tag not in EMPTY:
                stack.append(node)
    return root


def number(root: Node) -> list[Node]:
    """All nodes in page order, each with its index, the size and shape of its subtree; drops are settled."""
    nodes: list[Node] = []
    todo = [root]
    while todo:
        n = todo.pop()
        n.index = len(nodes)
        nodes.append(n)
        todo.extend(reversed(n.children))
    for n in reversed(nodes):
        n.size = 1 + sum(c.size for c in n.children)
        n.shape = hash((n.label, *[c.shape for c in n.children]))
        n.holds |= any(c.holds for c in n.children)
        # a hint on what holds the article speaks of the page's layout, not of the element
        n.dropped |= n.hinted and not n.holds and n.tag not in ("html", "body")
    return nodes


def own_text(node: Node) -> str:
    return "".join([p for p in node.parts if type(p) is str])


def clean(text: str) -> str:
    return _SPACE.sub(" ", html.unescape(text) if "&" in text else text).strip(" ")


def blocks(root: Node) -> list[str]:
    """The texts of the blocks below ``root`` that are not dropped, in page order."""
    found: list[str] = []
    todo: list = [root]
    held: list[str] = []
    while todo:
        p = todo.pop()
        if type(p) is str:
            held.append(p)
            continue
        if held:
            t = clean("".join(held))
            held = []
            if t:
                found.append(t)
        if p is None or p.dropped or is_menu(p):
            continue
        todo.append(None)
        todo.extend(reversed(p.parts))
    t = clean("".join(held))
    return [*found, t] if t else found


def is_menu(node: Node) -> bool:
    """A list of three links or more that holds little but links."""
    if node.tag not in ("ul", "ol", "dl", "table") or len(node.children) < 3:
        return False
    linked = total = links = 0
    todo = [node]
    while todo:
        n = todo.pop()
        linked += n.linked
        links += n.linked > 0
        total += sum(len(p.strip()) for p in n.parts if type(p) is str)
        todo.extend(n.children)
    return links >= 3 and linked >= 0.8 * max(total, 1)
