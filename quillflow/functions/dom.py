"""A small document tree for HTML and XML with CSS selectors, in plain Python for use inside vectorised functions.

HTML is parsed leniently: void elements, implied end tags of p, li, dt, dd, tr, td, th, option and the like, unclosed
elements closed by their parents. Text is given with runs of white space as one space.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style"))
BLOCK = frozenset("address article aside blockquote body br dd details div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section table tbody td tfoot th thead title tr ul".split())
_ENDS_P = BLOCK - {"br", "body", "html", "head", "title", "option", "td", "th", "tr", "tbody", "thead", "tfoot"}
#: A start tag closes open elements of these names, up to the nearest of the bounds.
_IMPLIED: dict[str, tuple[frozenset[str], frozenset[str]]] = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "tbody": (frozenset({"tbody", "thead", "tfoot", "tr", "td", "th"}), frozenset({"table"})),
    "tfoot": (frozenset({"tbody", "thead", "tfoot", "tr", "td", "th"}), frozenset({"table"})),
}


class Node:
    """An element, or with the tag None a piece of text. data marks text that isn't shown (scripts, comments)."""

    __slots__ = ("attrs", "children", "data", "parent", "tag", "text")

    def __init__(self, tag: str | None, attrs: dict[str, str] | None = None, text: str = "", data: str = ""):
        self.tag, self.attrs, self.text, self.data = tag, attrs or {}, text, data
        self.children: list[Node] = []
        self.parent: Node | None = None

    def add(self, child: Node) -> Node:
        child.parent = self
        self.children.append(child)
        return child

    def elements(self) -> list[Node]:
        return [c for c in self.children if c.tag]

    def walk(self) -> Iterator[Node]:
        """All elements below, in document order."""
        stack = [iter(self.children)]
        while stack:
            for c in stack[-1]:
                if c.tag:
                    yield c
                    stack.append(iter(c.children))
                    break
            else:
                stack.pop()

    def pieces(self) -> Iterator[str]:
        for c in self.children:
            if c.tag is None:
                if not c.data:
                    yield c.text
            else:
                edge = c.tag in BLOCK
                if edge:
                    yield " "
                yield from c.pieces()
                if edge:
                    yield " "


class _Builder(HTMLParser):
    def __init__(self, xml: bool):
        super().__init__(convert_charrefs=True)
        self.xml, self.root = xml, Node("#root")
        self.at = self.root
        if xml:
            self.CDATA_CONTENT_ELEMENTS = ()

    def close_to(self, names: frozenset[str], bounds: frozenset[str]) -> None:
        node, last = self.at, None
        while node.parent and node.tag not in bounds:
            if node.tag in names:
                last = node
            node = node.parent
        if last is not None:
            self.at = last.parent

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.xml:
            tag = self._name(tag)
        else:
            if tag in ("html", "head", "body"):
                known = next((n for n in self.root.walk() if n.tag == tag), None)
                if known is not None:
                    for k, v in attrs:
                        known.attrs.setdefault(k, v or "")
                    return
            if tag in _ENDS_P:
                self.close_to(frozenset({"p"}), frozenset({"td", "th", "table", "button"}))
            if tag in _IMPLIED:
                self.close_to(*_IMPLIED[tag])
        node = self.at.add(Node(tag, {k: v or "" for k, v in attrs}))
        if self.xml or tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if self.xml:
            self.at = self.at.parent or self.root

    def _name(self, tag: str) -> str:
        """XML keeps the case of names; the tokenizer lowers it, so it's read from the source."""
        raw = self.get_starttag_text() or ""
        m = re.match(r"<\s*([^\s/>]+)", raw)
        return m[1] if m else tag

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent and (node.tag or "").lower() != tag:
            node = node.parent
        if node.parent:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        hidden = data if self.at.tag in RAW and not self.xml else ""
        self.at.add(Node(None, text="" if hidden else data, data=hidden))

    def handle_comment(self, data: str) -> None:
        pass

    def unknown_decl(self, data: str) -> None:
        if data.startswith("CDATA["):
            self.at.add(Node(None, text=data[6:]))


def parse(source: str, parser: str = "html") -> Node:
    """The tree's root. HTML without html, head or body elements gets none of its own."""
    builder = _Builder(parser == "xml")
    builder.feed(source)
    builder.close()
    return builder.root


def text_of(node: Node) -> str:
    return re.sub(r"\s+", " ", "".join(node.pieces())).strip()


def own_text(node: Node) -> str:
    return re.sub(r"\s+", " ", "".join(c.text if c.tag is None else " " if c.tag == "br" else "" for c in node.children)).strip()


def data_of(node: Node) -> str:
    return "".join(c.data if c.tag is None else data_of(c) for c in node.children)


def inner_html(node: Node) -> str:
    return "".join(html.escape(c.text, quote=False) + c.data if c.tag is None else outer_html(c) for c in node.children)


def outer_html(node: Node) -> str:
    if node.tag == "#root":
        return inner_html(node)
    attrs = "".join(f' {k}="{html.escape(v)}"' for k, v in node.attrs.items())
    return f"<{node.tag}{attrs}>" + ("" if node.tag in VOID else f"{inner_html(node)}</{node.tag}>")


def css_path(node: Node) -> str:
    """A selector that hits the element: its id where it has one, else a path of tags, classes and positions."""
    if node.attrs.get("id"):
        return f"#{node.attrs['id']}"
    name = node.tag + "".join(f".{c}" for c in node.attrs.get("class", "").split())
    parent = node.parent
    if parent is None or parent.tag == "#root":
        return name
    same = [c for c in parent.elements() if c.tag == node.tag and c.attrs.get("class", "") == node.attrs.get("class", "")]
    if len(same) > 1:
        name += f":nth-child({parent.elements().index(node) + 1})"
    return f"{css_path(parent)} > {name}"


def value_of(node: Node, extract: str = "text") -> str:
    """What an extract mode takes from an element; an unknown mode takes the text."""
    kind = (extract or "text").strip()
    attr = re.fullmatch(r"(?i)attr\((.*)\)", kind)
    if attr:
        return node.attrs.get(attr[1].strip().lower(), node.attrs.get(attr[1].strip(), ""))
    of: dict[str, Callable[[Node], str]] = {
        "html": inner_html, "outerhtml": outer_html, "owntext": own_text, "data": data_of, "id": lambda n: n.attrs.get("id", ""), "tagname": lambda n: n.tag or "",
        "val": lambda n: text_of(n) if n.tag == "textarea" else n.attrs.get("value", ""), "classname": lambda n: n.attrs.get("class", ""), "cssselector": css_path,
    }
    return of.get(kind.lower(), text_of)(node)


# Selectors

_TOKEN = re.compile(
    r"""(?P<space>\s*[>+~,]\s*|\s+)|(?P<tag>\*|[\w|-]+)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~^$*|!]?=)\s*(?:"(?P<v1>[^"]*)"|'(?P<v2>[^']*)'|(?P<v3>[^\]\s]+))\s*)?\]|:(?P<pseudo>[\w-]+)(?:\((?P<arg>(?:[^()]|\([^()]*\))*)\))?""",
    re.X,
)
Test = Callable[[Node], bool]


def _nth(arg: str) -> Callable[[int], bool]:
    arg = arg.strip().lower().replace(" ", "")
    arg = {"odd": "2n+1", "even": "2n"}.get(arg, arg)
    if "n" in arg:
        a, b = arg.split("n", 1)
        step, start = int(a + "1" if a in ("", "+", "-") else a), int(b or 0)
        return lambda i: (i - start) % step == 0 and (i - start) // step >= 0 if step else i == start
    return lambda i: i == int(arg)


def _pseudo(name: str, arg: str | None) -> Test:
    kids = lambda n: n.parent.elements() if n.parent else [n]
    same = lambda n: [c for c in kids(n) if c.tag == n.tag]
    simple: dict[str, Test] = {
        "first-child": lambda n: kids(n)[0] is n, "last-child": lambda n: kids(n)[-1] is n, "only-child": lambda n: len(kids(n)) == 1,
        "first-of-type": lambda n: same(n)[0] is n, "last-of-type": lambda n: same(n)[-1] is n, "only-of-type": lambda n: len(same(n)) == 1,
        "empty": lambda n: not any(c.tag or c.text for c in n.children), "root": lambda n: n.parent is not None and n.parent.tag == "#root",
    }
    if name in simple:
        return simple[name]
    if arg is None:
        raise ValueError(f"selector :{name} isn't supported")
    if name in ("nth-child", "nth-of-type", "nth-last-child", "nth-last-of-type"):
        of, ok = (same if name.endswith("type") else kids), _nth(arg)
        return lambda n: ok((len(of(n)) - of(n).index(n)) if "last" in name else of(n).index(n) + 1)
    if name == "not":
        inner = compile_selector(arg)
        return lambda n: not matches(n, inner)
    if name == "has":
        inner = compile_selector(arg)
        return lambda n: any(matches(c, inner) for c in n.walk())
    want = arg.strip().strip("\"'")
    if name == "contains":
        return lambda n: want.lower() in text_of(n).lower()
    if name == "containsown":
        return lambda n: want.lower() in own_text(n).lower()
    if name == "matches":
        return lambda n: re.search(want, text_of(n)) is not None
    index = {"eq": lambda i, k: i == k, "lt": lambda i, k: i < k, "gt": lambda i, k: i > k}
    if name in index:
        return lambda n: index[name](kids(n).index(n), int(want))
    raise ValueError(f"selector :{name} isn't supported")


def _attribute(name: str, op: str | None, value: str) -> Test:
    got = lambda n: n.attrs.get(name, n.attrs.get(name.lower()))
    if op is None:
        return lambda n: got(n) is not None
    tests: dict[str, Callable[[str], bool]] = {
        "=": lambda v: v.strip().lower() == value.lower(), "~=": lambda v: value in v.split(), "^=": lambda v: v.lower().startswith(value.lower()),
        "$=": lambda v: v.lower().endswith(value.lower()), "*=": lambda v: value.lower() in v.lower(), "|=": lambda v: v == value or v.startswith(value + "-"),
    }
    if op == "!=":
        return lambda n: got(n) is None or got(n).lower() != value.lower()
    return lambda n: got(n) is not None and tests[op](got(n))


Compound = list[Test]
Chain = list[tuple[str, Compound]]


@lru_cache(maxsize=256)
def compile_selector(selector: str) -> tuple[Chain, ...]:
    """Alternatives, each a chain of (combinator to the part before, tests)."""
    groups: list[Chain] = []
    chain: Chain = [("", [])]
    at, text = 0, selector.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"bad selector {selector!r} at {at}")
        at = m.end()
        part = chain[-1][1]
        if m["space"] is not None:
            sign = m["space"].strip()
            if sign == ",":
                groups.append(chain)
                chain = [("", [])]
            else:
                chain.append((sign or " ", []))
        elif m["tag"]:
            tag = m["tag"].replace("|", ":")
            if tag != "*":
                part.append(lambda n, t=tag.lower(): n.tag.lower() == t)
        elif m["id"]:
            part.append(lambda n, v=m["id"]: n.attrs.get("id") == v)
        elif m["cls"]:
            part.append(lambda n, v=m["cls"].lower(): v in n.attrs.get("class", "").lower().split())
        elif m["attr"]:
            part.append(_attribute(m["attr"], m["op"], next((v for v in (m["v1"], m["v2"], m["v3"]) if v is not None), "")))
        else:
            part.append(_pseudo(m["pseudo"].lower(), m["arg"]))
    groups.append(chain)
    return tuple(groups)


def _chain_matches(node: Node, chain: Chain, at: int) -> bool:
    sign, tests = chain[at]
    if not all(t(node) for t in tests):
        return False
    if at == 0:
        return True
    if sign == ">":
        return node.parent is not None and node.parent.tag != "#root" and _chain_matches(node.parent, chain, at - 1)
    if sign in "+~":
        before = node.parent.elements()[: node.parent.elements().index(node)] if node.parent else []
        return any(_chain_matches(b, chain, at - 1) for b in (before[-1:] if sign == "+" else before))
    up = node.parent
    while up is not None and up.tag != "#root":
        if _chain_matches(up, chain, at - 1):
            return True
        up = up.parent
    return False


def matches(node: Node, selector: tuple[Chain, ...]) -> bool:
    return any(_chain_matches(node, chain, len(chain) - 1) for chain in selector)


def select(root: Node, selector: str) -> list[Node]:
    """Elements that a selector hits, in document order."""
    compiled = compile_selector(selector)
    return [n for n in root.walk() if matches(n, compiled)]


def extract_all(source: str, selector: str, parser: str = "html", extract: str = "text") -> list[str]:
    return [value_of(n, extract) for n in select(parse(source, parser), selector)]


def delete(source: str, selectors: list[str], parser: str = "html") -> str:
    """The document without the elements that any of the selectors hits."""
    root = parse(source, parser)
    for selector in selectors:
        for node in select(root, selector):
            if node.parent and node in node.parent.children:
                node.parent.children.remove(node)
    return inner_html(root)
