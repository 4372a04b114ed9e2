"""A small HTML tree on the standard tokenizer, with the selectors that listing pages need.

Void elements never open, an end tag pops to the nearest open match, no end tag is implied. Selectors: tag, .class, #id,
[attr], [attr=v], [attr*=v], compounds of these, descendants, comma groups. Matches come in document order.

Elements are indexed by tag, class, id and attribute while the page is read, so that a selector looks at the few elements
that its last part can mean; texts lie in one list, of which an element is a slice.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NO_TEXT = frozenset(("script", "style", "template"))
_WHITE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "attrs", "parent", "tree", "order", "last", "text_from", "text_to", "n_children", "only")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None, tree: _Tree):
        self.tag, self.attrs, self.parent, self.tree = tag, attrs, parent, tree
        self.order = self.last = len(tree.nodes)  # place in document order; that of the last element inside
        self.text_from = self.text_to = len(tree.texts)
        self.n_children, self.only = 0, None  # children of both kinds; the only one, if there is one

    def strings(self) -> list[str]:
        """The texts inside, without those of scripts, styles and templates."""
        t = self.tree
        return [s for s, seen in zip(t.texts[self.text_from : self.text_to], t.seen[self.text_from : self.text_to]) if seen]

    def raw_text(self) -> str:
        """The texts inside, put together as they stand."""
        return "".join(self.strings())

    def raw_text_lines(self) -> str:
        """The texts inside as they stand, a line each."""
        return "\n".join(self.strings())

    def text(self) -> str:
        """``raw_text`` with runs of white space as one blank, trimmed."""
        return _WHITE.sub(" ", self.raw_text()).strip()

    def spaced_text(self, sep: str = " ") -> str:
        """Trimmed texts with ``sep`` between."""
        return sep.join(s for s in (x.strip() for x in self.strings()) if s)

    def holds_one_text(self) -> bool:
        """Whether there is nothing inside but one text, however many elements are around it."""
        n = self
        while n.n_children == 1 and isinstance(n.only, Node):
            n = n.only
        return n.n_children == 1

    def get(self, name: str, default: str = "") -> str:
        return self.attrs.get(name, default)

    def select(self, selector: str) -> list[Node]:
        groups = _compile(selector)
        if len(groups) == 1:
            return self.tree.matches(self, groups[0])
        found = {n.order: n for g in groups for n in self.tree.matches(self, g)}
        return [found[k] for k in sorted(found)]

    def first(self, *selectors: str) -> Node | None:
        """The first match of the first selector that has one."""
        for s in selectors:
            got = self.select(s)
            if got:
                return got[0]
        return None


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[Node] = []
        self.texts: list[str] = []
        self.seen: list[bool] = []
        self.by: dict[tuple[str, str], list[Node]] = {}
        self.hidden = 0
        self.root = self.at = Node("", {}, None, self)
        self.nodes.append(self.root)

    def _add(self, tag: str, attrs: list) -> Node:
        up = self.at
        n = Node(tag, {k: v or "" for k, v in reversed(attrs)} if attrs else {}, up, self)
        up.n_children += 1
        up.only = n
        self.nodes.append(n)
        self.by.setdefault(("tag", tag), []).append(n)
        for k, v in n.attrs.items():
            self.by.setdefault(("has", k), []).append(n)
            if k == "class":
                for c in set(v.split()):
                    self.by.setdefault(("class", c), []).append(n)
            elif k == "id":
                self.by.setdefault(("id", v), []).append(n)
        return n

    def handle_starttag(self, tag: str, attrs: list) -> None:
        n = self._add(tag, attrs)
        if tag not in VOID:
            self.at = n
            self.hidden += tag in NO_TEXT

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self._add(tag, attrs)

    def _close(self, n: Node) -> None:
        n.last, n.text_to = len(self.nodes) - 1, len(self.texts)
        self.hidden -= n.tag in NO_TEXT

    def handle_endtag(self, tag: str) -> None:
        n = self.at
        while n.parent is not None and n.tag != tag:
            n = n.parent
        if n.parent is None:
            return
        while self.at is not n:
            self._close(self.at)
            self.at = self.at.parent
        self._close(n)
        self.at = n.parent

    def handle_data(self, data: str) -> None:
        self.at.n_children += 1
        self.at.only = data
        self.texts.append(data)
        self.seen.append(not self.hidden)

    def finish(self) -> Node:
        while self.at is not None:
            self._close(self.at)
            self.at = self.at.parent
        return self.root

    def matches(self, top: Node, steps: tuple) -> list[Node]:
        """Elements inside ``top`` that fit the last step, and whose ancestors fit the others."""
        tests = steps[-1]
        pools = [self.by.get((k, v), ()) if k != "=" and k != "*=" else self.by.get(("has", v), ()) for k, v, _ in tests]
        pool = min(pools, key=len) if pools else self.nodes[1:]
        if top.parent is not None and pool:
            lo = bisect_left(pool, top.order + 1, key=lambda n: n.order)
            pool = pool[lo : bisect_left(pool, top.last + 1, lo, key=lambda n: n.order)]
        return [n for n in pool if (len(tests) == 1 and tests[0][0] not in ("=", "*=") or _fits(n, tests)) and (len(steps) == 1 or _inside(n, steps))]


def parse(html: str | None) -> Node:
    """The tree of a page; an empty one for null."""
    t = _Tree()
    t.feed(html or "")
    t.close()
    return t.finish()


_PART = re.compile(r"""([a-zA-Z][\w-]*|\*)|\.([\w-]+)|\#([\w-]+)|\[\s*([\w:-]+)\s*(?:(\*?=)\s*(?:"([^"]*)"|'([^']*)'|([^\]\s]+)))?\s*\]""")


@lru_cache(maxsize=1024)
def _compile(selector: str) -> tuple:
    groups = []
    for g in selector.split(","):
        steps = []
        for word in re.findall(r"(?:\[[^\]]*\]|[^\s\[])+", g.strip()):
            tests = []
            for tag, cls, ident, attr, op, v1, v2, v3 in _PART.findall(word):
                if tag and tag != "*":
                    tests.append(("tag", tag.lower(), ""))
                elif cls:
                    tests.append(("class", cls, ""))
                elif ident:
                    tests.append(("id", ident, ""))
                elif attr:
                    tests.append((op or "has", attr.lower(), v1 or v2 or v3))
            steps.append(tuple(tests))
        groups.append(tuple(steps))
    return tuple(groups)


def _fits(n: Node, tests: tuple) -> bool:
    for kind, name, value in tests:
        if kind == "tag":
            ok = n.tag == name
        elif kind == "class":
            ok = name in n.get("class").split()
        elif kind == "id":
            ok = n.get("id") == name
        elif kind == "has":
            ok = name in n.attrs
        elif kind == "=":
            ok = n.attrs.get(name) == value
        else:
            ok = value in n.get(name)
        if not ok:
            return False
    return True


def _inside(n: Node, steps: tuple) -> bool:
    up, k = n.parent, len(steps) - 2
    while k >= 0 and up is not None:
        if _fits(up, steps[k]):
            k -= 1
        up = up.parent
    return k < 0
