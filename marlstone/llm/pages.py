"""Leaves of an HTML page: its text nodes in document order, each with the path of open elements above it.

A text node is ended by any tag or comment, not by a character reference; nodes of white space only, and those in title,
script, style, noscript and comments, don't count. Markup may be uneven: an end tag closes the nearest open element of
its name, void elements never open, p and li close an open one of their kind when another starts.
"""

from __future__ import annotations

import html as _html
import re

# Elements that have no content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES = {"p": ("p",), "li": ("li",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "option": ("option",), "dt": ("dt", "dd"), "dd": ("dt", "dd")}
_BOUND = frozenset(("table", "ul", "ol", "div", "section", "main", "body", "dl", "select"))
_BLOCKS_P = frozenset("div table ul ol section h1 h2 h3 h4 h5 h6 form hr center header footer nav main aside article blockquote pre dl".split())
_HIDDEN = re.compile(r"<!--.*?(?:-->|$)|<(script|style|noscript|title)\b[^>]*>(.*?)(?:</\1\s*>|$)", re.S | re.I)
_TAG = re.compile(r"""<[a-zA-Z/!?](?:[^'">]++|"[^"]*+"|'[^']*+')*+>""")
_TAG_AND_TEXT = re.compile(rf"""({_TAG.pattern})([^<]*+(?:<(?!{_TAG.pattern[1:]})[^<]*+)*+)""")
_HIDDEN_WORDS = re.compile(r"<(?:script|style|noscript|title)", re.I)
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9]*)")
_ATTR = re.compile(r"""\b(class|id|role|width|href)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_RANDOM = re.compile(r"^(?=.*\d)[a-z]?[0-9a-f]{2,8}$", re.I)
_HEX = re.compile(r"^[a-gx]?[0-9a-f]{2,5}$", re.I)
DEPTH = 16  # elements of a path, nearest last
_TAG_CACHE: dict[str, tuple] = {}


def _parse_tag(raw: str) -> tuple:
    """(kind, name, token, what it closes) of a tag: kind 0 nothing, 1 start, 2 end; the token is the name with its telling attributes."""
    m = _NAME.match(raw)
    if not m:
        return 0, "", "", None
    name = m.group(1).lower()
    if raw[1] == "/":
        return 2, name, "", None
    if name in VOID or raw.endswith("/>"):
        return 0, name, "", None
    token = name
    for a in _ATTR.finditer(raw):
        key, value = a.group(1).lower(), a.group(2) or a.group(3) or a.group(4) or ""
        if key == "href":
            v = "#" if value.startswith("#") else "/" + value.split("/")[1] if value.startswith("/") and value.count("/") > 1 else "." if value else ""
            token += ">" + re.sub(r"[0-9a-f]*\d[0-9a-f]*", "0", v)[:12]
        else:
            for w in value.split():
                token += "." + ("~" if _RANDOM.match(w) or _HEX.match(w) else w.lower()[:64])
    return 1, name, token, _CLOSES.get(name) or (("p",) if name in _BLOCKS_P else None)


def leaves(page: str | None) -> tuple[list[str], list[tuple[str, ...]]]:
    """(texts, paths) of a page's leaves; none for null and empty pages. texts[n - 1] is node_no n."""
    texts: list[str] = []
    paths: list[tuple[str, ...]] = []
    if not page:
        return texts, paths
    names: list[str] = []
    stack: list[str] = []
    path: tuple[str, ...] | None = ()
    cache = _TAG_CACHE
    for raw, part in _TAG_AND_TEXT.findall("<!>" + (_HIDDEN.sub("<!>", page) if "<!--" in page or _HIDDEN_WORDS.search(page) else page)):
        tag = cache.get(raw)
        if tag is None:
            tag = _parse_tag(raw)
            if len(cache) > 200_000:
                cache.clear()
            cache[raw] = tag
        kind, name, token, closes = tag
        if kind == 1:
            if closes:
                for back in range(len(names) - 1, -1, -1):
                    n = names[back]
                    if n in closes:
                        del names[back:], stack[back:]
                        if name != "tr":
                            break
                    elif n in _BOUND:
                        break
            names.append(name)
            stack.append(token)
            path = None
        elif kind == 2:
            if names and names[-1] == name:
                names.pop()
                stack.pop()
                path = None
            else:
                for back in range(len(names) - 2, -1, -1):
                    if names[back] == name:
                        del names[back:], stack[back:]
                        path = None
                        break
        if part and not part.isspace():
            text = _html.unescape(part) if "&" in part else part
            if text.strip():
                if path is None:
                    path = tuple(stack[-DEPTH:])
                texts.append(text)
                paths.append(path)
    return texts, paths


def hidden_notes(page: str | None) -> str:
    """The text of noscript elements, without tags."""
    if not page or "<noscript" not in page.lower():
        return ""
    out = [_TAG.sub(" ", m.group(2)) for m in _HIDDEN.finditer(page) if (m.group(1) or "").lower() == "noscript"]
    return _html.unescape(" ".join(out)).strip()
