"""HTML parsing: a tokenizer and the tree construction that browsers agree on.

Covers implied tags, ``p`` and list closing, the list of active formatting elements with
reconstruction and the adoption agency, raw text elements, tables with foster parenting,
select, templates as ordinary containers and foreign content without case adjustment.
Frames are left out. Scripting counts as enabled, so ``noscript`` holds raw text.
"""

from __future__ import annotations

import html as _entities
import re

from .dom import Comment, Element, Node, Text

_NAME = re.compile(r"[^\t\n\f\r />]+")
_SPACE = re.compile(r"[\t\n\f\r /]*")
_ATTR = re.compile(r"[\t\n\f\r /]*([^\t\n\f\r />=][^\t\n\f\r />=]*|=[^\t\n\f\r />=]*)(?:[\t\n\f\r ]*=[\t\n\f\r ]*(?:\"([^\"]*)\"|'([^']*)'|([^\t\n\f\r >]*)))?")

#: Element groups of the HTML standard.
RAWTEXT = frozenset("script style xmp iframe noembed noframes noscript textarea title plaintext".split())
ESCAPABLE = frozenset(("textarea", "title"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr keygen basefont bgsound frame".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
SPECIAL = frozenset(
    "address applet area article aside base basefont bgsound blockquote body br button caption center col colgroup dd details dir div dl dt embed fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe img input keygen li link listing main marquee menu meta nav noembed noframes noscript object ol p param plaintext pre script search section select source style summary table tbody td template textarea tfoot th thead title tr track ul wbr xmp".split()
)
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer header hgroup main menu nav ol p search section summary ul h1 h2 h3 h4 h5 h6 pre listing form li dd dt plaintext table hr xmp".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
IMPLIED = frozenset("dd dt li optgroup option p rb rp rt rtc".split())
SCOPE = frozenset("applet caption html table td th marquee object template foreignobject desc title".split())
IN_HEAD = frozenset("base basefont bgsound link meta noframes script style template title noscript".split())
TABLE_PARTS = frozenset("caption col colgroup tbody td tfoot th thead tr".split())
FOSTER = frozenset("table tbody tfoot thead tr".split())
BLOCK_ENDS = frozenset("address article aside blockquote button center details dialog dir div dl fieldset figcaption figure footer header hgroup listing main menu nav ol pre search section summary ul".split())
_WS = " \t\n\f\r"


class _Builder:
    def __init__(self, source: str) -> None:
        self.source = source.replace("\r\n", "\n").replace("\r", "\n").replace("\0", "")
        self.document = Element("#document")
        self.stack: list[Element] = []
        self.active: list[Element | None] = []
        self.head: Element | None = None
        self.body: Element | None = None
        self.form: Element | None = None
        self.before_body = True
        self.skip_newline = False

    # -- tokens ---------------------------------------------------------------

    def run(self) -> Element:
        s, at, n = self.source, 0, len(self.source)
        while at < n:
            low = s.find("<", at)
            if low < 0:
                self.chars(_entities.unescape(s[at:]) if "&" in s[at:] else s[at:])
                break
            if low > at:
                part = s[at:low]
                self.chars(_entities.unescape(part) if "&" in part else part)
            at = self.markup(low)
        self.ensure_body()
        return self.document

    def markup(self, at: int) -> int:
        """Handles the construct that starts with ``<`` at ``at``; returns the place behind it."""
        s = self.source
        after = s[at + 1 : at + 2]
        if after.isalpha() and after.isascii():
            return self.tag(at + 1, False)
        if after == "/":
            third = s[at + 2 : at + 3]
            if third.isalpha() and third.isascii():
                return self.tag(at + 2, True)
            if third == ">":
                return at + 3
            if not third:
                self.chars("</")
                return at + 2
            end = s.find(">", at)
            self.comment(s[at + 2 : end if end >= 0 else len(s)])
            return end + 1 if end >= 0 else len(s)
        if after in ("!", "?"):
            if s.startswith("<!--", at):
                m = re.compile(r"--!?>").search(s, at + 4)
                if s.startswith(("<!-->", "<!--->"), at):
                    end = s.index(">", at)
                    self.comment("")
                    return end + 1
                self.comment(s[at + 4 : m.start() if m else len(s)])
                return m.end() if m else len(s)
            if s.startswith("<![CDATA[", at) and self.stack and self.stack[-1].foreign:
                end = s.find("]]>", at)
                self.chars(s[at + 9 : end if end >= 0 else len(s)])
                return end + 3 if end >= 0 else len(s)
            end = s.find(">", at)
            end = len(s) if end < 0 else end
            if not s[at + 2 : at + 9].lower() == "doctype":
                self.comment(s[at + 1 if after == "?" else at + 2 : end])
            return end + 1
        self.chars("<")
        return at + 1

    def tag(self, at: int, ends: bool) -> int:
        s = self.source
        m = _NAME.match(s, at)
        name, at = m.group().lower(), m.end()
        attrs: dict[str, str] = {}
        while True:
            at = _SPACE.match(s, at).end()
            if at >= len(s):
                return at
            if s[at] == ">":
                break
            m = _ATTR.match(s, at)
            if not m or m.end() == at:
                at += 1
                continue
            value = next((g for g in m.groups()[1:] if g is not None), "")
            attrs.setdefault(m.group(1).lower(), _entities.unescape(value) if "&" in value else value)
            at = m.end()
        closed = s[at - 1] == "/"
        at += 1
        if ends:
            self.end(name)
            return at
        self.start(name, attrs, closed)
        if name in RAWTEXT and self.stack and self.stack[-1].name == name and not self.stack[-1].foreign:
            return self.raw(name, at)
        return at

    def raw(self, name: str, at: int) -> int:
        s = self.source
        m = re.compile(rf"</{name}(?=[\t\n\f\r />]|$)", re.I).search(s, at) if name != "plaintext" else None
        text = s[at : m.start() if m else len(s)]
        if name == "textarea" and text.startswith("\n"):
            text = text[1:]
        if text:
            self.stack[-1].add_text(_entities.unescape(text) if name in ESCAPABLE else text)
        self.stack.pop()
        if not m:
            return len(s)
        end = s.find(">", m.end())
        return end + 1 if end >= 0 else len(s)

    # -- tree -----------------------------------------------------------------

    @property
    def current(self) -> Element:
        return self.stack[-1]

    def ensure_html(self) -> None:
        if not self.stack:
            root = Element("html")
            self.document.append(root)
            self.stack.append(root)

    def ensure_head(self) -> None:
        self.ensure_html()
        if self.head is None:
            self.head = Element("head")
            self.stack[0].append(self.head)

    def ensure_body(self) -> None:
        self.ensure_head()
        if self.body is None:
            self.body = Element("body")
            self.stack[0].append(self.body)
            self.stack[1:] = [self.body]
            self.before_body = False

    def comment(self, data: str) -> None:
        (self.stack[-1] if self.stack else self.document).append(Comment(data))

    def place(self) -> tuple[Element, Node | None]:
        """Where a new node goes: foster parenting moves it before the table."""
        target = self.current
        if target.name in FOSTER and self.fostering:
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i].name == "table":
                    table = self.stack[i]
                    return (table.parent, table) if table.parent is not None else (self.stack[i - 1], None)
            return self.stack[0], None
        return target, None

    fostering = False

    def insert(self, name: str, attrs: dict[str, str], foreign: bool = False) -> Element:
        node = Element(name, attrs, foreign)
        parent, before = self.place()
        parent.insert_before(node, before) if before is not None else parent.append(node)
        self.stack.append(node)
        return node

    def chars(self, data: str) -> None:
        if self.skip_newline:
            self.skip_newline = False
            data = data.removeprefix("\n")
        if not data:
            return
        if self.body is None:
            if self.stack and self.stack[-1].name in IN_HEAD:
                self.stack[-1].add_text(data)
                return
            rest = data.lstrip(_WS)
            if not rest:
                if self.head is not None:
                    (self.head if self.stack[-1] is self.head else self.stack[0]).add_text(data)
                return
            if self.head is None or len(data) == len(rest):
                data = rest
            self.ensure_body()
        if self.current.name in FOSTER and data.strip(_WS):
            self.fostering = True
            self.reconstruct()
            parent, before = self.place()
            parent.add_text(data, before)
            self.fostering = False
            return
        if self.current.name not in FOSTER:
            self.reconstruct()
        self.current.add_text(data)

    def in_scope(self, names: frozenset[str] | tuple[str, ...], more: tuple[str, ...] = ()) -> bool:
        for e in reversed(self.stack):
            if e.name in names:
                return True
            if e.name in SCOPE and not (e.foreign and e.name in ("title", "desc", "foreignobject")) or e.name in more:
                return False
        return False

    def pop_to(self, *names: str) -> None:
        while len(self.stack) > 1:
            if self.stack.pop().name in names:
                return

    def imply_ends(self, but: str = "") -> None:
        while self.current.name in IMPLIED and self.current.name != but:
            self.stack.pop()

    def close_p(self) -> None:
        if self.in_scope(("p",), ("button",)):
            self.imply_ends("p")
            self.pop_to("p")

    def clear_to(self, *names: str) -> None:
        while self.current.name not in names and self.current.name not in ("html", "template"):
            self.stack.pop()

    # -- active formatting elements ----------------------------------------------

    def remember(self, e: Element) -> None:
        same = []
        for i in range(len(self.active) - 1, -1, -1):
            other = self.active[i]
            if other is None:
                break
            if other.name == e.name and other.attrs == e.attrs:
                same.append(i)
        if len(same) >= 3:
            del self.active[same[-1]]
        self.active.append(e)

    def reconstruct(self) -> None:
        if not self.active or self.active[-1] is None or any(self.active[-1] is x for x in self.stack):
            return
        at = len(self.active) - 1
        while at > 0 and self.active[at - 1] is not None and not any(self.active[at - 1] is x for x in self.stack):
            at -= 1
        for i in range(at, len(self.active)):
            old = self.active[i]
            self.active[i] = self.insert(old.name, dict(old.attrs))

    def forget_to_marker(self) -> None:
        while self.active and self.active.pop() is not None:
            pass

    def _index(self, where: list, e: Element) -> int:
        return next((i for i, x in enumerate(where) if x is e), -1)

    def adopt(self, name: str) -> None:
        """The adoption agency: closes a formatting element that other elements may overlap."""
        if self.current.name == name and self._index(self.active, self.current) < 0:
            self.stack.pop()
            return
        for _ in range(8):
            fmt = None
            for x in reversed(self.active):
                if x is None:
                    break
                if x.name == name:
                    fmt = x
                    break
            if fmt is None:
                self.any_end(name)
                return
            at = self._index(self.stack, fmt)
            if at < 0:
                del self.active[self._index(self.active, fmt)]
                return
            if not self._node_in_scope(fmt):
                return
            far = next((i for i in range(at + 1, len(self.stack)) if self.stack[i].name in SPECIAL), -1)
            if far < 0:
                del self.stack[at:]
                del self.active[self._index(self.active, fmt)]
                return
            block, above = self.stack[far], self.stack[at - 1]
            mark = self._index(self.active, fmt)
            last, i, inner = block, far, 0
            while True:
                i -= 1
                node = self.stack[i]
                if node is fmt:
                    break
                inner += 1
                k = self._index(self.active, node)
                if inner > 3 and k >= 0:
                    del self.active[k]
                    if k < mark:
                        mark -= 1
                    k = -1
                if k < 0:
                    del self.stack[i]
                    continue
                copy = Element(node.name, dict(node.attrs))
                self.active[k] = copy
                self.stack[i] = copy
                if last is block:
                    mark = k + 1
                last.remove()
                copy.append(last)
                last = copy
            last.remove()
            if above.name in FOSTER:
                keep, self.fostering = self.fostering, True
                rest = self.stack
                self.stack = self.stack[: self._index(rest, above) + 1]
                parent, before = self.place()
                self.stack, self.fostering = rest, keep
                parent.insert_before(last, before) if before is not None else parent.append(last)
            else:
                above.append(last)
            copy = Element(fmt.name, dict(fmt.attrs))
            for child in block.children:
                child.parent = copy
            copy.children, block.children = block.children, []
            block.append(copy)
            k = self._index(self.active, fmt)
            del self.active[k]
            if k < mark:
                mark -= 1
            self.active.insert(mark, copy)
            del self.stack[self._index(self.stack, fmt)]
            self.stack.insert(self._index(self.stack, block) + 1, copy)

    def _node_in_scope(self, e: Element) -> bool:
        for x in reversed(self.stack):
            if x is e:
                return True
            if x.name in SCOPE:
                return False
        return False

    def any_end(self, name: str) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            e = self.stack[i]
            if e.name == name:
                self.imply_ends(name)
                del self.stack[i:]
                return
            if e.name in SPECIAL:
                return

    # -- start tags --------------------------------------------------------------

    def start(self, name: str, attrs: dict[str, str], closed: bool) -> None:
        self.skip_newline = False
        if name == "html":
            self.ensure_html()
            for k, v in attrs.items():
                self.stack[0].attrs.setdefault(k, v)
            return
        if self.body is None:
            if name == "head":
                if self.head is None:
                    self.ensure_head()
                    self.head.attrs.update(attrs)
                    self.stack.append(self.head)
                return
            if name in IN_HEAD:
                self.ensure_head()
                if len(self.stack) == 1 or self.stack[-1] is not self.head:
                    if self.stack[-1].name == "template":
                        self.insert(name, attrs)
                        if name in VOID:
                            self.stack.pop()
                        return
                    self.stack.append(self.head)
                    self.insert(name, attrs)
                    node = self.stack.pop()
                    self.stack.pop()
                    if name not in VOID:
                        self.stack.append(node)
                    return
                self.insert(name, attrs)
                if name in VOID:
                    self.stack.pop()
                return
            if self.stack and self.stack[-1].name == "template":
                pass
            else:
                self.ensure_body()
                if name == "body":
                    self.body.attrs.update(attrs)
                    return
        elif name == "body":
            for k, v in attrs.items():
                self.body.attrs.setdefault(k, v)
            return
        elif name in ("head", "frame", "frameset"):
            return
        if self.current.foreign and not (self.current.name in ("foreignobject", "desc", "title") or name in ("b", "br", "div", "p", "ul", "ol", "li", "span", "table", "img", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "code", "em", "strong", "body", "head")):
            self.insert(name, attrs, foreign=True)
            if closed:
                self.stack.pop()
            return
        while self.current.foreign and self.current.name not in ("foreignobject", "desc", "title"):
            self.stack.pop()
        if self.in_table(name, attrs):
            return
        self.in_body(name, attrs, closed)

    def in_table(self, name: str, attrs: dict[str, str]) -> bool:
        """Start tags that table structure handles; True if done."""
        here = self.current.name
        inside = any(e.name in ("table", "template") for e in self.stack)
        if name in TABLE_PARTS:
            if not any(e.name == "table" for e in self.stack):
                return True
            if any(e.name == "select" for e in self.stack):
                self.pop_to("select")
            if name in ("td", "th"):
                if self.in_scope(("td", "th"), ("tr",)):
                    self.close_cell()
                if not self.in_scope(("tr",)):
                    self.in_table("tr", {})
                self.clear_to("tr")
                self.insert(name, attrs)
                self.active.append(None)
                return True
            if self.in_scope(("td", "th")):
                self.close_cell()
            if self.in_scope(("caption",)):
                self.pop_to("caption")
                self.forget_to_marker()
            if name == "tr":
                if not self.in_scope(("tbody", "thead", "tfoot")):
                    self.clear_to("table")
                    self.insert("tbody", {})
                self.clear_to("tbody", "thead", "tfoot")
                self.insert(name, attrs)
                return True
            if name == "col":
                if self.current.name != "colgroup":
                    self.clear_to("table")
                    self.insert("colgroup", {})
                self.insert(name, attrs)
                self.stack.pop()
                return True
            self.clear_to("table")
            self.insert(name, attrs)
            if name == "caption":
                self.active.append(None)
            return True
        if here == "colgroup":
            self.stack.pop()
            here = self.current.name
        if here in FOSTER and inside:
            if name == "table":
                self.pop_to("table")
                return False
            if name in ("script", "style", "template") or name == "input" and attrs.get("type", "").lower() == "hidden":
                self.insert(name, attrs)
                if name == "input":
                    self.stack.pop()
                return True
            if name == "form":
                if self.form is None:
                    self.form = self.insert(name, attrs)
                    self.stack.pop()
                return True
            self.fostering = True
            self.in_body(name, attrs, False)
            self.fostering = False
            return True
        return False

    def close_cell(self) -> None:
        self.imply_ends()
        self.pop_to("td", "th")
        self.forget_to_marker()

    def in_body(self, name: str, attrs: dict[str, str], closed: bool) -> None:
        if any(e.name == "select" for e in self.stack[-3:]) and name in ("select", "input", "textarea", "keygen"):
            self.pop_to("select")
            if name == "select":
                return
        if name in CLOSES_P:
            if name in ("li", "dd", "dt"):
                group = ("li",) if name == "li" else ("dd", "dt")
                for e in reversed(self.stack):
                    if e.name in group:
                        self.imply_ends(e.name)
                        self.pop_to(e.name)
                        break
                    if e.name in SPECIAL and e.name not in ("address", "div", "p"):
                        break
            if name == "form" and self.form is not None:
                return
            self.close_p()
            if name in HEADINGS and self.current.name in HEADINGS:
                self.stack.pop()
            node = self.insert(name, attrs)
            if name in ("pre", "listing"):
                self.skip_newline = True
            if name == "form":
                self.form = node
            if name == "hr":
                self.stack.pop()
            return
        if name == "a":
            for x in reversed(self.active):
                if x is None:
                    break
                if x.name == "a":
                    self.adopt("a")
                    if self._index(self.active, x) >= 0:
                        del self.active[self._index(self.active, x)]
                    if self._index(self.stack, x) >= 0:
                        del self.stack[self._index(self.stack, x)]
                    break
        if name in FORMATTING:
            self.reconstruct()
            if name == "nobr" and self.in_scope(("nobr",)):
                self.adopt("nobr")
                self.reconstruct()
            self.remember(self.insert(name, attrs))
            return
        if name == "button":
            if self.in_scope(("button",)):
                self.imply_ends()
                self.pop_to("button")
            self.reconstruct()
            self.insert(name, attrs)
            return
        if name in ("applet", "marquee", "object"):
            self.reconstruct()
            self.insert(name, attrs)
            self.active.append(None)
            return
        if name in ("option", "optgroup"):
            if self.current.name == "option":
                self.stack.pop()
            if name == "optgroup" and self.current.name == "optgroup":
                self.stack.pop()
            self.reconstruct()
            self.insert(name, attrs)
            return
        if name in ("rb", "rtc", "rp", "rt"):
            if self.in_scope(("ruby",)):
                self.imply_ends("rtc" if name in ("rp", "rt") else "")
            self.insert(name, attrs)
            return
        if name in ("svg", "math"):
            self.reconstruct()
            self.insert(name, attrs, foreign=True)
            if closed:
                self.stack.pop()
            return
        if name == "image":
            name = "img"
        if name in VOID:
            if name not in ("base", "link", "meta", "param", "source", "track", "basefont", "bgsound"):
                self.reconstruct()
            self.insert(name, attrs)
            self.stack.pop()
            return
        if name not in RAWTEXT or name in ("textarea",):
            self.reconstruct()
        self.insert(name, attrs)

    # -- end tags ----------------------------------------------------------------

    def end(self, name: str) -> None:
        self.skip_newline = False
        if self.body is None:
            if name == "head" and self.head is not None:
                if self.stack[-1] is self.head:
                    self.stack.pop()
                return
            if self.stack and self.stack[-1].name == name and name not in ("html", "head"):
                self.stack.pop()
                return
            if name not in ("body", "html", "br", "p"):
                return
            self.ensure_body()
        if name in ("body", "html"):
            return
        if self.current.foreign:
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i].name == name:
                    del self.stack[i:]
                    return
                if not self.stack[i].foreign:
                    break
        if name in FORMATTING:
            self.adopt(name)
        elif name == "p":
            if not self.in_scope(("p",), ("button",)):
                self.in_body("p", {}, False)
            self.imply_ends("p")
            self.pop_to("p")
        elif name == "br":
            self.start("br", {}, False)
        elif name in HEADINGS:
            if self.in_scope(HEADINGS):
                self.imply_ends()
                self.pop_to(*HEADINGS)
        elif name in ("li", "dd", "dt"):
            if self.in_scope((name,), ("ol", "ul") if name == "li" else ()):
                self.imply_ends(name)
                self.pop_to(name)
        elif name == "form":
            node, self.form = self.form, None
            if node is not None and self._index(self.stack, node) >= 0:
                self.imply_ends()
                del self.stack[self._index(self.stack, node)]
        elif name in ("td", "th"):
            if self.in_scope((name,), ("table",)):
                self.imply_ends()
                self.pop_to(name)
                self.forget_to_marker()
        elif name in ("tr", "tbody", "thead", "tfoot", "table"):
            if self._table_scope(name):
                if name != "table" and self.in_scope(("td", "th"), ("tr",)):
                    self.close_cell()
                while self.current.name != name:
                    if self.current.name in ("td", "th", "caption"):
                        self.forget_to_marker()
                    self.stack.pop()
                self.stack.pop()
        elif name == "caption":
            if self._table_scope("caption"):
                self.imply_ends()
                self.pop_to("caption")
                self.forget_to_marker()
        elif name in ("col", "colgroup"):
            if self.current.name == "colgroup":
                self.stack.pop()
        elif name in ("select", "template"):
            if any(e.name == name for e in self.stack):
                self.pop_to(name)
        elif name in BLOCK_ENDS or name in ("applet", "marquee", "object"):
            if self.in_scope((name,)):
                self.imply_ends()
                self.pop_to(name)
                if name in ("applet", "marquee", "object"):
                    self.forget_to_marker()
        else:
            self.any_end(name)

    def _table_scope(self, name: str) -> bool:
        for e in reversed(self.stack):
            if e.name == name:
                return True
            if e.name in ("table", "html", "template"):
                return False
        return False


def parse_document(source: str) -> Element:
    """The ``html`` element of a document; never raises, whatever the text."""
    document = _Builder(source).run()
    return next(c for c in document.children if isinstance(c, Element))


__all__ = ["Comment", "Text", "parse_document"]
