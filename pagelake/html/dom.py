"""The document tree: elements, texts and comments, linked by parent and child lists."""

from __future__ import annotations

from collections.abc import Iterator


class Node:
    __slots__ = ("parent",)

    def __init__(self) -> None:
        self.parent: Element | None = None

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children.remove(self) if self.parent.children.count(self) == 1 else self._cut()
            self.parent = None

    def _cut(self) -> None:
        self.parent.children = [c for c in self.parent.children if c is not self]


class Text(Node):
    __slots__ = ("data",)

    def __init__(self, data: str) -> None:
        super().__init__()
        self.data = data


class Comment(Node):
    __slots__ = ("data",)

    def __init__(self, data: str) -> None:
        super().__init__()
        self.data = data


class Element(Node):
    __slots__ = ("attrs", "children", "foreign", "name")

    def __init__(self, name: str, attrs: dict[str, str] | None = None, foreign: bool = False) -> None:
        super().__init__()
        self.name, self.attrs, self.children, self.foreign = name, attrs or {}, [], foreign

    def append(self, node: Node) -> None:
        node.parent = self
        self.children.append(node)

    def insert_before(self, node: Node, before: Node) -> None:
        node.parent = self
        self.children.insert(next(i for i, c in enumerate(self.children) if c is before), node)

    def add_text(self, data: str, before: Node | None = None) -> None:
        """Appends to a neighbouring text node or makes a new one."""
        if before is None:
            last = self.children[-1] if self.children else None
            if isinstance(last, Text):
                last.data += data
            else:
                self.append(Text(data))
            return
        at = next(i for i, c in enumerate(self.children) if c is before)
        if at and isinstance(self.children[at - 1], Text):
            self.children[at - 1].data += data
        else:
            node = Text(data)
            node.parent = self
            self.children.insert(at, node)

    def walk(self) -> Iterator[Node]:
        """This element and everything under it, in document order."""
        stack: list[Node] = [self]
        while stack:
            node = stack.pop()
            yield node
            if isinstance(node, Element):
                stack.extend(reversed(node.children))

    def elements(self, *names: str) -> Iterator[Element]:
        """Elements under this one, in document order, of the given names if there are any."""
        first = True
        for node in self.walk():
            if not first and isinstance(node, Element) and (not names or node.name in names):
                yield node
            first = False

    def ancestors(self) -> Iterator[Element]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def texts(self) -> Iterator[str]:
        for node in self.walk():
            if isinstance(node, Text):
                yield node.data

    def text(self) -> str:
        return "".join(self.texts())

    def joined_text(self) -> str:
        """Trimmed non-empty text nodes, joined by a space."""
        return " ".join(t for t in (x.strip() for x in self.texts()) if t)
