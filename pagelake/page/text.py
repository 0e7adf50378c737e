"""Plain text of an element: one line per block."""

from __future__ import annotations

from ..html import Element, Node, Text

#: Elements that stand on lines of their own.
LINES = frozenset("article br div h1 h2 h3 h4 h5 h6 li main p section tr".split())
_HIDDEN = frozenset(("script", "style", "noscript"))


def element_text(root: Element) -> str:
    out: list[str] = []
    stack: list[Node | str] = [root]
    while stack:
        node = stack.pop()
        if isinstance(node, str):
            out.append(node)
        elif isinstance(node, Text):
            out.append(node.data)
        elif isinstance(node, Element) and node.name not in _HIDDEN:
            if node.name in LINES:
                out.append("\n")
                if node.name != "br":
                    stack.append("\n")
            stack.extend(reversed(node.children))
    lines = (" ".join(line.split()) for line in "".join(out).split("\n"))
    return "\n".join(line for line in lines if line)
