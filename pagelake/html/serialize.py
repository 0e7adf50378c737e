"""Serialisation as the HTML standard writes fragments."""

from __future__ import annotations

from .dom import Comment, Element, Node, Text

VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("style script xmp iframe noembed noframes plaintext".split())


def _text(data: str) -> str:
    return data.replace("&", "&amp;").replace("\u00a0", "&nbsp;").replace("<", "&lt;").replace(">", "&gt;")


def _attr(data: str) -> str:
    return data.replace("&", "&amp;").replace("\u00a0", "&nbsp;").replace('"', "&quot;")


def _write(node: Node, out: list[str]) -> None:
    """Depth first with an explicit stack, as pages may nest thousands of elements."""
    stack: list[Node | str] = [node]
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            out.append(item)
        elif isinstance(item, Text):
            out.append(item.data if item.parent is not None and item.parent.name in RAW else _text(item.data))
        elif isinstance(item, Comment):
            out.append(f"<!--{item.data}-->")
        elif isinstance(item, Element):
            attrs = "".join(f' {k}="{_attr(v)}"' for k, v in item.attrs.items())
            out.append(f"<{item.name}{attrs}>")
            if item.name not in VOID:
                stack.append(f"</{item.name}>")
                stack.extend(reversed(item.children))


def outer_html(node: Node) -> str:
    out: list[str] = []
    _write(node, out)
    return "".join(out)


def inner_html(element: Element) -> str:
    out: list[str] = []
    for child in element.children:
        _write(child, out)
    return "".join(out)
