"""Page metadata from the head: title, description, and the Open Graph, Twitter and article properties."""

from __future__ import annotations

from ..html import Element


def page_metadata(root: Element) -> dict[str, str | None]:
    """``title``, ``description``, ``keywords`` and ``author`` are always present, possibly null."""
    metas = list(root.elements("meta"))

    def first(attr: str, name: str) -> str | None:
        e = next((m for m in metas if m.attrs.get(attr) == name and "content" in m.attrs), None)
        return (e.attrs["content"].strip() or None) if e is not None else None

    head = next(root.elements("head"), None)
    title = next((t for t in head.elements("title")), None) if head is not None else None
    out: dict[str, str | None] = {"title": (title.text().strip() if title is not None else "") or first("property", "og:title") or first("name", "twitter:title")}
    for name in ("description", "keywords", "author"):
        out[name] = first("name", name)
    for attr, prefix in (("property", "og:"), ("name", "twitter:"), ("property", "article:")):
        for m in metas:
            key, content = m.attrs.get(attr, "").strip(), m.attrs.get("content", "").strip()
            if key.startswith(prefix) and content:
                out[key] = content
    return out


#: Script types that a browser would run.
EXECUTABLE = frozenset(("", "module", "text/javascript", "application/javascript", "text/ecmascript", "application/ecmascript", "text/jscript"))


def needs_render(root: Element) -> bool:
    """Whether the page has a script that a browser would run."""
    return any(s.attrs.get("type", "").split(";")[0].strip().lower() in EXECUTABLE for s in root.elements("script"))
