"""The path of one page: parse, read metadata, clean, choose the content, render."""

from __future__ import annotations

import json
import sys
from dataclasses import dataclass, field

from .. import url as urls
from ..html import Element, SelectorError, inner_html, outer_html, parse_document, select
from . import clean
from .content import main_content
from .markdown import Renderer, normalize
from .metadata import needs_render, page_metadata
from .options import Options
from .text import element_text


#: Rendering follows the tree; frames of Python functions don't use the C stack.
sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))


@dataclass
class Page:
    """What comes out of a page; ``error`` is None if it went well."""

    content: str | None = None
    metadata: dict[str, str | None] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)
    needs_render: bool = False
    error: tuple[str, str] | None = None


def pretty(text: str) -> str:
    """One tag or text a line, indented by two blanks a level; void tags indent as others do."""
    out, level = [], 0
    for part in (p.strip() for p in text.replace(">", ">\n").replace("<", "\n<").split("\n")):
        if not part:
            continue
        if part.startswith("</"):
            level = max(0, level - 1)
        out.append("  " * level + part)
        if part.startswith("<") and not part.startswith("</") and not part.endswith("/>"):
            level += 1
    return "\n".join(out)


def _base_of(url: str, option: str | None, root: Element) -> str:
    base = option or ("" if url.startswith("raw:") else url)
    tag = next((b for b in root.elements("base") if "href" in b.attrs), None)
    if tag is None:
        return base
    return urls.join(base, tag.attrs["href"]) or (str(u) if (u := urls.parse(tag.attrs["href"])) else base)


def extract_page(url: str, source: str | None, options: Options = Options()) -> Page:
    """One page; what goes wrong becomes its ``error``, never an exception."""
    if source is None:
        return Page(error=("extraction_failed", "no content"))
    try:
        return _extract(url, source, options)
    except SelectorError as error:
        return Page(error=("extraction_failed", str(error)))
    except RecursionError:
        return Page(error=("extraction_failed", "nested too deeply"))


def _extract(url: str, source: str, options: Options) -> Page:
    o = options.resolved() | {"exclude_selector": options.exclude_selector}
    root = parse_document(source)
    page = Page(metadata=page_metadata(root), warnings=options.warnings(), needs_render=needs_render(root))
    base = _base_of(url, o["base_url"], root)
    clean.drop_comments(root)
    clean.drop(root, "script,style,link,meta,noscript")
    if options.wait_for_selector is not None and not select(root, options.wait_for_selector):
        page.error = ("extraction_failed", f"wait selector '{options.wait_for_selector}' was not found")
        return page
    clean.clean_document(root, o, base)
    selector = options.selector or o["css_selector"]
    main = selector is None and options.wait_for_selector is None and options.format != "html"
    roots = [root]
    if selector is not None:
        try:
            roots = select(root, selector) or roots
        except SelectorError:
            pass
    elif not o["target_elements"] and main:
        roots = [main_content(root, o["word_count_threshold"])]
    targets = [t for r in roots for s in o["target_elements"] for t in select(r, s)]
    clean.finish_document(root, o, [*roots, *targets], chrome=main and selector is None and len(roots) == 1 and roots[0].name in ("html", "body"))
    shown = targets if o["target_elements"] else roots
    if options.format == "html":
        text = inner_html(shown[0]) if len(shown) == 1 and not o["target_elements"] else "\n".join(map(outer_html, shown))
        page.content = pretty(text) if o["prettiify"] else text
    elif options.format == "markdown":
        parts = [Renderer(o, base).page(e) for e in shown]
        page.content = parts[0] if len(parts) == 1 and not o["target_elements"] else normalize("\n\n".join(filter(None, parts)))
    else:
        parts = [element_text(e) for e in shown]
        text = parts[0] if len(parts) == 1 else "\n".join(filter(None, parts))
        page.content = json.dumps({"content": text, "url": url}, ensure_ascii=False, separators=(",", ":")) if options.format == "json" else text
    return page
