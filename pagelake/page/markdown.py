"""Markdown of an element.

Text goes through a ``Sheet``, which knows how pieces meet: inline pieces are parted by
one blank unless the piece begins with closing punctuation, blocks by one empty line.
``Renderer`` maps element names to the methods that fill a sheet; nested inline content
is rendered on a sheet of its own and then added as one piece.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from .. import url as urls
from ..html import Element, Node, Text, outer_html
from .clean import struck

_ORDERED = re.compile(r"^[0-9]+\.\s")
_SENSITIVE = re.compile(r"\\(?=[\\`*_{}\[\]()#+\-.!])")
_SNOB = re.compile(r"([`*_{}\[\]()#!])")
#: ASCII spellings used when Unicode isn't wanted.
_ASCII = str.maketrans(
    {"©": "(C)", "’": "'", "‘": "'", "”": '"', "“": '"', "—": "--", "–": "-", "→": "->", "←": "<-", "·": "*", "œ": "oe", "æ": "ae", "‎": "", "‏": ""}
    | {c: a for a, group in (("a", "àáâãäå"), ("e", "èéêë"), ("i", "ìíîï"), ("o", "òóôõö"), ("u", "ùúûü")) for c in group}
)
#: Inline elements that become plain text when only text is wanted, and blocks that end with an empty line.
_PLAIN = frozenset("abbr b cite code del dfn em i ins kbd mark q s small span strike strong sub sup tt time u var".split())
_ENDING = frozenset("article aside footer header main nav section".split())


def one_line(text: str) -> str:
    return " ".join(text.split())


def escape_target(text: str) -> str:
    return re.sub(r"([\\\[\]()])", r"\\\1", text)


def escape_label(text: str) -> str:
    return re.sub(r"([\[\]])", r"\\\1", text)


class Sheet:
    """Markdown in the making."""

    def __init__(self) -> None:
        self.out = ""

    def add(self, text: str) -> None:
        self.out += text

    def trim(self) -> None:
        self.out = self.out.rstrip(" \t")

    def piece(self, text: str) -> None:
        """Adds an inline piece."""
        text = text.strip()
        if not text:
            return
        if self.out and not self.out[-1].isspace() and (text[0] not in ".,:;!?)]" or text.startswith("![")):
            self.out += " "
        self.out += text

    def new_line(self) -> None:
        if self.out and not self.out.endswith("\n"):
            self.out += "\n"

    def gap(self) -> None:
        """Makes sure that an empty line follows, unless nothing stands here yet."""
        self.trim()
        if self.out:
            self.out += "\n" * max(0, 2 - (len(self.out) - len(self.out.rstrip("\n"))))


@dataclass
class _Notes:
    """Link definitions and abbreviations of one page, shared by all its sheets."""

    links: list[list] = field(default_factory=list)  # [href, title, written]
    short: dict[str, str] = field(default_factory=dict)


class Renderer:
    def __init__(self, options: dict, base: str) -> None:
        self.o, self.base = options, base if urls.parse(base) else ""
        self.notes = _Notes()
        self.depth, self.in_link = 0, False
        self.keep = {t.lower() for t in options["preserve_tags"]}
        by: dict[str, Callable[[Element, Sheet], None]] = {f"h{n}": self.heading for n in range(1, 7)}
        for names, method in (
            ("p li address details figcaption figure summary", self.block), ("hr", self.rule), ("ul ol", self.listing), ("dl", self.definitions), ("table", self.table),
            ("pre", self.code_block), ("code kbd tt", self.code), ("strong b em i u del strike s q sub sup", self.marked), ("a", self.link), ("abbr", self.abbreviation), ("img", self.image), ("blockquote", self.quote),
        ):
            by |= dict.fromkeys(names.split(), method)
        self.by = by

    # -- running the tree -------------------------------------------------------

    def page(self, e: Element) -> str:
        sheet = Sheet()
        self.node(e, sheet)
        self.write_links(sheet)
        if self.notes.short:
            sheet.gap()
            for text, title in self.notes.short.items():
                sheet.add(f"  *[{text}]: {title}\n")
        out = normalize(sheet.out)
        if self.o["single_line_break"]:
            out = without_blank_lines(out)
        out = wrap(out, self.o)
        return pad_tables(out) if self.o["pad_tables"] else out

    def node(self, node: Node, sheet: Sheet) -> None:
        if isinstance(node, Text):
            self.text(node.data, sheet)
        elif isinstance(node, Element):
            self.element(node, sheet)

    def children(self, e: Element, sheet: Sheet) -> None:
        for child in e.children:
            self.node(child, sheet)

    def inline(self, e: Element) -> str:
        sheet = Sheet()
        self.children(e, sheet)
        return one_line(sheet.out)

    def element(self, e: Element, sheet: Sheet) -> None:
        o, name = self.o, e.name
        if name in self.keep:
            sheet.gap()
            sheet.add(outer_html(e))
            sheet.gap()
        elif o["hide_strikethrough"] and struck(e):
            return
        elif o["only_text"] and name in _PLAIN:
            self.text(e.text(), sheet)
        elif name == "br":
            sheet.add("  \n")
        elif o["google_doc"] and (name not in self.by or name in ("q", "sub", "sup", "a", "abbr", "img", "blockquote")) and self.styled(e, sheet):
            return
        elif name in self.by:
            self.by[name](e, sheet)
        else:
            self.children(e, sheet)
            if name in _ENDING:
                sheet.gap()

    def text(self, data: str, sheet: Sheet) -> None:
        o, text = self.o, one_line(data)
        if not o["unicode_snob"]:
            text = text.translate(_ASCII)
        if o["escape_backslash"] and "\\" in text:
            text = _SENSITIVE.sub(r"\\\\", text)
        if o["escape_snob"]:
            text = _SNOB.sub(r"\\\1", text)
        if not sheet.out or sheet.out.endswith("\n"):
            if o["escape_dot"] and _ORDERED.match(text):
                text = text.replace(".", "\\.", 1)
            elif len(text) > 1 and text[1].isspace() and (text[0] == "-" and o["escape_dash"] or text[0] == "+" and o["escape_plus"]):
                text = "\\" + text
        sheet.piece(text)

    # -- blocks -----------------------------------------------------------------

    def heading(self, e: Element, sheet: Sheet) -> None:
        text = self.inline(e)
        if text:
            sheet.gap()
            sheet.add(f"{'#' * int(e.name[1])} {text}")
            sheet.gap()

    def block(self, e: Element, sheet: Sheet) -> None:
        sheet.gap()
        self.children(e, sheet)
        sheet.gap()
        if self.o["links_each_paragraph"]:
            self.write_links(sheet)

    def rule(self, e: Element, sheet: Sheet) -> None:
        sheet.gap()
        sheet.add("* * *")
        sheet.gap()

    def listing(self, e: Element, sheet: Sheet) -> None:
        ordered = self.ordered(e)
        nested = self.depth > 0
        if nested:
            sheet.trim()
            sheet.new_line()
        else:
            sheet.gap()
        self.depth += 1
        indent, number = "  " * (self.depth - 1), 0
        for child in e.children:
            if not isinstance(child, Element) or child.name != "li":
                self.node(child, sheet)
                continue
            number += 1
            sheet.trim()
            sheet.new_line()
            sheet.add("  " * self.google_depth(child) if self.o["google_doc"] else indent)
            sheet.add(f"{number}. " if ordered else f"{self.o['ul_item_mark']} ")
            self.children(child, sheet)
            sheet.trim()
            if not sheet.out.endswith("\n"):
                sheet.add("\n")
        self.depth -= 1
        if nested:
            sheet.trim()
            if not sheet.out.endswith("\n"):
                sheet.add("\n")
        else:
            sheet.gap()

    def definitions(self, e: Element, sheet: Sheet) -> None:
        sheet.gap()
        for child in e.children:
            kind = child.name if isinstance(child, Element) else ""
            if kind not in ("dt", "dd"):
                self.node(child, sheet)
                continue
            text = self.inline(child)
            if text and kind == "dt":
                if not sheet.out.endswith("\n"):
                    sheet.add("\n")
                sheet.add(f"{text}\n")
            elif text:
                sheet.add(f"    {text}\n")
        sheet.gap()

    def code_block(self, e: Element, sheet: Sheet) -> None:
        text = self.ticked(e) if self.o["handle_code_in_pre"] else e.text()
        if text.strip():
            sheet.gap()
            sheet.add("```\n" + text.strip("\n") + "\n```")
            sheet.gap()

    def ticked(self, e: Element) -> str:
        parts = (c.data if isinstance(c, Text) else f"`{c.text()}`" if isinstance(c, Element) and c.name == "code" else self.ticked(c) if isinstance(c, Element) else "" for c in e.children)
        return "".join(parts)

    def quote(self, e: Element, sheet: Sheet) -> None:
        inner = Sheet()
        self.children(e, inner)
        text = normalize(inner.out)
        if text:
            sheet.gap()
            sheet.add("".join(f"> {line.strip()}".rstrip() + "\n" for line in text.split("\n")))
            sheet.gap()

    # -- inline -----------------------------------------------------------------

    def code(self, e: Element, sheet: Sheet) -> None:
        text = one_line(e.text())
        sheet.piece(text if self.in_link else f"`{text}`")

    def marked(self, e: Element, sheet: Sheet) -> None:
        o, name = self.o, e.name
        marks = {"strong": "strong_mark", "b": "strong_mark", "em": "emphasis_mark", "i": "emphasis_mark", "u": "emphasis_mark"}
        if name in marks and o["ignore_emphasis"] or name in ("sub", "sup") and not o["include_sup_sub"]:
            self.children(e, sheet)
            return
        left = right = o[marks[name]] if name in marks else "~~"
        if name == "q":
            left, right = o["open_quote"], o["close_quote"]
        elif name in ("sub", "sup"):
            left, right = f"<{name}>", f"</{name}>"
        sheet.piece(f"{left}{self.inline(e)}{right}")

    def abbreviation(self, e: Element, sheet: Sheet) -> None:
        text = self.inline(e)
        title = one_line(e.attrs.get("title", ""))
        if text and title:
            self.notes.short[text] = title
        sheet.piece(text)

    def resolve(self, target: str) -> str:
        return urls.resolve_or_raw(self.base, target) if self.base else target

    def reference(self, target: str, title: str) -> int:
        href = self.resolve(target)
        for number, (known, known_title, written) in enumerate(self.notes.links, 1):
            if (known, known_title) == (href, title) and not (written and self.o["links_each_paragraph"]):
                return number
        self.notes.links.append([href, title, False])
        return len(self.notes.links)

    def write_links(self, sheet: Sheet) -> None:
        pending = [(n, link) for n, link in enumerate(self.notes.links, 1) if not link[2]]
        if pending:
            sheet.gap()
        for n, link in pending:
            sheet.add(f"   [{n}]: {link[0]}" + (f" ({link[1]})" if link[1] else "") + "\n")
            link[2] = True

    def label(self, e: Element) -> str:
        outer, self.in_link = self.in_link, True
        try:
            return self.inline(e)
        finally:
            self.in_link = outer

    def only_child(self, e: Element) -> Element | None:
        """The one element child of ``e`` if nothing but blank text stands beside it."""
        found = [c for c in e.children if not (isinstance(c, Text) and not c.data.strip())]
        return found[0] if len(found) == 1 and isinstance(found[0], Element) else None

    def link(self, e: Element, sheet: Sheet) -> None:
        o, href = self.o, e.attrs.get("href")
        if o["ignore_links"] or href is None or o["skip_internal_links"] and href.startswith("#") or o["ignore_mailto_links"] and href.startswith("mailto:"):
            self.children(e, sheet)
            return
        title = escape_target(e.attrs.get("title", "").strip()).replace('"', '\\"')
        absolute = href.startswith(("http://", "https://"))

        def linked(label: str) -> str:
            if not o["inline_links"]:
                return f"[{label}][{self.reference(href, title)}]"
            resolved = self.resolve(href)
            target = f"<{escape_label(resolved)}>" if o["protect_links"] else escape_target(resolved)
            return f"[{label}]({target}" + (f' "{title}"' if title else "") + ")"

        only = self.only_child(e)
        if only is not None and re.fullmatch("h[1-6]", only.name):
            label = self.label(only)
            if label:
                sheet.gap()
                sheet.add(f"{'#' * int(only.name[1])} {linked(escape_label(label))}")
                sheet.gap()
                return
        if only is not None and only.name == "img":
            image = self.image_text(only)
            if image is not None:
                auto = o["images_to_alt"] and o["use_automatic_links"] and image == href and absolute
                sheet.piece(f"<{href}>" if auto else linked(image))
                return
        label = self.label(e)
        if o["use_automatic_links"] and label and label == href and absolute:
            sheet.piece(f"<{href}>")
        else:
            sheet.piece(linked(escape_label(label)))

    def image(self, e: Element, sheet: Sheet) -> None:
        sheet.piece(self.image_text(e) or "")

    def image_text(self, e: Element) -> str | None:
        o, src = self.o, e.attrs.get("src", "")
        if o["ignore_images"] or not src.strip():
            return None
        alt = e.attrs.get("alt") or o["default_image_alt"]
        if o["images_as_html"] or o["images_with_size"] and ("width" in e.attrs or "height" in e.attrs):
            sizes = "".join(f"{k}='{e.attrs[k]}' " for k in ("width", "height") if e.attrs.get(k))
            return f"<img src='{src}' {sizes}" + (f"alt='{alt}' " if alt else "") + "/>"
        if o["images_to_alt"]:
            return escape_target(alt)
        if not o["inline_links"]:
            return f"![{escape_target(alt)}][{self.reference(src, '')}]"
        return f"![{escape_target(alt)}]({escape_target(self.resolve(src))})"

    # -- tables -----------------------------------------------------------------

    def rows_of(self, e: Element) -> list[Element]:
        """Rows in document order; a row inside a row belongs to its cell."""
        out: list[Element] = []
        for child in e.children:
            if isinstance(child, Element):
                out += [child] if child.name == "tr" else self.rows_of(child)
        return out

    def table(self, e: Element, sheet: Sheet) -> None:
        if self.o["bypass_tables"]:
            sheet.gap()
            self.plain_table(e, sheet)
            sheet.gap()
            return
        caption = next((t for t in (self.inline(c) for c in e.elements("caption")) if t), "")
        cells = [[c for c in row.children if isinstance(c, Element) and c.name in ("td", "th")] for row in self.rows_of(e)]
        if self.o["ignore_tables"]:
            lines = [" ".join(filter(None, map(self.inline, row))) for row in cells]
            lines = [x for x in (caption, *lines) if x]
            if lines:
                sheet.gap()
                sheet.add("\n".join(lines) + "\n")
                sheet.gap()
            return
        width = max(map(len, cells), default=0)
        sheet.gap() if width or caption else None
        if caption:
            sheet.add(caption)
            sheet.gap()
        if not width:
            return
        head = next((i for i, row in enumerate(cells) if any(c.name == "th" for c in row)), 0)
        texts = [[self.inline(c).replace("\n", " ").replace("|", "\\|") for c in row] for row in cells]
        texts = [row + [""] * (width - len(row)) for row in texts]
        for row in (texts[head], ["---"] * width, *texts[:head], *texts[head + 1 :]):
            sheet.add(f"| {' | '.join(row)} |\n")
        sheet.gap()

    def plain_table(self, e: Element, sheet: Sheet) -> None:
        if e.name in ("td", "th"):
            sheet.add(f"<{e.name}>{self.inline(e)}</{e.name}>")
            return
        if e.name == "caption":
            text = self.inline(e)
            sheet.add(f"{text}\n" if text else "")
            return
        around = e.name in ("table", "tr")
        sheet.add(f"<{e.name}>" if around else "")
        for child in e.children:
            if isinstance(child, Element):
                self.plain_table(child, sheet)
        sheet.add(f"</{e.name}>" if around else "")

    # -- documents exported from an office suite ------------------------------------

    def styled(self, e: Element, sheet: Sheet) -> bool:
        style = e.attrs.get("style", "").lower()
        bold = re.search(r"font-weight: ?(?:bold|700)", style)
        fixed = re.search(r"font-family: ?(?:consolas|courier new)", style)
        italic = "font-style:italic" in style
        if not (bold or fixed or italic):
            return False
        text = self.inline(e)
        if text:
            text = f"`{text}`" if fixed else text
            text = f"{self.o['strong_mark']}{text}{self.o['strong_mark']}" if bold else text
            sheet.piece(f"{self.o['emphasis_mark']}{text}{self.o['emphasis_mark']}" if italic else text)
        return True

    @staticmethod
    def declared(e: Element, name: str) -> str | None:
        for part in e.attrs.get("style", "").split(";"):
            key, colon, value = part.partition(":")
            if colon and key.strip().lower() == name:
                return value.strip()
        return None

    def ordered(self, e: Element) -> bool:
        kind = (self.declared(e, "list-style-type") or "").lower() if self.o["google_doc"] else ""
        return kind not in ("disc", "circle", "square", "none") if kind else e.name == "ol"

    def google_depth(self, e: Element) -> int:
        m = re.fullmatch(r"(\d+)\s*px", self.declared(e, "margin-left") or "")
        return int(m.group(1)) // max(1, self.o["google_list_indent"]) if m else 0


# -- whole texts ------------------------------------------------------------------


def normalize(text: str) -> str:
    """At most one empty line in a row, no trailing blanks but for hard breaks, fences as they are."""
    out: list[str] = []
    fenced = False
    for raw in text.split("\n"):
        if fenced:
            out.append(raw)
            fenced = not raw.lstrip().startswith("```")
            continue
        bare = raw.rstrip("\t")
        line = bare.rstrip(" ") + "  " if bare.endswith("  ") and bare.strip(" ") else raw.rstrip()
        if not line.strip():
            if out and out[-1] != "":
                out.append("")
            continue
        out.append(line)
        fenced = line.lstrip().startswith("```")
    return "\n".join(out).strip()


def _outside_fences(text: str):
    """(line, is it fence or code) for each line."""
    fenced = False
    for line in text.split("\n"):
        mark = line.lstrip().startswith("```")
        yield line, fenced or mark
        fenced ^= mark


def without_blank_lines(text: str) -> str:
    return "\n".join(line for line, code in _outside_fences(text) if code or line.strip()).rstrip()


def wrap(text: str, o: dict) -> str:
    width = o["body_width"]
    if not width or not text:
        return text
    out: list[str] = []
    for line, code in _outside_fences(text):
        bare = line.lstrip()
        fixed = code or not bare or line.endswith("  ") or line[0].isspace() or bare.startswith(("#", ">", "![", "*[")) or bare == "* * *"
        fixed = fixed or not o["wrap_tables"] and (bare.startswith("|") or " | " in bare)
        fixed = fixed or not o["wrap_list_items"] and (bare.startswith(("* ", "- ", "+ ")) or bool(_ORDERED.match(bare)))
        if fixed or not o["wrap_links"] and "](" in line:
            out.append(line)
            continue
        row = ""
        for word in line.split():
            if row and len(row) + 1 + len(word) > width:
                out.append(row)
                row = ""
            row += f" {word}" if row else word
        out.append(row)
    return "\n".join(out).rstrip()


def pad_tables(text: str) -> str:
    out: list[str] = []
    table: list[str] = []
    for line in [*text.split("\n"), None]:
        bare = (line or "").strip()
        if line is not None and bare.startswith("|") and bare.endswith("|") and bare.count("|") >= 2:
            table.append(line)
            continue
        if len(table) > 1:
            rows = [[c.strip() for c in t.strip().strip("|").split("|")] for t in table]
            widths = [max(len(r[i]) if i < len(r) else 0 for r in rows) for i in range(max(map(len, rows)))]
            for r in rows:
                fill = "-" if all(set(c) <= {"-"} for c in r) else " "
                out.append("|" + "".join(f" {(c := r[i] if i < len(r) else '')}{fill * (w - len(c) + 1)}|" for i, w in enumerate(widths)))
        else:
            out += table
        table = []
        if line is not None:
            out.append(line)
    return "\n".join(out)
