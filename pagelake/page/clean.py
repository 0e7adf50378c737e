"""Clean-up of a document before and after the content is chosen."""

from __future__ import annotations

import re
from collections.abc import Iterable

from .. import url as urls
from ..html import Comment, Element, Selector, SelectorError, Text, select
from ..html.select import compile_selector

#: Elements that cover a page, matched without regard to case.
_OVERLAYS = ",".join(
    (
        'button[class*="close" i]',
        'button[class*="dismiss" i]',
        'button[aria-label*="close" i]',
        'button[title*="close" i]',
        'a[class*="close" i]',
        'span[class*="close" i]',
        '[class*="cookie-banner" i]',
        '[id*="cookie-banner" i]',
        '[class*="cookie-consent" i]',
        '[id*="cookie-consent" i]',
        '[class*="newsletter" i]',
        '[class*="subscribe" i]',
        '[class*="popup" i]',
        '[class*="modal" i]',
        '[class*="overlay" i]',
        '[class*="dialog" i]',
        '[role="dialog"]',
        '[role="alertdialog"]',
    )
)
#: Consent notices, matched without regard to case.
_CONSENT = ",".join(
    (
        '[class*="cookie-consent" i]',
        '[id*="cookie-consent" i]',
        '[class*="cookie-banner" i]',
        '[id*="cookie-banner" i]',
        '[class*="cookie-notice" i]',
        '[id*="cookie-notice" i]',
        '[class*="cookie-law" i]',
        '[id*="cookie-law" i]',
        '[class*="cookie-popup" i]',
        '[id*="cookie-popup" i]',
        '[class*="cookie-overlay" i]',
        '[id*="cookie-overlay" i]',
        '[class*="gdpr" i]',
        '[id*="gdpr" i]',
        'iframe[title*="cookie" i]',
        'iframe[src*="cookie" i]',
    )
)
#: Social networks.
SOCIAL = ("facebook.com", "twitter.com", "x.com", "linkedin.com", "instagram.com", "pinterest.com", "tiktok.com", "snapchat.com", "reddit.com")
#: Elements that are kept though they hold no words, and inline elements that become plain text.
_MAY_BE_EMPTY = frozenset("a img br hr input meta link source track wbr tr td th".split())
_PLAIN = frozenset("b i u span del ins sub sup strong em code kbd var s q abbr cite dfn time small mark".split())
_KEPT = frozenset("src href alt title width height class id".split())
PAGE_CHROME = "nav,footer,header,aside,form,iframe,noscript"
_BASE64 = re.compile(r"data:image/[^;]+;base64,")


def drop(root: Element, selector: str | Selector, lenient: bool = False) -> None:
    """Removes all matches under ``root``; a selector that can't be read does nothing if ``lenient``."""
    try:
        found = select(root, selector)
    except SelectorError:
        if lenient:
            return
        raise
    for e in found:
        e.remove()


def drop_comments(root: Element) -> None:
    for node in [n for n in root.walk() if isinstance(n, Comment)]:
        node.remove()


def _drop_links(root: Element, name: str, attr: str, leave: object) -> None:
    for e in list(root.elements(name)):
        if attr in e.attrs and leave(e.attrs[attr]):
            e.remove()


def _wanted_domain(text: str) -> str | None:
    """Base domain of a domain or URL given as an option."""
    text = text.strip()
    host = urls.link_host(text) if "://" in text else text.split("/")[0].split(":")[0].lower().rstrip(".").removeprefix("www.")
    return urls.base_domain(host) if host else None


def clean_document(root: Element, o: dict, base: str) -> None:
    """The removals that the options ask for, in their fixed order."""
    if o["remove_consent_popups"]:
        drop(root, _CONSENT)
    if o["remove_overlay_elements"]:
        drop(root, _OVERLAYS)
    if o["remove_forms"]:
        drop(root, "form")
    if o["excluded_tags"]:
        drop(root, ",".join(o["excluded_tags"]))
    for selector in filter(None, (o["exclude_selector"], *o["excluded_selector"])):
        drop(root, selector, lenient=True)
    if o["exclude_all_images"]:
        drop(root, "img")
    if not any(o[k] for k in ("exclude_domains", "exclude_external_links", "exclude_internal_links", "exclude_social_media_links", "exclude_external_images")):
        return

    def domain(href: str) -> str | None:
        host = urls.link_host(href, base)
        return urls.base_domain(host) if host else None

    unwanted = {d for d in map(_wanted_domain, o["exclude_domains"]) if d}
    if unwanted:
        _drop_links(root, "a", "href", lambda h: domain(h) in unwanted)
        _drop_links(root, "img", "src", lambda h: domain(h) in unwanted)
    if o["exclude_external_links"]:
        _drop_links(root, "a", "href", lambda h: urls.is_external(h, base))
    if o["exclude_internal_links"]:
        _drop_links(root, "a", "href", lambda h: not urls.is_external(h, base))
    if o["exclude_social_media_links"]:
        social = {*SOCIAL, *o["exclude_social_media_domains"]}
        _drop_links(root, "a", "href", lambda h: domain(h) in social)
    if o["exclude_external_images"]:
        _drop_links(root, "img", "src", lambda h: urls.is_external(h, base))


def struck(e: Element) -> bool:
    return "line-through" in e.attrs.get("style", "").lower()


def finish_document(root: Element, o: dict, kept: Iterable[Element], chrome: bool) -> None:
    """Clean-up once the content's roots are known; ``kept`` are never removed."""
    kept = list(kept)
    fixed = {id(e) for e in kept}
    if o["hide_strikethrough"]:
        for e in list(root.elements()):
            if struck(e) and id(e) not in fixed:
                e.remove()
    if o["only_text"]:
        around = fixed | {id(a) for e in kept for a in e.ancestors()}
        for e in list(root.elements()):
            if e.name in _PLAIN and id(e) not in around and e.parent is not None and not any(a.name in _PLAIN and id(a) not in around for a in e.ancestors()):
                text = e.text()
                if text:
                    node = Text(text)
                    e.parent.insert_before(node, e)
                    e.remove()
    for e in root.elements("img"):
        if _BASE64.match(e.attrs.get("src", "")):
            e.attrs["src"] = ""
    if chrome:
        drop(root, PAGE_CHROME)
    for e in reversed(list(root.elements())):
        if e.name in _MAY_BE_EMPTY or id(e) in fixed or any(isinstance(c, Element) for c in e.children):
            continue
        if not any(t.split() for t in e.texts()) and not any(a.name in ("pre", "code") for a in e.ancestors()):
            e.remove()
    names = _KEPT | set(o["keep_attrs"]) | ({"style"} if o["google_doc"] else set())
    for e in [root, *root.elements()]:
        e.attrs = {k: v for k, v in e.attrs.items() if k in names or o["keep_data_attributes"] and k.startswith("data-")}


__all__ = ["SOCIAL", "clean_document", "compile_selector", "drop", "drop_comments", "finish_document", "struck"]
