"""Choice of the main content: every container is scored, the best one wins."""

from __future__ import annotations

import math

from ..html import Element, outer_html

#: What names of classes, ids, roles and labels say about a container.
NOISE = ("nav", "footer", "header", "sidebar", "ads", "comment", "promo", "advert", "social", "share")
BAD_LABELS = ("nav", "footer", "header", "sidebar", "aside", "ad", "advert", "promo", "comment", "related", "share", "social")
GOOD_LABELS = ("article", "body", "content", "doc", "documentation", "entry", "main", "post", "story")
#: Containers that are never part of the content.
OUTSIDE = frozenset("nav footer header aside script style form iframe noscript".split())
TAG_SCORE = {"main": 300, "article": 250, "section": 125, "div": 75}
TAG_WEIGHT = {"article": 1.5, "main": 1.4, "section": 1.0, "p": 1.0, "h1": 1.2, "h2": 1.1, "h3": 1.0, "h4": 0.9, "h5": 0.8, "h6": 0.7}


def _label(e: Element) -> str:
    return " ".join(e.attrs[a] for a in ("id", "class", "role", "aria-label") if a in e.attrs).lower()


def _good(e: Element) -> int:
    label = _label(e)
    return sum(w in label for w in GOOD_LABELS)


def _noisy(e: Element) -> int:
    return sum(any(w in e.attrs.get(a, "").lower() for w in NOISE) for a in ("class", "id"))


def _measure(pieces) -> tuple[int, int]:
    """(words, characters with single blanks between words) of text nodes."""
    words = [w for piece in pieces for w in piece.split()]
    return len(words), sum(map(len, words)) + max(0, len(words) - 1)


def density_score(e: Element) -> int:
    _, length = _measure(e.texts())
    if not length:
        return 0
    links = sum(_measure(a.texts())[1] for a in e.elements("a"))
    score = 300 * length / max(1, len(outer_html(e))) + 220 * (1 - min(1.0, links / length)) + 80 * TAG_WEIGHT.get(e.name, 0.5) + 20 * math.log(length + 1)
    return math.floor(score + 0.5)


def _is_candidate(e: Element) -> bool:
    return e.name in ("main", "article", "section", "div") or e.attrs.get("role") == "main"


def score(e: Element, threshold: int) -> int:
    words, _ = _measure(e.texts())
    if not words or words < threshold:
        return 0
    density = density_score(e)
    good = _good(e)
    if e.name in ("div", "section") and not good and (density < 450 or any(_is_candidate(d) and _good(d) for d in e.elements())):
        return 0
    link_words = sum(_measure(a.texts())[0] for a in e.elements("a"))
    label = _label(e)
    return 8 * words - 12 * link_words + TAG_SCORE.get(e.name, 150) + 150 * good - 200 * sum(w in label for w in BAD_LABELS) - 350 * _noisy(e) + density


def candidates(root: Element) -> list[Element]:
    """Containers outside page chrome, in the order in which ties are decided."""
    found = [e for e in root.elements() if _is_candidate(e) and not _noisy(e) and not any(a.name in OUTSIDE for a in e.ancestors())]
    groups = (lambda e: e.name == "main", lambda e: e.attrs.get("role") == "main", lambda e: e.name == "article", lambda e: e.name == "section", lambda e: e.name == "div")
    return [e for test in groups for e in found if test(e)]


def main_content(root: Element, threshold: int) -> Element:
    """The best container, else ``body``, else the root."""
    best, top = None, 0
    for e in candidates(root):
        value = score(e, threshold)
        if value > top:
            best, top = e, value
    return best or next(root.elements("body"), root)
