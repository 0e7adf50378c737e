"""Extraction options: their kinds, defaults and the reading of their text form."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from ..html.select import SelectorError, compile_selector


class OptionError(ValueError):
    pass


#: Option -> (kind, default). List options gather over repeats, others overwrite.
SPECS: dict[str, tuple[str, object]] = {
    # which part of the page
    "base_url": ("text", None), "css_selector": ("text", None), "target_elements": ("selectors", ()), "only_text": ("bool", False),
    "excluded_tags": ("tags", ()), "excluded_selector": ("text_list", ()), "word_count_threshold": ("count", 1),
    # clean-up
    "remove_consent_popups": ("bool", False), "remove_overlay_elements": ("bool", True), "remove_forms": ("bool", False), "keep_data_attributes": ("bool", False), "keep_attrs": ("list", ()), "prettiify": ("bool", False), "exclude_all_images": ("bool", False),
    "exclude_domains": ("list", ()), "exclude_external_images": ("bool", False), "exclude_external_links": ("bool", False), "exclude_internal_links": ("bool", False), "exclude_social_media_domains": ("list", ()), "exclude_social_media_links": ("bool", False),
    # Markdown
    "skip_internal_links": ("bool", False), "default_image_alt": ("raw", ""), "body_width": ("count", 0), "open_quote": ("raw", '"'), "close_quote": ("raw", '"'), "ul_item_mark": ("raw", "*"), "emphasis_mark": ("raw", "_"), "strong_mark": ("raw", "**"),
    "ignore_images": ("bool", False), "images_as_html": ("bool", False), "images_to_alt": ("bool", False), "images_with_size": ("bool", False), "preserve_tags": ("tags", ()), "handle_code_in_pre": ("bool", False), "ignore_emphasis": ("bool", False), "ignore_links": ("bool", False),
    "inline_links": ("bool", True), "links_each_paragraph": ("bool", False), "ignore_mailto_links": ("bool", True), "ignore_tables": ("bool", False), "bypass_tables": ("bool", False), "hide_strikethrough": ("bool", False), "google_doc": ("bool", False), "google_list_indent": ("positive", 36), "pad_tables": ("bool", False),
    "protect_links": ("bool", False), "use_automatic_links": ("bool", True), "wrap_links": ("bool", True), "wrap_list_items": ("bool", False), "wrap_tables": ("bool", False), "unicode_snob": ("bool", True),
    "escape_backslash": ("bool", True), "escape_snob": ("bool", False), "escape_dot": ("bool", True), "escape_plus": ("bool", True), "escape_dash": ("bool", True), "include_sup_sub": ("bool", False), "single_line_break": ("bool", False), "mark_code": ("bool", False),
    # accepted and checked, without effect on pages that are already here
    "cache": ("cache", None), "cache_mode": ("cache", None), "user_agent": ("text", None), "locale": ("text", None), "timezone_id": ("text", None),
    "process_in_browser": ("bool", False), "process_iframes": ("bool", False), "flatten_shadow_dom": ("bool", False), "scan_full_page": ("bool", False), "wait_for_images": ("bool", False),
    "scroll_delay": ("seconds", 0.2), "max_scroll_steps": ("count", 10), "delay_before_return_html": ("seconds", 0.1), "page_timeout": ("millis", None), "wait_for_timeout": ("millis", None), "wait_until": ("load_state", "load"),
}
#: Other names of the same options.
ALIASES = {"ignore_anchors": "ignore_links", "excluded_selectors": "excluded_selector"}
BROWSER_ONLY = frozenset("process_in_browser process_iframes flatten_shadow_dom scan_full_page wait_for_images".split())
_FLAGS = {"true": True, "1": True, "yes": True, "on": True, "false": False, "0": False, "no": False, "off": False}


def _read(name: str, kind: str, text: object) -> object:
    """The value of an option given as text, or as a Python value of the right kind."""
    if kind == "bool" and isinstance(text, bool) or kind in ("count", "positive", "millis") and isinstance(text, int) and not isinstance(text, bool) and text >= (kind == "positive") or kind == "seconds" and isinstance(text, float | int) and text >= 0:
        return text
    if kind in ("list", "tags", "selectors", "text_list") and isinstance(text, list | tuple):
        text = ",".join(text) if kind != "text_list" else text
        if kind == "text_list":
            return tuple(text)
    text = str(text)
    value = text.strip()
    if kind == "raw":
        return text
    if kind == "bool":
        if value.lower() not in _FLAGS:
            raise OptionError(f"{name} expects a boolean value, got '{text}'")
        return _FLAGS[value.lower()]
    if kind in ("count", "positive", "millis"):
        if not re.fullmatch(r"\+?\d+", value) or kind == "positive" and int(value) == 0:
            raise OptionError(f"{name} expects a {'positive' if kind == 'positive' else 'non-negative'} integer, got '{text}'")
        return int(value)
    if kind == "seconds":
        try:
            number = float(value)
        except ValueError:
            number = -1.0
        if not math.isfinite(number) or number < 0:
            raise OptionError(f"{name} expects a non-negative number of seconds, got '{text}'")
        return number
    if kind == "cache":
        if value.lower().replace("-", "_") not in ("bypass", "disabled", "disable", "no_cache", "none", "off"):
            raise OptionError(f"{name} supports only bypass or disabled here, got '{text}'")
        return None
    if kind == "load_state":
        if value.lower() not in ("domcontentloaded", "load", "networkidle"):
            raise OptionError(f"{name} supports only domcontentloaded, load or networkidle, got '{text}'")
        return value.lower()
    if kind == "text":
        return value
    if kind == "text_list":
        return (value,)
    items = tuple(x for x in (p.strip() for p in value.split(",")) if x)
    if kind == "tags":
        bad = [x for x in items if not re.fullmatch(r"[A-Za-z][A-Za-z0-9-]*", x)]
        if bad:
            raise OptionError(f"{name} expects tag names, got '{bad[0]}'")
        return tuple(x.lower() for x in items)
    if kind == "selectors":
        for x in items:
            try:
                compile_selector(x)
            except SelectorError as error:
                raise OptionError(f"{name}: {error}") from error
    return items


@dataclass(frozen=True)
class Options:
    """One request's options; ``values`` holds what differs from the defaults."""

    format: str = "markdown"
    selector: str | None = None
    exclude_selector: str | None = None
    wait_for_selector: str | None = None
    max_chars: int | None = None
    values: tuple[tuple[str, object], ...] = field(default=())

    def __post_init__(self) -> None:
        if self.format not in ("html", "markdown", "text", "json"):
            raise OptionError(f"unknown format '{self.format}'")
        if self.wait_for_selector is not None:
            low = self.wait_for_selector.strip().lower()
            if low.startswith("js:") or any(mark in low for mark in ("=>", "function(", "return ", ";")):
                raise OptionError("only CSS selectors can be waited for")

    @classmethod
    def of(cls, pairs: dict[str, object] | list[tuple[str, object]] = (), **request: object) -> Options:
        """From option names, with or without namespace, and the request's own fields."""
        values: dict[str, object] = {}
        for full, given in pairs.items() if isinstance(pairs, dict) else pairs:
            name = full.rpartition(".")[2]
            name = ALIASES.get(name, name)
            if name not in SPECS:
                raise OptionError(f"unknown option '{full}'")
            kind = SPECS[name][0]
            value = _read(name, kind, given)
            if isinstance(value, tuple) and name in values:
                value = values[name] + value
            values[name] = value
        return cls(values=tuple(values.items()), **request)

    def __getattr__(self, name: str) -> object:
        if name not in SPECS:
            raise AttributeError(name)
        return dict(self.values).get(name, SPECS[name][1])

    def resolved(self) -> dict[str, object]:
        return {k: d for k, (_, d) in SPECS.items()} | dict(self.values)

    def warnings(self) -> list[str]:
        return [f"{k} needs a browser and has no effect" for k, v in self.values if k in BROWSER_ONLY and v]
