"""CSS selectors: compounds of type, id, class, attribute and structural tests, with the four combinators."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

from .dom import Element, Text

Test = Callable[[Element], bool]
_IDENT = r"-?(?:[A-Za-z_\u0080-\U0010ffff]|\\.)(?:[\w\-\u0080-\U0010ffff]|\\.)*|--[\w\-]*"
_TOKEN = re.compile(
    rf"""(?P<space>\s+)|(?P<comb>[>+~])|(?P<comma>,)|\#(?P<id>(?:{_IDENT}|[\w\-]+))|\.(?P<cls>{_IDENT})|(?P<star>\*)
    |\[\s*(?P<attr>[\w\-:]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?:"(?P<dq>[^"\\]*(?:\\.[^"\\]*)*)"|'(?P<sq>[^'\\]*(?:\\.[^'\\]*)*)'|(?P<bare>{_IDENT}|[\w\-]+))\s*(?P<flag>[iIsS])?\s*)?\]
    |:(?P<pseudo>[A-Za-z\-]+)(?P<paren>\()?|(?P<type>{_IDENT})""",
    re.X,
)


class SelectorError(ValueError):
    pass


def _unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text)


def _siblings(e: Element) -> list[Element]:
    return [c for c in e.parent.children if isinstance(c, Element)] if e.parent is not None else [e]


def _attr_test(name: str, op: str | None, value: str, fold: bool) -> Test:
    name = name.lower()
    if op is None:
        return lambda e: name in e.attrs
    if fold:
        value = value.lower()

    def test(e: Element) -> bool:
        own = e.attrs.get(name)
        if own is None:
            return False
        if fold:
            own = own.lower()
        if op == "=":
            return own == value
        if not value and op != "|=":
            return False
        if op == "*=":
            return value in own
        if op == "^=":
            return own.startswith(value)
        if op == "$=":
            return own.endswith(value)
        if op == "~=":
            return value in own.split()
        return own == value or own.startswith(value + "-")

    return test


def _nth(text: str) -> Callable[[int], bool]:
    text = text.strip().lower().replace(" ", "")
    if text in ("odd", "even"):
        text = "2n+1" if text == "odd" else "2n"
    m = re.fullmatch(r"(?:([+-]?\d*)n)?([+-]?\d+)?", text)
    if not m or not text:
        raise SelectorError(f"bad position {text!r}")
    a = 0 if "n" not in text else int(m.group(1) + "1" if m.group(1) in ("", "+", "-") else m.group(1))
    b = int(m.group(2) or 0)
    return (lambda i: i == b) if a == 0 else (lambda i: (i - b) % a == 0 and (i - b) // a >= 0)


class _Parser:
    def __init__(self, text: str) -> None:
        self.text, self.at = text, 0

    def fail(self) -> SelectorError:
        return SelectorError(f"selector {self.text!r} can't be read at {self.at}")

    def group(self, nested: bool = False) -> list[list[tuple[str, list[Test]]]]:
        out = [self.complex()]
        while self.at < len(self.text) and self.text[self.at] == ",":
            self.at += 1
            out.append(self.complex())
        if nested:
            if self.at >= len(self.text) or self.text[self.at] != ")":
                raise self.fail()
            self.at += 1
        elif self.at < len(self.text):
            raise self.fail()
        return out

    def complex(self) -> list[tuple[str, list[Test]]]:
        """[(combinator to the left, tests)], leftmost first."""
        parts: list[tuple[str, list[Test]]] = []
        tests: list[Test] = []
        comb, typed = "", False
        while self.at < len(self.text):
            m = _TOKEN.match(self.text, self.at)
            if not m or m.group("comma"):
                break
            kind = m.lastgroup
            if m.group("space") or m.group("comb"):
                self.at = m.end()
                step = (m.group("comb") or " ").strip() or " "
                if tests:
                    parts.append((comb, tests))
                    tests, comb, typed = [], step, False
                elif m.group("comb"):
                    if comb != " " or not parts:
                        raise self.fail()
                    comb = step
                continue
            if m.group("type") or m.group("star"):
                if tests:
                    raise self.fail()
                typed = True
                name = (m.group("type") or "*").lower()
                tests.append((lambda e: True) if name == "*" else (lambda e, name=name: e.name == name))
            elif m.group("id") is not None:
                tests.append(lambda e, v=_unescape(m.group("id")): e.attrs.get("id") == v)
            elif m.group("cls") is not None:
                tests.append(lambda e, v=_unescape(m.group("cls")): v in e.attrs.get("class", "").split())
            elif m.group("attr"):
                value = next((_unescape(m.group(g)) for g in ("dq", "sq", "bare") if m.group(g) is not None), "")
                tests.append(_attr_test(m.group("attr"), m.group("op"), value, (m.group("flag") or "").lower() == "i"))
            else:
                self.at = m.end()
                tests.append(self.pseudo(m.group("pseudo").lower(), bool(m.group("paren"))))
                continue
            self.at = m.end()
            del kind, typed
            typed = False
        if not tests:
            if not parts or comb != " ":
                raise self.fail()
            return parts
        parts.append((comb, tests))
        return parts

    def pseudo(self, name: str, paren: bool) -> Test:
        if paren:
            if name in ("not", "is", "where"):
                inner = self.group(nested=True)
                hit = lambda e: any(_matches(e, c) for c in inner)
                return (lambda e: not hit(e)) if name == "not" else hit
            end = self.text.find(")", self.at)
            if end < 0:
                raise self.fail()
            arg, self.at = self.text[self.at : end], end + 1
            if name in ("nth-child", "nth-last-child", "nth-of-type", "nth-last-of-type"):
                at = _nth(arg)

                def test(e: Element) -> bool:
                    own = [s for s in _siblings(e) if "type" not in name or s.name == e.name]
                    if "last" in name:
                        own.reverse()
                    return at(next(i for i, s in enumerate(own, 1) if s is e))

                return test
            raise self.fail()
        tests: dict[str, Test] = {
            "first-child": lambda e: _siblings(e)[0] is e,
            "last-child": lambda e: _siblings(e)[-1] is e,
            "only-child": lambda e: len(_siblings(e)) == 1,
            "first-of-type": lambda e: next(s for s in _siblings(e) if s.name == e.name) is e,
            "last-of-type": lambda e: next(s for s in reversed(_siblings(e)) if s.name == e.name) is e,
            "only-of-type": lambda e: sum(s.name == e.name for s in _siblings(e)) == 1,
            "empty": lambda e: not any(isinstance(c, Element) or isinstance(c, Text) and c.data for c in e.children),
            "root": lambda e: e.name == "html",
        }
        if name not in tests:
            raise self.fail()
        return tests[name]


def _matches(e: Element, parts: list[tuple[str, list[Test]]]) -> bool:
    comb, tests = parts[-1]
    if not all(t(e) for t in tests):
        return False
    if len(parts) == 1:
        return True
    rest = parts[:-1]
    if comb == ">":
        return e.parent is not None and _matches(e.parent, rest)
    if comb == " ":
        return any(_matches(a, rest) for a in e.ancestors())
    before = []
    for s in _siblings(e):
        if s is e:
            break
        before.append(s)
    if comb == "+":
        return bool(before) and _matches(before[-1], rest)
    return any(_matches(s, rest) for s in before)


class Selector:
    """A compiled selector list."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.group = _Parser(text).group()

    def matches(self, e: Element) -> bool:
        return any(_matches(e, parts) for parts in self.group)


@lru_cache(maxsize=512)
def compile_selector(text: str) -> Selector:
    """A selector as options give it: trimmed, with an optional ``css:`` in front."""
    text = text.strip()
    text = text.removeprefix("css:").strip()
    if not text:
        raise SelectorError("empty selector")
    return Selector(text)


def select(root: Element, selector: str | Selector) -> list[Element]:
    """Matching elements under ``root`` in document order."""
    if isinstance(selector, str):
        selector = compile_selector(selector)
    return [e for e in root.elements() if selector.matches(e)]
