"""URLs as browsers read them: parsing, joining, serialising, and the predicates built on them.

Follows the URL standard for the special schemes (http, https, ws, wss, ftp, file);
other schemes are kept opaque.  ``None`` stands for a URL that doesn't parse.
"""

from __future__ import annotations

import ipaddress
import re
import unicodedata
from dataclasses import dataclass, replace
from functools import lru_cache

#: Special schemes and their default ports.
DEFAULT_PORTS = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21, "file": None}

_SCHEME = re.compile(r"^([A-Za-z][A-Za-z0-9+.\-]*):(.*)$", re.S)
_CONTROL = set(range(0x20)) | set(range(0x7F, 0x100))
#: The percent-encode sets of the URL standard.
_FRAGMENT_SET = _CONTROL | set(b' "<>`')
_QUERY_SET = _CONTROL | set(b" \"#<>'")
_PATH_SET = _CONTROL | set(b' "#<>?`{}^')
_USER_SET = _PATH_SET | set(b"/:;=@[\\]|^")
_BAD_HOST = re.compile(r"[\x00-\x20#/:<>?@\[\\\]^|%\x7f]")


def _encode(text: str, which: set[int]) -> str:
    return "".join(chr(b) if b not in which else f"%{b:02X}" for b in text.encode("utf-8", "replace"))


@dataclass(frozen=True)
class Url:
    scheme: str
    user: str = ""
    password: str = ""
    host: str | None = None
    port: int | None = None
    path: str = ""
    query: str | None = None
    fragment: str | None = None
    opaque: bool = False

    def __str__(self) -> str:
        out = f"{self.scheme}:"
        if self.host is not None:
            out += "//"
            if self.user or self.password:
                out += self.user + (f":{self.password}" if self.password else "") + "@"
            out += self.host + (f":{self.port}" if self.port is not None else "")
        elif not self.opaque and self.path.startswith("//"):
            out += "/."
        out += self.path
        if self.query is not None:
            out += f"?{self.query}"
        if self.fragment is not None:
            out += f"#{self.fragment}"
        return out

    @property
    def effective_port(self) -> int | None:
        return self.port if self.port is not None else DEFAULT_PORTS.get(self.scheme)


def _host(text: str) -> str | None:
    if text.startswith("["):
        return _ipv6(text)
    from urllib.parse import unquote

    text = unquote(text, errors="replace") if "%" in text else text
    if not text.isascii():
        text = _international(text)
        if text is None:
            return None
    text = text.lower()
    if not text or _BAD_HOST.search(text):
        return None
    last = text.rstrip(".").rsplit(".", 1)[-1]
    if last.isdigit() or re.fullmatch(r"0x[0-9a-f]*", last):
        return _ipv4(text)
    return text


def _international(text: str) -> str | None:
    """A host name beyond ASCII with its labels in punycode, by the current rules: the sharp s and the final sigma stay letters of their own."""
    text = "".join(c if c in "ßς" else unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", c).casefold()) for c in text if c not in "\u00ad\u200b\u2060\ufeff")
    labels = []
    for label in re.split("[.。]", unicodedata.normalize("NFC", text)):
        if not label.isascii():
            if unicodedata.category(label[0]).startswith("M") or label.startswith("-") or label.endswith("-"):
                return None
            try:
                label = "xn--" + label.encode("punycode").decode("ascii")
            except UnicodeError:
                return None
            if len(label) > 63:
                return None
        labels.append(label)
    return ".".join(labels)


def _ipv6(text: str) -> str | None:
    """An address in brackets in its shortest form; None if it is none."""
    try:
        address = ipaddress.IPv6Address(text.removeprefix("[").removesuffix("]"))
    except ValueError:
        return None
    if "%" in text or not text.endswith("]"):
        return None
    parts = [f"{int(address) >> 16 * (7 - i) & 0xFFFF:x}" for i in range(8)]
    # the first of the longest runs of zeros, if it has two or more
    best, at = 0, 0
    for i in range(8):
        n = next((k for k, x in enumerate(parts[i:]) if x != "0"), 8 - i)
        if n > best:
            best, at = n, i
    if best < 2:
        return f"[{':'.join(parts)}]"
    return f"[{':'.join(parts[:at])}::{':'.join(parts[at + best:])}]"


def _ipv4(text: str) -> str | None:
    parts = text.removesuffix(".").split(".")
    if len(parts) > 4:
        return None
    numbers = []
    for p in parts:
        try:
            numbers.append(int(p, 16) if p.startswith("0x") else int(p, 8) if len(p) > 1 and p[0] == "0" else int(p))
        except ValueError:
            return None
    if any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
        return None
    value = numbers[-1] + sum(n << (8 * (3 - i)) for i, n in enumerate(numbers[:-1]))
    return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))


def _segments(path: str, base: list[str]) -> str:
    out = list(base)
    parts = path.split("/")
    for i, part in enumerate(parts):
        low = part.lower().replace("%2e", ".")
        final = i == len(parts) - 1
        if low == "..":
            if out:
                out.pop()
            if final:
                out.append("")
        elif low == ".":
            if final:
                out.append("")
        else:
            out.append(_encode(part, _PATH_SET))
    return "/" + "/".join(out)


def _tail(text: str) -> tuple[str, str | None, str | None]:
    """(path, query, fragment) as written."""
    text, sharp, fragment = text.partition("#")
    path, mark, query = text.partition("?")
    return path, query if mark else None, fragment if sharp else None


def _finish(url: Url, query: str | None, fragment: str | None) -> Url:
    special = url.scheme in DEFAULT_PORTS
    return replace(url, query=None if query is None else _encode(query, _QUERY_SET if special else _QUERY_SET - {0x27}), fragment=None if fragment is None else _encode(fragment, _FRAGMENT_SET))


@lru_cache(maxsize=4096)
def parse(text: str, base: Url | None = None) -> Url | None:
    text = re.sub(r"[\t\n\r]", "", text.strip("".join(map(chr, range(0x21)))))
    m = _SCHEME.match(text)
    if m and (m.group(1).lower() not in DEFAULT_PORTS or not base or base.scheme != m.group(1).lower() or m.group(2)[:1] in "/\\" and m.group(2)):
        scheme, rest = m.group(1).lower(), m.group(2)
        if scheme not in DEFAULT_PORTS:
            path, query, fragment = _tail(rest)
            if path.startswith("//"):
                authority, slash, path = path[2:].partition("/")
                host, _, port = authority.rpartition("@")[2].partition(":")
                return _finish(Url(scheme, host=host, port=int(port) if port.isdigit() else None, path=slash and _segments(path, [])), query, fragment)
            if path.startswith("/"):
                return _finish(Url(scheme, path=_segments(path[1:], [])), query, fragment)
            return _finish(Url(scheme, path=_encode(path, _CONTROL), opaque=True), query, fragment)
        path, query, fragment = _tail(rest)
        path = path.replace("\\", "/")
        if scheme == "file":
            host, slash, path = path[2:].partition("/") if path.startswith("//") else ("", "/", path.lstrip("/"))
            return _finish(Url(scheme, host="" if host in ("", "localhost") else host.lower(), path=_segments(path, [])), query, fragment)
        return _authority(scheme, path.lstrip("/"), query, fragment)
    if base is None:
        return None
    if m and m.group(1).lower() == base.scheme:
        text = m.group(2)
    if base.opaque:
        return _finish(replace(base, fragment=None), base.query, text[1:]) if text.startswith("#") else None
    path, query, fragment = _tail(text)
    if base.scheme in DEFAULT_PORTS:
        path = path.replace("\\", "/")
    if path.startswith("//"):
        return _authority(base.scheme, path[2:] if base.scheme == "file" else path.lstrip("/"), query, fragment)
    if path.startswith("/"):
        return _finish(replace(base, path=_segments(path[1:], []), query=None, fragment=None), query, fragment)
    if not path:
        kept = replace(base, fragment=None)
        out = _finish(replace(kept, query=None), query, fragment)
        return out if query is not None else replace(out, query=base.query)
    return _finish(replace(base, path=_segments(path, base.path.split("/")[1:-1]), query=None, fragment=None), query, fragment)


def _authority(scheme: str, rest: str, query: str | None, fragment: str | None) -> Url | None:
    authority, slash, path = rest.partition("/")
    login, at, place = authority.rpartition("@")
    user, _, password = login.partition(":")
    m = re.fullmatch(r"(\[[^\]]*\]|[^:]*)(?::(\d*))?", place)
    if not m:
        return None
    host = _host(m.group(1))
    port = int(m.group(2)) if m.group(2) else None
    if host is None or port is not None and port > 65535:
        return None
    if port == DEFAULT_PORTS.get(scheme):
        port = None
    return _finish(Url(scheme, _encode(user, _USER_SET), _encode(password, _USER_SET), host, port, _segments(path, []) if slash else "/"), query, fragment)


def join(base: str, reference: str) -> str | None:
    """The serialised URL of ``reference`` seen from ``base``; None if either doesn't parse."""
    root = parse(base)
    out = parse(reference, root) if root is not None else None
    return None if out is None else str(out)


def resolve_or_raw(base: str, reference: str) -> str:
    """Target of a link or image: absolute http(s) and mailto as written, else joined, else as written."""
    if reference.startswith(("http://", "https://", "mailto:")):
        return reference
    return join(base, reference) or reference


def followable(base: str, href: str) -> str | None:
    """The URL that a link leads to, or None for fragments and schemes that aren't pages."""
    href = href.strip()
    if not href or href.startswith(("#", "mailto:", "tel:", "javascript:")):
        return None
    return join(base, href)


def without_fragment(url: str) -> str:
    return url.partition("#")[0]


def same_origin(a: Url | None, b: Url | None) -> bool:
    return a is not None and b is not None and (a.scheme, a.host, a.effective_port) == (b.scheme, b.host, b.effective_port)


def origin_matches(a: str, b: str) -> bool:
    """Origin comparison that lets an unparsable side pass."""
    x, y = parse(a), parse(b)
    return x is None or y is None or same_origin(x, y)


def path_prefix(path: str) -> str:
    """The path up to its last slash; ``/`` for a path without one."""
    return path[: path.rfind("/") + 1] or "/"


#: Extensions and the content type they announce.
_TYPES = {"pdf": "application/pdf", "json": "application/json", "txt": "text/plain", "md": "text/plain", "html": "text/html", "htm": "text/html"}


def content_type_of(path: str) -> str | None:
    low = path.lower()
    name = low.rsplit("/", 1)[-1]
    ext = name.rsplit(".", 1)[-1] if "." in name else ""
    if ext in _TYPES:
        return _TYPES[ext]
    return "text/html" if low.endswith("/") or "." not in name else None


def glob_match(pattern: str, value: str) -> bool:
    """A pattern without ``*`` is a substring test.

    With ``*`` its parts are found in order.  A pattern that starts with text needs that
    text twice, at the start and again behind it; one that ends with text needs the value
    to end with it.
    """
    if "*" not in pattern:
        return pattern in value
    parts = pattern.split("*")
    rest = value
    if parts[0]:
        if not value.startswith(parts[0]):
            return False
        rest = value[len(parts[0]) :]
    for part in filter(None, parts):
        at = rest.find(part)
        if at < 0:
            return False
        rest = rest[at + len(part) :]
    return not parts[-1] or value.endswith(parts[-1])


def host_matches(host: str, domain: str) -> bool:
    return host == domain or host.endswith("." + domain)


def normal_domain(domain: str) -> str:
    return domain.strip().strip(".").lower()


def domain_covers(domain: str, host: str) -> bool:
    """Whether a cookie or allowed domain covers a host; empty domains cover nothing."""
    d, h = normal_domain(domain), normal_domain(host)
    return bool(d) and bool(h) and host_matches(h, d)


def origin_host(origin: str) -> str | None:
    """Host of ``scheme://[user@]host[:port]``."""
    m = re.match(r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@]*@)?(\[[^\]]*\]|[^/:?#]*)", origin)
    return m.group(1).strip("[]").lower() or None if m else None


def cookie_path_covers(cookie_path: str, path: str) -> bool:
    return path == cookie_path or path.startswith(cookie_path) and (cookie_path.endswith("/") or path[len(cookie_path) :].startswith("/"))


#: Second-level labels under which sites are registered one level deeper.
SHARED_LABELS = frozenset("co com org gov edu net mil int ac ad ae af ag".split())
#: Schemes whose links count as leaving the site.
LEAVING = ("mailto:", "tel:", "ftp:", "file:", "data:", "javascript:")


def base_domain(host: str) -> str:
    labels = normal_domain(host).removeprefix("www.").split(".")
    return ".".join(labels[-3:] if len(labels) > 2 and labels[-2] in SHARED_LABELS else labels[-2:])


def link_host(href: str, base: str = "") -> str | None:
    """Host that a link leads to, without ``www.``; None if it has none."""
    text = href.strip()
    u = parse(text) or (parse(text, parse(base)) if base and parse(base) else None)
    return u.host.rstrip(".").lower().removeprefix("www.") if u is not None and u.host else None


def is_external(href: str, base: str) -> bool:
    """Whether a link leaves the site of ``base``: its host doesn't end with the site's base domain."""
    if href.strip().lower().startswith(LEAVING):
        return True
    host = link_host(href, base)
    home = link_host(base)
    return host is not None and not host.endswith(base_domain(home) if home else "")


def redact_url(url: str) -> str:
    """Query and fragment replaced by ``<redacted>``, percent-encoded; a URL that doesn't parse is replaced as a whole."""
    u = parse(url)
    if u is None:
        return "<redacted>"
    head = str(replace(u, query=None, fragment=None))
    return head + ("?%3Credacted%3E" if u.query is not None else "") + ("#%3Credacted%3E" if u.fragment is not None else "")


def classify_input(text: str) -> str | None:
    """``file``, ``inline``, ``http`` or None for anything else, by prefix in that order."""
    if text.startswith("file://"):
        return "file"
    if text.startswith("raw:"):
        return "inline"
    u = parse(text)
    return "http" if u is not None and u.scheme in ("http", "https") and u.host else None
