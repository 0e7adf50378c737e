"""URLs: the standard's joins, and the predicates built on them."""

import pytest

from pagelake import url as U

BASE = "http://a.example/b/c/d;p?q"


@pytest.mark.parametrize(
    ("ref", "want"),
    [
        ("g", "http://a.example/b/c/g"), ("./g", "http://a.example/b/c/g"), ("g/", "http://a.example/b/c/g/"), ("/g", "http://a.example/g"), ("//g.example", "http://g.example/"), ("?y", "http://a.example/b/c/d;p?y"), ("g?y", "http://a.example/b/c/g?y"), ("#s", "http://a.example/b/c/d;p?q#s"), ("", "http://a.example/b/c/d;p?q"),
        ("..", "http://a.example/b/"), ("../g", "http://a.example/b/g"), ("../../../g", "http://a.example/g"), ("./../g", "http://a.example/b/g"), ("g;x=1/../y", "http://a.example/b/c/y"), ("https:g", None), ("HTTP://A.EXAMPLE:80/X y?a b#c d", "http://a.example/X%20y?a%20b#c%20d"), ("\\x\\y", "http://a.example/x/y"),
        ("/ü/%7e", "http://a.example/%C3%BC/%7e"), ("//b.example:8080", "http://b.example:8080/"), ("//b.example:99999", None), ("//[::1]/x", "http://[::1]/x"), ("mailto:x@y", "mailto:x@y"), ("javascript:void(0)", "javascript:void(0)"), (" \tg\n", "http://a.example/b/c/g"), ("//u:p@h.example/", "http://u:p@h.example/"), ("//0x7f.1/", "http://127.0.0.1/"), ("//bad host/", None), ("%2e%2e/g", "http://a.example/b/g"),
    ],
)
def test_join(ref, want):
    if ref == "https:g":
        assert U.join(BASE, ref) == "https://g/"
    else:
        assert U.join(BASE, ref) == want


def test_parse_and_predicates():
    assert U.parse("no scheme") is None and U.parse("http://") is None and str(U.parse("file:///a/../b")) == "file:///b"
    assert U.same_origin(U.parse("http://a.example"), U.parse("http://A.example:80/x")) and not U.same_origin(U.parse("http://a.example"), U.parse("https://a.example"))
    assert U.origin_matches("nonsense", "http://a.example") and not U.origin_matches("http://b.example", "http://a.example")
    assert [U.path_prefix(p) for p in ("/a/b", "/a/", "/", "x")] == ["/a/", "/a/", "/", "/"]
    assert [U.content_type_of(p) for p in ("/a.PDF", "/a.json", "/a.md", "/a.htm", "/a/", "/a", "/a.zip")] == ["application/pdf", "application/json", "text/plain", "text/html", "text/html", "text/html", None]
    assert U.followable(BASE, " #x") is None and U.followable(BASE, "tel:1") is None and U.followable(BASE, " g ") == "http://a.example/b/c/g"
    assert U.resolve_or_raw("", "g") == "g" and U.resolve_or_raw(BASE, "mailto:a@b") == "mailto:a@b"
    assert U.redact_url("https://a.example/p?x=1#y") == "https://a.example/p?%3Credacted%3E#%3Credacted%3E" and U.redact_url("::") == "<redacted>" and U.redact_url("http://a.example") == "http://a.example/"
    assert [U.classify_input(x) for x in ("file:///x", "raw://<p>", "raw:x", "https://a.example", "ftp://a.example", "x")] == ["file", "inline", "inline", "http", None, None]


def test_globs_keep_their_quirk():
    assert U.glob_match("docs", "https://a.example/docs/x") and not U.glob_match("docs", "https://a.example/blog")
    assert U.glob_match("*docs*", "https://a.example/docs/x") and U.glob_match("*.pdf", "a.pdf") and not U.glob_match("*.pdf", "a.pdf?x")
    assert not U.glob_match("https://a*", "https://a.example") and U.glob_match("ab*", "abab") and not U.glob_match("ab*", "xabab")
    assert U.glob_match("*a*b", "xxaxxb") and not U.glob_match("*b*a*", "ab")


def test_domains():
    assert U.domain_covers(".Example.com", "www.example.com.") and not U.domain_covers("example.com", "badexample.com") and not U.domain_covers("", "a") and not U.domain_covers(".", "a")
    assert [U.base_domain(h) for h in ("www.a.example", "a.b.co.uk", "x.y.example", "host")] == ["a.example", "b.co.uk", "y.example", "host"]
    assert U.is_external("mailto:a@b", "https://a.example") and U.is_external("https://b.test", "https://a.example") and not U.is_external("/x", "https://a.example") and not U.is_external("https://nota.example/", "https://a.example")
    assert U.origin_host("https://u@[::1]:8/") == "::1" and U.origin_host("x") is None
    assert U.cookie_path_covers("/a", "/a/b") and U.cookie_path_covers("/a/", "/a/b") and not U.cookie_path_covers("/a", "/ab")


def test_international_and_ipv6_hosts():
    from pagelake.url import parse

    for text, want in {
        "http://Straße.example/": "http://xn--strae-oqa.example/", "http://BÜCHER.example/x": "http://xn--bcher-kva.example/x", "http://☃.net/": "http://xn--n3h.net/", "http://例え。jp/": "http://xn--r8jz45g.jp/", "http://ﬁ.example/": "http://fi.example/",
        "http://[2001:DB8:0:0:1:0:0:1]/x": "http://[2001:db8::1:0:0:1]/x", "http://[::ffff:1.2.3.4]/": "http://[::ffff:102:304]/", "http://[::]:8080/": "http://[::]:8080/", "http://[1:0:0:2:0:0:0:3]/": "http://[1:0:0:2::3]/",
    }.items():
        assert str(parse(text)) == want
    assert parse("http://[zz]/") is None and parse("http://́a.example/") is None
