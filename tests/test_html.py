"""Tree construction on broken markup, serialisation, and selectors."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagelake.html import SelectorError, inner_html, outer_html, parse_document, select

H, T = "<html><head></head><body>", "</body></html>"


@pytest.mark.parametrize(
    ("source", "body"),
    [
        ("<p>1<b>2<i>3</b>4</i>5</p>", "<p>1<b>2<i>3</i></b><i>4</i>5</p>"),
        ("<b>1<p>2</b>3</p>", "<b>1</b><p><b>2</b>3</p>"),
        ("<p><b>A.<br><p>B.</p>", "<p><b>A.<br></b></p><p><b>B.</b></p>"),
        ("<b><b><b><b>x<p>y", "<b><b><b><b>x<p>y</p></b></b></b></b>"),
        ("<p><b><b><b><b>x<p>y", "<p><b><b><b><b>x</b></b></b></b></p><p><b><b><b>y</b></b></b></p>"),
        ("<table>foo<b>x<tr><td>1</table>y", "foo<b>x</b><table><tbody><tr><td>1</td></tr></tbody></table><b>y</b>"),
        ("<table><tr><td>1<td>2<tr><th>x</table>after", "<table><tbody><tr><td>1</td><td>2</td></tr><tr><th>x</th></tr></tbody></table>after"),
        ("<a href=1>x<a href=2>y</a>", '<a href="1">x</a><a href="2">y</a>'),
        ("<ul><li>a<ul><li>b</ul><li>c</ul>", "<ul><li>a<ul><li>b</li></ul></li><li>c</li></ul>"),
        ("<dl><dt>a<dd>b<dt>c</dl>", "<dl><dt>a</dt><dd>b</dd><dt>c</dt></dl>"),
        ("<i>a<b>b<p>c</i>d</p>e", "<i>a<b>b</b></i><b><p><i>c</i>d</p>e</b>"),
        ("</p></br>x</div>", "<p></p><br>x"),
        ("<pre>\nq</pre><textarea>\n<b></textarea>", "<pre>q</pre><textarea>&lt;b&gt;</textarea>"),
        ("&copy;&nbsp;&lt;&amp;amp; <!-- c -->", "©&nbsp;&lt;&amp;amp; <!-- c -->"),
        ("<select><option>a<option>b</select>", "<select><option>a</option><option>b</option></select>"),
        ("<svg><path d=M0 /><g></g></svg>x", '<svg><path d="M0"></path><g></g></svg>x'),
        ("<p>a<div>b</div>", "<p>a</p><div>b</div>"),
        ("a < b <3 </ x>", "a &lt; b &lt;3 <!-- x-->"),
        ("<x-y A=\"1\" a='2' b c=d>", '<x-y a="1" b="" c="d"></x-y>'),
    ],
)
def test_trees(source, body):
    assert outer_html(parse_document(source)) == H + body + T


def test_head_and_raw_text():
    root = parse_document("<!doctype html><title>a &amp; <b></title><script>if (a<b) '</p>'</script><p>x<style>p>q{}</style>")
    assert outer_html(root) == "<html><head><title>a &amp; &lt;b&gt;</title><script>if (a<b) '</p>'</script></head><body><p>x<style>p>q{}</style></p></body></html>"
    assert outer_html(parse_document("<html lang=en><body class=q>a<body id=z><html x=1>")) == '<html lang="en" x="1"><head></head><body class="q" id="z">a</body></html>'


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("<p> </p> <b> </b> <i> </i> <a> </a> <table> </table> <tr> <td> </td> <li> <ul> </ul> <div> </div> <h1> </h1> <br> <select> </select> <option> <pre> <svg> </svg> <form> </form> <button> </button> <caption> <template> </template> x & < <!-- --> </html> <title> </title>".split(" ")), max_size=30))
def test_any_markup_gives_a_stable_tree(parts):
    root = parse_document("".join(parts))
    for e in root.elements():
        assert all(c.parent is e for c in e.children)
    inner_html(root)


@given(st.text(max_size=200))
def test_any_text_parses(text):
    parse_document(text)


def test_deep_nesting():
    assert outer_html(parse_document("<div>" * 5000 + "x")).count("<div>") == 5000


@pytest.mark.parametrize(
    ("selector", "ids"),
    [("p", "bc"), ("#a > p:nth-child(2)", "c"), (".x.y", "a"), ("div p, span", "bcd"), ('[lang|="en"]', "b"), ('[data-k^="Va" i]', "d"), ("[data-k*=lu]", "d"), ("p + p", "c"), ("p ~ span", "d"), ("p:not(#b)", "c"), ("*:first-child", "b"), ("span:last-child", "d"), ("p:nth-of-type(odd)", "b"), ("css: #d", "d"), ("b:empty", "e"), ("span:is(.z, [data-k])", "d")],
)
def test_selectors(selector, ids):
    root = parse_document('<div id=a class="x y"><p id=b lang=en-us>1</p><p id=c>2</p><span id=d data-k=value>3<b id=e></b></span></div>')
    found = [e.attrs.get("id") for e in select(root, selector) if "id" in e.attrs]
    assert [i for i in found if i in ids] == list(ids) and (set(found) == set(ids) or selector.startswith("*") or ":last" in selector)


@pytest.mark.parametrize("bad", ["", "[", "p >", "> p", "p,,q", ":nth-child(x)", ":hover", "p:not(", "a=b"])
def test_bad_selectors(bad):
    with pytest.raises(SelectorError):
        select(parse_document("<p>"), bad)
