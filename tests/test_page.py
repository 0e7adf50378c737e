"""Extraction of single pages: content choice, clean-up, and the four formats."""

import json

import pytest

from pagelake.page import OptionError, Options, extract_page
from pagelake.plans.rendered import BASE, GROUPS

CASES = [c for cases in GROUPS.values() for c in cases]


@pytest.mark.parametrize("case", CASES, ids=[c.name for c in CASES])
def test_built_pages(case):
    """Each small page gives its text, whatever words it is made of."""
    for a, b, n in (("kettle", "barrel", "41"), ("lamp", "ferry", "7")):
        fill = lambda t, a=a, b=b, n=n: t.replace("{a}", a).replace("{b}", b).replace("{n}", n)
        page = extract_page(BASE, fill(case.html), case.build())
        assert page.error is None and page.content == fill(case.expected)


def markdown(body, **options):
    page = extract_page(BASE, body, Options.of(options))
    assert page.error is None, page.error
    return page.content


def test_reference_numbers_stand_behind_their_paragraph_if_asked():
    body = '<main><p>Go <a href="/one">left</a>.</p><p>Go <a href="/two">right</a>.</p></main>'
    assert markdown(body, inline_links="no", links_each_paragraph="yes") == "Go [left][1].\n\n   [1]: https://garden.example/one\n\nGo [right][2].\n\n   [2]: https://garden.example/two"


def test_link_texts():
    assert markdown('<main><p><a href="/x">a [b] c</a></p></main>') == "[a \\[b\\] c](https://garden.example/x)"
    assert markdown('<main><p>up <a href="#top">there</a></p></main>', skip_internal_links="1") == "up there"
    assert markdown('<main><p>by <a href="mailto:me@garden.example">mail</a></p></main>', ignore_mailto_links="off") == "by [mail](mailto:me@garden.example)"


def test_attributes_that_stay():
    body = '<main><p class="c" id="i" data-bed="4" lang="en" onclick="f()">Soil</p></main>'
    render = lambda **o: extract_page(BASE, body, Options.of(o, format="html", selector="main")).content
    assert render() == '<p class="c" id="i">Soil</p>'
    assert 'data-bed="4"' in render(keep_data_attributes="true") and 'lang="en"' in render(keep_attrs="lang")


def test_chrome_words_never_win():
    page = "<header><div id='content'><p>Opening hours, prices, directions and a great many other words of the garden's own header.</p></div></header><section class='post'><h2>Soil</h2><p>Only a little text.</p></section>"
    assert markdown(page).startswith("## Soil")


def test_metadata_formats_and_scripts():
    page = "<html><head><title> Beds </title><meta name='description' content=' on soil '><meta property='og:title' content='Beds'></head><body><main><h1>Soil</h1></main><script>go()</script></body></html>"
    got = extract_page(BASE, page, Options.of({}, format="text"))
    assert got.content == "Soil" and got.needs_render
    assert got.metadata == {"title": "Beds", "description": "on soil", "keywords": None, "author": None, "og:title": "Beds"}
    assert json.loads(extract_page(BASE, page, Options.of({}, format="json")).content) == {"content": "Soil", "url": BASE}


def test_selectors_that_miss_or_break():
    page = "<main><h1>Soil</h1><p>dark</p></main>"
    whole = extract_page(BASE, page).content
    assert extract_page(BASE, page, Options.of({}, selector="[")).content == whole
    assert extract_page(BASE, page, Options.of({}, wait_for_selector=".late")).error[0] == "extraction_failed"
    assert extract_page(BASE, None).error is not None and extract_page(BASE, "").content == ""


@pytest.mark.parametrize("options", [{"unheard_of": "1"}, {"only_text": "perhaps"}, {"body_width": "-3"}, {"google_list_indent": "0"}, {"excluded_tags": "b,not a tag"}, {"target_elements": "p["}, {"wait_until": "dinner"}, {"cache_mode": "enabled"}])
def test_options_that_are_refused(options):
    with pytest.raises(OptionError):
        Options.of(options)


def test_options_gather_and_warn():
    assert Options.of([("excluded_tags", "nav"), ("site.excluded_tags", "small")]).excluded_tags == ("nav", "small")
    assert extract_page(BASE, "<p>x</p>", Options.of({"scan_full_page": "true"})).warnings
    with pytest.raises(OptionError):
        Options.of({}, wait_for_selector="js:() => ready")


def test_deep_nesting_is_rendered():
    page = extract_page(BASE, "<main>" + "<section>" * 3000 + "<p>bottom</p>")
    assert page.error is None and page.content == "bottom"
