"""Residue: certain fillers, fillers that need a slot, messages, filler text, and pages that only write about them."""

import pytest

from pagelake.llm.residue import inspect, residue_pages, running_text

BODY = "The harbour opens early and the ferry leaves at nine with many people on board. " * 14


@pytest.mark.parametrize(
    "text",
    ["Dear {{ user.name }}, welcome", "Hello ${author}", "by <%= author %> today", "# About %%TITLE%%", "call *|FNAME|* now", "Price: [object Object]", "from [your city] with love", "<INSERT DATE> it began", "TITLE_GOES_HERE", "{% block title %}", "#{name} said", "@@X_Y@@", "on XX/XX/XXXX at noon", "of %s %d items", "wrapped {{\nname }} here", "step {0} of {1}"],
)
def test_certain_slots(text):
    assert inspect(BODY + "\n\n" + text, "markdown")[0] == "slot"
    assert inspect(f"{BODY}\n\n```\n{text}\n```\n", "markdown")[0] is None
    assert inspect(f"{BODY}\n\nWrite `{' '.join(text.split())}` there.", "markdown")[0] is None


@pytest.mark.parametrize(
    ("text", "kind"),
    [("# 404 - Page not found\n\nGo back.", "markdown"), ("Menu\n\nSESSION EXPIRED\n\nPlease sign in again to continue.", "text"), ('{"error": {"code": 503, "message": "Service unavailable Try later"}}', "json"), ("<p>Please enable JavaScript to run this app.</p>", "html"), ("The requested URL /a/b was not found on this server.", None), ("Seite nicht gefunden", "text")],
)
def test_messages(text, kind):
    assert inspect(text, kind)[0] == "message"


def test_no_cases():
    for text, kind in ((BODY + "\n\nEnable JavaScript to load the 5 comments below.", "text"), (BODY + "\n\nA `404` answer means that nothing was found.", "markdown"), ("| 404 | page not found | skip |\n\n" + BODY, "markdown"), ('{"name": "x", "retries": 3}', "json"), (BODY + " Such filler is called lorem ipsum.", "text"), ("", "text"), ("{broken", "json")):
        assert inspect(text, kind)[0] is None, text[-60:]


def test_filler():
    assert inspect("# T\n\nLorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore magna aliqua.", "markdown")[0] == "filler"
    assert inspect("Your headline here\n\nText goes here. Text goes here.", "text")[0] == "message"


def test_code_is_left_out():
    assert "secret" not in running_text("a\n\n    secret()\n\n~~~\nsecret\n~~~\nb `secret` c", "markdown")
    assert "secret" not in running_text("<p>a</p><pre><code>secret</code></pre>", "html")
    assert running_text('{"a": ["x", {"b": "y"}]}', "json") == "x\ny"


def test_pages(pages):
    site = "https://s{}.example/{}"
    rows = [{"page_id": i, "url": site.format(i % 5, i), "content_format": "text", "content": f"Menu {i}\n\nGeneric glitch number {i} occurred here\n\nUnit {chr(97 + i)}"} for i in range(12)]
    rows += [{"page_id": 100 + i, "url": site.format(i % 5, i), "content_format": "text", "content": f"{BODY}\n\nShare this page with friends"} for i in range(12)]
    rows += [{"page_id": 200, "content": "We count the parser today and undefined boat leaves " + BODY, "content_format": "text"}, {"page_id": 201, "content": "and the boat " + BODY, "content_format": "text"}, {"page_id": 202, "content": "and a boat " + BODY, "content_format": None}]
    rows += [{"page_id": 210 + i, "content": f"Dear {{{{ city_name }}}} {i} {BODY}", "content_format": "text"} for i in range(2)] + [{"page_id": 215, "content": "Zyx __CITY_NAME__ wvu " + BODY, "content_format": "text"}, {"page_id": 216, "content": "Zyx __OTHER_NAME__ wvu " + BODY, "content_format": "text"}]
    rows += [{"page_id": 203, "content": "The zygote undefined quasar " + BODY, "content_format": "text"}, {"page_id": 300, "content": None}, {"page_id": 301, "content": ""}, {"page_id": 302, "content": "y" * 200_000, "content_format": "text"}]
    for limit in (1_000_000, 0):
        got = {r.page_id: r.reason for r in residue_pages(pages(rows + rows[:2]), broadcast_keys=limit).collect()}
        assert got == {**{i: "template" for i in range(12)}, 200: "slot", 210: "slot", 211: "slot", 215: "slot"}
    assert residue_pages(pages(rows).limit(0)).count() == 0


def test_grounds(pages):
    """Templates, blanks and default text are proven by other records, at any length of the menus around them."""
    site = "https://s{}.example/{}"
    menu = "\n\n".join(f"{w} corner of the site with all its many entries" for w in ("north", "south", "east", "west", "upper", "lower", "inner", "outer") * 4)
    rows = [{"page_id": i, "url": site.format(i % 4, i), "content_format": "text", "content": f"{menu}\n\nNothing grows under this number {i}\n\nunit {chr(97 + i)}"} for i in range(8)]
    rows += [{"page_id": 50 + i, "url": site.format(i % 4, i), "content_format": "text", "content": f"{menu}\n\n{BODY} {chr(97 + i)}"} for i in range(25)]
    # versions of one text, of other sites, repeat all their lines
    version = "\n\n".join(f"Line {chr(97 + k)} of a long text that was copied and edited here and there" for k in range(20))
    rows += [{"page_id": 100 + i, "url": site.format(i % 4, i), "content_format": "text", "content": f"{version}\n\nedit {chr(97 + i)}"} for i in range(8)]
    # a blank between the same words
    rows += [{"page_id": 120, "content": "Zyx built in () by wvu " + BODY, "content_format": "text"}, {"page_id": 121, "content": "Zyx built in Oslo by wvu " + BODY}, {"page_id": 122, "content": "Zyx built in Rome by wvu " + BODY}, {"page_id": 123, "content": "Qua zeta rho () tau " + BODY, "content_format": "text"}]
    # addresses betray bare pages
    rows += [{"page_id": 130 + i, "url": "https://a.example/", "final_url": f"https://s{i % 4}.example/error?code={400 + i}", "content_format": "text", "content": f"gone {chr(97 + i)}"} for i in range(8)]
    rows += [{"page_id": 140, "final_url": "https://q.example/error?code=9", "content_format": "text", "content": BODY}]
    # words of default text, learnt from pages that open with it; one that only mentions it
    invented = "sedo quima vestu plora " * 6
    rows += [{"page_id": 150 + i, "content": f"Lorem ipsum {invented}", "content_format": "text"} for i in range(3)] + [{"page_id": 160, "content": f"# T\n\n{invented}", "content_format": "markdown"}, {"page_id": 161, "content": f"{BODY} Some call it lorem ipsum.", "content_format": "text"}]
    want = {**{i: "template" for i in range(8)}, 120: "slot", **{130 + i: "template" for i in range(8)}, **{150 + i: "default" for i in range(3)}, 160: "default"}
    for limit in (1_000_000, 0):
        assert {r.page_id: r.reason for r in residue_pages(pages(rows), broadcast_keys=limit).collect()} == want
