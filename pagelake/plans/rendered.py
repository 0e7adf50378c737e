"""Small pages made from table rows, with the text that each must give; the queries render them, SQL fills in the texts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pages
from ..page import Options

BASE = 'https://garden.example/beds/plan.html?year=3'


@dataclass(frozen=True)
class Case:
    """A page and its expected content, both with ``{a}``, ``{b}`` (words) and ``{n}`` (a number) to fill in."""

    name: str
    html: str
    expected: str
    format: str = "markdown"
    options: dict = field(default_factory=dict)
    request: dict = field(default_factory=dict)

    def build(self) -> Options:
        return Options.of(self.options, format=self.format, **self.request)


GROUPS: dict[str, tuple[Case, ...]] = {
    "render_blocks": (
        Case('headings', '<main><h1>{a} plan</h1><h2>North <em>{b}</em></h2><h6>Last</h6><p>Dig {n} rows.</p></main>', '# {a} plan\n\n## North _{b}_\n\n###### Last\n\nDig {n} rows.'),
        Case('lists', '<main><ul><li>{a}<ul><li>{b} inside</li></ul></li><li>Last</li></ul><ol start="3"><li>Third {a}</li><li>Fourth</li></ol></main>', '* {a}\n  * {b} inside\n* Last\n\n1. Third {a}\n2. Fourth'),
        Case('definitions', '<main><dl><dt>{a}</dt><dd>A bed of {b}.</dd><dt>Row</dt><dd>{n} steps.</dd></dl></main>', '{a}\n    A bed of {b}.\nRow\n    {n} steps.'),
        Case('quotes', '<main><p>{a} says:</p><blockquote><p>Water {b}.</p><p>Then wait.</p></blockquote></main>', '{a} says:\n\n> Water {b}.\n>\n> Then wait.'),
        Case('code', '<main><p>Run:</p><pre><code>dig {a}\n  --depth {n}</code></pre><p>Done.</p></main>', 'Run:\n\n```\ndig {a}\n  --depth {n}\n```\n\nDone.'),
        Case('breaks', '<main><p>{a}<br>{b}</p><hr><p>After.</p></main>', '{a}  \n{b}\n\n* * *\n\nAfter.'),
        Case('line_starts', '<main><p>{n}. is no list</p><p>- nor this</p><p>+ nor that</p></main>', '{n}\\. is no list\n\n\\- nor this\n\n\\+ nor that'),
        Case('wrapped', '<main><p>Every garden has beds of clay and beds of sand between them.</p><ul><li>an item that is long stays in one line anyhow</li></ul><p>{a}</p></main>', 'Every garden has beds of clay\nand beds of sand between them.\n\n* an item that is long stays in one line anyhow\n\n{a}', options={'body_width': '30'}),
        Case('single_breaks', '<main><h1>{a}</h1><p>One.</p><p>Two {b}.</p></main>', '# {a}\nOne.\nTwo {b}.', options={'single_line_break': 'true'}),
        Case('marked_code', '<main><p>x</p><pre>{a} = {n}</pre></main>', 'x\n\n```\n{a} = {n}\n```', options={'mark_code': 'true'}),
        Case('deep_lists', '<main><ol><li>{a}<ol><li>{b}<ul><li>three</li></ul></li></ol></li></ol></main>', '1. {a}\n  1. {b}\n    * three'),
        Case('quoted_list', '<main><p>x</p><blockquote><ul><li>{a}</li><li>{b}</li></ul></blockquote></main>', 'x\n\n> * {a}\n> * {b}'),
    ),
    "render_inline": (
        Case('marks', '<main><p>Plant <strong>{a}</strong> beside <b>{b}</b>, <i>not</i> <del>under</del> it; press <kbd>F{n}</kbd> or <code>sow({n})</code>. <q>More {a}</q> wants a foot <sup>2</sup> of {b}.</p></main>', 'Plant **{a}** beside **{b}**, _not_ ~~under~~ it; press `F{n}` or `sow({n})`. "More {a}" wants a foot 2 of {b}.'),
        Case('sup_sub', '<main><p>{a} wants m<sup>2</sup> and H<sub>2</sub>O.</p></main>', '{a} wants m <sup>2</sup> and H <sub>2</sub> O.', options={'include_sup_sub': 'true'}),
        Case('own_marks', '<main><p><em>{a}</em> <strong>{b}</strong> <q>{n} seeds</q></p><ul><li>{a}</li></ul></main>', '*{a}* __{b}__ «{n} seeds»\n\n- {a}', options={'emphasis_mark': '*', 'strong_mark': '__', 'open_quote': '«', 'close_quote': '»', 'ul_item_mark': '-'}),
        Case('no_marks', '<main><p><em>{a}</em> and <strong>{b}</strong></p></main>', '{a} and {b}', options={'ignore_emphasis': 'true'}),
        Case('abbreviations', '<main><p>The <abbr title="Royal {a} Club">RGC</abbr> meets.</p></main>', 'The RGC meets.\n\n  *[RGC]: Royal {a} Club'),
        Case('struck', '<main><p>{a} <del>gone</del> <s>too</s> stays</p></main>', '{a} ~~gone~~ ~~too~~ stays', options={'hide_strikethrough': 'true'}),
        Case('preserved', '<main><p>Press <kbd>{a}</kbd> now</p></main>', 'Press\n\n<kbd>{a}</kbd>\n\nnow', options={'preserve_tags': 'kbd'}),
        Case('unclosed', '<article><h1>{a}</h1><p><b>Bold {b}<p>next</article>', '# {a}\n\n**Bold {b}**\n\n**next**'),
        Case('google_bold', '<main><p><span style="font-weight:bold">{a}</span> and <span style="font-style:italic">{b}</span></p></main>', '**{a}** and _{b}_', options={'google_doc': 'true'}),
    ),
    "render_links": (
        Case('links', '<main><p>See <a href="/seeds/{a}">the {a}</a>, <a href="rows.html#r{n}">rows</a>, <a href="?year=4" title="Next">next</a> and <a href="https://other.example/{b}">https://other.example/{b}</a> or <a href="mailto:x@garden.example">post</a>.</p></main>', 'See [the {a}](https://garden.example/seeds/{a}), [rows](https://garden.example/beds/rows.html#r{n}), [next](https://garden.example/beds/plan.html?year=4 "Next") and <https://other.example/{b}> or post.'),
        Case('numbered_links', '<main><p>See <a href="/{a}">{a}</a> and <a href="/{b}-{n}">{b}</a>.</p><p>Again <a href="/{a}">there</a>.</p></main>', 'See [{a}][1] and [{b}][2].\n\nAgain [there][1].\n\n   [1]: https://garden.example/{a}\n   [2]: https://garden.example/{b}-{n}', options={'inline_links': 'false'}),
        Case('no_links', '<main><p>See <a href="/{a}">{a}</a>.</p></main>', 'See {a}.', options={'ignore_links': 'true'}),
        Case('base', '<html><head><base href="https://cdn.example/x/"></head><body><main><p><a href="{a}.html">{a}</a> <img src="{b}.png" alt="{b}"></p></main></body></html>', '[{a}](https://cdn.example/x/{a}.html) ![{b}](https://cdn.example/x/{b}.png)'),
        Case('images', '<main><p><img src="/{a}.png" alt="A {a}"> and <img src="/{b}.png"></p></main>', '![A {a}](https://garden.example/{a}.png) and ![](https://garden.example/{b}.png)'),
        Case('image_alts', '<main><p><img src="/{a}.png" alt="A {a}"> stands</p></main>', 'A {a} stands', options={'images_to_alt': 'true'}),
        Case('no_images', '<main><p><img src="/{a}.png" alt="A {a}"> stands</p></main>', 'stands', options={'ignore_images': 'true'}),
        Case('protected', '<main><p><a href="/{a}">{b}</a></p></main>', '[{b}](<https://garden.example/{a}>)', options={'protect_links': 'true'}),
        Case('no_autolinks', '<main><p><a href="https://far.example/{a}">https://far.example/{a}</a></p></main>', '[https://far.example/{a}](https://far.example/{a})', options={'use_automatic_links': 'false'}),
        Case('sized_images', '<main><p><img src="/{a}.png" alt="{b}" width="30" height="40"> x</p></main>', "<img src='/{a}.png' width='30' height='40' alt='{b}' /> x", options={'images_with_size': 'true'}),
        Case('html_images', '<main><p><img src="/{a}.png" alt="{b}"> x</p></main>', "<img src='/{a}.png' alt='{b}' /> x", options={'images_as_html': 'true'}),
        Case('default_alt', '<main><p><img src="/{a}.png"> x</p></main>', '![A picture](https://garden.example/{a}.png) x', options={'default_image_alt': 'A picture'}),
        Case('linked_heading', '<main><a href="/{a}"><h2>{b}</h2></a></main>', '## [{b}](https://garden.example/{a})'),
        Case('figure', '<main><figure><img src="/{a}.png" alt="{a}"><figcaption>About {b}</figcaption></figure></main>', '![{a}](https://garden.example/{a}.png)\n\nAbout {b}'),
    ),
    "render_tables": (
        Case('table', '<main><table><tr><th>Bed</th><th>Rows</th></tr><tr><td>{a}</td><td>{n}</td></tr><tr><td>a|b</td><td><em>{b}</em></td></tr></table></main>', '| Bed | Rows |\n| --- | --- |\n| {a} | {n} |\n| a\\|b | _{b}_ |'),
        Case('padded_table', '<main><table><tr><th>Bed</th><th>Rows of it</th></tr><tr><td>ab</td><td>1</td></tr></table><p>{a}</p></main>', '| Bed | Rows of it |\n| ----| -----------|\n| ab  | 1          |\n\n{a}', options={'pad_tables': 'true'}),
        Case('flat_table', '<main><table><tr><th>Bed</th><th>Rows</th></tr><tr><td>{a}</td><td>{n}</td></tr></table></main>', 'Bed Rows\n{a} {n}', options={'ignore_tables': 'true'}),
        Case('kept_table', '<main><table><tr><th>Bed</th></tr><tr><td>{a} <b>x</b></td></tr></table></main>', '<table><tr><th>Bed</th></tr><tr><td>{a} **x**</td></tr></table>', options={'bypass_tables': 'true'}),
        Case('empty_cells', '<main><table><tr><th>A</th><th>B</th></tr><tr><td></td><td>{a}</td></tr><tr><td>{b}</td></tr></table></main>', '| A | B |\n| --- | --- |\n|  | {a} |\n| {b} |  |'),
        Case('no_header', '<main><table><tr><td>{a}</td><td>{b}</td></tr><tr><td>1</td><td>2</td></tr></table></main>', '| {a} | {b} |\n| --- | --- |\n| 1 | 2 |'),
    ),
    "render_cleaned": (
        Case('chrome', '<body><nav><a href="/">Start</a></nav><header>Site</header><h1>{a}</h1><p>Words about {b}.</p><aside>More</aside><footer>Legal</footer></body>', '# {a}\n\nWords about {b}.'),
        Case('scripts', '<body><main><h1>{a}</h1><script>var x = 1;</script><style>p{}</style><noscript>off</noscript><!-- note --><p>{b} stays.</p></main></body>', '# {a}\n\n{b} stays.'),
        Case('overlays', '<main><p>{a} stays.</p><div class="site-newsletter">Join</div><div role="dialog">Ask</div><button class="btn-close">x</button></main>', '{a} stays.'),
        Case('forms', '<main><p>{a} stays.</p><form><p>Ask {b}</p></form></main>', '{a} stays.', options={'remove_forms': 'true'}),
        Case('excluded', '<main><p>{a} <small>tiny</small> <a href="https://far.example/">far</a> <a href="/near">near</a></p><figure>pic</figure></main>', '{a} [near](https://garden.example/near)', options={'excluded_tags': 'small,figure', 'exclude_external_links': 'true'}),
        Case('social', '<main><p>{a} <a href="https://www.facebook.com/x">fb</a> <a href="https://far.example/">far</a></p></main>', '{a} [far](https://far.example/)', options={'exclude_social_media_links': 'true'}),
        Case('outside_images', '<main><p>{a} <img src="https://far.example/i.png" alt="far"> <img src="/i.png" alt="near"></p></main>', '{a} ![near](https://garden.example/i.png)', options={'exclude_external_images': 'true'}),
        Case('only_text', '<main><h1>{a}</h1><p>One <b>{b}</b> <a href="/x">two</a></p></main>', '# {a}\n\nOne {b} [two](https://garden.example/x)', options={'only_text': 'true'}),
        Case('consent', '<main><p>{a}</p><div id="gdpr-box">Agree</div><div class="cookie-law">Law</div></main>', '{a}', options={'remove_consent_popups': 'true'}),
        Case('all_images_out', '<main><p>{a} <img src="/i.png" alt="i"></p></main>', '{a}', options={'exclude_all_images': 'true'}),
        Case('domains_out', '<main><p>{a} <a href="https://www.far.example/x">far</a> <a href="https://near.example/">near</a></p></main>', '{a} [near](https://near.example/)', options={'exclude_domains': 'far.example'}),
        Case('internal_out', '<main><p>{a} <a href="/in">in</a> <a href="https://far.example/">far</a></p></main>', '{a} [far](https://far.example/)', options={'exclude_internal_links': 'true'}),
        Case('selectors_out', '<main><p>{a}</p><p class="gone">{b}</p></main>', '{a}', options={'excluded_selector': '.gone'}),
    ),
    "render_chosen": (
        Case('choice', '<div class="comments"><p>Long talk about many things that nobody needs but that has a lot of words in it anyway, far more than the rest.</p></div><article><h1>{a}</h1><p>Short piece on {b}.</p></article>', '# {a}\n\nShort piece on {b}.'),
        Case('dense_choice', '<div id="links"><p><a href="/1">one two three four five six seven eight</a> <a href="/2">nine ten eleven twelve thirteen fourteen</a></p></div><div id="content"><h1>{a}</h1><p>Plain words on {b} make a body, since they are words and not links to others.</p></div>', '# {a}\n\nPlain words on {b} make a body, since they are words and not links to others.'),
        Case('selector', '<body><div class="keep"><p>{a}</p><p>{b}</p></div><p>out</p></body>', '{a}\n\n{b}', request={'selector': 'div.keep p'}),
        Case('selector_miss', '<main><h1>{a}</h1><p>{b}</p></main>', '# {a}\n\n{b}', request={'selector': '.nothing'}),
        Case('exclude_selector', '<main><p>{a}</p><p class="ad">Buy</p><p id="x">Y</p></main>', '{a}', request={'exclude_selector': '.ad, #x'}),
        Case('wait', '<main><p>{a}</p></main>', '{a}', format='text', request={'wait_for_selector': 'p'}),
        Case('targets', '<main><h1>Out</h1><h2>{a}</h2><p>out</p><p class="k">{b}</p></main>', '## {a}\n\n{b}', options={'target_elements': 'h2,p.k'}),
        Case('word_threshold', '<article><p>Few {a}</p></article><section class="post"><p>Here are more than six words about {b} now.</p></section>', 'Here are more than six words about {b} now.', options={'word_count_threshold': '6'}),
        Case('css_selector', '<main><p>out</p><p id="k">{a} {b}</p></main>', '{a} {b}', format='text', options={'css_selector': '#k'}),
    ),
    "render_formats": (
        Case('text', '<main><h1>{a}</h1><p>One  <b>{b}</b>\n two.</p><ul><li>x{n}</li></ul></main>', '{a}\nOne {b}\ntwo.\nx{n}', format='text'),
        Case('json', '<main><h1>{a}</h1><p>{b} "quoted"</p></main>', '{"content":"{a}\\n{b} \\"quoted\\"","url":"https://garden.example/beds/plan.html?year=3"}', format='json'),
        Case('html', '<main><h1 onclick="f()" class="t">{a}</h1><p style="x" data-k="1" id="p1">{b} <img src="data:image/png;base64,AAAA" alt="i"></p><div></div><span> </span><!-- c --></main>', '<h1 class="t">{a}</h1><p id="p1">{b} <img src="" alt="i"></p>', format='html', request={'selector': 'main'}),
        Case('roots_html', '<main><p>{a}</p><div><p>{b}</p></div></main>', '<p>{a}</p>\n<p>{b}</p>', format='html', request={'selector': 'p'}),
        Case('pretty', '<main><ul><li>{a}</li><li>{b}</li></ul></main>', '<ul>\n  <li>\n    {a}\n  </li>\n  <li>\n    {b}\n  </li>\n</ul>', format='html', options={'prettiify': 'true'}, request={'selector': 'main'}),
        Case('kept_attributes', '<main><p data-bed="{n}" lang="en" style="x">{a}</p></main>', '<p data-bed="{n}" lang="en">{a}</p>', format='html', options={'keep_data_attributes': 'true', 'keep_attrs': 'lang'}, request={'selector': 'main'}),
    ),
    "render_escapes": (
        Case('unicode_folded', '<main><p>{a} – “{b}” costs 5 € … ©</p></main>', '{a} - "{b}" costs 5 € … (C)', options={'unicode_snob': 'false'}),
        Case('escaped_more', '<main><p>{a} *b* _c_ [d] #e</p></main>', '{a} \\*b\\* \\_c\\_ \\[d\\] \\#e', options={'escape_snob': 'true'}),
        Case('escape_off', '<main><p>{n}. {a}</p><p>- {b}</p><p>+ c\\*</p></main>', '{n}. {a}\n\n- {b}\n\n+ c\\*', options={'escape_dot': 'false', 'escape_dash': 'false', 'escape_plus': 'false', 'escape_backslash': 'false'}),
    ),
}


def _filled(text: str) -> F.Column:
    out = F.lit(text)
    for mark, column in (("{a}", F.col("a")), ("{b}", F.col("b")), ("{n}", F.col("n"))):
        if mark in text:
            out = F.replace(out, F.lit(mark), column)
    return out


def words(spark: SparkSession, folder: str) -> DataFrame:
    """Two words and a number of each artifact, from its address."""
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract("url", "/([a-z]+)-([a-z]+)-", i), F.lit("")), F.lit("none"))
    return spark.read.parquet(f"{folder}/source_artifacts.parquet").select("artifact_id", part(1).alias("a"), part(2).alias("b"), F.col("artifact_id").cast("string").alias("n"))


def query(group: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        rows, out = words(spark, folder), None
        for case in GROUPS[group]:
            page = rows.select("artifact_id", F.lit(case.name).alias("case"), F.lit(BASE).alias("url"), _filled(case.html).alias("html"))
            got = pages.get(page, case.build(), keep=("artifact_id", "case")).select("artifact_id", "case", "content")
            out = got if out is None else out.unionByName(got)
        return out

    return run


QUERIES = {group: query(group) for group in GROUPS}


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_WORDS = "SELECT artifact_id, coalesce(nullif(regexp_extract(url, '/([a-z]+)-([a-z]+)-', 1), ''), 'none') AS a, coalesce(nullif(regexp_extract(url, '/([a-z]+)-([a-z]+)-', 2), ''), 'none') AS b, CAST(artifact_id AS VARCHAR) AS n FROM source_artifacts"
ORACLES = {
    group: f"WITH w AS ({_WORDS}), texts(\"case\", expected) AS (VALUES {', '.join(f'({_sql(c.name)}, {_sql(c.expected)})' for c in cases)}) SELECT artifact_id, \"case\", replace(replace(replace(expected, '{{a}}', a), '{{b}}', b), '{{n}}', n) AS content FROM w, texts"
    for group, cases in GROUPS.items()
}
