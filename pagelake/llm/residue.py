"""Template residue and error-page text (problem 2).

Records of one template are aligned by what they share, and the places where they differ
are its slots.  Two units are aligned:

* Lines.  The form of a line is the line with its numbers, codes and paths masked; a form
  in many pages of several sites, with different texts around it, is a line of a template.
  The words of a page outside such lines are its own.  A page with hardly any own words is
  bare, and a template line that stands mostly in bare pages is the line of a whole-page
  template: an error, a demand for scripts, filler.  Menus and notices stand beside bodies
  nearly always, so they never qualify.  The masked path of ``final_url`` counts as one
  more line of the page, so that addresses such as ``/error?code=0`` are found alike.
* Words.  The words around a filler are a frame; the frame is a slot if other records fill
  it with other words.  A filler is also a slot's if its name is one that slots of other
  records use.  Fillers are written as variables (``{{name}}``), as defaults that a
  template puts in (``undefined``, ``NaN``) or left blank (empty brackets and quotes).

A third alignment is for the default text of text slots: the words of lines that open with
"lorem ipsum" are collected over all pages, those common to such lines are the vocabulary
of default text, and a page is filler if most of its running text consists of such words.

Fixed lists of messages and of the usual filler, and the syntax of template languages, give
the same answer where a collection is too small for repetition.  They hold at every size;
``reason`` tells which rows have no other ground than a list.

Code (fenced, indented, in backticks or code elements) is left out before all of this.
"""

from __future__ import annotations

import html
import json
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, spread
from .common import WORD, arrow_map, mix64, need, site_of

CODE = ""  # stands for code that was taken out
_FENCE = re.compile(r"^(```|~~~).*?(?:^\1[^\n]*$|\Z)", re.M | re.S)
_CODE_ELEMENT = re.compile(r"<(pre|code|script|style|textarea|kbd|samp)\b[^<>]*>.*?(?:</\1\s*>|\Z)", re.I | re.S)
_INLINE = re.compile(r"(`+)(?!`)[^\n]*?(?<!`)\1(?!`)")
_INDENTED = re.compile(r"^(?: {4}|\t)[^\n]*$", re.M)
_TARGET = re.compile(r"\]\([^()\s]*\)")
_ELEMENT = re.compile(r"<!--(?:(?!<!--).)*?-->|</?(?:html|head|body|title|meta|link|div|span|p|br|hr|h[1-6]|ul|ol|li|dl|dt|dd|a|b|i|u|em|strong|small|table|thead|tbody|tfoot|tr|td|th|caption|nav|header|footer|aside|main|section|article|figure|figcaption|img|blockquote|form|input|button|label|select|option|noscript|iframe|svg|sup|sub|q|cite|del|ins|details|summary)\b[^<>]*>", re.I)
_BREAK = re.compile(r"</?(?:div|p|br|hr|h[1-6]|ul|ol|li|dl|dt|dd|table|tr|nav|header|footer|aside|main|section|article|blockquote|form|noscript|title)\b", re.I)
_WRAP = re.compile(r"(?<=[^\n])\n(?=[^\n])")
#: How template languages write a variable.
_NAME = r"[A-Za-z_][\w.\- ]{0,40}?"
STRONG = re.compile(
    "|".join(
        (
            rf"\{{\{{\{{?\s*[#/^&>]?\s*{_NAME}(?:\s*\|[^{{}}\n]*)?\s*\}}\}}",
            r"\{%-?\s*\w+[^%\n]{0,60}%\}",
            r"<%[=\-]?\s*[^%\n]{1,60}%>",
            r"\$\{[A-Za-z_][\w.]*\}",
            r"#\{[A-Za-z_][\w.]*\}",
            r"@@[A-Za-z]\w*@@",
            r"%%[A-Za-z]\w*%%",
            r"\*\|[A-Za-z]\w*\|\*",
            r"\[(?:your|insert|enter|add)\s+[\w ]{1,40}\]",
            r"<(?:your|insert|enter|add)\s+[\w ]{1,40}>",
            r"\b[A-Za-z_]+_GOES_HERE\b",
            r"\[object Object\]",
            r"\bXX/XX/XXXX\b",
            r"\bTK TK\b",
            r"%s %d|%\(\w+\)s",
            r"\{\d{1,2}\}",
            r"\bnull null\b",
        )
    ),
    re.I,
)
#: Fillers that ordinary text can hold as well; they need a frame.
WEAK = re.compile(
    r"(?<![\w{$#])\{[A-Za-z_][\w.]*\}(?![\w}])|\[\[\s*[A-Za-z_][\w.]*\s*\]\]|\(\(\s*[A-Za-z_][\w.]*\s*\)\)|(?<![\w%])%[A-Za-z_]+%(?![\w%])|(?<![\w_])__[A-Za-z][A-Za-z]*(?:_[A-Za-z]+)*__(?![\w_])|(?<![\w$])\$[A-Za-z_]+\$(?![\w$])"
    r"|\bundefined\b|\bNaN\b|\bnull(?: null)?\b|\bNULL\b|\bInvalid Date\b|#(?:REF|N/A|VALUE|NAME\?)!?|\bTODO:? (?:title|text|name|content)\b"
    r"|(?<=\s)(?:\(\s?\)|\"\"|“”|«»)(?=[\s.,;:!?])"
)
#: Messages that stand in place of a page, in several languages: titles, which fill a line, and sentences.
_TITLES = (
    r"(?:page|file|site|document) not found|not found|forbidden|access denied|unauthorized|bad request|bad gateway|gateway time-?out|request time-?out|service unavailable|internal server error|too many requests|proxy error|session (?:has )?expired|javascript is disabled|loading\.\.\."
    r"|seite nicht gefunden|ein fehler ist aufgetreten|zugriff verweigert|page introuvable|erreur du serveur|accès (?:refusé|interdit)|página no encontrada|servicio no disponible|acceso denegado|pagina non trovata|página não encontrada|strona nie została znaleziona|страница не найдена|сторінку не знайдено|ページが見つかりません|sidan hittades inte|pagina niet gevonden"
)
_SENTENCES = (
    r"you do not have permission to (?:view|access)|request was blocked by|page you (?:asked|are looking|requested)\b.{0,20}(?:moved|never existed|not exist|for)|requested (?:url|page|address)\b.{0,80}(?:not found|not exist)|seem to find what you are looking for|may have been removed or renamed|nothing lives at this address|please sign in again|domain is not configured|connection was interrupted|network change was detected"
    r"|(?:down|closed) for (?:planned |scheduled )?maintenance|please slow down and try again|upstream closed the connection|error establishing a database connection|did not respond within|went wrong on our side|isn'?t working right now|if the problem continues, contact|could not load this content|uncaught exception|fatal error:"
    r"|gewünschte seite existiert|versuchen sie es später|wartungsarbeiten|page demandée n'existe|merci de réessayer|dirección pedida ya no existe|trabajando para volver"
    r"|(?:javascript|js|scripting|scripts?)\b.{0,12} (?:is|are|has to be|have to be|must be)\b.{0,30}(?:disabled|required|switched|turned)|muss javascript|without js enabled|some parts of this site cannot be shown without|works? only with\b.{0,20}scripts|scripts and cookies have to be|requires javascript|while we check your browser|javascript to run this app|allow scripts for this site|enable (?:java)?scripts? in your browser"
    r"|aktivieren sie javascript|activer javascript|besoin de scripts pour s'afficher|active javascript en su navegador|does not support scripting"
)
MESSAGES = re.compile(rf"^(?:error )?(?:4\d\d|5\d\d)?[ \-:–]*(?:{_TITLES})[.!]?$|^stack trace:$|^#?\d* ?\{{main\}}$|{_SENTENCES}")
#: The same in the values of a JSON record, where title and sentence follow each other.
_JSON_MESSAGES = re.compile(rf"^(?:error )?(?:4\d\d|5\d\d)?[ \-:–]*(?:{_TITLES})(?:$|[.!,;: ])|{_SENTENCES}")
#: Filler that designers put where text will be, matched against whole short lines.
FILLER = re.compile(
    r"^(?:your (?:headline|title|text|name) here|coming soon|tbd|sample (?:heading|subheading|title|text)|sample body text\b.*|asdf[ asdfjklm]*|x{3,}(?: x{2,})+|test test \d+|dummy (?:paragraph|text)\b.*|placeholder (?:copy|text)\b.*|content to be supplied\b.*|text goes here\b.*|add a short description of your service\b.*|this is an example page created by\b.*|hier steht später ihr text\b.*|votre texte ici\b.*|texto de ejemplo\b.*|su texto aquí\b.*)$"
)
#: The stems of the usual pseudo-Latin filler.
LOREM = frozenset("lorem ipsum dolor sit amet conse adipi elit sed eius eiusm tempo incid labor magna aliqu enim minim veniam venia veni quis nostr exerc ullam ullamc nisi commo conseq duis dui aute irure repre repreh volup velit esse cillu fugia fugi nulla paria excep sint occae cupid non proid sunt culpa qui offic deser mollit molli anim est sinta suntia ipsu".split())
#: A page with that many own words has a body of its own; one under ``BARE_WORDS`` is bare.
BODY_WORDS, BARE_WORDS = 150, 12
#: Lines of more words are running text.
LINE_WORDS = 40


def running_text(content: str, kind: str | None) -> str:
    """The visible text without code; one line per paragraph, heading, item or table row."""
    if kind == "json":
        try:
            return "\n".join(_strings(json.loads(content)))
        except (ValueError, RecursionError):
            pass
    text = content.replace("\r\n", "\n")
    if "<" in text and ("<pre" in text or "<code" in text or "<script" in text or "<style" in text or kind == "html"):
        text = _CODE_ELEMENT.sub(CODE, text)
    if "```" in text or "~~~" in text:
        text = _FENCE.sub(CODE, text)
    if kind == "html":
        text = html.unescape(_ELEMENT.sub(" ", _BREAK.sub(lambda m: "\n" + m.group(), text)))
    else:
        text = _INDENTED.sub(CODE, text)
        if "<" in text:
            text = _ELEMENT.sub(" ", text)
    if "`" in text:
        text = _INLINE.sub(CODE, text)
    return _TARGET.sub("]", text)


def _strings(value: object) -> list[str]:
    if isinstance(value, str):
        return [value]
    if isinstance(value, dict):
        return [s for v in value.values() for s in _strings(v)]
    if isinstance(value, list):
        return [s for v in value for s in _strings(v)]
    return []


_DIGITS = re.compile(r"\d+")
_CODE_WORD = re.compile(r"[0-9a-f]*\d[0-9a-f]*")


def _masked(word: str) -> str:
    if "/" in word or "_" in word or word.count("-") > 1 or len(word) > 40:
        return "0"
    return _CODE_WORD.sub("0", word)


def _slots(words: list[str]) -> str:
    """The line of ``words`` with its slots masked: numbers, hexadecimal codes, paths, names of several parts, very long words."""
    return " ".join([w if w.isalpha() and len(w) < 40 else _masked(w) for w in words])


_STEMS = frozenset(w[:3] for w in LOREM)
_MARKS = ("{", "%", "$", "@@", "*|", "_GOES_HERE", "_goes_here", "XX/XX/", "xx/xx/", "TK TK", "tk tk", "[object", "null null", "NULL NULL")
_ASKS = re.compile(r"[\[<](?:your|insert|enter|add)\s", re.I)
_WEAK_MARKS = ("{", "%", "$", "[[", "((", "__", "undefined", "NaN", "null", "NULL", "Invalid Date", "#REF", "#N/A", "#VALUE", "#NAME", "TODO", "()", "( )", '""', "“”", "«»")


def _is_lorem(line: str) -> bool:
    head = line.split(" ", 5)
    if len(head) < 6 or sum(w[:3] in _STEMS for w in head[:5]) < 2:
        return False
    words = WORD.findall(line)
    return sum(any(w[:k] in LOREM for k in (3, 4, 5)) for w in words) >= 0.7 * len(words)


_WORDS_ABOUT = frozenset("your insert enter add here goes page block object null".split())


def _variable(filler: str) -> str:
    """The variable's own name in a filler: the last part of its last word; '' if there is none."""
    words = [w for w in re.findall(r"[a-z][a-z0-9]*(?:_[a-z0-9]+)*", filler.lower().replace("_goes_here", "")) if w not in _WORDS_ABOUT]
    return words[-1] if words else ""


class Found(NamedTuple):
    """What one page shows by itself."""

    sign: str | None  #: what a list or the syntax of a template language says: ``slot``, ``message`` or ``filler``
    frames: list[int]  #: the frames of its fillers
    names: set[str]  #: the names of variables in them
    forms: list[tuple[str, int]]  #: (form, words) of each line
    stems: set[str]  #: stems of the words on lines that open with "lorem ipsum"


def _around(text: str, start: int, end: int) -> list[int]:
    left = WORD.findall(text[max(0, start - 80) : start].rpartition("\n")[2].lower())
    right = WORD.findall(text[end : end + 80].partition("\n")[0].lower())
    return _frames(left, right)


def inspect(content: str, kind: str | None) -> Found:
    text = running_text(content, kind)
    sign, frames, names, stems = None, [], set(), set()
    if any(m in text for m in _MARKS) or _ASKS.search(text):
        joined = _WRAP.sub(" ", text)
        for m in [*STRONG.finditer(joined)] or [*STRONG.finditer(text)]:
            sign = "slot"
            frames.extend(_around(m.string, m.start(), m.end()))
            names.add(_variable(m.group()))
    if not sign and kind != "json" and any(m in text for m in _WEAK_MARKS):
        joined = _WRAP.sub(" ", text)
        for m in WEAK.finditer(joined):
            frames.extend(_around(joined, m.start(), m.end()))
            if not m.group()[0].isalnum():
                names.add(_variable(m.group()))
    forms, short, filler_words, running, body = [], [], 0, 0, 0
    for line in text.lower().split("\n"):
        words = line.split()
        n = len(words)
        if n > LINE_WORDS:
            forms.append(("", n))
            low = line.lstrip()
        elif n:
            low = " ".join(words).lstrip("#*->•·| ")
            forms.append((_slots(low.split(" ")), n))
            if n <= 20:
                short.append(low)
        else:
            continue
        if n > 5:
            running += n
            body += n if n > 12 else 0
            if _is_lorem(low):
                filler_words += n
            if low.startswith("lorem ipsum"):
                stems.update(w[:STEM] for w in WORD.findall(low))
    # the list is looked up where there is hardly any running text; templates are found at any length
    if not sign and body < BODY_WORDS:
        if kind == "json":
            sign = "message" if any(map(_JSON_MESSAGES.search, text.lower().split("\n"))) else None
        elif any(CODE not in x and (MESSAGES.search(x) or FILLER.match(x)) for x in short):
            sign = "message"
    if sign != "slot" and filler_words >= 12 and filler_words * 2 >= running:
        sign = "filler"
    return Found(sign, frames, names - {""}, forms, stems)


#: So many letters of a word make its stem.
STEM = 4


def _is_default_text(content: str, kind: str | None, stems: frozenset[str]) -> bool:
    """Whether most of the running text stands on lines whose words nearly all begin like filler."""
    filler = running = 0
    for line in running_text(content, kind).split("\n"):
        words = WORD.findall(line.lower())
        if len(words) > 5:
            running += len(words)
            if sum(w[:STEM] in stems for w in words) >= 0.7 * len(words):
                filler += len(words)
    return filler >= 12 and filler * 2 >= running


#: Which of three words is the filler: the middle one, the first, the last.
_SHAPES = ((1, 0, 2), (0, 1, 2), (2, 0, 1))


_FACTORS = tuple((np.uint64(2 * a + 1), np.uint64(2 * b + 1)) for a, b in np.random.default_rng(3).integers(0, 2**62, (3, 2)).tolist())


def _frame_keys(h: np.ndarray, shape: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(frame, filler) of each three consecutive word hashes; the hashes are evenly spread, so a sum of multiples is too."""
    part = [h[k : len(h) - 2 + k] for k in range(3)]
    filler, a, b = shape
    first, second = _FACTORS[filler]
    return part[a] * first + part[b] * second, part[filler]


def _word_hash(word: str) -> int:
    """64 bits, the lowest of them 0."""
    return xxhash.xxh64_intdigest(word) & ~1


def _frames(left: list[str], right: list[str]) -> list[int]:
    """The frames of a filler between these words of its line."""
    out = []
    for shape, words in zip(_SHAPES, (left[-1:] + [""] + right[:1], [""] + right[:2], left[-2:] + [""])):
        if len(words) == 3:
            out.append(int(_frame_keys(np.array([_word_hash(w) for w in words], np.uint64), shape)[0][0]))
    return out


_ADDRESS = re.compile(r"^\s*[a-z][a-z0-9+.\-]*://[^/?#]*/?([^#]+)", re.I)


def _address_form(final_url: str | None) -> str | None:
    """The masked path and query of an address; None for a site's root and a missing address."""
    m = _ADDRESS.match(final_url or "")
    return "\0" + _DIGITS.sub("0", m.group(1).lower()) if m else None


def _row_forms(forms: list[tuple[str, int]], kind: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, words, keys of two lines together) of the lines; 0 for a line too long to be a template's.

    Two lines together matter in plain text only, where a sentence may be wrapped.
    """
    hashed = xxhash.xxh64_intdigest
    keys = [hashed(x) if n <= LINE_WORDS else 0 for x, n in forms]
    pairs = [0] * len(keys)
    if kind in ("text", None):
        for i in range(len(keys) - 1):
            if keys[i] and keys[i + 1] and len(forms[i][0]) >= 30:
                pairs[i] = hashed(f"{forms[i][0]} {forms[i + 1][0]}")
    return np.array(keys, np.uint64), np.array([min(n, 65535) for _, n in forms], np.uint16), np.array(pairs, np.uint64)


def _covered(known: np.ndarray, known_pairs: np.ndarray) -> np.ndarray:
    """The lines that are known by themselves or as one of two."""
    covered = known | known_pairs
    covered[1:] |= known_pairs[:-1]
    return covered


def _own_words(known: np.ndarray, known_pairs: np.ndarray, words: np.ndarray) -> int:
    return int(words[~_covered(known, known_pairs)].sum(dtype=np.int64))


def _held(spark, keys: DataFrame, limit: int):
    """The keys of a one-column table as a broadcast sorted array, or None if there are more than ``limit``."""
    size = keys.count()
    if size > limit:
        return None
    return spark.sparkContext.broadcast(np.sort(np.fromiter((r[0] for r in keys.collect()), np.int64, size).view(np.uint64)))


def _among(keys: np.ndarray, held: np.ndarray) -> np.ndarray:
    if not len(held):
        return np.zeros(len(keys), bool)
    return held[np.minimum(np.searchsorted(held, keys), len(held) - 1)] == keys


def _least_and_most(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each key once, with the least and the greatest of its values; the two differ if and only if there are several."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return (keys[at], np.minimum.reduceat(values, at), np.maximum.reduceat(values, at)) if len(keys) else (keys, values, values)


_last: list[np.ndarray | None] = [None, None]


def _perhaps(keys: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Whether the upper 22 bits of each key occur in ``held``; the table is made once for each broadcast and process."""
    if _last[0] is not held:
        table = np.zeros(1 << 22, bool)
        table[(held >> np.uint64(42)).astype(np.int64)] = True
        _last[:] = [held, table]
    return _last[1][(keys >> np.uint64(42)).view(np.int64)]


def page_templates(table: DataFrame, min_pages: int, min_sites: int, min_bare: float, broadcast_keys: int) -> DataFrame:
    """``page_id`` of the pages that carry a line of a whole-page template and have no body of their own.

    ``table`` has page_id, site, body, address, lines, words and pairs: packed keys.
    """
    spark = table.sparkSession
    kind = dict(table.dtypes)["page_id"]
    packed = ["page_id", "body", "site", "address", "lines", "words", "pairs"]
    table = table.select(*packed)

    def read(batch: pa.RecordBatch):
        for page, body, site, address, lines, words, pairs in zip(*(batch.column(i).to_pylist() for i in range(7))):
            yield page, body, site, np.uint64(address & 0xFFFFFFFFFFFFFFFF), np.frombuffer(lines, np.uint64), np.frombuffer(words, np.uint16), np.frombuffer(pairs, np.uint64)

    def once(address: np.uint64, lines: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        got = np.unique(np.concatenate((lines, pairs, [address])))
        return got[1:] if len(got) and not got[0] else got

    def sums(keys: list[np.ndarray], *values: list) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
        """Keys of a batch in order, the values beside them, the starts of their runs and the runs' lengths."""
        key = np.concatenate(keys)
        sizes = [len(k) for k in keys]
        order = np.argsort(key, kind="stable")
        key = key[order]
        at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        return key[at], [np.repeat(np.array(v, np.int64), sizes)[order] for v in values], at, np.diff(np.append(at, len(key)))

    def count(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        keys, sites, bodies = [], [], []
        for _, body, site, address, lines, _, pairs in read(batch):
            keys.append(once(address, lines, pairs))
            sites.append(1 << (site % 63))
            bodies.append(1 << (body % 63))
        if not any(map(len, keys)):
            return None
        key, (s, b), at, n = sums(keys, sites, bodies)
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n), pa.array(np.bitwise_or.reduceat(s, at)), pa.array(np.bitwise_or.reduceat(b, at))], ["key", "n", "sites", "bodies"])

    counts = arrow_map(table, count, "key bigint, n bigint, sites bigint, bodies bigint").groupBy("key").agg(F.sum("n").alias("n"), F.expr("bit_count(bit_or(sites))").alias("sites"), F.expr("bit_count(bit_or(bodies))").alias("bodies"))
    repeated = cut_lineage(counts.where((F.col("n") >= min_pages) & (F.col("bodies") >= min_sites)).select("key", "n", "sites"))
    whole = (F.col("sites") >= min_sites) & (F.col("bare") >= F.col("n") * min_bare)
    held = _held(spark, repeated.select("key"), broadcast_keys)

    if held is not None:

        def bare(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            keys = []
            for _, _, _, address, lines, words, pairs in read(batch):
                if _own_words(_among(lines, held.value), _among(pairs, held.value), words) < BARE_WORDS:
                    got = once(address, lines, pairs)
                    keys.append(got[_among(got, held.value)])
            if not any(map(len, keys)):
                return None
            key, _, _, n = sums(keys)
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["key", "bare"])

        found = arrow_map(table, bare, "key bigint, bare bigint").groupBy("key").agg(F.sum("bare").alias("bare"))
        templates = found.join(repeated, "key").where(whole).select("key")
        final = _held(spark, templates, broadcast_keys)

        def decide(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for i, (_, _, _, address, lines, words, pairs) in enumerate(read(batch)):
                own = _own_words(_among(lines, held.value), _among(pairs, held.value), words)
                if own >= BODY_WORDS:
                    continue
                # versions of one text repeat each other's lines, but these make a body
                hit = _covered(_among(lines, final.value), _among(pairs, final.value))
                if hit.any() and own + int(words[hit].sum(dtype=np.int64)) < BODY_WORDS or own < BARE_WORDS and not hit.any() and _among(np.array([address]), final.value)[0]:
                    out.append(i)
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(out, pa.int64()))], ["page_id"])

        return arrow_map(table, decide, f"page_id {kind}")

    # More repeated forms than may be broadcast: every line's keys are joined with them.
    def unpack(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        at, no, count_, key = [], [], [], []
        for i, (_, _, _, address, lines, words, pairs) in enumerate(read(batch)):
            n = len(lines)
            at.append(np.full(3 * n + 1 - (n > 0), i))
            no.append(np.concatenate((np.arange(n), np.arange(n), np.arange(1, n), [-1])))
            count_.append(np.concatenate((words, words, words[1:], [0])))
            key.append(np.concatenate((lines, pairs, pairs[:-1], np.array([address], np.uint64))))
        if not at:
            return None
        at = pa.array(np.concatenate(at))
        return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(np.concatenate(no).astype(np.int64)), pa.array(np.concatenate(count_).astype(np.int64)), pa.array(np.concatenate(key).view(np.int64))], ["page_id", "body", "line", "words", "key"])

    lines = arrow_map(table, unpack, f"page_id {kind}, body bigint, line bigint, words bigint, key bigint")
    marked = lines.join(repeated.select("key", F.lit(True).alias("known")), "key", "left")
    by_line = marked.groupBy("page_id", "body", "line").agg(F.max("words").alias("words"), F.max("known").alias("known"))
    own = cut_lineage(by_line.groupBy("page_id", "body").agg(F.sum(F.when(F.col("known"), 0).otherwise(F.col("words"))).alias("own")))
    edges = lines.where("key <> 0").join(own, ["page_id", "body"]).where(F.col("own") < BODY_WORDS)
    bares = edges.where(F.col("own") < BARE_WORDS).select("page_id", "body", "key").distinct().groupBy("key").agg(F.count("*").alias("bare"))
    templates = bares.join(repeated, "key").where(whole).select("key")
    hits = edges.join(templates, "key", "left_semi").groupBy("page_id", "body", "own", "line").agg(F.max("words").alias("words"))
    per_page = hits.groupBy("page_id", "body", "own").agg(F.sum("words").alias("words"), F.max("line").alias("line"))
    return per_page.where((F.col("own") + F.col("words") < BODY_WORDS) & ((F.col("line") >= 0) | (F.col("own") < BARE_WORDS))).select("page_id")


def residue_pages(pages: DataFrame, min_pages: int = 6, min_sites: int = 3, min_bare: float = 0.4, broadcast_keys: int = 1_000_000) -> DataFrame:
    """``(page_id, reason)``: pages that hold an error message, filler, or an unfilled template.

    ``reason``: ``slot`` (a filler in a slot that other records prove), ``template`` (a
    line of a whole-page template), ``default`` (default text in place of the body); for
    pages with no other ground than a list ``syntax`` (a variable of a template language),
    ``message`` and ``filler``.  Null and empty contents are no cases; broken JSON is read
    as text; a page repeated under one id comes out once; further columns are ignored; an
    empty table gives no rows.
    """
    spark = pages.sparkSession
    base = need(pages, "page_id", "content_format", "content", "final_url", "url").where("length(content) > 0")
    base = spread(base.select("page_id", "content_format", "content", site_of(F.col("final_url"), F.col("url")).alias("site"), "final_url"))
    kind = dict(base.dtypes)["page_id"]
    schema = f"page_id {kind}, sign string, body bigint, site bigint, address bigint, lines binary, words binary, pairs binary, frames array<bigint>, names array<string>, stems array<string>"

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for fmt, content, site, final_url in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
            got = inspect(content, fmt)
            lines, words, pairs = _row_forms(got.forms, fmt)
            address = _address_form(final_url)
            frames = np.unique(np.array(got.frames, np.uint64)).view(np.int64).tolist()
            rows.append((got.sign, xxhash.xxh32_intdigest(content), xxhash.xxh32_intdigest(site), np.uint64(xxhash.xxh64_intdigest(address) if address else 0).view(np.int64), lines.tobytes(), words.tobytes(), pairs.tobytes(), frames, sorted(got.names), sorted(got.stems)))
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string())]
        names = ["sign", "body", "site", "address", "lines", "words", "pairs", "frames", "names", "stems"]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], ["page_id", *names])

    seen = cut_lineage(arrow_map(base, one, schema, text="content"))
    repeated = page_templates(seen, min_pages, min_sites, min_bare, broadcast_keys).select("page_id", F.lit("template").alias("reason"))

    # Stems of default text: in at least a twentieth of the pages that open with it, so at most 20 times as many as a page has.
    anchors = seen.where("size(stems) > 0")
    least = max(1, anchors.count() // 20)
    stems = frozenset(r[0] for r in anchors.select(F.explode("stems").alias("stem")).groupBy("stem").count().where(F.col("count") >= least).collect())

    # Frames of the fillers, looked up in all pages.
    edge = seen.where("size(frames) > 0").select("page_id", F.explode("frames").alias("key"))
    held = _held(spark, edge.select("key").distinct(), broadcast_keys)
    cache: dict[str, int] = {}

    def fillers(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        if held is not None and not len(held.value) and not stems:
            return None
        if len(cache) > 500_000:
            cache.clear()
        whole = []
        ids, formats, texts = (batch.column(i).to_pylist() for i in range(3))
        # the words of all pages in one array, two stops between them, so that no frame spans two pages
        use = [i for i, fmt in enumerate(formats) if fmt != "json"]
        flat, starts = [], []
        for i in use:
            starts.append(len(flat))
            flat += WORD.findall(texts[i].lower())
            flat += ("\0", "\0")
        for w in set(flat).difference(cache):
            cache[w] = _word_hash(w) | (w[:STEM] in stems)
        if not flat:
            return None
        h = np.array([cache[w] for w in flat], np.uint64)
        bit = h & np.uint64(1)
        for i, share, size in zip(use, np.add.reduceat(bit.astype(np.int64), starts).tolist(), np.diff([*starts, len(flat)]).tolist()):
            if share >= 12 and share * 4 >= size and _is_default_text(texts[i], formats[i], stems):
                whole.append(ids[i])
        h ^= bit
        inside = h != _word_hash("\0")
        inside = inside[:-2] & inside[1:-1] & inside[2:]
        keys, words = [], []
        for shape in _SHAPES if held is None or len(held.value) else ():
            key, filler = _frame_keys(h, shape)
            at = np.flatnonzero(inside & _perhaps(key, held.value) if held is not None else inside)
            if held is not None:
                at = at[_among(key[at], held.value)]
            keys.append(key[at])
            words.append(filler[at].view(np.int64))
        key, low, high = _least_and_most(np.concatenate(keys), np.concatenate(words)) if keys else (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 2
        none = pa.nulls(len(whole), pa.int64())
        pages_ = pa.array([None] * len(key) + whole, batch.schema.field(0).type)
        return pa.RecordBatch.from_arrays([pages_, *(pa.concat_arrays([pa.array(x), none]) for x in (key.view(np.int64), low, high))], ["page_id", "key", "low", "high"])

    scan = cut_lineage(arrow_map(base.drop("site", "final_url"), fillers, f"page_id {kind}, key bigint, low bigint, high bigint", text="content"))
    default = scan.where("page_id is not null").select("page_id", F.lit("default").alias("reason"))
    slots = scan.where("page_id is null").groupBy("key").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("key")
    open_slots = edge.join(slots, "key", "left_semi").select("page_id", F.lit("slot").alias("reason"))
    # A filler whose name variables of other pages have.
    named = seen.where("size(names) > 0").select("page_id", F.explode("names").alias("name"), F.expr("coalesce(sign = 'slot', false)").alias("certain"))
    shared = named.where("certain").groupBy("name").agg(F.count("*").alias("n")).where("n >= 2").select("name")
    by_name = named.join(shared, "name", "left_semi").select("page_id", F.lit("slot").alias("reason"))
    listed = seen.where("sign is not null").select("page_id", F.expr("if(sign = 'slot', 'syntax', sign)").alias("reason"))
    every = repeated.unionByName(default).unionByName(open_slots).unionByName(by_name).unionByName(listed)
    grounds = F.array_sort(F.collect_set("reason"))
    rank = "element_at(filter(array('slot', 'template', 'default', 'syntax', 'message', 'filler'), x -> array_contains(grounds, x)), 1)"
    return every.groupBy("page_id").agg(grounds.alias("grounds")).select("page_id", F.expr(rank).alias("reason"))
