"""Evaluation texts inside training text (problem 7).

One Aho-Corasick automaton holds the held-out items, normalised to lower-case words
with single spaces.  A run of ``n`` shared words contains a whole block of
``(n + 1) // 2`` words of the item's own grid, so the automaton needs only the grid's
blocks: one per ``(n + 1) // 2`` words instead of one per word.  A hit is extended word
by word to both sides and counts if the run has at least ``n`` words; the run's word
numbers lead back to places in the original text.

The automaton is built from the item table, whose size is checked against
``max_item_chars``; more items are handled in further passes of that size each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import cut_lineage, spread
from .common import WORD, arrow_map, need

#: Markup between words: tags, comments, character references, link targets.
MARKUP = re.compile(r"<!--(?:(?!<!--).)*?-->|</?[A-Za-z][^<>]*>|&(?:[A-Za-z]+|#\d+|#x[0-9A-Fa-f]+);|\]\([^()\s]*\)", re.S)


def blanked(text: str) -> str:
    """``text`` with markup replaced by as many spaces, so that places stay the same."""
    if "<" in text or "&" in text or "](" in text:
        return MARKUP.sub(lambda m: " " * len(m.group()), text)
    return text


def words_of(text: str) -> list[str]:
    return WORD.findall(blanked(text).lower())


class ItemIndex:
    """The automaton over the items' grid blocks, made on first use in each worker."""

    def __init__(self, items: list[tuple[int, str]], n: int):
        self.items, self.n, self.block = items, n, (n + 1) // 2
        self._made = None

    def __getstate__(self):
        return (self.items, self.n, self.block)

    def __setstate__(self, state):
        self.items, self.n, self.block = state
        self._made = None

    def _make(self):
        where: dict[str, list[tuple[int, int]]] = {}
        texts = []
        for number, (_, text) in enumerate(self.items):
            words = words_of(text)
            texts.append(words)
            if len(words) >= self.n:
                for at in range(0, len(words) - self.block + 1, self.block):
                    where.setdefault(f" {' '.join(words[at : at + self.block])} ", []).append((number, at))
        automaton = ahocorasick.Automaton()
        for key, places in where.items():
            automaton.add_word(key, (len(key), places))
        if where:
            automaton.make_automaton()
        return automaton if where else None, texts

    def scan(self, text: str) -> list[tuple[int, int, int]]:
        """(item number, first word, number of words) of the longest shared run with each item."""
        if self._made is None:
            self._made = self._make()
        automaton, texts = self._made
        if automaton is None:
            return []
        words = words_of(text)
        if len(words) < self.n:
            return []
        line = f" {' '.join(words)} "
        found: dict[int, tuple[int, int]] = {}
        for end, (size, places) in automaton.iter(line):
            at = line.count(" ", 0, end - size + 1)
            for number, start in places:
                if number in found and found[number][0] <= at < found[number][0] + found[number][1]:
                    continue
                item = texts[number]
                left = 0
                while at - left > 0 and start - left > 0 and words[at - left - 1] == item[start - left - 1]:
                    left += 1
                right = self.block
                while at + right < len(words) and start + right < len(item) and words[at + right] == item[start + right]:
                    right += 1
                if left + right >= self.n and left + right > found.get(number, (0, 0))[1]:
                    found[number] = (at - left, left + right)
        return [(number, at, size) for number, (at, size) in found.items()]


def _passes(items: DataFrame, id_col: str, text_col: str, max_item_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items in lists of at most ``max_item_chars`` characters, streamed to the driver one partition at a time."""
    part, size = [], 0
    for row in need(items, id_col, text_col).dropna().toLocalIterator():
        if part and size + len(row[1]) > max_item_chars:
            yield part
            part, size = [], 0
        part.append((row[0], row[1]))
        size += len(row[1])
    if part:
        yield part


def leaked_passages(docs: DataFrame, items: DataFrame, n: int = 13, max_item_chars: int = 16_000_000, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(doc_id, item_id, n_words, char_start, char_end)``: each document and item that share ``n`` consecutive words.

    The place is that of the longest shared run in the document's own text.  Null,
    empty and shorter texts share nothing; repeated rows give one result row each per
    distinct document row; without items the result is empty.
    """
    kinds = dict(docs.dtypes)[doc_id], dict(items.dtypes)[item_id]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, n_words int, char_start bigint, char_end bigint"
    narrow = spread(need(docs, doc_id, doc_text))
    spark = docs.sparkSession
    result = None
    passes = _passes(items, item_id, item_text, max_item_chars)
    part = next(passes, None)
    while part is not None:
        following = next(passes, None)
        held = spark.sparkContext.broadcast(ItemIndex(part, n))  # at most max_item_chars characters
        ids = [i for i, _ in part]

        def one(batch: pa.RecordBatch, held=held, ids=ids) -> pa.RecordBatch:
            index = held.value
            rows = ([], [], [], [], [])
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                hits = index.scan(text)
                if hits:
                    spans = _spans(text)
                    for number, at, size in hits:
                        for column, value in zip(rows, (doc, ids[number], size, spans[at][0], spans[at + size - 1][1])):
                            column.append(value)
            return pa.RecordBatch.from_arrays([pa.array(rows[0], batch.schema.field(0).type), pa.array(rows[1]), pa.array(rows[2], pa.int32()), pa.array(rows[3], pa.int64()), pa.array(rows[4], pa.int64())], ["doc_id", "item_id", "n_words", "char_start", "char_end"]) if rows[0] else None

        found = arrow_map(narrow, one, schema, text=doc_text)
        if following is not None or result is not None:  # of several passes each is done before the next, with one automaton held at a time
            found = cut_lineage(found)
            held.destroy()
        result = found if result is None else result.unionByName(found)
        part = following
    return (spark.createDataFrame([], schema) if result is None else result).dropDuplicates(["doc_id", "item_id"])


def _spans(text: str) -> list[tuple[int, int]]:
    """Start and end of each word in the original text, in the order of ``words_of``."""
    text = blanked(text)
    if len(text.lower()) == len(text):
        return [m.span() for m in WORD.finditer(text.lower())]
    back, low = [], []  # a few capitals become two characters in lower case
    for i, c in enumerate(text):
        c = c.lower()
        low.append(c)
        back.extend([i] * len(c))
    return [(back[m.start()], back[m.end() - 1] + 1) for m in WORD.finditer("".join(low))]
