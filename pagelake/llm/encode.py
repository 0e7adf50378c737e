"""Encoding of a corpus with a public byte-level BPE vocabulary (problem 6).

The vocabulary file is read once on the driver; its merge table (a fixed number of
entries) travels to the tasks as three numpy arrays.  A task cuts its texts into
pre-tokens, keeps the ids of words seen before in a bounded cache and encodes the
new ones together: the symbols of all new words lie in one flat array, and each
round looks up the pairs of neighbours by binary search over the sorted pair keys
and merges, in each word, every occurrence of its lowest-ranked pair.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ..session import spread
from .common import arrow_map, list_array, need

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"

#: Fixed value: the published pre-token pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_SHIFT = np.int64(20)
_NONE = np.int64(1 << 40)


class MergeTable:
    """Sorted pair keys with the rank and id of each merge, and the ids of the 256 bytes."""

    def __init__(self, byte_ids: np.ndarray, keys: np.ndarray, ranks: np.ndarray, merged: np.ndarray):
        self.byte_ids, self.keys, self.ranks, self.merged = byte_ids, keys, ranks, merged

    @classmethod
    def load(cls, path: str = DEFAULT_VOCABULARY) -> MergeTable:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        rest = [b for b in range(256) if b not in set(shown)]
        letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
        byte_ids = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = (left << _SHIFT) | right
        order = np.argsort(keys)
        return cls(byte_ids, keys[order], order.astype(np.int64), merged[order])

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of ``words``; offsets has one entry more than there are words."""
        lengths = np.array([len(w) for w in words], np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8)
        sym = self.byte_ids[flat]
        word = np.repeat(np.arange(len(words), dtype=np.int64), lengths)
        done_sym, done_word = [], []
        top = len(self.keys) - 1
        while len(sym):
            same = word[:-1] == word[1:]
            key = (sym[:-1] << _SHIFT) | sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), top) if top >= 0 else np.zeros(len(key), np.int64)
            hit = same & (self.keys[at] == key) if top >= 0 else np.zeros(len(key), bool)
            rank = np.full(len(sym), _NONE)
            rank[:-1][hit] = self.ranks[at[hit]]
            starts = np.flatnonzero(np.concatenate(([True], ~same)))
            best = np.minimum.reduceat(rank, starts)
            size = np.diff(np.append(starts, len(sym)))
            live = np.repeat(best < _NONE, size)
            if not live.all():
                done_sym.append(sym[~live])
                done_word.append(word[~live])
            pick = live & (rank == np.repeat(best, size)) & (rank < _NONE)
            chosen = np.flatnonzero(pick)
            if not len(chosen):
                break
            # in a run of overlapping places (a a a) every second one merges, from the left
            new_run = np.concatenate(([True], np.diff(chosen) > 1))
            first = np.maximum.accumulate(np.where(new_run, np.arange(len(chosen)), 0))
            chosen = chosen[(np.arange(len(chosen)) - first) % 2 == 0]
            sym = sym.copy()
            sym[chosen] = self.merged[at[chosen]]
            keep = live
            keep[chosen + 1] = False
            sym, word = sym[keep], word[keep]
        if not done_sym:
            return np.zeros(0, np.int32), np.zeros(len(words) + 1, np.int64)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        counts = np.bincount(word, minlength=len(words))
        return sym[order].astype(np.int32), np.concatenate(([0], np.cumsum(counts)))


class Encoder:
    """Encodes batches of texts; what it remembers of pre-tokens is let go beyond ``cache_words`` of them or ``cache_chars`` characters."""

    def __init__(self, table: MergeTable, cache_words: int = 300_000, cache_chars: int = 16_000_000):
        self.table, self.cache_words, self.cache_chars = table, cache_words, cache_chars
        self.find = regex.compile(PATTERN).findall
        self._reset()

    def _reset(self) -> None:
        self.known: dict[str, int] = {}
        self.chars = 0
        self.ids, self.offsets = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of ``texts``; null and empty texts have no ids."""
        if len(self.known) > self.cache_words or self.chars > self.cache_chars:
            self._reset()
        known, fresh, counts, seq = self.known, [], np.zeros(len(texts), np.int64), []
        for i, text in enumerate(texts):
            if not text:
                continue
            words = self.find(text)
            counts[i] = len(words)
            try:
                seq.append([known[w] for w in words])
            except KeyError:
                for w in words:
                    if w not in known:
                        known[w] = len(known)
                        fresh.append(w)
                seq.append([known[w] for w in words])
        if fresh:
            self.chars += sum(map(len, fresh))
            ids, offsets = self.table.encode_words([w.encode("utf-8", "surrogatepass") for w in fresh])
            self.ids = np.concatenate((self.ids, ids))
            self.offsets = np.concatenate((self.offsets, self.offsets[-1] + offsets[1:]))
        flat = np.concatenate([np.array(s, np.int64) for s in seq]) if seq else np.zeros(0, np.int64)
        size = self.offsets[flat + 1] - self.offsets[flat]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        source = np.repeat(self.offsets[flat] - (ends - size), size) + np.arange(total)
        per_word = np.concatenate(([0], ends))
        return self.ids[source], per_word[np.concatenate(([0], np.cumsum(counts)))]


def encode_corpus(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids ARRAY<INT>)`` of every row; no special tokens, their strings are ordinary text.

    Null and empty texts have an empty list; a repeated row is encoded again; columns
    besides the two named are ignored; an empty table gives an empty result.
    """
    table = MergeTable.load(vocabulary)
    bound: dict[str, Encoder] = {}

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = bound.get("e") or bound.setdefault("e", Encoder(table))
        ids, offsets = encoder.batch(batch.column(1).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), list_array(offsets, pa.array(ids, pa.int32()))], ["doc_id", "ids"])

    kind = dict(docs.dtypes)[id_col]
    return arrow_map(spread(need(docs, id_col, text_col)), one, f"doc_id {kind}, ids array<int>", text=text_col)
