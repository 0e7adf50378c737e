"""Languages of documents and paragraphs (problem 8): a linear-chain conditional random field.

Words are labelled by a CRF whose emissions sum hashed features (the word itself, its
affixes, its character trigrams, its script and length, and the language in whose lexicon
it stands) and whose transitions between languages are learned with them.  The lexicons
are the words that paragraphs of one language nearly alone use, taken from the cleaned sample.  Forward-backward gives each word a distribution over
the languages; a paragraph takes the language with the largest share of its letters,
a document that of most letters outside code.

The model is trained on the driver from a bounded sample of labelled rows
(``per_label`` rows a language).  Labels may be wrong and texts mixed, so the sample is
first cleaned: a word model is fitted to the labels, paragraphs are relabelled by it, and
both are repeated.  Chains of two paragraphs of different languages are added, so that
the transitions see code-switched text.  All rows are then labelled, whatever their
number, in batches of equal-length chains.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import spread
from .common import arrow_map, need

LANGUAGES = ("en", "de", "fr", "es", "pt", "it", "nl", "sv", "pl", "ru", "uk", "ja")
BUCKETS = 1 << 17
#: Letters; a run of kana and ideographs is cut every four characters, as it has no blanks.
_TOKEN = re.compile("[぀-ヿ㐀-鿿々]{1,4}|[^\\W\\d_぀-ヿ㐀-鿿]+")
_LETTER = re.compile(r"[^\W\d_]")
_NOISE = re.compile(r"`[^`\n]*`|https?://\S+|\]\([^()\s]*\)|</?[A-Za-z][^<>]*>|&[A-Za-z]+;")
_CHAIN = 256


def label_of(lang: Column) -> Column:
    """The first two letters of a label after trimming, in lower case; null if they are none of the languages."""
    short = F.lower(F.substring(F.trim(F.regexp_replace(lang, r"^\s+|\s+$", "")), 1, 2))
    return F.when(short.isin(*LANGUAGES), short)


def paragraphs(text: str) -> list[tuple[int, str]]:
    """(number, text outside code) of the runs of non-blank lines, numbered from 1; '' for code."""
    out, part, any_line, fence, number = [], [], False, "", 0
    for line in [*text.replace("\r\n", "\n").split("\n"), ""]:
        s = line.strip()
        if not s:
            if any_line:
                number += 1
                out.append((number, "\n".join(part)))
            part, any_line = [], False
            continue
        any_line = True
        if fence:
            if s.startswith(fence):
                fence = ""
        elif s.startswith("```"):
            fence = "```"
        elif not line.startswith("    "):
            part.append(line)
    return out


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(_NOISE.sub(" ", text) if "`" in text or "<" in text or "(" in text or "://" in text or "&" in text else text)


def _script(c: str) -> str:
    o = ord(c)
    return "l" if o < 0x250 else "c" if 0x400 <= o < 0x530 else "k" if 0x3040 <= o < 0x3100 else "h" if 0x3400 <= o < 0xA000 else "x"


def features(word: str, lexicon: dict[str, int]) -> list[int]:
    w = word.lower()
    p = f"^{w}$"
    names = ["w" + w, "s" + _script(w[0]), f"n{min(len(w), 12)}", "A" + str(word[0] != w[0])]
    names += ["p" + w[:k] for k in (1, 2, 3) if len(w) >= k] + ["q" + w[-k:] for k in (1, 2, 3, 4) if len(w) >= k]
    if w in lexicon:
        names.append(f"L{lexicon[w]}")
    names += ["t" + p[i : i + 3] for i in range(min(len(p) - 2, 24))]
    return [xxhash.xxh32_intdigest(n) % BUCKETS for n in names]


class Vocabulary:
    """Rows of word features, for summing weights per word."""

    def __init__(self, lexicon: dict[str, int]):
        self.lexicon = lexicon
        self.rows: dict[str, int] = {}
        self.flat: list[int] = []
        self.starts: list[int] = []

    def ids(self, words: list[str]) -> list[int]:
        rows = self.rows
        try:
            return [rows[w] for w in words]
        except KeyError:
            for w in words:
                if w not in rows:
                    rows[w] = len(rows)
                    self.starts.append(len(self.flat))
                    self.flat += features(w, self.lexicon)
            return [rows[w] for w in words]

    def emissions(self, weights: np.ndarray) -> np.ndarray:
        """Summed weights of the words whose features are held."""
        if not self.starts:
            return np.zeros((0, weights.shape[1]), weights.dtype)
        return np.add.reduceat(weights[np.array(self.flat, np.int64)], np.array(self.starts, np.int64), axis=0)

    def drain(self, weights: np.ndarray) -> np.ndarray:
        """``emissions`` of the words that are new since the last call, whose features are then let go."""
        out = self.emissions(weights)
        self.flat, self.starts = [], []
        return out


def forward_backward(emit: np.ndarray, mask: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(marginals (B, T, L), expected transitions (L, L), log likelihood of the partition) of chains padded to T.

    Works with scaled probabilities; ``mask`` is True on real places, which come first.
    """
    b, t, k = emit.shape
    top = emit.max(axis=2, keepdims=True)
    e = np.exp(emit - top)
    m = np.exp(trans)
    alpha = np.empty_like(e)
    scale = np.ones((b, t), e.dtype)
    a = e[:, 0] * np.exp(start)
    scale[:, 0] = a.sum(axis=1)
    alpha[:, 0] = a / scale[:, :1]
    for i in range(1, t):
        a = (alpha[:, i - 1] @ m) * e[:, i]
        s = a.sum(axis=1)
        live = mask[:, i]
        s = np.where(live, s, 1)
        scale[:, i] = s
        alpha[:, i] = np.where(live[:, None], a / s[:, None], alpha[:, i - 1])
    beta = np.ones((b, k), e.dtype)
    gamma = np.empty_like(e)
    expected = np.zeros((k, k))
    gamma[:, t - 1] = alpha[:, t - 1]
    for i in range(t - 2, -1, -1):
        live = mask[:, i + 1]
        x = e[:, i + 1] * beta / scale[:, i + 1, None]
        expected += (alpha[:, i] * live[:, None]).T @ x * m
        beta = np.where(live[:, None], x @ m.T, 1)
        gamma[:, i] = alpha[:, i] * beta
    total = float((np.log(scale) + np.where(mask, top[:, :, 0], 0))[mask].sum())
    return gamma, expected, total


def _padded(chains: list[np.ndarray], most: int = 60_000) -> list[tuple[list[int], np.ndarray, np.ndarray]]:
    """Chains of about equal length together: (numbers, ids (B, T), mask)."""
    order = sorted(range(len(chains)), key=lambda i: len(chains[i]))
    out, at = [], 0
    while at < len(order):
        end = at + 1
        while end < len(order) and len(chains[order[end]]) * (end + 1 - at) <= most and len(chains[order[end]]) <= 1.5 * len(chains[order[at]]) + 8:
            end += 1
        part = order[at:end]
        width = len(chains[part[-1]])
        ids, mask = np.zeros((len(part), width), np.int64), np.zeros((len(part), width), bool)
        for r, i in enumerate(part):
            ids[r, : len(chains[i])] = chains[i]
            mask[r, : len(chains[i])] = True
        out.append((part, ids, mask))
        at = end
    return out


class Tagger:
    """Weights of the field; ``label`` gives letters per language for a list of paragraphs."""

    def __init__(self, weights: np.ndarray, trans: np.ndarray, start: np.ndarray, lexicon: dict[str, int] | None = None):
        self.weights, self.trans, self.start, self.lexicon = weights, trans, start, lexicon or {}
        self._vocabulary, self._table = None, None

    def __getstate__(self):
        return (self.weights, self.trans, self.start, self.lexicon)

    def __setstate__(self, state):
        self.__init__(*state)

    def label(self, texts: list[str], most_words: int = 300_000) -> tuple[np.ndarray, np.ndarray]:
        """(letters per language (n, L), letters (n,)) of the texts; long texts are cut into overlapping chains."""
        if self._vocabulary is None or len(self._vocabulary.rows) > most_words:
            self._vocabulary, self._table = Vocabulary(self.lexicon), np.zeros((0, len(LANGUAGES)), np.float32)
        vocabulary = self._vocabulary
        chains, owner, skip, weight = [], [], [], []
        for i, text in enumerate(texts):
            words = tokens(text) if text else []
            if not words:
                continue
            ids = np.array(vocabulary.ids(words), np.int64)
            size = np.fromiter(map(len, words), np.float32, len(words))
            for low in range(0, len(ids), _CHAIN):
                before = min(low, 32)
                high = min(len(ids), low + _CHAIN)
                after = min(len(ids) - high, 32)
                chains.append(ids[low - before : high + after])
                owner.append(i)
                skip.append((before, high - low))
                weight.append(size[low:high])
        if vocabulary.starts:
            self._table = np.concatenate((self._table, vocabulary.drain(self.weights)))
        out = np.zeros((len(texts), len(LANGUAGES)))
        for part, ids, mask in _padded(chains):
            gamma = forward_backward(self._table[ids], mask, self.trans, self.start)[0]
            gamma /= np.maximum(gamma.sum(axis=2, keepdims=True), 1e-30)
            letters = np.zeros(ids.shape, np.float32)
            for r, i in enumerate(part):
                letters[r, skip[i][0] : skip[i][0] + skip[i][1]] = weight[i]
            sums = np.einsum("bt,btk->bk", letters, gamma)
            np.add.at(out, [owner[i] for i in part], sums)
        return out, out.sum(axis=1)


def _clean(texts: list[list[str]], labels: list[int], rounds: int = 4) -> tuple[list[list[str]], np.ndarray]:
    """Paragraphs as word lists and their languages, from texts with partly wrong labels."""
    parts, lab = [], []
    for paragraphs_, y in zip(texts, labels):
        for p in paragraphs_:
            words = tokens(p)
            if words:
                parts.append(words)
                lab.append(y)
    names = {w: i for i, w in enumerate(Counter(w.lower() for p in parts for w in p))}
    flat = np.array([names[w.lower()] for p in parts for w in p], np.int64)
    starts = np.concatenate(([0], np.cumsum([len(p) for p in parts])))[:-1]
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    lab = np.array(lab)
    k = len(LANGUAGES)
    for _ in range(rounds):
        counts = np.full((k, len(names)), 0.1)
        np.add.at(counts, (lab[owner], flat), 1.0)
        logp = np.log(counts / counts.sum(axis=1, keepdims=True)).T
        lab = np.add.reduceat(logp[flat], starts, axis=0).argmax(axis=1)
    return parts, lab


def lexicon_of(parts: list[list[str]], lab: np.ndarray, least: int = 3, share: float = 0.8) -> dict[str, int]:
    """The words of at least ``least`` paragraphs, ``share`` of them in one language, with that language's number."""
    seen: dict[str, Counter] = {}
    for words, y in zip(parts, lab.tolist()):
        for w in {w.lower() for w in words}:
            seen.setdefault(w, Counter())[y] += 1
    out = {}
    for w, counts in seen.items():
        (y, n), total = counts.most_common(1)[0], counts.total()
        if total >= least and n >= share * total:
            out[w] = y
    return out


def train(texts: list[str], labels: list[str], rounds: int = 40, rate: float = 0.4, decay: float = 1e-5, seed: int = 5, least_gain: float = 0.04) -> Tagger:
    """Fits the field by gradient ascent on the likelihood of cleaned chains.

    It ends when the probability on wrong languages falls by less than ``least_gain`` of
    itself in a round, or after ``rounds``.
    """
    k = len(LANGUAGES)
    rng = np.random.default_rng(seed)
    weights, trans, start = np.zeros((BUCKETS, k), np.float32), np.zeros((k, k)), np.zeros(k)
    if not texts:
        return Tagger(weights, trans.astype(np.float32), start.astype(np.float32))
    parts, lab = _clean([[p for _, p in paragraphs(t)] for t in texts], [LANGUAGES.index(x) for x in labels])
    lexicon = lexicon_of(parts, lab)
    lab = np.repeat(lab, [-(-len(p) // _CHAIN) for p in parts])
    parts = [p[i : i + _CHAIN] for p in parts for i in range(0, len(p), _CHAIN)]
    vocabulary = Vocabulary(lexicon)
    chains = [np.array(vocabulary.ids(p), np.int64) for p in parts]
    gold = [np.full(len(c), y) for c, y in zip(chains, lab)]
    for i, j in rng.integers(0, len(parts), (len(parts) // 5, 2)):
        if lab[i] != lab[j]:
            # of two long paragraphs the end and the beginning, so that the language changes within the chain
            a, b = chains[i][-max(_CHAIN // 2, _CHAIN - len(chains[j])) :], chains[j]
            chains.append(np.concatenate((a, b))[:_CHAIN])
            gold.append(np.concatenate((gold[i][-len(a) :], gold[j]))[:_CHAIN])
    batches = _padded(chains)
    truths = []
    for part, ids, mask in batches:
        y = np.zeros(ids.shape, np.int64)
        for r, i in enumerate(part):
            y[r, : len(gold[i])] = gold[i]
        truths.append(y)
    n = sum(len(c) for c in chains)
    flat = np.array(vocabulary.flat, np.int64)
    sizes = np.diff(np.append(vocabulary.starts, len(flat)))
    words = np.repeat(np.arange(len(sizes)), sizes)
    grads = [np.zeros_like(weights), np.zeros_like(trans), np.zeros_like(start)]
    last = np.inf
    for step_no in range(rounds):
        wrong = 0.0
        table = vocabulary.emissions(weights)
        g_word, g_trans, g_start = np.zeros(table.shape), np.zeros((k, k)), np.zeros(k)
        for (_, ids, mask), y in zip(batches, truths):
            gamma, expected, _ = forward_backward(table[ids], mask, trans.astype(np.float32), start.astype(np.float32))
            gamma /= np.maximum(gamma.sum(axis=2, keepdims=True), 1e-30)
            diff = -gamma
            np.put_along_axis(diff, y[:, :, None], np.take_along_axis(diff, y[:, :, None], 2) + 1, 2)
            diff *= mask[:, :, None]
            wrong += float(np.abs(diff).sum()) / 2
            for c in range(k):
                g_word[:, c] += np.bincount(ids.ravel(), diff[:, :, c].ravel(), minlength=len(table))
            np.add.at(g_trans, (y[:, :-1][mask[:, 1:]], y[:, 1:][mask[:, 1:]]), 1.0)
            g_trans -= expected
            g_start += np.bincount(y[:, 0], minlength=k) - gamma[:, 0].sum(axis=0)
        # the first rounds, in which the steps find their size, may go up and down
        if step_no >= 8 and wrong > (1 - least_gain) * last:
            break
        last = wrong
        g = np.stack([np.bincount(flat, g_word[words, c], minlength=BUCKETS) for c in range(k)], axis=1).astype(np.float32)
        for value, step, kept, pull in ((weights, g, grads[0], decay * n), (trans, g_trans, grads[1], 0), (start, g_start, grads[2], 0)):
            step = step - pull * value
            kept += step * step
            value += (rate * step / np.sqrt(kept + 1e-8)).astype(value.dtype)
    return Tagger(weights, trans.astype(np.float32), start.astype(np.float32), lexicon)


def training_sample(docs: DataFrame, per_label: int = 150, most_chars: int = 6000) -> tuple[list[str], list[str]]:
    """At most ``per_label`` labelled rows a language, of 80 to ``most_chars`` characters, spread over the table by a hash of the text; copies count once."""
    labelled = docs.select(label_of(F.col("lang")).alias("label"), "text").where(F.col("label").isNotNull() & F.length("text").between(80, most_chars)).withColumn("h", F.xxhash64("text"))
    # a coarse hash filter first, so that the window sees a bounded number of rows of each language
    sizes = {r[0]: r[1] for r in labelled.groupBy("label").agg(F.approx_count_distinct("h", 0.02)).collect()}
    keep = None
    for name, n in sizes.items():
        step = max(1, n // (3 * per_label))
        test = (F.col("label") == name) & (F.pmod("h", F.lit(step)) == 0)
        keep = test if keep is None else keep | test
    if keep is None:
        return [], []
    # copies are dropped within the tasks before they are shuffled, so a text in a third of the rows never meets in one task
    once = labelled.where(keep).dropDuplicates(["label", "h"])
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy("h"))).where(F.col("rank") <= per_label)
    rows = ranked.orderBy("label", "h").select("text", "label").collect()
    return [r[0] for r in rows], [r[1] for r in rows]


def language_segments(docs: DataFrame, tagger: Tagger | None = None, per_label: int = 150, least_letters: int = 40, least_share: float = 0.5) -> DataFrame:
    """``(doc_id, seg_no, lang, confidence, letters, label)``.

    ``seg_no`` 0 is the document, 1 and up are its paragraphs with letters outside code.
    Documents with fewer than ``least_letters`` letters outside code, null and empty
    texts have no rows. ``label`` is the row's own label, null if missing. A paragraph in
    which no language has more than ``least_share`` of the letters (0.9 under 25 letters)
    takes the document's. Further columns are ignored; a repeated row gives its rows again.
    """
    base = need(docs, "doc_id", "text", "lang")
    if tagger is None:
        tagger = train(*training_sample(base, per_label))
    held = docs.sparkSession.sparkContext.broadcast(tagger)  # a fixed number of weights
    rows = spread(base.where("length(text) > 0").select("doc_id", "text", label_of(F.col("lang")).alias("label")))
    kind = dict(base.dtypes)["doc_id"]
    names = np.array(LANGUAGES)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        texts, owner, number = [], [], []
        for i, text in enumerate(batch.column(1).to_pylist()):
            for no, p in paragraphs(text):
                if p:
                    texts.append(p)
                    owner.append(i)
                    number.append(no)
        if not texts:
            return None
        score, _ = held.value.label(texts)
        owner, number = np.array(owner), np.array(number)
        letters = np.array([len(_LETTER.findall(t)) for t in texts])
        total = np.bincount(owner, letters, minlength=batch.num_rows)
        share = score / np.maximum(score.sum(axis=1, keepdims=True), 1e-30)
        best = share.argmax(axis=1)
        by_lang = np.zeros((batch.num_rows, len(LANGUAGES)))
        np.add.at(by_lang, (owner, best), np.where(score.sum(axis=1) > 0, letters, 0))
        soft = np.zeros_like(by_lang)
        np.add.at(soft, owner, score)
        doc_best = (by_lang + 1e-6 * soft).argmax(axis=1)
        # a few words can belong to several languages; they need more than a small majority
        weak = (share[np.arange(len(best)), best] <= np.where(letters < 25, 0.9, least_share)) | (score.sum(axis=1) <= 0)
        best = np.where(weak, doc_best[owner], best)
        enough = total >= least_letters
        seg = np.flatnonzero(enough[owner] & (letters > 0))
        whole = np.flatnonzero(enough)
        at = np.concatenate((whole, owner[seg]))
        soft /= np.maximum(soft.sum(axis=1, keepdims=True), 1e-30)
        lang = np.concatenate((doc_best[whole], best[seg]))
        conf = np.concatenate((soft[whole, doc_best[whole]], share[seg, best[seg]]))
        take = pa.array(at)
        return pa.RecordBatch.from_arrays([batch.column(0).take(take), pa.array(np.concatenate((np.zeros(len(whole)), number[seg])).astype(np.int64)), pa.array(names[lang].tolist()), pa.array(conf), pa.array(np.concatenate((total[whole], letters[seg])).astype(np.int64)), batch.column(2).take(take), pa.array(names[doc_best[at]].tolist())], ["doc_id", "seg_no", "lang", "confidence", "letters", "label", "doc_lang"])

    return arrow_map(rows, one, f"doc_id {kind}, seg_no bigint, lang string, confidence double, letters bigint, label string, doc_lang string", text="text")


def mislabelled(docs: DataFrame, **options) -> DataFrame:
    """``(doc_id, seg_no, lang, confidence)``: documents with a missing or wrong label, and paragraphs in another language than their document's."""
    found = language_segments(docs, **options)
    wrong = (F.col("seg_no") == 0) & (F.col("label").isNull() | (F.col("label") != F.col("lang")))
    foreign = (F.col("seg_no") > 0) & (F.col("lang") != F.col("doc_lang"))
    return found.where(wrong | foreign).select("doc_id", "seg_no", "lang", "confidence").dropDuplicates(["doc_id", "seg_no"])
