"""Languages: forward-backward against enumeration, accuracy on held-out texts, and the reading of paragraphs."""

import itertools
import random

import numpy as np
import pytest

from pagelake.llm.language import LANGUAGES, Tagger, features, forward_backward, label_of, language_segments, lexicon_of, mislabelled, paragraphs, tokens, train, training_sample

WORDS = {
    "en": "the harbour opens early and this ferry leaves with many people who never wait for their tickets".split(),
    "de": "der hafen öffnet früh und diese fähre fährt mit vielen leuten die niemals auf ihre karten warten".split(),
    "fr": "le port ouvre tôt et ce bac part avec beaucoup de gens qui jamais n'attendent leurs billets".split(),
    "es": "el puerto abre temprano y este barco sale con mucha gente que nunca espera sus billetes".split(),
    "ru": "гавань открывается рано и этот паром уходит со многими людьми которые никогда не ждут".split(),
    "uk": "гавань відкривається рано і цей пором відходить з багатьма людьми які ніколи не чекають їхні".split(),
}


def sentence(rng, lang, n=30):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def made(rng, count=240, wrong=0.1):
    rows = []
    for i in range(count):
        lang = rng.choice(list(WORDS))
        parts = [sentence(rng, lang) for _ in range(4)]
        other = rng.choice(list(WORDS))
        mixed = i % 4 == 0 and other != lang
        if mixed:
            parts[2] = sentence(rng, other, 14)
        label = rng.choice(list(WORDS)) if rng.random() < wrong else lang
        rows.append((i, "\n\n".join(parts), label, lang, {3: other} if mixed else {}))
    return rows


def test_forward_backward_is_exact():
    rng = np.random.default_rng(1)
    emit, trans, start = rng.normal(size=(2, 4, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    mask = np.array([[True] * 4, [True] * 2 + [False] * 2])
    gamma, expected, total = forward_backward(emit, mask, trans, start)
    sums, log = np.zeros((3, 3)), 0.0
    for b, n in ((0, 4), (1, 2)):
        weights = {p: np.exp(start[p[0]] + sum(emit[b, i, x] for i, x in enumerate(p)) + sum(trans[x, y] for x, y in zip(p, p[1:]))) for p in itertools.product(range(3), repeat=n)}
        z = sum(weights.values())
        log += np.log(z)
        for i in range(n):
            want = [sum(w for p, w in weights.items() if p[i] == c) / z for c in range(3)]
            got = gamma[b, i] / gamma[b, i].sum()
            assert np.allclose(got, want)
        for p, w in weights.items():
            for x, y in zip(p, p[1:]):
                sums[x, y] += w / z
    assert np.allclose(expected, sums) and np.isclose(total, log)


@pytest.fixture(scope="module")
def rows():
    return made(random.Random(4))


def test_found_rows(spark, rows):
    odd = [(1000, None, "en"), (1001, "", None), (1002, "ok", "en"), (1003, "```\n" + "der hafen und die fähre " * 9 + "\n```\n\nthe people wait", "en"), (1004, sentence(random.Random(1), "en", 30_000), "zz")]
    df = spark.createDataFrame([(i, t, l, "x") for i, t, l, *_ in rows] + [(*r, "x") for r in odd] + [(*rows[0][:3], "x")], "doc_id bigint, text string, lang string, seg_no string")
    want = {(i, 0, lang) for i, _, label, lang, _ in rows if label != lang} | {(i, s, o) for i, _, _, _, more in rows for s, o in more.items()} | {(1004, 0, "en")}
    found = mislabelled(df).collect()
    got = {(r.doc_id, r.seg_no, r.lang) for r in found}
    assert len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.02 * len(want) + 1
    assert all(0 < r.confidence <= 1 for r in found) and (1004, 0, "en") in got
    assert not {d for d, *_ in got} & {1000, 1001, 1002, 1003}
    assert language_segments(df.limit(0)).count() == 0


def test_held_out_accuracy(rows):
    tagger = train([t for _, t, *_ in rows[:150]], [label for _, _, label, *_ in rows[:150]])
    texts = [p for _, t, *_ in rows[150:] for p in t.split("\n\n")]
    truth = [more.get(k, lang) for _, t, _, lang, more in rows[150:] for k in range(1, 5)]
    score, _ = tagger.label(texts)
    hit = [LANGUAGES[i] == y for i, y in zip(score.argmax(axis=1), truth)]
    assert np.mean(hit) > 0.98
    long, _ = tagger.label([" ".join(texts[:1]) * 200])
    assert np.isfinite(long).all()
    empty = train([], [])
    assert isinstance(empty, Tagger) and np.isfinite(empty.label(["word", ""])[0]).all()


def test_paragraphs_and_tokens():
    assert paragraphs("a\nb\n\n\nc\n\n```\nx\n\ny\n```\n\n    code\n\nd\r\n") == [(1, "a\nb"), (2, "c"), (3, ""), (4, ""), (5, ""), (6, "d")]
    assert tokens("<b>Hi</b> 12 you_too `code` 日本語テキスト [x](/not)") == ["Hi", "you", "too", "日本語テ", "キスト", "x"]


def test_labels(spark):
    df = spark.createDataFrame([(" EN_us",), ("de ",), ("??",), (None,), ("",), ("unknown",), ("\tfr-CA",)], "lang string")
    assert [r[0] for r in df.select(label_of(df.lang)).collect()] == ["en", "de", None, None, None, None, "fr"]


def test_training_takes_copies_once_and_long_paragraphs_whole(spark):
    rng = random.Random(3)
    one = sentence(rng, "en")
    texts = [one] * 100 + [sentence(rng, "en") for _ in range(40)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string")
    got, labels = training_sample(docs, per_label=41)
    assert set(got) == set(texts) and len(got) == 41 and set(labels) == {"en"}

    late = {"en": ["zuvok", "zuvim", "uzuvo"], "de": ["wexal", "exwor", "wexum"]}
    rows = [(sentence(rng, lang, 300) + " " + " ".join(rng.choice(late[lang]) for _ in range(60)), lang) for _ in range(30) for lang in late]
    tagger = train([t for t, _ in rows], [lang for _, lang in rows])
    score, letters = tagger.label([" ".join(late[lang]) for lang in late])
    share = [score[i][LANGUAGES.index(lang)] / letters[i] for i, lang in enumerate(late)]
    assert min(share) > 0.9


def test_lexicons():
    parts = [["Der", "Hafen"], ["der", "hafen"], ["der", "radio"], ["the", "radio"], ["the", "Hafen"], ["the", "radio"]]
    assert lexicon_of(parts, np.array([1, 1, 1, 0, 0, 0])) == {"der": 1, "the": 0}
    assert lexicon_of([], np.array([], int)) == {}
    assert set(features("der", {"der": 1})) > set(features("der", {})) and features("x", {"der": 1}) == features("x", {})
