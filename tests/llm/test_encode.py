"""Ids against the public library, and texts back from their ids."""

import pytest

from pagelake.llm.encode import DEFAULT_VOCABULARY, Encoder, MergeTable, encode_corpus

tokenizers = pytest.importorskip("tokenizers")

TEXTS = ["", None, " ", "\n\n \t", "Hello  world's", "<|endoftext|> is text", "aaaaaaaaaaaaaaaaaaaa", "日本語のテキスト。", "👩‍👩‍👧 é é", "x" * 3000, "  indented\n    code()", "ﷺ  ", "\x00\x01", "don't WON'T 12345", "a" * 7 + " " + "ab" * 50]


@pytest.fixture(scope="module")
def table():
    return MergeTable.load(DEFAULT_VOCABULARY)


def library(texts):
    t = tokenizers.Tokenizer.from_file(DEFAULT_VOCABULARY)
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_ids_are_the_library_s(table):
    for size in (2, 300_000):  # with a cache that is emptied all the time as well
        encoder = Encoder(table, cache_words=size)
        for _ in range(2):
            ids, offsets = encoder.batch(TEXTS)
            assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == library(TEXTS)


def test_round_trip(table):
    t = tokenizers.Tokenizer.from_file(DEFAULT_VOCABULARY)
    ids, offsets = Encoder(table).batch(TEXTS)
    for text, a, b in zip(TEXTS, offsets, offsets[1:]):
        assert t.decode(ids[a:b].tolist(), skip_special_tokens=False) == (text or "")


def test_corpus(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "y")], "doc_id bigint, text string, ids string")
    rows = encode_corpus(df).collect()
    want = library(TEXTS)
    assert len(rows) == len(TEXTS) + 1
    assert all(r.ids == want[r.doc_id] for r in rows)
    assert encode_corpus(df.limit(0)).count() == 0


def test_what_is_remembered_is_bounded():
    from pagelake.llm.encode import DEFAULT_VOCABULARY, Encoder, MergeTable

    small, large = (Encoder(MergeTable.load(DEFAULT_VOCABULARY), cache_chars=n) for n in (10, 1 << 30))
    texts = ["one two three", "z" * 500, "four five", "one two"]
    for text in texts:
        assert [x.tolist() for x in small.batch([text])] == [x.tolist() for x in large.batch([text])]
    assert len(small.known) < len(large.known)
