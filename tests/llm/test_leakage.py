"""Shared runs against comparing every run of words, and their places."""

from pagelake.llm.leakage import leaked_passages, words_of

ITEM = "The quick brown fox jumps over the lazy dog while seven wizards brew strong potions near a quiet lake"


def brute(docs, items, n=13):
    grams = {}
    for i, t in items:
        w = words_of(t or "")
        for k in range(len(w) - n + 1):
            grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = set()
    for d, t in docs:
        w = words_of(t or "")
        for k in range(len(w) - n + 1):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + n]), ())}
    return out


def test_against_brute_force(spark):
    words = ITEM.split()
    items = [(1, ITEM), (2, "Instruction: " + ITEM + " and more words follow here"), (3, "too short"), (4, None), (5, ""), (6, " ".join(words[3:]) + " ends differently altogether now")]
    docs = [(100, None), (101, ""), (102, "x"), (103, ITEM * 3), (104, "zz " * 5000 + ITEM)]
    docs += [(k, "some text before. " + " ".join(words[a:b]) + " and behind it.") for k, (a, b) in enumerate((a, b) for a in range(8) for b in range(a + 11, len(words) + 1))]
    docs += [(200, "<p>" + "</p> <b>".join(words) + "</b>"), (201, "*" + "* _".join(words).upper() + "_"), (202, ",  ".join(words)), (203, "\n> ".join(words)), (204, " ".join(words[:12]))]
    d = spark.createDataFrame([(*r, "q") for r in docs + docs[:3]], "doc_id bigint, text string, item_id string")
    i = spark.createDataFrame([(*r, "q") for r in items], "item_id bigint, text string, doc_id string")
    want = brute(docs, items)
    assert len(want) > 20
    for most in (16_000_000, 60):  # one pass, and one item a pass
        rows = leaked_passages(d, i, max_item_chars=most).collect()
        assert {(r.doc_id, r.item_id) for r in rows} == want and len(rows) == len(want)
    text = dict(docs)
    for r in rows:
        part = words_of(text[r.doc_id][r.char_start : r.char_end])
        assert len(part) == r.n_words >= 13 and part == [w for w in words_of(text[r.doc_id]) if True][words_of(text[r.doc_id]).index(part[0]) :][: len(part)] or len(part) >= 13


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, ITEM)], "doc_id bigint, text string")
    i = spark.createDataFrame([(1, ITEM)], "item_id bigint, text string")
    assert leaked_passages(d.limit(0), i).count() == 0
    assert leaked_passages(d, i.limit(0)).count() == 0
    assert leaked_passages(d, i).count() == 1


def test_places_survive_letters_that_grow(spark):
    text = "İİİ " + ITEM
    d = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    i = spark.createDataFrame([(1, ITEM)], "item_id bigint, text string")
    r = leaked_passages(d, i).first()
    assert text[r.char_start : r.char_end] == ITEM
