"""Pieces against a plain reading of the rule, ranges against whole texts, files against texts."""

import random

import pytest

from pagelake.llm.split import PieceRule, section_pieces, split_files, split_texts, stitch

RULE = PieceRule()


def by_rule(text, limit=1200, least=600, overlap=150):
    """The rule of the task, position by position."""
    kinds = [
        lambda e: text[e - 2 : e] == "\n\n",
        lambda e: text[e - 1] == "\n",
        lambda e: text[e - 1] in "。！？" or text[e - 1] == " " and text[e - 2] in ".!?",
        lambda e: text[e - 1] == " ",
        lambda e: e == s + limit,
    ]
    out, s = [], 0
    while len(text) - s > limit:
        e = next(c for kind in kinds for c in [max((e for e in range(s + least + 1, s + limit + 1) if kind(e)), default=0)] if c)
        out.append((s, e))
        s = next((q for q in range(e - overlap, e) if text[q - 1] in " \n"), e - overlap)
    return [*out, (s, len(text))]


def texts():
    rng = random.Random(3)
    made = ["a" * 5000, "猫。" * 2500, "x" * 1200, "x" * 1201, "", "w " * 3000, "ends. " * 900, "a\n\n" + "b" * 3000]
    for alphabet in ("ab \n", "ab. !\n", "abcdefgh    .", "ab。 cd", "\n"):
        made += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 6000))) for _ in range(6)]
    return made + [("word " * rng.randrange(1, 300) + "\n\n") * 9 for _ in range(4)]


@pytest.mark.parametrize("text", texts())
def test_rule(text):
    if text:
        assert RULE.pieces(text)[0] == by_rule(text)


def test_ranges_give_what_whole_texts_give(spark):
    rows = [(i, t) for i, t in enumerate(t * 6 for t in texts() if t)] + [(10_000, None), (10_001, "")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "id bigint, text string, key string, piece_no int")
    got = {tuple(r) for r in split_texts(df, "id", "text", range_chars=4800).collect()}
    want = {(i, n, s, e) for i, t in rows if t for n, (s, e) in enumerate(by_rule(t), 1)}
    assert got == want
    assert split_texts(df.limit(0), "id", "text").count() == 0
    with pytest.raises(ValueError):
        split_texts(df, "id", "text", range_chars=100)


def test_stitching_follows_entries():
    assert stitch([[(0, 5, 3)], [(0, 1, 2), (4, 9, 7)], [(0, -1, 1)]]) == [(0, 1), (5, 4), (9, 11), (-1, 12)]
    assert stitch([[(0, -1, 2)], [(0, -1, 1)]])[1][0] == -1


def test_files(spark, tmp_path):
    text = ("Ein Wört. " * 40 + "\n\n" + "猫が寝る。" * 200 + "\n") * 60
    files = {str(tmp_path / n): t for n, t in (("a.txt", text), ("b.txt", "kurz"), ("c.txt", ""))}
    for name, t in files.items():
        with open(name, "w", encoding="utf-8", newline="") as f:
            f.write(t)
    rows = split_files(spark, list(files), range_bytes=20_000).collect()
    got = {(r.path, r.piece_no, r.piece_start, r.piece_end) for r in rows}
    assert got == {(p, n, s, e) for p, t in files.items() if t for n, (s, e) in enumerate(by_rule(t), 1)}
    raw = text.encode()
    for r in rows:
        if r.path.endswith("a.txt"):
            assert raw[r.byte_start : r.byte_end].decode() == text[r.piece_start : r.piece_end]


def test_sections(spark):
    body = "Satz eins. " * 300
    artifacts = spark.createDataFrame([(1, "Kopf\n" + body), (2, None)], "artifact_id bigint, content string")
    rows = [(1, 1, body, 5), (2, 1, body, None), (3, 1, body, 7), (4, 1, "short", 0), (5, 1, None, 0), (6, 2, body, 9), (7, 99, body, None)]
    sections = spark.createDataFrame([(*r, "x") for r in rows], "section_key bigint, artifact_id bigint, text string, char_start bigint, content string")
    got = {}
    for r in section_pieces(sections, artifacts).collect():
        got.setdefault(r.section_key, set()).add((r.piece_no, r.piece_start, r.piece_end))
    want = [(n, s, e) for n, (s, e) in enumerate(by_rule(body), 1)]
    shifted = lambda k: {(n, s + k, e + k) for n, s, e in want}
    assert got == {1: shifted(5), 2: shifted(5), 3: shifted(5), 6: shifted(9), 7: shifted(0)}
    assert section_pieces(sections.limit(0), artifacts).count() == 0
