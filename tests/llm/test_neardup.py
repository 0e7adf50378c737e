"""The join against comparing all pairs, and its trie walk against plain set similarity."""

import itertools
import random
import re

import numpy as np

from pagelake.llm.neardup import Maps, _listed_pairs, bitmap, heads, link_counts, maps_of, needed_overlap, pack, prefix_of, prefixes, similar_pairs, trie_join, unpack


def sets_of(rows, n, least):
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        if len(w) >= max(n, least):
            out[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    return out


def brute(rows, threshold, n, least):
    s = sets_of(rows, n, least)
    return {(a, b) for a, b in itertools.combinations(sorted(s), 2) if len(s[a] & s[b]) >= threshold * len(s[a] | s[b])}


def made(seed=1):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    rows, i = [], 0
    for _ in range(25):
        base = [word() for _ in range(rng.randrange(100, 260))]
        for _ in range(rng.randrange(1, 6)):
            new = list(base)
            for _ in range(rng.randrange(0, 25)):
                at = rng.randrange(len(new))
                new[at : at + rng.randrange(0, 3)] = [word() for _ in range(rng.randrange(0, 3))]
            rows.append((i, " ".join(new)))
            i += 1
    rows += [(i + k, rows[0][1].upper()) for k in range(4)]
    rows += [(i + 10, None), (i + 11, ""), (i + 12, "short one"), (i + 13, "same " * 120), (i + 14, "same " * 150), (i + 15, "lang " * 120_000)]
    return rows


def test_pairs_against_brute_force(spark, pages):
    rows = made()
    df = pages([{"page_id": i, "content": t} for i, t in rows])
    for threshold, n in ((0.5, 3), (0.8, 5)):
        want = brute(rows, threshold, n, 100)
        found = {tuple(r) for r in similar_pairs(df, threshold, n, 100, exact=True, block=7).collect()}
        assert found == want
        got = similar_pairs(df, threshold, n, 100).collect()
        assert len(got) == len(set(got))
        found = {(r.page_id_a, r.page_id_b) for r in got}
        assert found <= want and len(found) >= 0.99 * len(want) and len(want) > 10
    small = similar_pairs(df, 0.8, 5, 100, block=2).collect()  # groups split into blocks lose nothing
    assert {(r.page_id_a, r.page_id_b) for r in small} == found


def test_one_row_per_page(spark, pages):
    rows = made(2)
    df = pages([{"page_id": i, "content": t} for i, t in rows + rows[:1]])
    counts = {r.page_id: r for r in link_counts(df, 0.8, 5, 100).collect()}
    assert set(counts) == set(sets_of(rows, 5, 100))
    assert counts[0].copies == 5
    assert link_counts(df.limit(0)).count() == 0 and similar_pairs(df.limit(0)).count() == 0


def test_trie_walk():
    rng = random.Random(5)
    for _ in range(60):
        probe = np.unique(np.array([rng.randrange(60) for _ in range(rng.randrange(1, 40))], np.uint32))
        partners = [np.unique(np.array([rng.randrange(60) for _ in range(rng.randrange(1, 40))], np.uint32)) for _ in range(12)] + [probe, probe.copy()]
        for threshold in (0.1, 0.5, 0.8, 1.0):
            a = set(probe.tolist())
            want = [i for i, p in enumerate(partners) if len(a & set(p.tolist())) >= threshold * len(a | set(p.tolist())) - 1e-12]
            assert sorted(trie_join(probe, partners, threshold)) == want
    assert needed_overlap(10, 10, 0.5) == 7 and needed_overlap(9, 9, 0.5) == 6


def test_prefixes_and_bitmaps():
    rng = np.random.default_rng(4)
    levels = np.zeros(1 << 20, np.uint16)
    levels[: 1 << 19] = 9  # the lower half of the hashes is common
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**32, rng.integers(1, 300), dtype=np.uint64).astype(np.uint32))
        b = np.unique(np.concatenate((a[rng.random(len(a)) < rng.random()], rng.integers(0, 2**32, rng.integers(0, 200), dtype=np.uint64).astype(np.uint32))))
        if not len(b):
            continue
        shared = len(np.intersect1d(a, b))
        assert np.bitwise_count(bitmap(a) ^ bitmap(b)).sum() <= len(a) + len(b) - 2 * shared
        for threshold in (0.3, 0.5, 0.8, 1.0):
            if shared >= threshold * (len(a) + len(b) - shared):
                assert len(np.intersect1d(prefix_of(a, levels, threshold), prefix_of(b, levels, threshold)))
    rare = prefix_of(np.array([5, 6, 1 << 31, (1 << 31) + 1], np.uint32), levels, 0.5)
    assert rare.tolist() == [1 << 31, (1 << 31) + 1, 5]


def test_no_pair_at_the_threshold_is_lost(spark, pages):
    rows = []
    for k in range(300):  # 150 n-grams each, of which 100 are shared: a similarity of exactly 0.5; then 99, just under it
        for at, shared in ((0, 102), (1000, 101)):
            text = [f"p{k}at{at}w{i}" for i in range(152)]
            rows += [(4 * k + at * 10, " ".join(text)), (4 * k + at * 10 + 1, " ".join(text[:shared] + [w + "b" for w in text[shared:]]))]
    df = pages([{"page_id": i, "content": t} for i, t in rows])
    want = {(4 * k, 4 * k + 1) for k in range(300)}
    assert {tuple(r) for r in similar_pairs(df, 0.5, 3, 100).collect()} == want
    assert link_counts(df, 0.5, 3, 100).where("links = 1").count() == 600
    some = {tuple(r) for r in similar_pairs(df, 0.5, 3, 100, exact=False, block=7).collect()}
    assert some <= want and len(some) >= 0.97 * len(want)


def test_letters_are_lowered_one_by_one(spark, pages):
    upper = [f"ΟΔΟΣ{i}Σ İX{i}" for i in range(60)]
    df = pages([{"page_id": 1, "content": " ".join(upper)}, {"page_id": 2, "content": " ".join(upper).replace("Σ", "σ").replace("İ", "i").lower()}])
    assert [tuple(r) for r in similar_pairs(df, 0.5, 3, 100).collect()] == [(1, 2)]


def test_listing_against_all_pairs():
    rng = np.random.default_rng(8)
    levels = rng.integers(0, 5, 1 << 20).astype(np.uint16)
    for threshold in (0.2, 0.5, 0.8, 1.0):
        base = [np.unique(rng.integers(0, 2**64, rng.integers(1, 60), dtype=np.uint64) >> np.uint64(24) << np.uint64(24)) for _ in range(6)]
        sets = [np.unique(np.concatenate((b[rng.random(len(b)) < 0.85], rng.choice(base[0], 3), rng.choice(base[1], 2) | np.uint64(1 << 24)))) for b in base for _ in range(6)]
        assert all((unpack(pack(s)) == s >> np.uint64(24)).all() for s in sets)
        lists = [heads(pack(s)) for s in sets]
        assert any(len(np.unique(x)) < len(x) for x in lists)  # different n-grams with equal upper halves
        sizes = np.array([len(x) for x in lists])
        flat = np.concatenate(lists)
        maps = Maps(sizes, {w: x for w, (_, x) in maps_of(flat, sizes).items()})
        for at_once in (1, 50, 10_000):
            listed = {tuple(sorted(p)) for part in _listed_pairs(*prefixes(flat, sizes, levels, threshold), sizes, maps, threshold, at_once) for p in part.tolist()}
            for i, j in itertools.combinations(range(len(sets)), 2):
                shared = len(np.intersect1d(sets[i], sets[j]))
                assert shared < threshold * (sizes[i] + sizes[j] - shared) or (i, j) in listed


def test_bitmaps_of_different_widths():
    rng = np.random.default_rng(9)
    sets = [np.sort(rng.integers(0, 2**32, n, dtype=np.uint64)).astype(np.uint32) for n in (5, 150, 300, 700, 1500, 9000)]
    sets += [np.sort(np.concatenate((s[: len(s) // 2], rng.integers(0, 2**32, len(s) // 3 + 1, dtype=np.uint64).astype(np.uint32)))) for s in sets]
    sizes = np.array([len(s) for s in sets])
    maps = Maps(sizes, {w: x for w, (_, x) in maps_of(np.concatenate(sets), sizes).items()})
    assert len(maps.at) == 5
    x, y = np.array(list(itertools.product(range(len(sets)), repeat=2))).T
    for i, j, bits, width in zip(x, y, maps.differ(x, y).tolist(), np.minimum(maps.width[x], maps.width[y]).tolist()):
        assert bits == np.bitwise_count(bitmap(sets[i], width) ^ bitmap(sets[j], width)).sum() <= len(np.setxor1d(sets[i], sets[j]))
