"""Near-duplicate records with small edits (problem 5): a distributed prefix-tree join.

Records are sets of word n-grams, as sorted 40-bit hashes (one global order).  Records
with the same set form a class and are joined once.

1. Placement.  Each class stands under the n-grams of its prefix in the order of rising
   document frequency; two sets that reach the threshold share one of these.  Placements
   are packed by bucket, so a bucket travels in a few binary rows.
2. Listing.  The classes under one n-gram are ordered by size; for each, those that its
   place leaves room for are a range of them.  A pair goes on if the other's place leaves
   room too and bitmaps of both sets, which bound the overlap from above, allow it.
3. Join.  For each class, the sets of its partners are visited in prefix order, i.e. as
   a depth-first walk of their trie: the overlap with the probing set is kept for each
   depth, so that shared prefixes are followed once, and a subtree is left as soon as the
   elements that remain cannot bring the overlap to what the threshold asks for.

No pair is lost in any step.  The number of listed pairs grows faster than a collection
whose common phrases stay the same (see the README).

``exact=False`` replaces steps 1 and 2 by ``bands`` keys of ``rows`` minima of hash
functions for each class and a comparison of 256-bit sketches.  It loses pairs: one of
similarity J is found with probability 1 - (1 - J**rows)**bands (0.990 at 0.5), and a few
in 100,000 of those by the sketches.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, spread
from .common import WORD, arrow_map, mix64, need

SKETCH_BITS = 256


def shingle_sets(texts: list[str], n: int, least_words: int, vocabulary: dict[str, int]) -> list[np.ndarray | None]:
    """Sorted distinct 64-bit hashes of the word n-grams of each text; None under ``least_words`` words.

    Letters are lowered one by one, as in SQL: a capital sigma always gives the same small one, a dotted capital I an i.
    """
    import xxhash

    kept, parts = [], []
    for text in texts:
        words = WORD.findall(text.replace("\u03a3", "\u03c3").replace("\u0130", "i").lower())
        kept.append(len(words) if len(words) >= max(n, least_words) else 0)
        if not kept[-1]:
            continue
        try:
            ids = list(map(vocabulary.__getitem__, words))
        except KeyError:
            for w in words:
                if w not in vocabulary:
                    vocabulary[w] = xxhash.xxh64_intdigest(w)
            ids = list(map(vocabulary.__getitem__, words))
        parts.append(np.array(ids, np.uint64))
    if not parts:
        return [None] * len(texts)
    h = np.concatenate(parts)
    g = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        g = mix64(g) + h[k : len(h) - n + 1 + k]
    g = mix64(g)  # runs over the borders of texts, where it isn't used
    starts = np.concatenate(([0], np.cumsum(kept)[:-1])).tolist()
    return [np.unique(g[at : at + count - n + 1]) if count else None for at, count in zip(starts, kept)]


def pack(grams: np.ndarray) -> bytes:
    """The upper 40 bits of sorted 64-bit hashes: first the upper 32 of each, then the rest."""
    return (grams >> np.uint64(32)).astype(np.uint32).tobytes() + (grams >> np.uint64(24)).astype(np.uint8).tobytes()


def heads(grams: pa.Buffer | bytes) -> np.ndarray:
    """The upper 32 bits of packed n-grams, one for each n-gram, so that equal ones may follow each other."""
    return np.frombuffer(grams, np.uint32, len(grams) // 5)


def unpack(grams: bytes) -> np.ndarray:
    count = len(grams) // 5
    return (heads(grams).astype(np.uint64) << np.uint64(8)) | np.frombuffer(grams, np.uint8, count, 4 * count)


class _MinHash:
    def __init__(self, count: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.seeds = rng.integers(0, 2**32, count, dtype=np.uint64).astype(np.uint32)[:, None]
        self.mults = (rng.integers(0, 2**32, count, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]

    def __call__(self, s: np.ndarray) -> np.ndarray:
        out = np.full(len(self.seeds), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(s), 4096):
            x = s[None, at : at + 4096] ^ self.seeds
            x *= self.mults
            np.minimum(out, x.min(axis=1), out=out)
        return out


def _band_keys(minima: np.ndarray, rows: int, bands: int) -> np.ndarray:
    m = minima[: rows * bands].reshape(bands, rows).astype(np.uint64)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for r in range(rows):
        key = mix64(key) ^ m[:, r]
    return mix64(key)


def needed_overlap(a: int, b: int, threshold: float) -> int:
    """The least overlap at which sets of these sizes reach the threshold."""
    x = threshold / (1 + threshold) * (a + b)
    return int(np.ceil(x - 1e-9))


def trie_join(probe: np.ndarray, partners: list[np.ndarray], threshold: float) -> list[int]:
    """Numbers of the partners whose Jaccard similarity with ``probe`` reaches ``threshold``.

    All sets are sorted.  The partners are walked in lexicographic order, which is the
    depth-first order of their prefix tree; ``depth[i]`` holds the overlap of the current
    path's first i elements.
    """
    members = set(probe.tolist())
    a = len(probe)
    order = sorted(range(len(partners)), key=lambda i: partners[i].astype(partners[i].dtype.newbyteorder(">")).tobytes())
    found: list[int] = []
    path: list[int] = []
    depth = [0]
    for i in order:
        s = partners[i].tolist()
        b = len(s)
        want = needed_overlap(a, b, threshold)
        if min(a, b) < want:
            continue
        shared = 0
        for x, y in zip(path, s):
            if x != y:
                break
            shared += 1
        del path[shared:], depth[shared + 1 :]
        have = depth[shared]
        for at in range(shared, b):
            if have + b - at < want:  # nothing under this node can reach the overlap
                break
            have += s[at] in members
            path.append(s[at])
            depth.append(have)
        else:
            if have >= want:
                found.append(i)
    return found


def _pairs_in(members: np.ndarray, sketches: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows whose sketches differ in at most ``limit`` bits."""
    a, b = [], []
    for i in range(len(members) - 1):
        differ = np.bitwise_count(sketches[i + 1 :] ^ sketches[i]).sum(axis=1)
        j = np.flatnonzero(differ <= limit) + i + 1
        a.append(np.full(len(j), i))
        b.append(j)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, int), np.zeros(0, int))


SLOTS = 20  #: bits of an n-gram's hash that name its counter
_COUNT_PARTS = 64


def frequency_levels(table: DataFrame) -> np.ndarray:
    """A level for each of 2**SLOTS counters of n-gram hashes, rising with the document frequency; a fixed number of bytes.

    Any fixed order of all n-grams keeps a prefix filter exact; counters shared by several n-grams only cost selectivity.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SLOTS, np.uint32)
        for batch in batches:
            grams = batch.column(0)
            for at in range(0, len(grams), 1000):
                part = np.concatenate([heads(g.as_buffer()) for g in grams[at : at + 1000]])
                total += np.bincount(part >> np.uint32(32 - SLOTS), minlength=1 << SLOTS).astype(np.uint32)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(_COUNT_PARTS), pa.int32()), pa.array([x.tobytes() for x in np.split(total, _COUNT_PARTS)], pa.binary())], ["part", "counts"])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[part] = sums.get(part, 0) + np.frombuffer(counts, np.uint32).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.round(8 * np.log2(1 + x)).astype(np.uint16).tobytes() for x in sums.values()], pa.binary())], ["part", "levels"])

    added = table.select("grams").mapInArrow(count, "part int, counts binary").repartition("part").mapInArrow(add, "part int, levels binary")
    out = np.zeros((_COUNT_PARTS, (1 << SLOTS) // _COUNT_PARTS), np.uint16)
    for part, levels in added.collect():
        out[part] = np.frombuffer(levels, np.uint16)
    return out.ravel()


def bitmaps(grams: np.ndarray, owner: np.ndarray, count: int, bits: int) -> np.ndarray:
    """A row for each of ``count`` sets: the parities of ``bits`` groups of its n-grams. Two sets differ in at least as many n-grams as their rows in bits."""
    cell = owner * bits + (mix64(grams) & np.uint64(bits - 1)).astype(np.int64)
    odd = np.bincount(cell, minlength=count * bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64).reshape(count, -1)


def bitmap(grams: np.ndarray, bits: int = 2048) -> np.ndarray:
    return bitmaps(grams, np.zeros(len(grams), np.int64), 1, bits)[0]


def prefixes(grams: np.ndarray, sizes: np.ndarray, levels: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(gram, owner, place)``: the n-grams of which two sets that reach ``threshold`` share one, the rarest of each set first.

    ``grams`` holds set after set, of the given ``sizes``. N-grams of a set with equal hashes count each in its size and
    in places, and stand once, at the first of their places.
    """
    owner = np.repeat(np.arange(len(sizes)), sizes)
    level = levels[grams >> np.uint32(32 - SLOTS)]
    order = np.sort(owner.astype(np.uint64) << np.uint64(44) | level.astype(np.uint64) << np.uint64(32) | grams)
    place = np.arange(len(grams)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    use = place < np.repeat(sizes - np.ceil(threshold * sizes - 1e-9).astype(np.int64) + 1, sizes)
    use[1:] &= order[1:] != order[:-1]
    return order[use].astype(np.uint32), owner[use], place[use]


def prefix_of(grams: np.ndarray, levels: np.ndarray, threshold: float) -> np.ndarray:
    return prefixes(grams, np.array([len(grams)]), levels, threshold)[0]


def _planes(x: np.ndarray) -> bytes:
    """32-bit numbers, byte by byte: the upper bytes of small ones are zeros, which compress."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.frombuffer(planes, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


def _widths(sizes: np.ndarray) -> np.ndarray:
    """The bits of a set's bitmap, 512 to 8192: a power of two, 2.5 times the size or more as far as that goes."""
    return 1 << np.clip(np.ceil(np.log2(np.maximum(2.5 * sizes, 1))), 9, 13).astype(np.int64)


class Maps:
    """Bitmaps of sets of given sizes, each of its own width; a wider one is folded where it meets a narrower one."""

    def __init__(self, sizes: np.ndarray, raw: dict[int, np.ndarray]):
        """``raw`` has, for each width, the rows of the sets of that width in the order of the sets."""
        self.width = _widths(sizes)
        self.at: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        rows = np.zeros((0, 0), np.uint64)
        who = np.zeros(0, np.int64)
        for width in sorted(set(self.width.tolist()), reverse=True):
            while len(who) and rows.shape[1] * 64 > width:
                rows = rows[:, : rows.shape[1] // 2] ^ rows[:, rows.shape[1] // 2 :]
            own = np.flatnonzero(self.width == width)
            rows = np.concatenate((rows, raw[width])) if len(who) else raw[width]
            who = np.concatenate((who, own))
            place = np.full(len(sizes), -1, np.int32)
            place[who] = np.arange(len(who))
            self.at[width] = rows, place

    def differ(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        width = np.minimum(self.width[x], self.width[y])
        out = np.zeros(len(x), np.int64)
        for w, (rows, place) in self.at.items():
            use = np.flatnonzero(width == w)
            if len(use):
                out[use] = np.bitwise_count(rows[place[x[use]]] ^ rows[place[y[use]]]).sum(axis=1)
        return out


def maps_of(grams: np.ndarray, sizes: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each width the numbers of the sets of that width and their bitmaps; ``grams`` holds set after set."""
    owner, width = np.repeat(np.arange(len(sizes)), sizes), _widths(sizes)
    out = {}
    for w in set(width.tolist()):
        own = np.flatnonzero(width == w)
        use = width[owner] == w
        out[w] = own, bitmaps(grams[use], np.searchsorted(own, owner[use]), len(own), w)
    return out


def _listed_pairs(gram: np.ndarray, owner: np.ndarray, place: np.ndarray, sizes: np.ndarray, maps: Maps, threshold: float, at_once: int = 1_000_000) -> Iterator[np.ndarray]:
    """Pairs (i, j) of owners under one n-gram that places and bitmaps leave possible, ``at_once`` looked at together."""
    size = sizes[owner]
    key = gram.astype(np.uint64) << np.uint64(32) | size.astype(np.uint64)
    order = np.argsort(key)
    key, owner, size = key[order], owner[order], size[order]
    # the overlap that a pair needs is t / (1 + t) of both sizes, and at most what follows the place in either set
    most = np.floor((size - place[order] + 1e-6) * (1 + threshold) / threshold).astype(np.int64) - size
    ends = np.searchsorted(key, (key >> np.uint64(32) << np.uint64(32)) | np.clip(most, 0, 2**32 - 1).astype(np.uint64), "right")
    counts = np.maximum(ends - np.arange(1, len(key) + 1), 0)
    total = np.cumsum(counts)
    low, done = 0, 0
    while done < (total[-1] if len(total) else 0):
        high = max(low + 1, int(np.searchsorted(total, done + at_once, "right")))
        many = counts[low:high]
        i = np.repeat(np.arange(low, high), many)
        j = i + 1 + np.arange(len(i)) - np.repeat(total[low:high] - many - done, many)
        low, done = high, int(total[high - 1])
        fits = np.flatnonzero(size[i] <= most[j])
        for at in range(0, len(fits), 100_000):
            x, y = i[fits[at : at + 100_000]], j[fits[at : at + 100_000]]
            both = size[x] + size[y]
            want = np.ceil(threshold / (1 + threshold) * both - 1e-9).astype(np.int64)
            keep = maps.differ(owner[x], owner[y]) <= both - 2 * want
            if keep.any():
                yield np.stack((owner[x[keep]], owner[y[keep]]), axis=1)


PLACED = 8_000_000  #: placements in a bucket, about; more buckets ask for more copies of the bitmaps
_SORTED = 500_000  #: placements of a bucket that are joined together


def prefix_pairs(table: DataFrame, threshold: float) -> DataFrame:
    """``(a, b)``, a < b: every pair of classes that may reach ``threshold``, by their prefixes. ``table`` has (class, grams)."""
    held = table.sparkSession.sparkContext.broadcast(frequency_levels(table))  # 2 MB
    total = table.agg(F.coalesce(F.sum(F.length("grams")) / 5, F.lit(0))).first()[0]
    buckets = max(8, int(total * (1 - threshold)) // PLACED)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, first = np.unique(batch.column(0).to_numpy(), return_index=True)
            sets = [heads(batch.column(1)[i].as_buffer()) for i in first.tolist()]
            length = np.array([len(x) for x in sets])
            part = np.maximum.accumulate(np.maximum(np.cumsum(length) // 1_000_000, np.arange(len(sets)) // 2000)) if len(sets) else length
            for own in np.split(np.arange(len(sets)), np.flatnonzero(np.diff(part)) + 1):
                if not len(own):
                    continue
                sizes, flat = length[own], np.concatenate([sets[i] for i in own])
                maps = maps_of(flat, sizes)
                gram, owner, at = prefixes(flat, sizes, held.value, threshold)
                bucket = (mix64(gram) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                bucket = bucket[order]
                rows: list[tuple] = []
                for some in np.split(np.arange(len(order)), np.flatnonzero(np.diff(bucket)) + 1):
                    use = order[some]
                    who, counts = np.unique(owner[use], return_counts=True)
                    # the widths follow from the sizes; the narrower bitmaps come first
                    packed = b"".join(maps[w][1][np.isin(maps[w][0], who)].tobytes() for w in sorted(maps))
                    rows.append((int(bucket[some[0]]), ids[own[who]].tobytes(), _planes(sizes[who]), packed, _planes(counts), gram[use].tobytes(), _planes(at[use])))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in range(1, 7))], ["bucket", "classes", "sizes", "maps", "counts", "grams", "places"])

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(part: list[list[pa.Buffer]]) -> Iterator[pa.RecordBatch]:
            raw = lambda k, kind: np.concatenate([np.frombuffer(r[k], kind) for r in part])
            numbers = lambda k: [_numbers(r[k]) for r in part]
            bits: dict[int, list[np.ndarray]] = {}
            for row, own in zip(part, numbers(1)):
                width, at = _widths(own), 0
                for w in sorted(set(width.tolist())):
                    count = int((width == w).sum())
                    bits.setdefault(w, []).append(np.frombuffer(row[2], np.uint64, count * w // 64, at).reshape(count, -1))
                    at += count * w // 8
            sizes, classes, gram = np.concatenate(numbers(1)), raw(0, np.int64), raw(4, np.uint32)
            maps = Maps(sizes, {w: np.concatenate(x) for w, x in bits.items()})
            owner = np.repeat(np.arange(len(classes), dtype=np.int32), np.concatenate(numbers(3)))
            at = np.concatenate([_numbers(r[5]).astype(np.int32) for r in part])
            bits.clear()
            part.clear()
            # a class that stands in two splits counts once
            once = np.zeros(len(classes), bool)
            once[np.unique(classes, return_index=True)[1]] = True
            shares = len(gram) // _SORTED + 1
            for share in range(shares):
                use = np.flatnonzero((gram % np.uint32(shares) == share) & once[owner])
                codes = np.zeros(0, np.int64)
                for got in _listed_pairs(gram[use], owner[use].astype(np.int64), at[use].astype(np.int64), sizes, maps, threshold):
                    codes = np.concatenate((codes, got.min(axis=1) * len(classes) + got.max(axis=1)))
                    if len(codes) > 2_000_000:  # a pair that comes again after this is dropped by distinct
                        yield from rows_of(classes, codes)
                        codes = codes[:0]
                yield from rows_of(classes, codes)

        def rows_of(classes: np.ndarray, codes: np.ndarray) -> Iterator[pa.RecordBatch]:
            codes = np.unique(codes)
            for at in range(0, len(codes), 100_000):
                a, b = classes[codes[at : at + 100_000] // len(classes)], classes[codes[at : at + 100_000] % len(classes)]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        now, part = None, []
        for batch in batches:
            for r, bucket in enumerate(batch.column(0).to_pylist()):
                if bucket != now and part:
                    yield from flush(part)
                now = bucket
                part.append([batch.column(k)[r].as_buffer() for k in range(1, 7)])
        if part:
            yield from flush(part)

    placed = table.select("class", "grams").mapInArrow(place, "bucket int, classes binary, sizes binary, maps binary, counts binary, grams binary, places binary")
    return placed.repartitionById(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(join, "a bigint, b bigint").distinct()


def similar_classes(pages: DataFrame, threshold: float = 0.8, n: int = 5, least_words: int = 0, rows: int | None = None, bands: int = 144, block: int = 512, bucket_mb: int = 8, broadcast_classes: int = 1_000_000, exact: bool = True) -> tuple[DataFrame, DataFrame]:
    """``(members, links)``: members (page_id, class), and links (a, b), a < b, between classes that reach ``threshold``.

    ``class`` is a 64-bit fingerprint of the set of word ``n``-grams.  Null and short
    texts belong to no class.  ``page_id`` is the key: a repeated row adds nothing.  Every
    pair is found.  With ``exact=False`` classes meet under minhash keys and some pairs are
    lost; only then ``rows``, ``bands``, ``block`` and ``bucket_mb`` play a part.  A group of
    more than ``block`` classes under one key is compared block by block in separate rows, so
    no task holds more than two blocks' sketches at once. ``rows`` is 5, or fewer where the
    threshold is so low that most pairs at it would be missed otherwise.
    """
    rows = rows or max(1, min(5, int(np.log(1 - 0.015 ** (1 / bands)) / np.log(threshold)) if threshold < 1 else 5))
    base = spread(need(pages, "page_id", "content").where("content is not null"))
    kind = dict(base.dtypes)["page_id"]
    words: dict[str, int] = {}

    sketcher = _MinHash(SKETCH_BITS, seed=11)

    def sketch(grams: np.ndarray) -> bytes | None:
        return None if exact else np.packbits((sketcher((grams >> np.uint64(32)).astype(np.uint32)) >> np.uint32(7)) & np.uint32(1)).tobytes()

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        import xxhash

        if len(words) > 500_000:
            words.clear()
        got = shingle_sets(batch.column(1).to_pylist(), n, least_words, words)
        at = [i for i, s in enumerate(got) if s is not None]
        classes = [xxhash.xxh64_intdigest(got[i].tobytes()) for i in at]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(np.array(classes, np.uint64).view(np.int64)), pa.array([sketch(got[i]) for i in at], pa.binary()), pa.array([pack(got[i]) for i in at], pa.binary())], ["page_id", "class", "sketch", "grams"])

    table = cut_lineage(arrow_map(base, sets, f"page_id {kind}, class bigint, sketch binary, grams binary", text="content"))
    members = table.select("page_id", "class").distinct()
    count = table.count()
    buckets = max(48, count * bands * 12 // (bucket_mb << 20))
    shift = np.uint64(64 - 32)

    def keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash = _MinHash(rows * bands)
        for batch in batches:
            ids, first = np.unique(batch.column(0).to_numpy(), return_index=True)
            grams = batch.column(1)
            for low in range(0, len(ids), 4000):
                own, at = ids[low : low + 4000], first[low : low + 4000]
                key = np.concatenate([_band_keys(minhash(heads(grams[int(i)].as_buffer())), rows, bands) for i in at])
                owner = np.repeat(own, bands)
                # the bucket comes from the upper half of a key, so the lower half tells the keys of a bucket apart
                bucket = ((key >> shift) * np.uint64(buckets)) >> np.uint64(32)
                key = key.astype(np.uint32)
                order = np.lexsort((key, bucket))
                key, owner, bucket = key[order], owner[order], bucket[order]
                starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
                ends = np.append(starts[1:], len(bucket))
                yield pa.RecordBatch.from_arrays([pa.array(bucket[starts].astype(np.int64)), pa.array([key[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()), pa.array([owner[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary())], ["bucket", "keys", "owners"])

    packed = table.select("class", "grams").mapInArrow(keys, "bucket bigint, keys binary, owners binary")

    def groups(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups of classes under one key, as (id, member) rows; equal groups have equal ids."""

        def flush(part: list[tuple[bytes, bytes]]) -> pa.RecordBatch | None:
            key = np.frombuffer(b"".join(k for k, _ in part), np.uint32)
            owner = np.frombuffer(b"".join(o for _, o in part), np.int64)
            order = np.lexsort((owner, key))
            key, owner = key[order], owner[order]
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])))
            key, owner = key[new], owner[new]
            starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            size = np.diff(np.append(starts, len(key)))
            ids, who, side, seen = [], [], [], set()
            for s, m in zip(starts[size > 1].tolist(), size[size > 1].tolist()):
                blocks = [owner[at : min(at + block, s + m)] for at in range(s, s + m, block)]
                cells = [(i, j) for i in range(len(blocks)) for j in range(i, len(blocks))] if len(blocks) > 1 else [(0, 0)]
                for i, j in cells:
                    both = blocks[i] if i == j else np.concatenate((blocks[i], blocks[j]))
                    if len(both) < 2:
                        continue
                    weight = mix64(both.view(np.uint64) + np.uint64(0x9E37 * (len(blocks[i]) if i != j else 1)))
                    gid = int(np.bitwise_xor.reduce(weight)) ^ len(both)
                    if gid not in seen:
                        seen.add(gid)
                        ids.append(np.full(len(both), gid, np.uint64))
                        who.append(both)
            if not ids:
                return None
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids).view(np.int64)), pa.array(np.concatenate(who))], ["gid", "class"])

        # rows come sorted by bucket; a bucket's rows are held together
        now, part = None, []
        for batch in batches:
            for bucket, k, o in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if bucket != now and part:
                    out = flush(part)
                    if out is not None:
                        yield out
                    part = []
                now = bucket
                part.append((k, o))
        if part:
            out = flush(part)
            if out is not None:
                yield out

    # as many tasks as the keys need, whatever the session's number of shuffle partitions
    by_bucket = packed.repartition(buckets // 4, "bucket").sortWithinPartitions("bucket")
    grouped = by_bucket.mapInArrow(groups, "gid bigint, class bigint").distinct()
    sketches = table.select("class", "sketch").dropDuplicates(["class"])
    # bits differ with probability (1 - J) / 2
    p = (1 - threshold) / 2
    limit = int(SKETCH_BITS * p + 4 * (SKETCH_BITS * p * (1 - p)) ** 0.5 + 1)

    def screen(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(ids: list[int], data: list[bytes]) -> pa.RecordBatch:
            own = np.array(ids, np.int64)
            i, j = _pairs_in(own, np.frombuffer(b"".join(data), np.uint64).reshape(len(data), -1), limit)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(own[i], own[j])), pa.array(np.maximum(own[i], own[j]))], ["a", "b"])

        now, ids, data = None, [], []
        for batch in batches:
            for gid, c, s in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if gid != now:
                    if len(ids) > 1:
                        yield flush(ids, data)
                    now, ids, data = gid, [], []
                ids.append(c)
                data.append(s)
        if len(ids) > 1:
            yield flush(ids, data)

    if exact:
        screened = prefix_pairs(table, threshold)
    else:
        screened = grouped.join(sketches, "class").select("gid", "class", "sketch").repartition("gid").sortWithinPartitions("gid").mapInArrow(screen, "a bigint, b bigint")
    pairs = cut_lineage(screened.distinct())
    # The sets of the remaining classes only; the classes are broadcast up to a checked number.
    sides = cut_lineage(pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct())
    sides = F.broadcast(sides) if sides.count() <= broadcast_classes else sides
    sets_used = table.select("class", "grams").join(sides, "class", "left_semi").dropDuplicates(["class"])
    right = pairs.join(sets_used.select(F.col("class").alias("b"), F.col("grams").alias("b_grams")), "b")
    # a null partner carries the probing set itself, so that it travels once for each class
    stream = right.select("a", "b", F.col("b_grams").alias("grams")).unionByName(pairs.select("a").distinct().join(sets_used.withColumnRenamed("class", "a"), "a").select("a", F.lit(None).cast("bigint").alias("b"), "grams"))
    stream = stream.repartition("a").sortWithinPartitions("a", F.col("b").asc_nulls_first())

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(a: int, probe: np.ndarray, ids: list[int], data: list[np.ndarray]) -> pa.RecordBatch:
            hit = trie_join(probe, data, threshold)
            return pa.RecordBatch.from_arrays([pa.array([a] * len(hit), pa.int64()), pa.array([ids[i] for i in hit], pa.int64())], ["a", "b"])

        now, probe, ids, data = None, None, [], []
        for batch in batches:
            for a, b, grams in zip(*(batch.column(i).to_pylist() for i in range(3))):
                s = unpack(grams)
                if b is None:
                    if ids:
                        yield flush(now, probe, ids, data)
                    now, probe, ids, data = a, s, [], []
                    continue
                ids.append(b)
                data.append(s)
                if len(ids) >= 1024:  # a trie of bounded size
                    yield flush(now, probe, ids, data)
                    ids, data = [], []
        if ids:
            yield flush(now, probe, ids, data)

    return members, stream.mapInArrow(join, "a bigint, b bigint")


def similar_pairs(pages: DataFrame, threshold: float = 0.8, n: int = 5, least_words: int = 0, **options: int) -> DataFrame:
    """``(page_id_a, page_id_b)``, a < b, of all similar pages, copies included.

    Exact copies give all their pairs, so a group of k copies has k(k-1)/2 rows; use
    ``link_counts`` for one row per page instead.  Empty tables give no rows.
    """
    members, links = similar_classes(pages, threshold, n, least_words, **options)
    left = members.select(F.col("page_id").alias("x"), F.col("class").alias("a"))
    right = members.select(F.col("page_id").alias("y"), F.col("class").alias("b"))
    many = members.groupBy("class").count().where("count > 1").select("class")
    own = members.join(many, "class", "left_semi")
    copies = own.select(F.col("class"), F.col("page_id").alias("x")).join(own.select(F.col("class"), F.col("page_id").alias("y")), "class").where("x < y").select("x", "y")
    across = links.join(left, "a").join(right, "b").select("x", "y")
    return across.unionByName(copies).select(F.least("x", "y").alias("page_id_a"), F.greatest("x", "y").alias("page_id_b"))


def link_counts(pages: DataFrame, threshold: float = 0.8, n: int = 5, least_words: int = 0, **options: int) -> DataFrame:
    """``(page_id, class, copies, links)``: one row per page with the size of its class and the number of similar classes."""
    members, links = similar_classes(pages, threshold, n, least_words, **options)
    both = links.select(F.col("a").alias("class")).unionAll(links.select(F.col("b").alias("class"))).groupBy("class").agg(F.count("*").alias("links"))
    copies = members.groupBy("class").agg(F.count("*").alias("copies"))
    return members.join(copies, "class").join(both, "class", "left").select("page_id", "class", "copies", F.coalesce("links", F.lit(0)).alias("links"))
