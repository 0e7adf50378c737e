"""Splitting oversized texts at natural boundaries with overlap (problem 1).

A text is cut into ranges; a worker sees one range and a halo of one piece length
behind it.  The rule that leads from the start of a piece to the start of the next
looks at most one piece length ahead, so a worker can follow it without the rest of
the text.  It does not know where its first piece starts, but that start lies within
one piece length of the range's begin, so it notes for every possible entry the exit
into the next range and the number of pieces between (its boundary table; chains meet
after a few pieces, so runs of entries share one exit and are stored once).  Stitching
the tables in order and summing up lengths and piece counts gives each range its entry
and its first piece number; a second look at the range emits its pieces by offset.

Texts of at most one range need no stitching and are emitted at once, without a shuffle.
``split_files`` does the same over byte ranges of files that no worker reads as a whole.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import arrow_map, need


@dataclass(frozen=True)
class PieceRule:
    """At most ``limit`` characters a piece, cut beyond ``least``, overlapping by up to ``overlap``.

    A boundary is, in order of preference: after an empty line, after a line end, after
    the end of a sentence, after a blank, and at the limit.
    """

    limit: int = 1200
    least: int = 600
    overlap: int = 150

    def end(self, text: str, s: int) -> int:
        """End of the piece that starts at ``s`` and isn't the last."""
        low, high = s + self.least, s + self.limit
        # the position e after a two-character boundary at i is i + 2, so i starts at low - 1
        i = text.rfind("\n\n", max(0, low - 1), high)
        if i >= 0:
            return i + 2
        i = text.rfind("\n", low, high)
        if i >= 0:
            return i + 1
        e = max(text.rfind(c, low, high) + 1 for c in "。！？")
        e = max(e, *(text.rfind(c, max(0, low - 1), high) + 2 for c in (". ", "! ", "? ")))
        if e > low:
            return e
        i = text.rfind(" ", low, high)
        return i + 1 if i >= 0 else high

    def next_start(self, text: str, e: int) -> int:
        a, b = text.find(" ", e - self.overlap - 1, e - 1), text.find("\n", e - self.overlap - 1, e - 1)
        i = min(x for x in (a, b) if x >= 0) if max(a, b) >= 0 else -1
        return i + 1 if i >= 0 else e - self.overlap

    def pieces(self, text: str, s: int = 0, stop: int | None = None, remaining: int | None = None) -> tuple[list[tuple[int, int]], int]:
        """Pieces that start before ``stop``, and the start of the next (the text's length after the last).

        ``remaining``: characters from 0 to the end of the whole text, of which ``text`` may lack the tail.
        """
        n = len(text) if remaining is None else remaining
        stop = n if stop is None else stop
        out = []
        while s < stop:
            if n - s <= self.limit:
                out.append((s, n))
                return out, n
            e = self.end(text, s)
            out.append((s, e))
            s = self.next_start(text, e)
        return out, s

    def table(self, text: str, stop: int, remaining: int | None, first: bool) -> list[tuple[int, int, int]]:
        """(entry, exit, pieces) of a range: runs of equal exits, each named by its smallest entry.

        Exits count from ``stop``; -1 says that the text ends here.
        """
        n = remaining
        memo: dict[int, tuple[int, int]] = {}

        def follow(s: int) -> tuple[int, int]:
            path = []
            while s < stop and s not in memo:
                path.append(s)
                if n is not None and n - s <= self.limit:
                    memo[s] = (-1, 1)
                    path.pop()
                    break
                s = self.next_start(text, self.end(text, s))
            base = memo[s] if s in memo else (s - stop, 0)
            for p in reversed(path):
                base = memo[p] = (base[0], base[1] + 1)
            return base

        out: list[tuple[int, int, int]] = []
        for entry in range(0, 1 if first else min(self.limit, stop)):
            exit_, count = follow(entry)
            if not out or out[-1][1:] != (exit_, count):
                out.append((entry, exit_, count))
        return out


def stitch(tables: list[list[tuple[int, int, int]]], entry: int = 0, number: int = 1) -> list[tuple[int, int]]:
    """Entry and number of the first piece of each range, from the tables in order, and of what follows; (-1, ...) after the text's end."""
    out = [(entry, number)]
    for table in tables:
        if entry >= 0:
            _, exit_, count = table[bisect.bisect_right([t[0] for t in table], entry) - 1]
            entry, number = exit_, number + count
        out.append((entry, number))
    return out


def _entries(jumps: DataFrame, schema: str) -> DataFrame:
    """The columns of ``schema`` (the first two name a text and a range) with ``entry``, ``number`` and ``before``, of ranges in which pieces start.

    The ranges of a text pass in order, and only its running entry, piece number and
    number of characters are held, so that a text may have any number of ranges.
    """
    key = jumps.columns[:2]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, entry, number, before = None, None, 0, 1, 0
        for batch in batches:
            kept, rows = [], []
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (*key, "chars", "jumps")]
            for i, (text, k, chars, table) in enumerate(zip(*columns)):
                if text != now or last is None:
                    now, last, entry, number, before = text, None, 0, 1, 0
                if k == last:  # a repeated row
                    continue
                last = k
                if entry >= 0:
                    kept.append(i)
                    rows.append((entry, number, before))
                ((entry, number),) = stitch([[(j["a"], j["b"], j["c"]) for j in table]], entry, number)[1:]
                before += chars
            got = batch.select([n for n in batch.schema.names if n not in ("chars", "jumps")]).take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*got.columns, *(pa.array([r[i] for r in rows], pa.int64()) for i in range(3))], [*got.schema.names, "entry", "number", "before"])

    return jumps.repartition(key[0]).sortWithinPartitions(*key).mapInArrow(run, f"{schema}, entry bigint, number bigint, before bigint")


def split_texts(df: DataFrame, key: str, text: str, rule: PieceRule = PieceRule(), range_chars: int = 262_144) -> DataFrame:
    """``(key, piece_no, piece_start, piece_end)`` for each row; positions count characters of ``text``.

    Null and empty texts have no pieces; a text within the limit is one piece; equal
    rows under different keys are split each.  ``key`` must be unique: a repeated row
    gives its pieces once.  Further columns are ignored; an empty table gives no rows.
    """
    if range_chars < 4 * rule.limit:
        raise ValueError("a range must hold at least four pieces")
    kind = dict(df.dtypes)[key]
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).where("length(text) > 0")
    schema = f"key {kind}, piece_no bigint, piece_start bigint, piece_end bigint"
    names = ["key", "piece_no", "piece_start", "piece_end"]

    def direct(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, no, start, end = [], [], [], []
        for i, t in enumerate(batch.column(1).to_pylist()):
            for k, (s, e) in enumerate(rule.pieces(t)[0]):
                at.append(i)
                no.append(k + 1)
                start.append(s)
                end.append(e)
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(x, pa.int64()) for x in (no, start, end))], names)

    small = arrow_map(rows.where(F.length("text") <= range_chars), direct, schema, text="text")
    # Longer texts: one row a range, each with its halo, all cut in one pass over the text.
    # The last range takes the rest, so it has at least one range's length.
    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, no, stops, last, parts = [], [], [], [], []
        for i, t in enumerate(batch.column(1).to_pylist()):
            count = len(t) // range_chars
            for k in range(count):
                low, high = k * range_chars, len(t) if k == count - 1 else (k + 1) * range_chars
                at.append(i)
                no.append(k)
                stops.append(high - low)
                last.append(k == count - 1)
                parts.append(t[low : high + rule.limit])
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(no, pa.int64()), pa.array(stops, pa.int64()), pa.array(last, pa.bool_()), pa.array(parts, pa.string())], ["key", "k", "stop", "last", "part"])

    ranges = arrow_map(rows.where(F.length("text") > range_chars), cut, f"key {kind}, k bigint, stop bigint, last boolean, part string", text="text")

    def tables(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for k, stop, final, part in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4))):
            table = rule.table(part, stop, len(part) if final else None, k == 0)
            out.append([{"a": a, "b": b, "c": c} for a, b, c in table])
        kinds = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("c", pa.int64())]))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out, kinds)], ["key", "k", "chars", "jumps"])

    jumps = arrow_map(ranges, tables, f"key {kind}, k bigint, chars bigint, jumps array<struct<a:bigint,b:bigint,c:bigint>>", text="part")

    entries = _entries(jumps, f"key {kind}, k bigint")

    def emit(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, no, start, end = [], [], [], []
        for i, (k, stop, final, part, entry, number) in enumerate(zip(*(batch.column(j).to_pylist() for j in range(1, 7)))):
            for j, (s, e) in enumerate(rule.pieces(part, entry, stop, len(part) if final else 1 << 60)[0]):
                at.append(i)
                no.append(number + j)
                start.append(k * range_chars + s)
                end.append(k * range_chars + e)
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(x, pa.int64()) for x in (no, start, end))], names)

    big = arrow_map(ranges.join(entries, ["key", "k"]).select("key", "k", "stop", "last", "part", "entry", "number"), emit, schema, text="part")
    return small.unionByName(big)


def split_files(spark: SparkSession, paths: list[str] | DataFrame, rule: PieceRule = PieceRule(), range_bytes: int = 8 << 20) -> DataFrame:
    """``(path, piece_no, piece_start, piece_end, byte_start, byte_end)`` of UTF-8 files on a shared file system.

    ``paths``: addresses that ``pyarrow.fs`` opens (``hdfs://``, ``s3://``, ``file://`` or
    plain paths), as a list or as a table with a column ``path``. No task reads more than
    one byte range and its halo, and the ranges are planned by the tasks too. Positions
    count characters, which a prefix sum over the ranges' lengths makes absolute. Empty
    files have no pieces; bytes that aren't UTF-8 count as one replacement character each;
    a path given twice is read once.
    """
    halo = 4 * rule.limit + 4
    if range_bytes < 4 * halo:
        raise ValueError(f"a range must hold at least {4 * halo} bytes")
    listed = paths.select("path") if isinstance(paths, DataFrame) else spark.createDataFrame([(p,) for p in paths], "path string")

    def opened(path: str) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)

    def plan(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for path in batch.column(0).to_pylist():
            system, inner = opened(path)
            size = system.get_file_info(inner).size or 0
            count = max(1, size // range_bytes)
            rows += [(path, k, k * range_bytes, size if k == count - 1 else (k + 1) * range_bytes, size) for k in range(count if size else 0)]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(1, 5))], ["path", "k", "low", "high", "size"])

    # dealt out by range, so that one file is read by many tasks
    ranges = cut_lineage(arrow_map(listed.where("path is not null").distinct(), plan, "path string, k bigint, low bigint, high bigint, size bigint").repartition("path", "k"))

    def read(path: str, low: int, high: int, size: int) -> tuple[str, int, bool, int]:
        """Text of the range and its halo, characters of the range, whether it is the last, first whole byte."""
        system, inner = opened(path)
        with system.open_input_file(inner) as f:
            data = f.read_at(min(size, high + halo) - low, low)
        skip = 0
        while low and skip < 3 and skip < len(data) and data[skip] & 0xC0 == 0x80:
            skip += 1
        edge = high - low
        while high < size and edge < len(data) and edge < high - low + 3 and data[edge] & 0xC0 == 0x80:
            edge += 1
        text = data[skip:edge].decode("utf-8", "replace")
        return text + data[edge:].decode("utf-8", "replace"), len(text), high == size, low + skip

    def tables(batch: pa.RecordBatch) -> pa.RecordBatch:
        out, sizes = [], []
        for path, k, low, high, size in zip(*(batch.column(i).to_pylist() for i in range(5))):
            text, stop, final, _ = read(path, low, high, size)
            sizes.append(stop)
            out.append([{"a": a, "b": b, "c": c} for a, b, c in rule.table(text, stop, len(text) if final else None, k == 0)])
        kinds = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("c", pa.int64())]))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64()), pa.array(out, kinds)], ["path", "k", "low", "high", "size", "chars", "jumps"])

    base = "path string, k bigint, low bigint, high bigint, size bigint"

    jumps = arrow_map(ranges, tables, f"{base}, chars bigint, jumps array<struct<a:bigint,b:bigint,c:bigint>>")
    entries = _entries(jumps, base)

    def emit(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for path, _, low, high, size, entry, number, before in zip(*(batch.column(i).to_pylist() for i in range(8))):
            text, stop, final, begin = read(path, low, high, size)
            at, byte = 0, begin
            for j, (s, e) in enumerate(rule.pieces(text, entry, stop, len(text) if final else 1 << 60)[0]):
                byte, at = byte + len(text[at:s].encode()), s
                rows.append((path, number + j, before + s, before + e, byte, byte + len(text[s:e].encode())))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(1, 6))], ["path", "piece_no", "piece_start", "piece_end", "byte_start", "byte_end"])

    return arrow_map(entries.repartition("path", "k"), emit, "path string, piece_no bigint, piece_start bigint, piece_end bigint, byte_start bigint, byte_end bigint")


def section_pieces(sections: DataFrame, artifacts: DataFrame, rule: PieceRule = PieceRule(), range_chars: int = 4800) -> DataFrame:
    """``(section_key, piece_no, piece_start, piece_end)`` of the sections longer than the limit.

    Positions are places in the artifact's ``content``: the section's true start there
    plus the position in its text.  The stored ``char_start`` is taken where the text
    stands at it; otherwise the place is searched for.  A section whose artifact or
    text place can't be found keeps its stored start, or 0 if that is null.
    """
    long = need(sections, "section_key", "artifact_id", "text", "char_start").where(F.length("text") > rule.limit)
    whole = need(artifacts, "artifact_id", "content").where("content is not null").withColumnRenamed("content", "whole")
    stands = F.expr("char_start >= 0 and substring(whole, cast(char_start + 1 as int), length(text)) = text")
    placed = long.join(whole, "artifact_id", "left").select(
        "section_key", "text",
        F.coalesce(F.when(stands, F.col("char_start")), F.expr("nullif(instr(whole, text), 0) - 1"), F.col("char_start"), F.lit(0)).cast("bigint").alias("base"),
    )
    # The start rides along in the key, so the text is joined once and never shuffled again.
    keyed = placed.select(F.struct("section_key", "base").alias("key"), "text")
    pieces = split_texts(keyed, "key", "text", rule, range_chars)
    base = F.col("key.base")
    return pieces.select(F.col("key.section_key").alias("section_key"), "piece_no", (base + F.col("piece_start")).alias("piece_start"), (base + F.col("piece_end")).alias("piece_end"))
