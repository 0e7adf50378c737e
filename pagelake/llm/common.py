"""Shared pieces of the training-data operators."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a longest run of letters and digits.
WORD = re.compile(r"[^\W_]+")
TAG = re.compile(r"<[^>\n]*>")


def drop_tags(content: str) -> str:
    """``content`` without ``<...>`` within a line; the part of a line behind its last ``>`` holds none and isn't searched."""
    if "<" not in content:
        return content
    out = []
    for line in content.split("\n"):
        end = line.rfind(">") + 1
        out.append(TAG.sub("", line[:end]) + line[end:] if "<" in line and end else line)
    return "\n".join(out)


_SITE = r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:\s]*)"


def site_of(final_url: Column, url: Column) -> Column:
    """Host of ``final_url`` (of ``url`` if null): lower case, no port, no leading ``www.``; '' if there is none."""
    host = F.lower(F.regexp_extract(F.coalesce(final_url, url, F.lit("")), _SITE, 1))
    return F.regexp_replace(host, r"^www\.", "")


def path_of(final_url: Column, url: Column) -> Column:
    """Path of the page's address, without query and fragment; '' if there is none."""
    return F.regexp_extract(F.coalesce(final_url, url, F.lit("")), r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def need(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns only, so that any further ones, whatever their names, play no part."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def slices(batch: pa.RecordBatch, text: str, chars: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """``batch`` in consecutive parts of about ``chars`` bytes of column ``text``; one row is never cut."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(sizes) // chars
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def arrow_map(df: DataFrame, one: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, text: str | None = None) -> DataFrame:
    """``mapInArrow`` with ``one`` called for each batch, cut to bounded text sizes if ``text`` names a column."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text) if text else (batch,):
                out = one(part)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit values (xor-shift and multiplication)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def list_array(offsets: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)
