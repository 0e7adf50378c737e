"""The ``get`` operator: HTML rows to content rows, then limits, usage and the result record."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..page import Options, Page, extract_page
from ..session import spread

EXTRACTED = "ok boolean, error struct<code:string,message:string>, final_url string, content string, page_metadata map<string,string>, warnings array<string>, source_bytes bigint, needs_render boolean"
_FIELDS = pa.struct(
    [("ok", pa.bool_()), ("error", pa.struct([("code", pa.string()), ("message", pa.string())])), ("final_url", pa.string()), ("content", pa.string()), ("page_metadata", pa.map_(pa.string(), pa.string())), ("warnings", pa.list_(pa.string())), ("source_bytes", pa.int64()), ("needs_render", pa.bool_())]
)
Extractor = Callable[[str, str | None, Options], Page]


def _row(url: str | None, source: str | None, options: Options, extractor: Extractor) -> dict:
    page = extractor(url or "", source, options)
    return {
        "ok": page.error is None, "error": page.error and {"code": page.error[0], "message": page.error[1]}, "final_url": url, "content": page.content,
        "page_metadata": sorted(page.metadata.items()), "warnings": page.warnings, "source_bytes": None if source is None else len(source.encode("utf-8", "surrogatepass")), "needs_render": page.needs_render,
    }


def get(df: DataFrame, options: Options = Options(), url_col: str = "url", html_col: str = "html", keep: Iterable[str] = (), extractor: Extractor = extract_page) -> DataFrame:
    """The kept columns and the extraction of each row; one narrow stage, each page parsed once.

    A null text gives ``ok`` false with an error record; no row raises.  ``extractor``
    replaces the built-in one. Columns that aren't kept are pruned from the scan.
    """
    kept = list(keep)
    inner = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{url_col}`").alias("__url"), F.col(f"`{html_col}`").alias("__html"))
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                rows = [_row(u, h, options, extractor) for u, h in zip(part.column(len(kept)).to_pylist(), part.column(len(kept) + 1).to_pylist())]
                out = pa.array(rows, _FIELDS)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *out.flatten()], [*kept, *(f.name for f in _FIELDS)])

    out = spread(inner).mapInArrow(run, f"{fields}, {EXTRACTED}" if kept else EXTRACTED)
    return with_limits(out, options.max_chars) if options.max_chars is not None else out


def with_limits(df: DataFrame, max_chars: int | None, content: str = "content") -> DataFrame:
    """``content`` cut to its first ``max_chars`` code points, and the record of the cut."""
    before = F.char_length(content).cast("bigint")
    cut = F.lit(False) if max_chars is None else before > max_chars
    limits = F.struct(
        F.lit(max_chars).cast("bigint").alias("max_chars"), cut.alias("truncated"), F.when(cut, "max_chars").alias("truncated_by"),
        before.alias("chars_before"), (before if max_chars is None else F.least(before, F.lit(max_chars).cast("bigint"))).alias("chars_after"),
    )
    out = df.withColumn("limits", limits)
    return out if max_chars is None else out.withColumn(content, F.expr(f"left(`{content}`, {int(max_chars)})"))


def tokens(chars: Column) -> Column:
    """A quarter of the length, rounded up."""
    return F.ceil(chars / 4).cast("bigint")


def with_usage(df: DataFrame, content: str = "content", source_bytes: str | None = "source_bytes") -> DataFrame:
    """``usage``: bytes fetched and kept, estimated tokens, and tokens saved against the source."""
    used = tokens(F.char_length(content))
    fetched = F.col(source_bytes).cast("bigint") if source_bytes else F.lit(None).cast("bigint")
    return df.withColumn("usage", F.struct(fetched.alias("fetched_bytes"), F.octet_length(content).cast("bigint").alias("content_bytes"), used.alias("estimated_tokens"), F.greatest(F.lit(0).cast("bigint"), tokens(fetched) - used).alias("estimated_tokens_saved")))


def envelope(df: DataFrame, command: str, data: Iterable[str], inline: str = "auto", sensitive: str = "sensitive", timing_ms: Column | None = None) -> DataFrame:
    """One JSON document a row; ``content`` is left out of sensitive rows unless ``inline`` is ``always``, and of all if ``never``."""
    if inline not in ("auto", "always", "never"):
        raise ValueError(f"inline must be auto, always or never, not '{inline}'")
    names = list(data)
    shown = {"always": F.lit(True), "never": F.lit(False)}.get(inline, ~F.coalesce(F.col(sensitive), F.lit(False)))
    fields = [F.when(shown, F.col(n)).alias(n) if n == "content" else F.col(n) for n in names]
    ok = F.col("ok") if "ok" in df.columns else F.lit(True)
    warnings = F.col("warnings") if "warnings" in df.columns else F.array().cast("array<string>")
    return df.withColumn("envelope", F.to_json(F.struct(ok.alias("ok"), F.lit("pagelake.envelope.v1").alias("schema_version"), F.lit(command).alias("command"), F.struct(*fields).alias("data"), warnings.alias("warnings"), F.struct((timing_ms if timing_ms is not None else F.lit(0)).cast("bigint").alias("total")).alias("timing_ms"))))


def finalize(extracted: DataFrame, command: str = "get", max_chars: int | None = None, debug: bool = False, inline: str = "auto", keep: Iterable[str] = (), sensitive: str = "sensitive") -> DataFrame:
    """What ``get`` gives, brought to its last form in order: limits, usage, the debug trace if asked for, and the record.

    Adds ``limits`` (unless they are there), ``usage``, ``debug_trace`` and ``envelope``; the
    kept columns become part of the record.
    """
    out = extracted if "limits" in extracted.columns else with_limits(extracted, max_chars)
    out = with_usage(out)
    if sensitive not in out.columns:
        out = out.withColumn(sensitive, F.lit(False))
    if debug:
        out = out.withColumn("debug_trace", F.to_json(F.struct(F.lit("pagelake.debug_trace.v1").alias("schema_version"), "final_url", "needs_render", "source_bytes", "ok")))
    return envelope(out, command, [*keep, "final_url", "content", "page_metadata", "limits", "usage", "error"], inline, sensitive)
