"""The catalog of stored runs: listing, inspection, deletion and pruning."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.paths import plain_path
from .running import running_before


def parse_duration(text: str) -> int:
    """Seconds of ``7d``, ``12h``, ``30m``, ``45s`` or a bare number."""
    m = re.fullmatch(r"\s*(\d+)\s*([smhd]?)\s*", text)
    if not m:
        raise ValueError(f"'{text}' is no duration")
    return int(m.group(1)) * {"": 1, "s": 1, "m": 60, "h": 3600, "d": 86400}[m.group(2)]


def age_label(seconds: Column) -> Column:
    """The largest whole unit of an age."""
    out = F.concat(seconds.cast("string"), F.lit("s"))
    for size, unit in ((60, "m"), (3600, "h"), (86400, "d")):
        out = F.when(seconds >= size, F.concat(F.floor(seconds / size).cast("string"), F.lit(unit))).otherwise(out)
    return out


def runs(df: DataFrame, now: Column, run_id: str = "run_id", modified: str = "modified", size: str = "size_bytes", inside: Column | None = None) -> DataFrame:
    """Runs with age, label and whether their files lie inside the store."""
    age = F.when(F.col(modified).isNotNull(), F.greatest(F.lit(0).cast("bigint"), now.cast("bigint") - F.col(modified).cast("bigint")))
    return df.withColumns({"age_seconds": age, "age": age_label(age), "ownership": F.when(inside if inside is not None else F.lit(True), "internal").otherwise("external")})


def listing(df: DataFrame, modified: str = "modified", run_id: str = "run_id", limit: int | None = None) -> DataFrame:
    """Newest first; ties by id."""
    out = df.orderBy(F.desc(modified), run_id)
    return out if limit is None else out.limit(limit)


def summary(df: DataFrame, size: str = "size_bytes", sensitive: str = "sensitive", malformed: str | None = None) -> DataFrame:
    bad = F.count_if(F.col(malformed)) if malformed else F.lit(0).cast("bigint")
    return df.agg(F.count("*").alias("count"), F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("total_size_bytes"), F.count_if(F.col(sensitive)).alias("sensitive_count"), bad.alias("malformed_count"))


def inspect(df: DataFrame, url: str = "url", sensitive: str = "sensitive") -> DataFrame:
    """URLs of sensitive runs lose their query and fragment."""
    return df.withColumn(url, F.when(F.coalesce(F.col(sensitive), F.lit(False)), U.redact_url(F.col(url))).otherwise(F.col(url)))


def check_run_id(run_id: str) -> None:
    """Raises unless the id can name a run folder."""
    if not run_id.startswith("run-") or not re.fullmatch(r"[A-Za-z0-9._-]+", run_id):
        raise ValueError(f"'{run_id}' is no run id")


def delete(df: DataFrame, run_ids: list[str], confirmed: bool, run_id: str = "run_id") -> DataFrame:
    """The catalog without the named runs; deletion must be confirmed."""
    if not confirmed:
        raise ValueError("deleting runs needs confirmation")
    for r in run_ids:
        check_run_id(r)
    return df.where(~F.col(run_id).isin(*run_ids)) if run_ids else df


def prune(df: DataFrame, older_than: int | None = None, keep_last: int | None = None, max_bytes: int | None = None, run_id: str = "run_id", modified: str = "modified", size: str = "size_bytes", age: str = "age_seconds", store: str | None = None) -> DataFrame:
    """The runs to delete.

    The newest ``keep_last`` are protected, and alone it deletes all others. ``older_than``
    selects what is strictly older. ``max_bytes`` then selects the oldest unprotected runs
    until what stays fits. Runs of equal age go by id. ``store`` names the column that
    tells stores apart. A run without a time counts as the oldest, one without a size as empty.
    """
    if older_than is None and keep_last is None and max_bytes is None:
        raise ValueError("pruning needs at least one of older_than, keep_last and max_bytes")
    part = [store] if store else []
    columns = [*dict.fromkeys([*part, run_id, modified, size, age])]
    out = df.select(*columns)
    weight = F.coalesce(F.col(size), F.lit(0))
    kept = F.lit(False)
    if keep_last is not None:
        out = running_before(out, part, F.lit(1), modified, ties=[run_id], descending=True)
        kept = F.col("__before") < keep_last
    out = out.withColumn("__kept", kept).drop("__before")
    chosen = F.lit(False)
    if older_than is not None:
        chosen = ~F.col("__kept") & (F.coalesce(F.col(age), F.lit(1 << 62)) > older_than)
    elif max_bytes is None:
        chosen = ~F.col("__kept")
    out = out.withColumn("__chosen", chosen)
    if max_bytes is not None:
        out = running_before(out, part, F.when(F.col("__kept") | F.col("__chosen"), 0).otherwise(weight), modified, ties=[run_id])
        stays = F.sum(F.when(F.col("__chosen"), 0).otherwise(weight)).alias("__stays")
        out = out.withColumn("__store", F.struct(*part, F.lit(0)))  # null stores are equal
        out = out.join(out.groupBy("__store").agg(stays), "__store")
        out = out.withColumn("__chosen", F.col("__chosen") | ~F.col("__kept") & (F.col("__stays") - F.col("__before") > max_bytes))
    return out.where("__chosen").select(*columns)


def prune_result(df: DataFrame, apply: bool = False, dry_run: bool = False, size: str = "size_bytes", run_id: str = "run_id", **criteria) -> tuple[DataFrame, DataFrame]:
    """(the catalog afterwards, one row a selected run: ``(run_id, size_bytes, action)``).

    Without ``apply`` nothing goes and the action is ``would_delete``; asking for both
    ``apply`` and ``dry_run`` is an error. ``criteria`` are those of ``prune``.
    """
    if apply and dry_run:
        raise ValueError("a dry run can't be applied")
    chosen = prune(df, size=size, run_id=run_id, **criteria)
    rows = chosen.select(run_id, F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("size_bytes"), F.lit("deleted" if apply else "would_delete").alias("action"))
    return (df.join(chosen.select(run_id), run_id, "left_anti") if apply else df), rows


def file_entries(df: DataFrame, files: DataFrame, root: str, run_id: str = "run_id", metadata: str = "metadata") -> DataFrame:
    """``(run_id, path, kind, ownership, exists, size_bytes)``: the files that each run names in its record, and whether they are there.

    ``metadata`` is the run's record as JSON: its own file, the content, debug traces and
    captures of actions. ``files`` has ``(path, size_bytes)`` of what is stored. A file
    outside the run's folder under ``root`` is external. Runs without a readable record
    have the first two entries, with the places that runs have by default.
    """
    m = F.col(metadata)
    home = F.concat(F.lit(root.rstrip("/") + "/"), F.col(run_id))
    listed = lambda path: F.coalesce(F.from_json(F.get_json_object(m, path), "array<string>"), F.array().cast("array<string>"))
    entry = lambda path, kind: F.struct(path.alias("path"), F.lit(kind).alias("kind"))
    named = F.concat(
        F.array(entry(F.concat(home, F.lit("/metadata.json")), "metadata"), entry(F.coalesce(F.get_json_object(m, "$.artifacts.content"), F.concat(home, F.lit("/content.md"))), "content")),
        F.transform(listed("$.artifacts.debug"), lambda p: entry(p, "debug")), F.transform(listed("$.artifacts.captures"), lambda p: entry(p, "capture")),
    )
    rows = df.select(run_id, home.alias("__home"), F.explode(named).alias("f")).select(run_id, "__home", "f.*")
    there = files.groupBy(F.col("path").alias("__path")).agg(F.max("size_bytes").alias("size_bytes"))
    owned = F.when(F.coalesce(plain_path(F.col("path")).startswith(F.concat(F.col("__home"), F.lit("/"))), F.lit(False)), "internal").otherwise("external")
    return rows.join(there, F.col("path") == F.col("__path"), "left").select(run_id, "path", "kind", owned.alias("ownership"), F.col("__path").isNotNull().alias("exists"), F.coalesce("size_bytes", F.lit(0)).cast("bigint").alias("size_bytes"))
