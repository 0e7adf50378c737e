"""File paths as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain_path(path: Column) -> Column:
    """``path`` without ``.``, ``..`` and doubled slashes, as far as names alone can tell; null if it leads above its root."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    # each ".." takes the last name before it away; one too many leaves a mark
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda done, p: F.when(p != "..", F.array_append(done, p)).when(F.size(done) == 0, F.array(F.lit("/"))).otherwise(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))))
    rooted = F.when(path.startswith("/"), "/").otherwise("")
    return F.when(~F.array_contains(walked, "/"), F.concat(rooted, F.array_join(walked, "/")))
