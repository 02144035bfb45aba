"""Pages of a sorted result that lie anywhere in it, without bringing what is before them to one task."""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a row's place within its partition in ``monotonically_increasing_id``.
_PLACE_BITS = 33


@dataclass(frozen=True)
class RankedPages:
    """A stored result: a folder for each range of the order, and how many rows lie before each."""

    table: DataFrame
    parts: tuple[int, ...]
    before: tuple[int, ...]
    total: int
    columns: tuple[str, ...]

    def page(self, start: int = 0, size: int = 20, names: list[str] | None = None) -> DataFrame:
        """The rows from ``start`` on with ``_rownum``, and for the columns ``names`` their values as ``_sort``.

        Only the folders that the page lies in are read.
        """
        stop = min(start + size, self.total)
        first, last = max(bisect_right(self.before, start) - 1, 0), bisect_right(self.before, stop - 1)
        chosen = dict(list(zip(self.parts, self.before))[first:last]) if start < stop else {}
        if not chosen:
            rows = self.table.where("false").withColumn("_rownum", F.lit(0).cast("long"))
        else:
            offset = F.element_at(F.create_map(*[F.lit(x).cast("long") for pair in chosen.items() for x in pair]), F.col("__part").cast("long"))
            rows = self.table.where(F.col("__part").isin(list(chosen))).withColumn("_rownum", F.col("__place") + offset)
            rows = rows.where(F.col("_rownum").between(start, stop - 1))
        out = rows.select(*self.columns, "_rownum")
        return out.withColumn("_sort", F.array(*[F.col(n).cast("string") for n in names])) if names else out


def store_ranked(hits: DataFrame, order: list[Column], path: str) -> RankedPages:
    """Sort ``hits`` over all tasks and store them under ``path`` for pages; ``order`` should end in a unique column.

    The number of rows of each range comes back to the driver, one number for each partition of the sort.
    """
    place = F.monotonically_increasing_id()
    placed = hits.orderBy(*order).withColumn("__id", place)
    split = placed.select(*hits.columns, F.shiftright("__id", _PLACE_BITS).cast("int").alias("__part"), F.col("__id").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)).alias("__place"))
    split.write.partitionBy("__part").parquet(path)
    table = hits.sparkSession.read.schema(split.schema).parquet(path)
    sizes = {r["__part"]: r["n"] for r in table.groupBy("__part").agg(F.count("*").alias("n")).collect()}
    parts = tuple(sorted(sizes))
    ends = tuple(accumulate(sizes[p] for p in parts))
    return RankedPages(table, parts, (0, *ends[:-1]) if ends else (), ends[-1] if ends else 0, tuple(hits.columns))
