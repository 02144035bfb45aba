"""A paged HTTP source of JSON results, as a Spark data source: one partition for each run of pages."""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.request import urlopen

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class PageRange(InputPartition):
    def __init__(self, start: int, stop: int) -> None:
        self.start, self.stop = start, stop


class PagedJsonSource(DataSource):
    """Options: url, start (1 at least), length (rows a page, 10 at least), partitions.

    Register with ``spark.dataSource.register(PagedJsonSource)``; rows are (fields map<string, string>).
    """

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "fields map<string,string>"

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(self.options)


class _PagedReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.url = options["url"]
        self.first = max(1, int(options.get("start", 1)))
        self.length = max(10, int(options.get("length", 1000)))
        self.count = max(1, int(options.get("partitions", 8)))

    def _page(self, start: int) -> dict:
        sign = "&" if "?" in self.url else "?"
        with urlopen(f"{self.url}{sign}sn={start}&ln={self.length}", timeout=60) as reply:
            return json.load(reply)

    def partitions(self) -> list[InputPartition]:
        total = int(self._page(self.first).get("total_count", 0))
        starts = list(range(self.first, max(total, self.first) + 1, self.length)) if total >= self.first else []
        size = -(-len(starts) // self.count) or 1
        return [PageRange(starts[k], starts[min(k + size, len(starts)) - 1] + self.length) for k in range(0, len(starts), size)]

    def read(self, partition: PageRange) -> Iterator[tuple]:
        for start in range(partition.start, partition.stop, self.length):
            for row in self._page(start).get("result", []):
                yield ({k: None if v is None else str(v) for k, v in row.items()},)
