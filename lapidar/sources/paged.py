"""A paged search service as a data source: one partition per page, filters handed to the service."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition, IsNotNull

class _Page(InputPartition):
    def __init__(self, page: int):
        self.page = page


class PagedReader(DataSourceReader):
    def __init__(self, options: dict, fetch: Callable[[dict], dict]):
        self.options, self.fetch, self.filters = options, fetch, []

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("language",):
                self.filters.append(f'language:"{f.value}"')
            elif isinstance(f, IsNotNull) and f.attribute == ("url",):
                self.filters.append("url:[* TO *]")
            yield f  # checked again here, as the service's notion may be wider

    def _ask(self, page: int) -> dict:
        return self.fetch({"type": self.options.get("type", "AllFields"), "filter[]": list(self.filters), "page": page, "limit": int(self.options.get("limit", 100))})

    def partitions(self) -> list[_Page]:
        total, limit = int(self._ask(0).get("resultCount", 0)), int(self.options.get("limit", 100))
        return [_Page(i) for i in range(max(1, -(-total // limit)))]

    def read(self, partition: _Page) -> Iterator[tuple]:
        for r in self._ask(partition.page).get("records", []):
            urls = r.get("urls") or []
            yield r.get("id"), (r.get("languages") or [None])[0], urls[0].get("url") if urls else None, json.dumps(r, ensure_ascii=False)


def register(spark: SparkSession, name: str, fetch: Callable[[dict], dict]) -> None:
    """Makes spark.read.format(name) read the service that fetch asks. Options: type, limit. Switches on filter pushdown for Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "id string, language string, url string, record string"

        def reader(self, schema) -> PagedReader:
            return PagedReader(dict(self.options), fetch)

    spark.dataSource.register(Paged)
