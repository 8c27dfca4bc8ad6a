"""A paginated REST source as a Python data source: one partition a range of pages."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "repo string, page int, payload string"


@dataclass
class Pages(InputPartition):
    first: int
    last: int

    def __init__(self, first: int, last: int) -> None:
        super().__init__((first, last))
        self.first, self.last = first, last


class PagedSource(DataSource):
    """Options: fetch ("module:function" that takes (url, page) and returns a list), url, repo, pages, per_task."""

    @classmethod
    def name(cls) -> str:
        return "paged_rest"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return PagedReader(self.options)


class PagedReader(DataSourceReader):
    def __init__(self, options) -> None:  # noqa: ANN001
        self.options = dict(options)

    def partitions(self) -> list[Pages]:
        pages, step = int(self.options.get("pages", 1)), int(self.options.get("per_task", 10))
        return [Pages(a, min(a + step - 1, pages)) for a in range(1, pages + 1, step)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        module, _, name = self.options["fetch"].partition(":")
        fetch: Callable = getattr(__import__(module, fromlist=[name]), name)
        for page in range(partition.first, partition.last + 1):
            rows = fetch(self.options.get("url", ""), page)
            if not rows:  # an empty raw page ends the listing; a page whose rows are all filtered later does not
                return
            for row in rows:
                yield self.options.get("repo", ""), page, json.dumps(row)
