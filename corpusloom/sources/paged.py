"""A Python data source of paged REST records, read from saved pages: one partition a page, so a page is fetched by one task.

The network is out of reach here; a page is a JSON file of {"results": [...]}, named by its number. Against a live service only
`fetch` differs.
"""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def polite(get: Callable[[], bytes], tries: int = 5, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep, rng: random.Random | None = None) -> bytes:
    """get(), tried again after waits that double, with jitter; the last failure is raised."""
    rng = rng or random.Random()
    for i in range(tries):
        try:
            return get()
        except OSError:
            if i == tries - 1:
                raise
            sleep(wait * 2**i * (1 + rng.random() / 2))
    raise AssertionError


class Breaker:
    """Stops asking after so many refusals in a row."""

    def __init__(self, limit: int = 5) -> None:
        self.limit, self.refused = limit, 0

    def saw(self, refused: bool) -> None:
        self.refused = self.refused + 1 if refused else 0

    @property
    def open(self) -> bool:
        return self.refused >= self.limit


class Page(InputPartition):
    def __init__(self, number: int) -> None:
        self.number = number


class PagedReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder, self.pages, self.fields = options["path"], int(options["pages"]), options["fields"].split(",")

    def partitions(self) -> list[Page]:
        return [Page(i) for i in range(1, self.pages + 1)]

    def fetch(self, number: int) -> bytes:
        with open(f"{self.folder}/{number}.json", "rb") as f:
            return f.read()

    def read(self, partition: Page) -> Iterator[tuple]:
        for r in json.loads(polite(lambda: self.fetch(partition.number), tries=1))["results"]:
            yield tuple(None if r.get(f) is None else str(r[f]) for f in self.fields)


class PagedSource(DataSource):
    """format("paged") with options path (a local folder), pages and fields."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return ", ".join(f"{f} string" for f in self.options["fields"].split(","))

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)
