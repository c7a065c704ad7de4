"""A paginated REST catalogue as a data source: one input partition per page, polite retries inside the reader."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Page(InputPartition):
    def __init__(self, offset: int):
        super().__init__(offset)
        self.offset = offset


def get_json(url: str, tries: int = 5, pause: float = 1.0, absent: tuple[int, ...] = (400, 404)) -> dict | None:
    """GET with patience: waits as told on 429, ever longer on 5xx and broken connections; None for ``absent`` codes."""
    for attempt in range(tries):
        try:
            with urllib.request.urlopen(url, timeout=60) as r:
                return json.load(r)
        except urllib.error.HTTPError as e:
            if e.code in absent:
                return None
            if e.code != 429 and e.code < 500:
                raise
            wait = float(e.headers.get("Retry-After") or pause * 2**attempt)
        except urllib.error.URLError:
            wait = pause * 2**attempt
        if attempt + 1 < tries:
            time.sleep(wait)
    raise ConnectionError(f"no answer from {url} after {tries} tries")


class CatalogueReader(DataSourceReader):
    def __init__(self, options: dict):
        self.url, self.size = options["url"], int(options.get("pageSize", 100))
        self.items, self.count, self.key = options.get("items", "packages"), options.get("count", "count"), options.get("key", "packageId")

    def _page(self, offset: int) -> dict:
        sep = "&" if "?" in self.url else "?"
        return get_json(f"{self.url}{sep}offset={offset}&pageSize={self.size}") or {}

    def partitions(self) -> list[Page]:
        return [Page(o) for o in range(0, int(self._page(0).get(self.count, 0)), self.size)]

    def read(self, partition: Page) -> Iterator[tuple]:
        for x in self._page(partition.offset).get(self.items, []):
            yield (str(x.get(self.key)), json.dumps(x))


class CatalogueSource(DataSource):
    """``spark.read.format("catalogue").option("url", ...)``: ``package_id, body`` (JSON)."""

    @classmethod
    def name(cls) -> str:
        return "catalogue"

    def schema(self) -> str:
        return "package_id string, body string"

    def reader(self, schema) -> DataSourceReader:
        return CatalogueReader(dict(self.options))
