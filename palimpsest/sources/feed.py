"""A data source of feed pages: spark.dataSource.register(FeedSource), then spark.read.format("paper_feed")."""

from __future__ import annotations

import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from palimpsest.sources.papers import date_window

#: Entries of a page.
PAGE = 100


class FeedSource(DataSource):
    """Pages (start, xml) of a feed's query for a category and a span of days, in order of submission, until one is empty.

    Options: url, category, start, end (YYYY-MM-DD), delay (seconds between requests), retries and timeout. A request that
    fails is repeated after the delay, `retries` times; then it is an error. The feed limits its callers, so one task
    asks page by page.
    """

    @classmethod
    def name(cls) -> str:
        return "paper_feed"

    def schema(self) -> str:
        return "start int, xml string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return FeedReader(dict(self.options))


class FeedReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        first, last = date_window(options["start"], options["end"])
        self.url, self.query = options["url"], f"cat:{options['category']} AND submittedDate:[{first} TO {last}]"
        self.delay, self.retries, self.timeout = float(options.get("delay", 3)), int(options.get("retries", 3)), float(options.get("timeout", 30))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple[int, str]]:
        at = 0
        while "<entry" in (xml := self._page(at)):
            yield at, xml
            at += PAGE
            time.sleep(self.delay)

    def _page(self, at: int) -> str:
        asked = urllib.parse.urlencode({"search_query": self.query, "start": at, "max_results": PAGE, "sortBy": "submittedDate", "sortOrder": "ascending"})
        for left in range(self.retries, -1, -1):
            try:
                with urllib.request.urlopen(f"{self.url}?{asked}", timeout=self.timeout) as answer:
                    return answer.read().decode("utf-8", "replace")
            except (urllib.error.URLError, TimeoutError):
                if not left:
                    raise
                time.sleep(self.delay)
        raise AssertionError
