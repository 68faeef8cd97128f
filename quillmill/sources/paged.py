"""A service's pages as a stream: a micro-batch has the next pages, a scan ends at the first empty
one, and a restart reads none twice. Pages are read where Spark plans the batch, a bounded number
at a time, because whether there is a next page is known only from the one before; what is read
is a few responses, and everything after them is distributed."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from .readers import fetched


class PagedStream(DataSource):
    """Rows (page, body). Options: url with {page}; records, the path of the list that is empty
    on the last page (`data.records`); pages, the most of a micro-batch; most, the last page;
    retries and timeout. The offset is the next page; behind an empty page it is 0."""

    @classmethod
    def name(cls) -> str:
        return "paged_stream"

    def schema(self) -> str:
        return "page int, body string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return PagedStreamReader(dict(self.options))


class PagedStreamReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.options = options
        self.pages, self.most = int(options.get("pages", "10")), int(options.get("most", "200"))
        self.path = options.get("records", "data.records").split(".")

    def initialOffset(self) -> dict:
        return {"page": 1}

    def body(self, page: int) -> str:
        return fetched(self.options["url"].format(page=page), int(self.options.get("retries", "2")), float(self.options.get("timeout", "15")))

    def empty(self, body: str) -> bool:
        at = json.loads(body)
        for name in self.path:
            at = (at or {}).get(name)
        return not at

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        first, rows = start["page"], []
        if not first:
            return iter([]), start
        for page in range(first, min(first + self.pages, self.most + 1)):
            body = self.body(page)
            if self.empty(body):
                return iter(rows), {"page": 0}
            rows.append((page, body))
        end = first + len(rows)
        return iter(rows), {"page": end if end <= self.most else 0}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """The pages of a batch again, after a failure: up to the end it had, or the empty page."""
        page = start["page"]
        while page and page != end["page"] and page <= self.most:
            body = self.body(page)
            if not end["page"] and self.empty(body):
                return
            yield page, body
            page += 1
