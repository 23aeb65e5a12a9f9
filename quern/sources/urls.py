"""Pages by address as a Python data source: ``spark.read.format("urls").option("urls", "one a line").load()``."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Part(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class UrlReader(DataSourceReader):
    def __init__(self, options: dict):
        self.urls = [u for u in (x.strip() for x in options.get("urls", "").split("\n")) if u and not u.startswith("#")]
        self.size, self.timeout = int(options.get("pagesPerTask", 20)), float(options.get("timeout", 15))

    def partitions(self) -> list[Part]:
        return [Part(self.urls[i : i + self.size]) for i in range(0, len(self.urls), self.size)]

    def read(self, partition: Part) -> Iterator[tuple]:
        from urllib.request import Request, urlopen

        from quern.functions.html import extract_text

        for url in partition.urls:
            try:
                with urlopen(Request(url, headers={"User-Agent": "quern"}), timeout=self.timeout) as page:
                    raw = page.read()
                    html = raw.decode(page.headers.get_content_charset() or "utf-8", "replace")
            except (OSError, ValueError) as e:
                yield url, None, str(e)[:200]
                continue
            text = extract_text(html) or re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", html)).strip()
            yield url, text, None


class UrlSource(DataSource):
    """url, text (of the main content, or with the tags stripped) and error of each address; failures are rows, too."""

    @classmethod
    def name(cls) -> str:
        return "urls"

    def schema(self) -> str:
        return "url string, text string, error string"

    def reader(self, schema) -> UrlReader:
        return UrlReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(UrlSource)
