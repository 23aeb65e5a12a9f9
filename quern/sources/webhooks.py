"""Rows to web addresses: ``df.write.format("webhook").options(...).mode("append").save()``, and as a stream's sink.

A delivery is a POST of the row as JSON with an HMAC-SHA256 signature of the body and a delivery id, a hash of event and row.
A delivery is tried again with growing pauses; one that fails for good fails the task. A replayed batch or a retried task
sends the same ids again, by which a receiver tells them, so each row takes effect once.
"""

from __future__ import annotations

import hashlib
import hmac
import json
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage

#: Headers of a delivery.
SIGNATURE, EVENT, DELIVERY = "X-Webhook-Signature", "X-Webhook-Event", "X-Webhook-Delivery"


def signature(body: bytes, secret: str) -> str:
    return "sha256=" + hmac.new(secret.encode(), body, hashlib.sha256).hexdigest()


@dataclass
class Sent(WriterCommitMessage):
    rows: int
    tries: int


class WebhookWriter(DataSourceWriter, DataSourceStreamWriter):
    def __init__(self, options: dict):
        self.url, self.secret, self.event = options["url"], options.get("secret", ""), options.get("event", "row")
        self.tries, self.pause, self.timeout = int(options.get("tries", 3)), float(options.get("pause", 0.5)), float(options.get("timeout", 10))
        self.log = options.get("log")

    def write(self, iterator: Iterator) -> Sent:
        n = tries = 0
        for row in iterator:
            tries += self._deliver(row.asDict(recursive=True))
            n += 1
        return Sent(n, tries)

    def _deliver(self, row: dict) -> int:
        from urllib.error import HTTPError
        from urllib.request import Request, urlopen

        data = json.dumps(row, sort_keys=True, default=str)
        delivery = hashlib.sha256(f"{self.event}\n{data}".encode()).hexdigest()
        body = json.dumps({"event": self.event, "id": delivery, "data": json.loads(data)}, sort_keys=True).encode()
        headers = {"Content-Type": "application/json", SIGNATURE: signature(body, self.secret), EVENT: self.event, DELIVERY: delivery}
        for i in range(1, self.tries + 1):
            try:
                with urlopen(Request(self.url, body, headers, method="POST"), timeout=self.timeout):
                    return i
            except (HTTPError, OSError) as e:
                if i == self.tries:
                    raise RuntimeError(f"delivery {delivery} failed after {i} tries: {e}") from e
                time.sleep(self.pause * 2 ** (i - 1))
        raise AssertionError

    def commit(self, messages: list, batchId: int | None = None) -> None:  # noqa: N803  the name that Spark calls it by
        """Append the numbers of rows and tries to the log, if there is one: a line a batch, written by the driver."""
        if self.log:
            from pyarrow import fs

            store, path = fs.FileSystem.from_uri(self.log) if "://" in self.log else (fs.LocalFileSystem(), self.log)
            store.create_dir(path, recursive=True)
            done = [m for m in messages if m is not None]
            name = f"batch-{batchId}" if batchId is not None else hashlib.sha256(repr(time.time_ns()).encode()).hexdigest()[:16]
            with store.open_output_stream(f"{path}/{name}.json") as f:
                f.write(json.dumps({"batch": batchId, "rows": sum(m.rows for m in done), "tries": sum(m.tries for m in done)}).encode())

    def abort(self, messages: list, batchId: int | None = None) -> None:  # noqa: N803
        pass


class Webhook(DataSource):
    """Options: url, secret, event, tries, pause (seconds before the second try, doubled after each), timeout, log (a folder)."""

    @classmethod
    def name(cls) -> str:
        return "webhook"

    def writer(self, schema, overwrite: bool) -> WebhookWriter:
        return WebhookWriter(self.options)

    def streamWriter(self, schema, overwrite: bool) -> WebhookWriter:
        return WebhookWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Webhook)
