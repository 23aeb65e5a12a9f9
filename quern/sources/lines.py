"""Lines of JSON as a stream: ``spark.readStream.format("json_lines").option("path", ...).load()``.

An offset is the number of bytes taken of each file, so a query that stops and starts again from its checkpoint yields each
line once, also of files that have grown or come since. A batch's bytes are dealt to tasks in ranges; a line belongs to the
range that it begins in. The files may be in any store that pyarrow's file systems know; new ones are looked for at each batch.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Bytes of a file read at a time.
BLOCK = 1 << 20


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def _opened(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def complete_bytes(store, path: str, size: int) -> int:
    """The bytes of a file up to the last line's end."""
    with store.open_input_file(path) as f:
        end = size
        while end > 0:
            start = max(0, end - BLOCK)
            f.seek(start)
            at = f.read(end - start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            end = start
    return 0


def lines_of(store, path: str, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(first byte, line) of the lines that begin in a range."""
    with store.open_input_file(path) as f:
        at, held = start, b""
        if start:  # the line that ends here or later began before
            f.seek(start - 1)
            at = start - 1
            while True:
                block = f.read(BLOCK)
                if not block:
                    return
                cut = block.find(b"\n")
                if cut >= 0:
                    held = block[cut + 1 :]
                    at += cut + 1
                    break
                at += len(block)
        while at < end:
            parts = held.split(b"\n")
            for line in parts[:-1]:
                if at >= end:
                    return
                yield at, line
                at += len(line) + 1
            held = parts[-1]
            block = f.read(BLOCK) if at < end else b""
            if not block:
                if at < end and held:
                    yield at, held
                return
            held += block


class Lines:
    """What both kinds of reading share."""

    def __init__(self, options: dict):
        self.folder, self.text = options["path"], options.get("textField", "text")
        self.suffix, self.size = options.get("suffix", ".jsonl"), int(options.get("bytesPerTask", 64 << 20))
        self.growing = options.get("growing", "false").lower() == "true"

    def _files(self) -> dict[str, int]:
        """The bytes to take of each file; of growing ones only whole lines."""
        from pyarrow import fs

        store, path = _opened(self.folder)
        found = store.get_file_info(path)
        infos = [found] if found.is_file else store.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
        sizes = {i.path: i.size for i in infos if i.is_file and (i.path.endswith(self.suffix) or found.is_file)}
        return {p: complete_bytes(store, p, n) if self.growing else n for p, n in sorted(sizes.items())}

    def _ranges(self, before: dict[str, int], after: dict[str, int]) -> list[Range]:
        out = []
        for path, end in after.items():
            start = before.get(path, 0)
            out += [Range(path, a, min(end, a + self.size)) for a in range(start, end, self.size)]
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        store, _ = _opened(self.folder)
        for at, line in lines_of(store, partition.path, partition.start, partition.end):
            try:
                record = json.loads(line)
            except ValueError:
                continue
            text = record.get(self.text) if isinstance(record, dict) else None
            if isinstance(text, str) and text:
                yield partition.path, at, text, line.decode("utf-8", "replace")


class LineStream(Lines, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self._files()

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return self._ranges(start, end)

    def commit(self, end: dict) -> None:
        pass


class LineTable(Lines, DataSourceReader):
    def partitions(self) -> list[Range]:
        return self._ranges({}, self._files())

    def read(self, partition: Range) -> Iterator:
        """The rows as Arrow batches of about a BLOCK of text."""
        import pyarrow as pa

        schema = pa.schema([("file", pa.string()), ("place", pa.int64()), ("text", pa.string()), ("record", pa.string())])
        rows, size = [], 0
        for row in super().read(partition):
            rows.append(row)
            size += len(row[3])
            if size >= BLOCK:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


class JsonLines(DataSource):
    """file, place (its first byte), text and record of each line whose text is a string that isn't empty; others are left out."""

    @classmethod
    def name(cls) -> str:
        return "json_lines"

    def schema(self) -> str:
        return "file string, place long, text string, record string"

    def reader(self, schema) -> LineTable:
        return LineTable(self.options)

    def streamReader(self, schema) -> LineStream:
        return LineStream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(JsonLines)


def examples(lines: DataFrame, tokens, length: int = 1024) -> DataFrame:
    """input_ids, attention_mask and labels of lines (a batch of the stream), cut to length and padded, by a column function
    of the text that yields ids; lines without ids are left out."""
    from quern.operators.training import fixed

    ids = lines.withColumn("ids", F.slice(tokens(F.col("text")), 1, length)).filter(F.size("ids") > 0)
    return ids.select("file", "place", fixed(F.col("ids"), length).alias("x")).select("file", "place", "x.*")
