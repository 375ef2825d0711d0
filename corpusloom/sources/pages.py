"""Extension point for sources: a Python data source over landed payload pages, in batch and as a stream.

A fetcher (not part of this library) lands response pages as files of JSON lines, one page a line.  A source says which
records a page holds: by options, or by a subclass that overrides ``records``::

    class Trials(LandedPages):
        @classmethod
        def name(cls):
            return "trials"

        def records(self, page):
            for study in page.get("studies", []):
                yield study["nctId"], study.get("title"), study

    register(spark, Trials)
    spark.read.format("trials").load(folder)            # or spark.readStream

Rows are (file, at, item, status, id, text, body): ``at`` is the byte of the file at which the page begins (of its text, in a
compressed file), ``item`` the record's number in the page, ``body`` the record as JSON.  A page that does not parse, control characters allowed and
then removed, or that ``records`` fails on, is one row of status ``failed`` with the line as body; nothing is dropped but empty lines.
A page without records has no row; a missing id or text is null; numbers become text.

Files are cut into ranges of ``splitBytes`` (a line belongs to the range it begins in; compressed files are read whole), small ones are
read several to a task.  Names that begin with ``_`` or ``.`` are not pages.  A stream's offset is the time and name of the last file taken, so a
range of offsets names the same files whenever it is replayed, in any process; files must not change, nor appear
under a time already passed: ``settleSeconds`` (default 5) keeps the youngest for the next batch.  A batch takes
all files that have landed; an available-now trigger runs one batch.  Paths are those that Arrow's file systems
reach.
"""

from __future__ import annotations

import io
import json
import re
import sys
import time
from collections.abc import Iterator
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..session import ship_code

SCHEMA = "file string, at long, item int, status string, id string, text string, body string"
COMPRESSED = (".gz", ".bz2", ".zst", ".lz4")
BATCH_CHARS = 4 << 20
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"


class PageRanges(InputPartition):
    """Ranges (file, first byte, last byte or None) that one task reads."""

    def __init__(self, ranges: list[tuple[str, int, int | None]]):
        super().__init__(None)
        self.ranges = ranges


def at_path(value: Any, path: str) -> Any:
    """The part of a JSON value at a dotted path (numbers index lists); None where there is none."""
    for step in path.split(".") if path else ():
        if isinstance(value, dict):
            value = value.get(step)
        elif isinstance(value, list) and step.isdigit() and int(step) < len(value):
            value = value[int(step)]
        else:
            return None
    return value


def as_text(value: Any) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)


class LandedPages(DataSource):
    """Options: ``path``; ``items`` (dotted path of a page's list of records, default: the page is the record), ``id`` and
    ``text`` (dotted paths in a record; several for the text, by commas, are joined by blank lines), ``splitBytes``, ``settleSeconds``."""

    @classmethod
    def name(cls) -> str:
        return "landed_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PageReader(self) if schema is None else PageBatchReader(self)  # Spark names a schema; without one rows are tuples

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PageStreamReader(self) if schema is None else PageBatchStreamReader(self)

    def records(self, page: Any) -> Iterator[tuple[Any, Any, Any]]:
        """(id, text, body) of each record of a page."""
        items = at_path(page, self.options.get("items", ""))
        for item in items if isinstance(items, list) else [] if items is None else [items]:
            parts = [as_text(at_path(item, p.strip())) for p in self.options.get("text", "text").split(",")]
            yield at_path(item, self.options.get("id", "id")), "\n\n".join(p for p in parts if p) if any(p is not None for p in parts) else None, item

    def files(self) -> list[tuple[int, str, int]]:
        """(time, name, size) of the landed files in landing order."""
        from pyarrow import fs

        if not self.options.get("path"):
            raise ValueError(f"{self.name()} needs the option 'path'")
        system, root = fs.FileSystem.from_uri(self.options["path"])
        found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        hidden = re.compile(r"(^|/)[_.]")
        return sorted((f.mtime_ns, f.path, f.size) for f in found if f.is_file and not hidden.search(f.path[len(root):]))

    def tasks(self, files: list[tuple[int, str, int]]) -> list[InputPartition]:
        split = max(1, int(self.options.get("splitBytes", 64 << 20)))
        out, now, size = [], [], 0
        for _, name, length in files:
            cuts = [(0, None, length)] if name.endswith(COMPRESSED) else [(a, min(a + split, length), min(split, length - a)) for a in range(0, length, split)]
            for first, last, n in cuts:
                if now and size + n > split:
                    out.append(PageRanges(now))
                    now, size = [], 0
                now.append((name, first, last))
                size += n
        return [*out, PageRanges(now)]

    def lines(self, name: str, first: int, last: int | None) -> Iterator[tuple[int, bytes]]:
        """(first byte, line) of the lines that begin in a range."""
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.options["path"])
        if last is None:
            stream, at = io.BufferedReader(system.open_input_stream(name)), 0
        else:
            raw = system.open_input_file(name)
            # From one byte before: what is left of the line before, its end of line at least, is passed over.
            raw.seek(max(first - 1, 0))
            stream, at = io.BufferedReader(raw), max(first - 1, 0)
            at += len(stream.readline()) if first else 0
        with stream:
            while last is None or at < last:
                line = stream.readline()
                if not line:
                    return
                yield at, line
                at += len(line)

    def rows(self, part: PageRanges) -> Iterator[tuple]:
        for name, first, last in part.ranges:
            for at, raw in self.lines(name, first, last):
                line = raw.decode("utf-8", "replace").strip()
                if not line:
                    continue
                try:
                    try:
                        page = json.loads(line, strict=False)
                    except ValueError:
                        page = json.loads(re.sub(CONTROL, "", line), strict=False)
                    found = [(as_text(i), as_text(t), json.dumps(b, ensure_ascii=False)) for i, t, b in self.records(page)]
                except Exception:  # noqa: BLE001 - the page is kept, with its status
                    yield name, at, 0, "failed", None, None, line
                    continue
                for k, (i, t, b) in enumerate(found):
                    yield name, at, k, "ok", i, t, b


    def batches(self, part: PageRanges) -> Iterator[Any]:
        """The rows as Arrow batches of about ``BATCH_CHARS`` of text (one row at least): a task holds one of them, however long texts are."""
        import pyarrow as pa

        types = pa.schema([("file", pa.string()), ("at", pa.int64()), ("item", pa.int32()), *[(c, pa.string()) for c in ("status", "id", "text", "body")]])
        rows, size = [], 0
        for row in self.rows(part):
            rows.append(row)
            size += 100 + len(row[5] or "") + len(row[6] or "")
            if size >= BATCH_CHARS:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), types)], schema=types)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), types)], schema=types)


class PageReader(DataSourceReader):
    def __init__(self, source: LandedPages):
        self.source = source

    def partitions(self) -> list[InputPartition]:
        return self.source.tasks(self.source.files())

    def read(self, partition: PageRanges) -> Iterator[tuple]:
        return self.source.rows(partition)


class PageStreamReader(DataSourceStreamReader):
    def __init__(self, source: LandedPages):
        self.source = source

    def initialOffset(self) -> dict:
        return {"time": 0, "file": ""}

    def latestOffset(self) -> dict:
        settled = time.time_ns() - int(float(self.source.options.get("settleSeconds", 5)) * 1e9)
        ready = [f for f in self.source.files() if f[0] <= settled]
        return {"time": ready[-1][0], "file": ready[-1][1]} if ready else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        after, upto = (start["time"], start["file"]), (end["time"], end["file"])
        return self.source.tasks([f for f in self.source.files() if after < f[:2] <= upto])

    def read(self, partition: PageRanges) -> Iterator[tuple]:
        return self.source.rows(partition)


class PageBatchReader(PageReader):
    """What Spark gets: the same rows as Arrow batches."""

    def read(self, partition: PageRanges) -> Iterator[Any]:
        return self.source.batches(partition)


class PageBatchStreamReader(PageStreamReader):
    def read(self, partition: PageRanges) -> Iterator[Any]:
        return self.source.batches(partition)


def register(spark: SparkSession, source: type[LandedPages] = LandedPages) -> str:
    """Make a source known to the session (its code and that of its module go to the tasks); its format name."""
    from pyspark import cloudpickle

    ship_code()
    if source.__module__ != "__main__":
        cloudpickle.register_pickle_by_value(sys.modules[source.__module__])
    spark.dataSource.register(source)
    return source.name()
