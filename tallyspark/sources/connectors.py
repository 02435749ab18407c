"""Python data sources: evaluation documents of many buckets, paged JSON, the block clock.

All read through ``pyarrow.fs``, on executors, from any place that has a filesystem there (local, S3, HDFS ...). ``register`` makes them known to a session:

* ``tally_evaluations``: ``bucket, evaluation_id, content`` of the newest documents of any number of buckets, one scan;
* ``tally_pages``: ``offset, position, row`` of a paged JSON source, in batch and as a stream;
* ``tally_blocks``: ``clock, block``, a stream of chain heights.
"""

from __future__ import annotations

import heapq
import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

NAME = "metadata.json"


def place_of(uri: str) -> tuple[fs.FileSystem, str]:
    """Filesystem and path of a URI or a local path."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri.rstrip("/")
    found, path = fs.FileSystem.from_uri(uri)
    return found, path.rstrip("/")


def _content(place: fs.FileSystem, path: str) -> str:
    with place.open_input_stream(path) as f:
        return f.read().decode("utf-8", "replace")


# Evaluation documents


def newest_ids(place: fs.FileSystem, root: str, n: int) -> list[str]:
    """The ``n`` greatest ids under a root (all if n is not positive), greatest first; an id is the path to a folder with ``metadata.json``.

    Folders of the first level are opened from the greatest name down, until nothing in the others can be among the newest, so of a large bucket only its end is listed.
    """
    found: list[str] = []
    if place.get_file_info(root).type != fs.FileType.Directory:
        return found
    tops = sorted((x.base_name for x in place.get_file_info(fs.FileSelector(root)) if x.type == fs.FileType.Directory), key=lambda x: f"{x}/", reverse=True)
    for top in tops:
        # No id within a folder is greater than its name followed by the character after "/".
        if 0 < n <= len(found) and f"{top}0" <= found[n - 1]:
            break
        for x in place.get_file_info(fs.FileSelector(f"{root}/{top}", recursive=True)):
            if x.type == fs.FileType.File and x.base_name == NAME:
                found.append(x.path[len(root) + 1 : -len(NAME) - 1])
        found.sort(reverse=True)
        if n > 0:
            del found[n:]
    return found


@dataclass
class _Buckets(InputPartition):
    value: list[tuple[str, str]]


class EvaluationReader(DataSourceReader):
    """A partition for every ``perpartition`` buckets. Filters on the bucket (equal, in) choose buckets before anything is listed."""

    def __init__(self, options: dict[str, str]) -> None:
        self.buckets = sorted(json.loads(options["buckets"]).items())
        self.n, self.step = int(options.get("newest", "0")), max(1, int(options.get("perpartition", "32")))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("bucket",):
                self.buckets = [b for b in self.buckets if b[0] == f.value]
            elif isinstance(f, In) and f.attribute == ("bucket",):
                self.buckets = [b for b in self.buckets if b[0] in f.value]
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [_Buckets(self.buckets[i : i + self.step]) for i in range(0, len(self.buckets), self.step)] or [_Buckets([])]

    def read(self, partition: _Buckets) -> Iterator[tuple]:
        for bucket, uri in partition.value:
            place, root = place_of(uri)
            for x in newest_ids(place, root, self.n):
                yield bucket, x, _content(place, f"{root}/{x}/{NAME}")


class EvaluationSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tally_evaluations"

    def schema(self) -> str:
        return "bucket string, evaluation_id string, content string"

    def reader(self, schema) -> DataSourceReader:
        return EvaluationReader(dict(self.options))


# Pages


def folder_page(path: str, offset: int, limit: int) -> list:
    """A page from a folder that stands for the service: ``<offset>.json`` holds the rows from there, under ``books``; no file, no rows."""
    place, root = place_of(path)
    name = f"{root}/{offset}.json"
    if place.get_file_info(name).type != fs.FileType.File:
        return []
    return (json.loads(_content(place, name)).get("books") or [])[:limit]


def _rows_upto(fetch: Callable[[str, int, int], list], path: str, offset: int, limit: int) -> int:
    """The offset behind the last page that has rows, from ``offset`` on."""
    while len(fetch(path, offset, limit)) == limit:
        offset += limit
    return offset + (limit if fetch(path, offset, limit) else 0)


@dataclass
class _Page(InputPartition):
    value: int


class _Pages:
    fetch: Callable[[str, int, int], list] = staticmethod(folder_page)

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.limit = options["path"], int(options.get("limit", "50"))

    def read(self, partition: _Page) -> Iterator[tuple]:
        for i, row in enumerate(self.fetch(self.path, partition.value, self.limit)):
            yield partition.value, i, json.dumps(row, ensure_ascii=False)


class PageReader(_Pages, DataSourceReader):
    """A partition a page. ``pages`` says how many there are; else they are counted first."""

    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options)
        self.pages = options.get("pages")

    def partitions(self) -> list[InputPartition]:
        end = int(self.pages) * self.limit if self.pages else _rows_upto(self.fetch, self.path, 0, self.limit)
        return [_Page(at) for at in range(0, end, self.limit)] or [_Page(0)]


class PageStreamReader(_Pages, DataSourceStreamReader):
    """The offset is that of the first page not read. Only full pages are read, since a page that is not full may still grow."""

    def initialOffset(self) -> dict:
        return {"offset": 0}

    def latestOffset(self) -> dict:
        self.end = getattr(self, "end", 0)
        while len(self.fetch(self.path, self.end, self.limit)) == self.limit:
            self.end += self.limit
        return {"offset": self.end}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Page(at) for at in range(start["offset"], end["offset"], self.limit)]

    def commit(self, end: dict) -> None:
        pass


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tally_pages"

    def schema(self) -> str:
        return "offset long, position int, row string"

    def reader(self, schema) -> DataSourceReader:
        return PageReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PageStreamReader(dict(self.options))


# The block clock


class BlockReader(SimpleDataSourceStreamReader):
    """Heights from a file to which a poller appends one a line. The offset is the place in the file; a height not above those before it is left out."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.clock = options["path"], options.get("clock", "chain")

    def initialOffset(self) -> dict:
        return {"at": 0, "block": -1}

    def _lines(self, start: dict, end: int | None = None) -> tuple[list[tuple], dict]:
        place, path = place_of(self.path)
        if place.get_file_info(path).type != fs.FileType.File:
            return [], start
        with place.open_input_file(path) as f:
            f.seek(start["at"])
            data = f.read(None if end is None else end - start["at"])
        data = data[: data.rfind(b"\n") + 1]  # a line that is still written waits
        rows, last = [], start["block"]
        for line in data.split():
            if int(line) > last:
                last = int(line)
                rows.append((self.clock, last))
        return rows, {"at": start["at"] + len(data), "block": last}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = self._lines(start)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._lines(start, end["at"])[0])

    def commit(self, end: dict) -> None:
        pass


class BlockSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tally_blocks"

    def schema(self) -> str:
        return "clock string, block long"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return BlockReader(dict(self.options))


class StaleGuard(StreamingQueryListener):
    """Stops a query whose clock has not moved for ``seconds``: what acts on heights must not act on an old one. ``stale`` holds the ids of those that it stopped."""

    def __init__(self, query: StreamingQuery, seconds: float, now: Callable[[], float] = time.monotonic) -> None:
        self.query, self.seconds, self.now = query, seconds, now
        self.moved, self.stale = now(), set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if str(event.progress.id) == str(self.query.id):
            self._seen(event.progress.numInputRows > 0)

    def onQueryIdle(self, event) -> None:
        if str(event.id) == str(self.query.id):
            self._seen(False)

    def onQueryTerminated(self, event) -> None:
        pass

    def _seen(self, moved: bool) -> None:
        if moved:
            self.moved = self.now()
        elif self.now() - self.moved > self.seconds:
            self.stale.add(str(self.query.id))
            self.query.stop()


def register(spark: SparkSession) -> None:
    """Makes the sources known to a session, and lets filters reach them."""
    for source in (EvaluationSource, PageSource, BlockSource):
        spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def evaluation_documents(spark: SparkSession, buckets: dict[str, str], n: int = 0, per_partition: int = 32) -> DataFrame:
    """``bucket, evaluation_id, content`` of the newest ``n`` ids of each bucket (all if n is not positive), whatever the number of buckets in one scan."""
    register(spark)
    return spark.read.format("tally_evaluations").options(buckets=json.dumps(buckets), newest=n, perpartition=per_partition).load()
