"""A pluggable source: landed response files as a Spark data source."""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """File system of a path and the path in it; a path without a scheme, or with ``file``, is local."""
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parts.path) if parts.scheme else uri
    return fs.FileSystem.from_uri(uri)


class LandedFile(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class LandedFeed(DataSource):
    """Reads JSON-line responses below a folder every executor can reach, one task per file.

    With the option ``prune`` a batch takes filters on ``source`` over and picks folders
    before any file is opened; Spark asks the session to allow that (``FILTERS``). As a
    stream, files are taken in the order of their times and paths, each once.
    """

    @classmethod
    def name(cls) -> str:
        return "landed_feed"

    def schema(self) -> str:
        return "source string, country string, year bigint, data string"

    def reader(self, schema) -> LandedReader:
        kind = PrunedReader if str(self.options.get("prune", "false")).lower() == "true" else LandedReader
        return kind(self.options["path"])

    def streamReader(self, schema) -> LandedStream:
        return LandedStream(self.options["path"], int(self.options.get("maxFilesPerTrigger", 0)))


#: Session option that lets filters reach Python sources.
FILTERS = {"spark.sql.python.filterPushdown.enabled": "true"}


def source_of(path: str) -> str:
    return posixpath.basename(posixpath.dirname(path)).removeprefix("source=")


class _Files:
    """Listing and reading of landed files."""

    root: str

    def files(self) -> list[fs.FileInfo]:
        files, folder = opened(self.root)
        found = files.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True))
        return [f for f in found if f.is_file and f.path.endswith(".json")]

    def read(self, partition: LandedFile) -> Iterator[tuple]:
        files, _ = opened(self.root)
        source = source_of(partition.path)
        with files.open_input_stream(partition.path) as stream:
            for line in _lines(stream):
                row = json.loads(line)
                yield source, row.get("country"), row.get("year"), row.get("data")


class LandedReader(_Files, DataSourceReader):
    def __init__(self, path: str):
        self.root = path

    def wanted(self, path: str) -> bool:
        return True

    def partitions(self) -> list[LandedFile]:
        names = sorted(f.path for f in self.files())
        if not names:
            raise FileNotFoundError(f"no .json files below {self.root}")
        return [LandedFile(n) for n in names if self.wanted(n)]


class PrunedReader(LandedReader):
    """A reader that opens the folders of the asked sources only."""

    sources: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take over what folders decide; hand the rest back to Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("source",):
                asked = set(f.value) if isinstance(f, In) else {f.value}
                self.sources = asked if self.sources is None else self.sources & asked
            else:
                yield f

    def wanted(self, path: str) -> bool:
        return self.sources is None or source_of(path) in self.sources


class LandedStream(_Files, DataSourceStreamReader):
    """An offset is the time and path of the last file taken: files up to it are done.

    Files must appear whole (written elsewhere and renamed, as Spark does) and not earlier
    than those already taken. Nothing is kept between batches but the offset, so a
    restart goes on from the checkpoint, and a replayed batch reads the same files.
    """

    def __init__(self, path: str, most: int):
        self.root, self.most, self.taken = path, most, ["", ""]

    def _marked(self) -> list[tuple[list[str], str]]:
        return sorted(([f"{f.mtime_ns:020d}", f.path], f.path) for f in self.files())

    def initialOffset(self) -> dict:
        return {"last": ["", ""]}

    def latestOffset(self) -> dict:
        ahead = [mark for mark, _ in self._marked() if mark > self.taken]
        if ahead:
            self.taken = ahead[min(self.most, len(ahead)) - 1] if self.most else ahead[-1]
        return {"last": self.taken}

    def partitions(self, start: dict, end: dict) -> list[LandedFile]:
        self.taken = max(self.taken, end["last"])
        return [LandedFile(path) for mark, path in self._marked() if start["last"] < mark <= end["last"]]

    def commit(self, end: dict) -> None:
        self.taken = max(self.taken, end["last"])


def _lines(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """Non-empty lines of a stream, read in blocks."""
    rest = b""
    while block := stream.read(size):
        *lines, rest = (rest + block).split(b"\n")
        yield from filter(None, lines)
    if rest:
        yield rest
