"""A watched folder as a stream of changes: a data source whose offsets are listings.

Each poll lists the folder, all levels deep, and writes the listing (path, token of size and time) below ``state``; the
offset names that file. What happened between two offsets is the difference of their two listings, so a batch that runs again
after a restart gives the same changes, and none is lost or given twice. Executors take shares of the paths by hash. A
file that appears is created, one of another token modified, one that is gone deleted; what happens between two polls
and leaves the listing as it was isn't seen. The listing that a
committed batch started from is removed (one is left behind by each restart).

``spark.dataSource.register(Watcher)``, then ``spark.readStream.format("watcher").option("path", ...).option("state", ...)``;
both folders must be seen by the driver and all executors.
"""

from __future__ import annotations

import json
import time
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .cdc import CHANGE

#: Shares of a difference, where the option ``shares`` names none.
SHARES = 8


def opened(uri: str):
    """A file system, and the path in it."""
    from pyarrow import fs

    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri[5:])
    return fs.LocalFileSystem(), uri


def listing(folder: str) -> dict[str, str]:
    """Path and token of each file below a folder; of a missing one none. Hidden files and those being written are passed over."""
    from pyarrow import fs

    store, path = opened(folder)
    found = store.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
    return {f.path: f"{f.size}-{f.mtime_ns}" for f in found if f.type == fs.FileType.File and not any(p.startswith((".", "_")) for p in f.path[len(path) :].split("/"))}


def read_listing(file: str) -> dict[str, str]:
    if not file:
        return {}
    store, path = opened(file)
    with store.open_input_stream(path) as f:
        return json.loads(f.read())


class Share(InputPartition):
    def __init__(self, start: str, end: str, seq: int, place: int, shares: int):
        super().__init__((start, end, seq, place, shares))


class Listings(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.state = options["path"], options["state"]
        self.shares = int(options.get("shares", SHARES))
        self.last: tuple[dict[str, str], dict] | None = None
        self.starts: dict[str, str] = {}  # of batches that aren't committed yet, by their ends

    def initialOffset(self) -> dict:
        return {"seq": 0, "file": ""}

    def latestOffset(self) -> dict:
        now = listing(self.folder)
        if self.last and self.last[0] == now:
            return self.last[1]
        store, path = opened(self.state)
        store.create_dir(path, recursive=True)
        file = f"listing-{uuid.uuid4().hex}.json"
        with store.open_output_stream(f"{path}/{file}") as f:
            f.write(json.dumps(now).encode())
        self.last = now, {"seq": time.time_ns(), "file": f"{self.state.rstrip('/')}/{file}"}
        return self.last[1]

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.starts[end["file"]] = start["file"] if start["file"] != end["file"] else ""
        return [Share(start["file"], end["file"], end["seq"], k, self.shares) for k in range(self.shares)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        start, end, seq, place, shares = partition.value
        was, now = read_listing(start), read_listing(end)
        for path in sorted(was.keys() | now.keys()):
            a, b = was.get(path), now.get(path)
            if a != b and zlib.crc32(path.encode()) % shares == place:
                yield path, "created" if a is None else "deleted" if b is None else "modified", a, b, seq

    def commit(self, end: dict) -> None:
        """The listing that a committed batch started from isn't asked for any more; those of other streams over the folder stay."""
        if file := self.starts.pop(end["file"], ""):
            store, path = opened(file)
            store.delete_file(path)

    def stop(self) -> None:
        pass


class Watcher(DataSource):
    """Columns as other streams of changes have them; hashes are tokens of size and time, and ``seq`` the time of the poll."""

    @classmethod
    def name(cls) -> str:
        return "watcher"

    def schema(self) -> str:
        return CHANGE

    def streamReader(self, schema) -> DataSourceStreamReader:
        return Listings(self.options)


def watched(spark: SparkSession, folder: str, state: str) -> DataFrame:
    """Changes of the files below ``folder``."""
    spark.dataSource.register(Watcher)
    return spark.readStream.format("watcher").option("path", folder).option("state", state).load()
