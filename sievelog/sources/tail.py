"""A streaming source that tails growing log files.

Spark's file source reads a file once; this one remembers the end byte of every
file generation, so bytes appended later are read in a later batch. A
generation is (path, device, inode): a rotated file starts anew under its own
key, while the old one, found by its inode beside its path (0.log.*), is drained to its
last whole line. Rotated files that were never planned under their own path are not read.
"""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "path string, dev long, ino long, line string, offset long"


class TailSource(DataSource):
    """Options: path (root folder), maxBytesPerFile (bytes read of a file in one batch), exclude (comma-separated namespaces)."""

    @classmethod
    def name(cls) -> str:
        return "logtail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema):  # noqa: N802
        return TailReader(dict(self.options))


class Span(InputPartition):
    def __init__(self, path: str, dev: int, ino: int, start: int, end: int):
        self.path, self.dev, self.ino, self.start, self.end = path, dev, ino, start, end


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root = options["path"].rstrip("/")
        self.most = int(options.get("maxBytesPerFile", 64 << 20))
        self.skip = {x for x in options.get("exclude", "").split(",") if x}
        self.done: dict[str, int] = {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {"ends": "{}", "rotated": "{}"}

    def _finished(self, path: str, start: int, size: int) -> int:
        """The end of the last whole line in [start, start + most), looking further if one line is longer."""
        with open(path, "rb") as f:
            f.seek(start)
            at, step = start, self.most
            while at < size:
                data = f.read(min(step, size - at))
                cut = data.rfind(b"\n")
                if cut >= 0:
                    return at + cut + 1
                at += len(data)
                if not data:
                    break
        return start

    def latestOffset(self) -> dict:  # noqa: N802
        ends = dict(self.done)
        for path in sorted(glob.glob(f"{self.root}/*/*/*.log")):
            if os.path.basename(os.path.dirname(os.path.dirname(path))).split("_")[0] in self.skip:
                continue
            try:
                st = os.stat(path)
                key = json.dumps([path, st.st_dev, st.st_ino])
                start = ends.get(key, 0)
                if st.st_size > start:
                    ends[key] = self._finished(path, start, st.st_size)
            except OSError:
                continue  # gone meanwhile
        self.done = ends
        return {"ends": json.dumps(ends, sort_keys=True), "rotated": json.dumps(self._rotated(), sort_keys=True)}

    def _rotated(self) -> dict[str, int]:
        """The last whole line's end in every renamed file, by the key it had at its own path; a restarted reader finds the same keys."""
        ends: dict[str, int] = {}
        for path in sorted(glob.glob(f"{self.root}/*/*/*.log.*")):
            if path.endswith((".gz", ".tmp")) or os.path.basename(os.path.dirname(os.path.dirname(path))).split("_")[0] in self.skip:
                continue
            try:
                st = os.stat(path)
                with open(path, "rb") as f:
                    at, cut = st.st_size, -1
                    while at and cut < 0:
                        low = max(0, at - 65_536)
                        f.seek(low)
                        cut, at = f.read(at - low).rfind(b"\n"), low
                    ends[json.dumps([f"{path[: path.rindex('.log.')]}.log", st.st_dev, st.st_ino])] = at + cut + 1
            except OSError:
                continue  # gone meanwhile
        return ends

    def partitions(self, start: dict, end: dict) -> list[Span]:
        before, after = json.loads(start["ends"]), json.loads(end["ends"])
        gone, now = json.loads(start.get("rotated", "{}")), json.loads(end.get("rotated", "{}"))
        for k, v in now.items():  # read on from where the generation stood at its path
            if k in before or k in gone:
                before[k] = max(before.get(k, 0), gone.get(k, 0))
                after[k] = max(v, after.get(k, 0))
        self.done = {**after, **{k: max(v, after.get(k, 0)) for k, v in self.done.items()}}
        spans = [Span(*json.loads(k), before.get(k, 0), v) for k, v in sorted(after.items()) if v > before.get(k, 0)]
        return spans or [Span("", 0, 0, 0, 0)]

    def read(self, partition: Span) -> Iterator[tuple]:
        if not partition.path:
            return
        path = _of_generation(partition)
        if path is None:
            return
        with open(path, "rb") as f:
            f.seek(partition.start)
            at = partition.start
            while at < partition.end:
                line = f.readline(partition.end - at)
                if not line:
                    return
                at += len(line)
                yield partition.path, partition.dev, partition.ino, line.rstrip(b"\n").decode("utf-8", "replace"), at

    def commit(self, end: dict) -> None:
        pass


def _of_generation(span: Span) -> str | None:
    """Where the generation is now: its path, or the name it was rotated to."""
    for path in [span.path, *sorted(glob.glob(f"{os.path.dirname(span.path)}/*"))]:
        try:
            st = os.stat(path)
        except OSError:
            continue
        if (st.st_dev, st.st_ino) == (span.dev, span.ino):
            return path
    return None


def tail(spark: SparkSession, root: str, **options):
    """A streaming frame of finished lines under root."""
    spark.dataSource.register(TailSource)
    return spark.readStream.format("logtail").options(path=root, **{k: str(v) for k, v in options.items()}).load()
