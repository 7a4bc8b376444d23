"""Landed report windows as a streaming source: offsets are dates, and each window is a partition.

A window is a file ``<first day>_<last day>.txt`` (ISO dates) under a folder that drivers and executors see. A batch has the
windows that follow each other without a gap from the last offset on, so a window that lands early waits for the one before it.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .shared import filesystem

DAY = dt.timedelta(1)


class Window(InputPartition):
    def __init__(self, uri: str, first: str, last: str):
        self.uri, self.first, self.last = uri, first, last


def landed(folder: str) -> list[tuple[dt.date, dt.date, str]]:
    """(first, last, uri) of the windows under ``folder``, in order; other names are passed over."""
    from pyarrow import fs

    store, path = filesystem(folder)
    found = []
    for f in store.get_file_info(fs.FileSelector(path, allow_not_found=True)):
        first, _, last = f.base_name.removesuffix(".txt").partition("_")
        try:
            found.append((dt.date.fromisoformat(first), dt.date.fromisoformat(last), f"{folder.rstrip('/')}/{f.base_name}"))
        except ValueError:
            continue
    return sorted(found)


def following(windows: list[tuple[dt.date, dt.date, str]], next_day: dt.date) -> Iterator[tuple[dt.date, dt.date, str]]:
    """The windows that go on from ``next_day``: each starts by the day after the one before it and ends after it."""
    for first, last, uri in windows:
        if first > next_day:
            return
        if last >= next_day:
            yield first, last, uri
            next_day = last + DAY


class WindowReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.start = options["path"], options["start"]
        self.most = int(options.get("windows", 4))
        self.at = self.start

    def initialOffset(self) -> dict:
        return {"next": self.start}

    def latestOffset(self) -> dict:
        """At most ``windows`` windows beyond the last offset that was handed out."""
        day = dt.date.fromisoformat(self.at)
        for i, (_, last, _) in enumerate(following(landed(self.folder), day)):
            if i == self.most:
                break
            day = last + DAY
        self.at = day.isoformat()
        return {"next": self.at}

    def partitions(self, start: dict, end: dict) -> list[Window]:
        self.at = max(self.at, end["next"])
        first, stop = dt.date.fromisoformat(start["next"]), dt.date.fromisoformat(end["next"])
        return [Window(uri, a.isoformat(), b.isoformat()) for a, b, uri in following(landed(self.folder), first) if b < stop]

    def read(self, partition: Window) -> Iterator[pa.RecordBatch]:
        """The window's lines, a few thousand at a time."""
        store, path = filesystem(partition.uri)
        pos, held = 0, []

        def batch() -> pa.RecordBatch:
            n = len(held)
            days = [pa.array([dt.date.fromisoformat(d)] * n, pa.date32()) for d in (partition.first, partition.last)]
            return pa.RecordBatch.from_arrays([*days, pa.array(range(pos - n, pos), pa.int64()), pa.array(held, pa.string())], names=["first_day", "last_day", "pos", "value"])

        with store.open_input_stream(path) as raw:
            import io

            for line in io.TextIOWrapper(io.BufferedReader(raw), "utf-8", errors="replace"):
                held.append(line.rstrip("\r\n"))
                pos += 1
                if len(held) == 8192:
                    yield batch()
                    held.clear()
        if held:
            yield batch()

    def commit(self, end: dict) -> None:
        pass


class ReportWindows(DataSource):
    """``spark.readStream.format("report_windows").option("start", "2006-04-01").load(folder)``; option ``windows`` bounds a batch."""

    @classmethod
    def name(cls) -> str:
        return "report_windows"

    def schema(self) -> str:
        return "first_day date, last_day date, pos long, value string"

    def streamReader(self, schema) -> WindowReader:
        return WindowReader(dict(self.options))
