"""A streaming source of text files that grow: every line once, also those appended to a file that was read before.

The offset of a stream says for each file how many bytes were read and which file that was. A batch reads, per file,
the bytes between two offsets, long stretches cut into splits at line ends; a lost batch or driver reads the same bytes again.
Only whole lines count: what follows the last line end waits until its line is finished.

A file is told by its first line. The offset follows a file that was renamed (`a.log` to `a.log.1`) if the pattern still
covers it; a file that begins with another line, or is shorter than what was read of it, is a new one and is read from its
start. A file that is gone has no more lines. Lines that were in an offset and can be found in no file any more stop
the stream, or are left out with the option `failOnDataLoss` false. The offset has an entry per file of the folder, so
old files should be moved away in time.
"""

from __future__ import annotations

import fnmatch
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SPLIT_BYTES = 32 << 20
CHUNK = 1 << 20
ROWS = 10_000
HEAD = 4096          # as much of the first line as tells files apart


@dataclass
class Stretch(InputPartition):
    """Bytes of one file, both ends at line ends, and the part of them that a task reads."""

    path: str
    first: int
    begin: int
    end: int
    lower: int
    upper: int


class AppendedLines(DataSource):
    """`spark.readStream.format("appended_lines")` with the options path (folders, * and ? in their names), pattern, splitBytes and failOnDataLoss."""

    @classmethod
    def name(cls) -> str:
        return "appended_lines"

    def schema(self) -> str:
        return "file string, at long, value string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return AppendedReader(self.options)


class AppendedReader(DataSourceStreamReader):
    def __init__(self, options):
        self.folder = options["path"]
        self.pattern = options.get("pattern", "*")
        self.split = int(options.get("splitBytes", SPLIT_BYTES))
        self.strict = options.get("failOnDataLoss", "true").lower() != "false"
        self.seen: dict[str, tuple] = {}

    def _files(self) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
        system, folder = fs.FileSystem.from_uri(self.folder)
        found = [f for at in _folders(system, folder) for f in system.get_file_info(fs.FileSelector(at, allow_not_found=True))]
        return system, [f for f in found if f.is_file and fnmatch.fnmatch(f.base_name, self.pattern) and not f.base_name.startswith(("_", "."))]

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Per file: `first`, the checksum of its first line, and `end`, the end of its last whole line."""
        system, files = self._files()
        offset = {}
        for info in files:
            key = (info.size, info.mtime_ns)
            known = self.seen.get(info.path)
            if known is None or known[0] != key:
                known = (key, _extent(system, info))
                self.seen[info.path] = known
            if known[1] is not None:
                offset[info.path] = {"first": known[1][0], "end": known[1][1]}
        self.seen = {path: x for path, x in self.seen.items() if path in offset}
        return offset

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        parts = []
        for path, begin in read_before(start, end).items():
            first, stop = end[path]["first"], end[path]["end"]
            for at in range(begin, stop, self.split):
                parts.append(Stretch(path, first, begin, stop, at, min(at + self.split, stop)))
        return parts

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        system, files = self._files()
        by_path = {f.path: f for f in files}
        here = by_path.pop(partition.path, None)
        for info in [*([here] if here else []), *by_path.values()]:       # renamed since the batch was planned?
            if info.size >= partition.end and _first_line(system, info.path) == partition.first:
                yield from _lines(system, info.path, partition)
                return
        if self.strict:
            raise OSError(f"{partition.path}: lines up to byte {partition.end} are in no file of the folder any more")


def read_before(start: dict, end: dict) -> dict[str, int]:
    """How much of each file in `end` was read by `start`."""
    out, moved = {}, {}
    for path, was in start.items():
        now = end.get(path)
        if now is not None and now["first"] == was["first"] and now["end"] >= was["end"]:
            out[path] = was["end"]
        else:
            moved.setdefault(was["first"], []).append(was["end"])
    for path, now in sorted(end.items()):
        if path not in out:
            places = [e for e in moved.get(now["first"], []) if path not in start and e <= now["end"]]
            out[path] = max(places, default=0)
            if places:
                moved[now["first"]].remove(out[path])
    return out


def _folders(system: fs.FileSystem, path: str) -> list[str]:
    """The folders that a path names; in names of folders * and ? stand for any characters and for one."""
    first, *names = path.split("/")
    out = [first]
    for name in names:
        if "*" in name or "?" in name:
            inside = [f for at in out for f in system.get_file_info(fs.FileSelector(at or "/", allow_not_found=True))]
            out = [f.path for f in inside if f.type == fs.FileType.Directory and fnmatch.fnmatch(f.base_name, name) and not f.base_name.startswith(("_", "."))]
        else:
            out = [f"{at}/{name}" for at in out]
    return out


def _first_line(system: fs.FileSystem, path: str) -> int | None:
    """Checksum of the first line (of its first `HEAD` bytes), None while that line is not finished."""
    try:
        with system.open_input_file(path) as file:
            head = file.read(HEAD)
    except FileNotFoundError:
        return None
    line, ended, _ = head.partition(b"\n")
    return zlib.crc32(line) if ended or len(head) == HEAD else None


def _extent(system: fs.FileSystem, info: fs.FileInfo) -> tuple[int, int] | None:
    """Checksum of the first line and the end of the last whole line; None for a file without one."""
    first = _first_line(system, info.path)
    if first is None:
        return None
    with system.open_input_file(info.path) as file:
        at = info.size
        while at > 0:
            size = min(CHUNK, at)
            file.seek(at - size)
            cut = file.read(size).rfind(b"\n")
            if cut >= 0:
                return first, at - size + cut + 1
            at -= size
    return None


def _lines(system: fs.FileSystem, path: str, part: Stretch) -> Iterator[pa.RecordBatch]:
    """The lines that begin in the part; the one that crosses its end is read whole, the one that crosses its begin is not."""
    names = ["file", "at", "value"]
    with system.open_input_file(path) as file:
        at = part.lower
        rest = b""
        if at > part.begin:                                     # a line that begins right here follows a line end
            at -= 1
        file.seek(at)
        skipping = at < part.lower
        place, starts, values = at, [], []
        while place < part.upper:
            data = file.read(min(CHUNK, part.end - place - len(rest)))
            if not data:
                raise OSError(f"{path} ends before byte {part.end}")
            *whole, rest = (rest + data).split(b"\n")
            for line in whole:
                if skipping:
                    skipping = False
                elif place < part.upper:
                    starts.append(place)
                    values.append(line.removesuffix(b"\r").decode(errors="replace"))
                place += len(line) + 1
            for k in range(0, len(values), ROWS):
                n = len(values[k:k + ROWS])
                yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(starts[k:k + ROWS], pa.int64()), pa.array(values[k:k + ROWS])], names)
            starts, values = [], []
