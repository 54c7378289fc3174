"""Streaming source that follows growing text files, byte range by byte range.

Files are read through ``pyarrow.fs``: a plain path, or a URI of any store that it knows (``file:``, ``s3:``, ``gs:``, ``hdfs:``,
``abfs:``). Object stores have no inodes, so a file is known by its first bytes and by those just before the position reached: at its
own path if these agree, else at any other path of the pattern where they do (a file renamed by log rotation). A file that shrank,
begins otherwise, or has other bytes before the position is another one and starts at 0. Two files that agree in all of
that are told apart by their paths alone. A listing reads only files whose size or time changed since the last one, or which are behind.

A line is delivered once its newline has been written, byte for byte. The limit of a batch holds from the first one on: at a restart
the committed positions are read from the offset log of the query's checkpoint, where that folder is given.
"""

from __future__ import annotations

import fnmatch
import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

BLOCK = 1 << 20
DEFAULT_RANGE = 64 << 20
#: Bytes at the start, and before the position, that tell a file from another.
KNOWN = 1024


@dataclass
class ByteRange(InputPartition):
    """The lines that begin in [first, last) of a file whose complete lines lie in [begin, end)."""

    store: str
    path: str
    known: dict
    begin: int
    end: int
    first: int
    last: int


def store_of(pattern: str) -> tuple[str, fs.FileSystem, str]:
    """(root URI, file system, pattern inside of it) of a path or URI; the root is what executors open it by."""
    scheme = re.match(r"([a-zA-Z][a-zA-Z0-9+.-]*):", pattern)
    if scheme is None:
        return "", fs.LocalFileSystem(), pattern
    if scheme[1] == "file":
        return "", fs.LocalFileSystem(), re.sub(r"^file:(//)?(?=/)", "", pattern)
    root = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://[^/*?\[]*", pattern)
    if root is None:
        raise ValueError(f"not a path and not a URI: {pattern}")
    try:
        system, base = fs.FileSystem.from_uri(root[0])
    except (pa.ArrowInvalid, OSError) as error:
        raise ValueError(f"no file system for {pattern}: {error}") from error
    return root[0], system, f"{base.rstrip('/')}/{pattern[len(root[0]) :].lstrip('/')}" if base else pattern[len(root[0]) :]


def _system(store: str) -> fs.FileSystem:
    return fs.FileSystem.from_uri(store)[0] if store else fs.LocalFileSystem()


def _folder_of(pattern: str) -> str:
    """The deepest folder before the first wildcard."""
    fixed = re.split(r"[*?\[]", pattern, maxsplit=1)[0]
    return fixed.rsplit("/", 1)[0] if "/" in fixed else "."


def listed(system: fs.FileSystem, pattern: str) -> list[fs.FileInfo]:
    """The files of a path or pattern, by name. A pattern is matched folder by folder."""
    if not re.search(r"[*?\[]", pattern):
        info = system.get_file_info(pattern)
        return [info] if info.type == fs.FileType.File else []
    below = pattern[len(_folder_of(pattern)) :].strip("/").count("/") > 0
    selector = fs.FileSelector(_folder_of(pattern), recursive=below, allow_not_found=True)
    own = pattern if "/" in pattern else f"./{pattern}"
    wanted = re.compile("/".join(fnmatch.translate(p).replace("(?s:", "(?s:(?!\\.)" if p[0] in "*?[" else "(?s:").removesuffix("\\Z").removesuffix("\\z")
                                 .replace(".*", "[^/]*") for p in own.split("/") if p))
    found = [i for i in system.get_file_info(selector) if i.type == fs.FileType.File and wanted.fullmatch(i.path.lstrip("/"))]
    return sorted(found, key=lambda i: i.path)


def _digest(data: bytes) -> str:
    return hashlib.md5(data, usedforsecurity=False).hexdigest()


class _File:
    """A file opened for reads of ranges."""

    def __init__(self, system: fs.FileSystem, path: str):
        self.path, self.file = path, system.open_input_file(path)

    def __enter__(self) -> _File:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def size(self) -> int:
        return self.file.size()

    def read(self, begin: int, end: int) -> bytes:
        return self.file.read_at(max(0, end - begin), begin)

    def last_line_end(self, begin: int, limit: int) -> int:
        """Position after the last newline in [begin, limit); ``begin`` if there is none."""
        stop = limit
        while stop > begin:
            start = max(begin, stop - BLOCK)
            at = self.read(start, stop).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            stop = start
        return begin

    def after_line(self, position: int, limit: int) -> int:
        """Position after the line that holds the byte before ``position``."""
        at = position - 1
        while at < limit:
            data = self.read(at, min(at + BLOCK, limit))
            cut = data.find(b"\n")
            if cut >= 0:
                return at + cut + 1
            at += len(data)
        return limit

    def known(self, position: int) -> dict:
        """What the file is known by once it has been read up to ``position``."""
        head = min(position, KNOWN)
        return {"pos": position, "head": _digest(self.read(0, head)), "tail": _digest(self.read(position - head, position))}

    def is_known(self, known: dict, size: int) -> bool:
        """Whether this is the file that was read up to a position; a file of which nothing was read is as good as new."""
        return 0 < known["pos"] <= size and self.known(known["pos"]) == {k: known[k] for k in ("pos", "head", "tail")}


def _as_lines(block: bytes) -> pa.Array:
    """The lines of a block that ends with a newline, as they are: the bytes are not looked into."""
    codes = np.frombuffer(block, np.uint8)
    ends = np.flatnonzero(codes == 10)
    offsets = np.concatenate([[0], ends - np.arange(len(ends))]).astype(np.int32)
    data = np.delete(codes, ends).tobytes()
    return pa.StringArray.from_buffers(len(ends), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data))


def _opened(system: fs.FileSystem, path: str, known: dict) -> _File:
    """The file that ``known`` describes: at its path, or where it was renamed to since the batch was planned."""
    folder = path.rsplit("/", 1)[0] if "/" in path else "."
    others = (i.path for i in system.get_file_info(fs.FileSelector(folder)) if i.type == fs.FileType.File and i.size >= known["pos"])
    for at in [path, *sorted(others)]:
        try:
            file = _File(system, at)
        except FileNotFoundError:
            continue
        if file.is_known(known, file.size()):
            return file
        file.__exit__()
    raise FileNotFoundError(f"{path} is gone before its lines were read")


def read_lines(part: ByteRange) -> Iterator[pa.Array]:
    """Blocks of lines of one byte range, without their newlines."""
    with _opened(_system(part.store), part.path, part.known) as f:
        start = part.begin if part.first == part.begin else f.after_line(part.first, part.end)
        stop = part.end if part.last == part.end else f.after_line(part.last, part.end)
        rest = b""
        while start < stop:
            data = f.read(start, min(start + BLOCK, stop))
            if not data:
                raise OSError(f"{part.path} ended before byte {part.end}")
            start += len(data)
            cut = data.rfind(b"\n") + 1
            if cut:
                yield _as_lines(rest + data[:cut])
                rest = data[cut:]
            else:
                rest += data


def committed_offset(checkpoint: str, source: int = 0) -> dict | None:
    """The offset up to which a query's batches are done or planned, from the newest entry of its offset log; None if there is none."""
    _, system, folder = store_of(checkpoint)
    selector = fs.FileSelector(f"{folder.rstrip('/')}/offsets", allow_not_found=True)
    numbers = [int(i.base_name) for i in system.get_file_info(selector) if i.base_name.isdigit()]
    if not numbers:
        return None
    with system.open_input_file(f"{selector.base_dir}/{max(numbers)}") as f:
        entries = f.read().decode().split("\n")[2:]  # a version and the metadata of the batch come first
    return json.loads(entries[source]) if len(entries) > source and entries[source] != "-" else None


class TailReader(DataSourceStreamReader):
    """Offsets are ``{path: {"pos": ..., "head": ..., "tail": ...}}``; a position is always the start of a line."""

    def __init__(self, options: dict):
        self.store, self.system, self.pattern = store_of(options["path"])
        self.range = int(options.get("maxBytesPerPartition", DEFAULT_RANGE))
        limit = options.get("maxBytesPerBatch")
        self.limit = None if limit is None else int(limit)
        self.seen: dict | None = None
        self.unchanged: dict[str, tuple] = {}
        checkpoint = options.get("checkpoint")
        if checkpoint is not None:
            self.seen = committed_offset(checkpoint)

    def initialOffset(self) -> dict:
        self.seen = {}
        return {}

    def latestOffset(self) -> dict:
        """The complete lines of all files, within the limit of a batch.

        Without a checkpoint to read from, the first batch after a restart has no limit, as its start is not known here.
        """
        budget = None if self.seen is None else self.limit
        before, offset, states = self.seen or {}, {}, {}
        infos = listed(self.system, self.pattern)
        moved = self._moved(before, infos)
        for info in infos:
            state = (info.size, info.mtime_ns)
            known = moved.get(info.path)
            if known is not None and self.unchanged.get(info.path) == (*state, known["pos"]):
                offset[info.path] = known
                states[info.path] = self.unchanged[info.path]
                continue
            try:
                with _File(self.system, info.path) as f:
                    size = f.size()
                    begin = known["pos"] if known is not None else 0
                    whole = f.last_line_end(begin, size)
                    end = whole
                    if budget is not None:
                        end = self._within(f, begin, whole, budget) if whole - begin > budget else whole
                        budget = max(0, budget - (end - begin))
                    offset[info.path] = f.known(end)
            except FileNotFoundError:  # rotated away since it was listed
                continue
            if end == whole:
                states[info.path] = (*state, end)
        self.unchanged = states
        self.seen = offset
        return offset

    def _moved(self, before: dict, infos: list[fs.FileInfo]) -> dict[str, dict]:
        """For each listed path what is known of the file that is there now: one known at the path, else one known at another."""
        found: dict[str, dict] = {}
        rest = dict(before)
        strangers = []
        for info in infos:
            known = before.get(info.path)
            if known is not None and self.unchanged.get(info.path) == (info.size, info.mtime_ns, known["pos"]):
                found[info.path] = rest.pop(info.path)
            elif known is not None and self._same(info, known):
                found[info.path] = rest.pop(info.path)
            else:
                strangers.append(info)
        for info in strangers if rest else []:
            path = next((p for p, known in rest.items() if self._same(info, known)), None)
            if path is not None:
                found[info.path] = rest.pop(path)
        return found

    def _same(self, info: fs.FileInfo, known: dict) -> bool:
        try:
            with _File(self.system, info.path) as f:
                return f.is_known(known, f.size())
        except FileNotFoundError:
            return False

    @staticmethod
    def _within(f: _File, begin: int, end: int, budget: int) -> int:
        """The last line end within the budget; a line longer than the budget goes alone."""
        if budget == 0:
            return begin
        stop = f.last_line_end(begin, begin + budget)
        return stop if stop > begin else f.after_line(begin + 1, end)

    def partitions(self, start: dict, end: dict) -> list[ByteRange]:
        self.seen = end
        parts = []
        for path, now in end.items():
            begin = self._begin(path, now, start)
            for first in range(begin, now["pos"], self.range):
                last = min(first + self.range, now["pos"])
                parts.append(ByteRange(self.store, path, now, begin, now["pos"], first, last))
        return parts

    def _begin(self, path: str, now: dict, start: dict) -> int:
        """Where the file of an end offset goes on: the position of the start offset that is of the same file, or 0."""
        known = start.get(path)
        if known == now:
            return now["pos"]
        candidates = [v for p, v in start.items() if 0 < v["pos"] <= now["pos"]]
        candidates.sort(key=lambda v: v is not known)
        if not candidates:
            return 0
        try:
            with _opened(self.system, path, now) as f:
                return next((v["pos"] for v in candidates if f.is_known(v, now["pos"])), 0)
        except FileNotFoundError:  # the batch fails when it reads, unless it has read all of the file before
            return min(known["pos"], now["pos"]) if known else 0

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        for lines in read_lines(partition):
            yield pa.RecordBatch.from_arrays([lines], names=["value"])

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    """Options: ``path`` (a file or glob), ``maxBytesPerPartition``, ``maxBytesPerBatch``, ``checkpoint``."""

    @classmethod
    def name(cls) -> str:
        return "loglark_tail"

    def schema(self) -> str:
        return "value string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


def stream_tail(
    spark: SparkSession,
    path: str,
    max_bytes: int | None = None,
    range_bytes: int | None = None,
    checkpoint: str | None = None,
) -> DataFrame:
    """Stream of the lines appended to the files of ``path``, which need not exist yet.

    Give the query's ``checkpoint`` folder along with ``max_bytes``: the limit then holds for the first batch after a restart too.
    """
    store_of(path)  # an error now rather than in the query
    spark.dataSource.register(TailSource)
    reader = spark.readStream.format(TailSource.name()).option("path", path)
    if max_bytes is not None:
        reader = reader.option("maxBytesPerBatch", max_bytes)
    if range_bytes is not None:
        reader = reader.option("maxBytesPerPartition", range_bytes)
    if checkpoint is not None:
        reader = reader.option("checkpoint", checkpoint)
    return reader.load()
