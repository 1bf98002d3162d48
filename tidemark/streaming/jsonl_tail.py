"""A streaming source that follows growing files of JSON lines.

An offset holds, for each file, how often it was begun anew and the bytes up to
a whole line's end, so a line that is half written is read once, when it is
whole. Files are read by tasks, one range of a file each; the driver only looks
for line breaks, in files whose size has changed.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow.fs as fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

_BACK = 1 << 16


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class JsonlTail(DataSource):
    """``spark.readStream.format("jsonl_tail").load(folder)``: (path, line) of folder/*/*.jsonl.

    ``from_start``: true reads the lines already there too; otherwise reading
    starts at the end of the files that exist. A file that appears later is read
    from its beginning, so none of its lines is lost; one that has become
    shorter was begun anew and is read again from its beginning.

    ``max_bytes``: a batch takes no more bytes than these, but one whole line at
    least. It goes on from the last offset, which a restarted query finds in
    its checkpoint, so ``checkpoint`` has to name that folder; the tail must be
    the query's only source.

    ``failOnDataLoss``: false goes on where a planned range is gone, as its file
    has been cut meanwhile; otherwise the query ends with an error.
    """

    @classmethod
    def name(cls) -> str:
        return "jsonl_tail"

    def schema(self) -> str:
        return "path string, line string"

    def streamReader(self, schema) -> TailReader:
        flag = lambda name, default: self.options.get(name, default).lower() == "true"
        most = self.options.get("max_bytes")
        if most and "checkpoint" not in self.options:
            raise ValueError("max_bytes needs the checkpoint's folder, as a restarted query goes on from its last offset")
        return TailReader(self.options["path"], flag("from_start", "false"), int(most) if most else None, self.options.get("checkpoint"), flag("failondataloss", "true"))


def _url(folder: str) -> str:
    return folder if "://" in folder else f"file://{folder}"


class TailReader(DataSourceStreamReader):
    def __init__(self, folder: str, from_start: bool, most: int | None = None, checkpoint: str | None = None, strict: bool = True):
        self.folder, self.from_start, self.most, self.checkpoint, self.strict = _url(folder), from_start, most, checkpoint and _url(checkpoint), strict
        self.last: dict[str, list[int]] | None = None
        #: Sizes at which files were looked through to their end.
        self.seen: dict[str, int] = {}

    def _files(self, store: fs.FileSystem, root: str) -> dict[str, int]:
        out = {}
        for info in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            inside = info.path[len(root.rstrip("/")) + 1 :]
            if info.type == fs.FileType.File and inside.endswith(".jsonl") and inside.count("/") == 1:
                out[info.path] = info.size
        return out

    def _further(self, start: dict[str, list[int]], most: int | None) -> dict[str, list[int]]:
        """The offset after ``start``: whole lines of up to so many bytes in all, or one longer line."""
        store, root = fs.FileSystem.from_uri(self.folder)
        end, room = dict(start), most
        for path, size in sorted(self._files(store, root).items()):
            begun, at = end.get(path, [0, 0])
            if size < at:
                begun, at = begun + 1, 0
                end[path] = [begun, 0]
                self.seen.pop(path, None)
            if size == at or self.seen.get(path) == size or room == 0:
                continue
            whole = room is None or at + room >= size
            with store.open_input_file(path) as file:
                to = self._break_before(file, at, size if whole else at + room)
                if to == at and not whole and room == most:
                    to = self._break_after(file, at + room, size)
                    whole, to = to is None, to or at
            self.seen[path] = size if whole else -1
            if to > at:
                end[path] = [begun, to]
                room = room if room is None else max(0, room - (to - at))
        return end

    def _break_before(self, file, least: int, end: int) -> int:
        """The place after the last line break before ``end``; ``least`` if there is none behind it."""
        while end > least:
            begin = max(least, end - _BACK)
            file.seek(begin)
            at = file.read(end - begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            end = begin
        return least

    def _break_after(self, file, begin: int, size: int) -> int | None:
        """The place after the first line break from ``begin`` on."""
        while begin < size:
            file.seek(begin)
            chunk = file.read(min(_BACK, size - begin))
            if b"\n" in chunk:
                return begin + chunk.index(b"\n") + 1
            if not chunk:
                return None
            begin += len(chunk)
        return None

    def _logged(self) -> dict[str, list[int]] | None:
        """The last offset that the checkpoint has."""
        store, root = fs.FileSystem.from_uri(self.checkpoint)
        found = store.get_file_info(fs.FileSelector(f"{root}/offsets", allow_not_found=True))
        numbered = {int(f.base_name): f.path for f in found if f.base_name.isdigit()}
        if not numbered:
            return None
        with store.open_input_stream(numbered[max(numbered)]) as file:
            return json.loads(file.read().decode().strip().split("\n")[-1])

    def initialOffset(self) -> dict:
        self.last = {} if self.from_start else self._further({}, None)
        return self.last

    def latestOffset(self) -> dict:
        if self.last is None:
            self.last = (self._logged() if self.checkpoint else None) or {}
        self.last = self._further(self.last, self.most)
        return self.last

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for path, (begun, to) in sorted(end.items()):
            before, at = start.get(path, [0, 0])
            at = 0 if begun > before else at
            if to > at:
                out.append(Range(path, at, to))
        return out

    def read(self, partition: Range) -> Iterator[tuple[str, str]]:
        store, _ = fs.FileSystem.from_uri(self.folder)
        with store.open_input_file(partition.path) as file:
            left, rest = partition.end - partition.start, b""
            if file.size() >= partition.start:
                file.seek(partition.start)
            while left:
                chunk = file.read(min(left, 1 << 20)) if file.tell() >= partition.start else b""
                if not chunk:
                    if self.strict:
                        raise OSError(f"{partition.path} has become shorter than the {partition.end} bytes it had; set failOnDataLoss to false to go on without its lost lines")
                    return
                left -= len(chunk)
                *lines, rest = (rest + chunk).split(b"\n")
                for line in lines:
                    yield partition.path, line.decode("utf-8", "replace")
