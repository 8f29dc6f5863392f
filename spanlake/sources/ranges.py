"""Files cut into byte ranges, in any store that Arrow can open (a plain path is local or mounted)."""

from __future__ import annotations

from collections.abc import Iterator
from fnmatch import fnmatch

import pyarrow.fs as fs

CHUNK = 1 << 20


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path.split("/", 1)[0] else (fs.LocalFileSystem(), path)


def files_below(path: str, pattern: str = "*") -> list[tuple[str, int, int]]:
    """(path, bytes, nanoseconds of its last change) of the file at ``path``, or of all below it whose name fits; hidden ones are left out."""
    store, root = store_of(path)
    info = store.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else [i for i in store.get_file_info(fs.FileSelector(root, recursive=True)) if i.is_file]
    plain = [i for i in found if info.is_file or (fnmatch(i.base_name, pattern) and i.base_name[0] not in "._")]
    head = path.split("://", 1)[0] + "://" if "://" in path else ""
    return sorted((head + i.path if head and head != "file://" else i.path, i.size, i.mtime_ns or 0) for i in plain)


def ranges_of(size: int, width: int) -> Iterator[tuple[int, int]]:
    for lo in range(0, size, width):
        yield lo, min(lo + width, size)


class Window:
    """A stretch of an open file that grows to the right and is let go on the left."""

    def __init__(self, path: str, at: int, chunk: int = CHUNK) -> None:
        store, name = store_of(path)
        self.file, self.chunk = store.open_input_file(name), chunk
        self.size, self.base, self.data = self.file.size(), at, b""

    @property
    def end(self) -> int:
        return self.base + len(self.data)

    def grow(self) -> bool:
        more = self.file.read_at(min(self.chunk, self.size - self.end), self.end) if self.end < self.size else b""
        self.data += more
        return bool(more)

    def drop(self, upto: int) -> None:
        self.data, self.base = self.data[upto - self.base :], upto

    def back(self, at: int, count: int) -> bytes:
        """The ``count`` bytes before ``at``, or those that there are."""
        return self.file.read_at(min(count, at), max(0, at - count))
