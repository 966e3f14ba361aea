"""Files in the shared folder, opened from tasks by ranges."""

from __future__ import annotations

from pyarrow import fs


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or absolute path, and the path in it."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


class Ranges:
    """Reads byte ranges of one file."""

    def __init__(self, uri: str):
        system, path = located(uri)
        self._file = system.open_input_file(path)
        self.size = self._file.size()

    def read(self, start: int, length: int) -> bytes:
        data = self._file.read_at(length, start)
        if len(data) != length:
            raise ValueError(f"file ends within the range {start}..{start + length}")
        return data

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self._file.close()
