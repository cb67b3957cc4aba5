"""Files in the shared store, read by ranges."""

from __future__ import annotations

from pyarrow import fs


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it; without a scheme it is a local one."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


class Ranged:
    """A file of which only the asked ranges are read."""

    def __init__(self, path: str):
        system, at = located(path)
        self.file = system.open_input_file(at)
        self.size = self.file.size()

    def read(self, start: int, n: int) -> bytes:
        """Exactly ``n`` bytes from ``start`` on."""
        if start < 0 or n < 0 or start + n > self.size:
            raise ValueError(f"range {start}+{n} of a file of {self.size} bytes")
        out = self.file.read_at(n, start)
        if len(out) != n:
            raise ValueError(f"range {start}+{n} ended after {len(out)} bytes")
        return out

    def __enter__(self) -> "Ranged":
        return self

    def __exit__(self, *_) -> None:
        self.file.close()
