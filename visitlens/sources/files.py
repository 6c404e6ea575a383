"""Files of any store that pyarrow can open, by path or URI, for data sources that read them in parts."""

from __future__ import annotations

from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


def files_under(path: str, *endings: str) -> list[str]:
    """Paths of the files with one of the endings (case set aside): the path itself, or those in the folder, in order."""
    store, at = opened(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(at, recursive=True))
    hidden = lambda p: any(x.startswith(("_", ".")) for x in p[len(at) :].split("/"))
    return sorted(x.path for x in found if x.type == fs.FileType.File and x.path.lower().endswith(endings) and not hidden(x.path))


class Parts:
    """Byte ranges of a file of a store."""

    def __init__(self, store: fs.FileSystem, path: str):
        self.file = store.open_input_file(path)

    def at(self, offset: int, size: int) -> bytes:
        got = self.file.read_at(size, offset)
        if len(got) < size:
            raise EOFError(f"{size} bytes at {offset} of a file of {self.file.size()}")
        return got

    def size(self) -> int:
        return self.file.size()
